"""Time-series rollup: one aggregate with Catalyst's partial and final phases, dimension join, target encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.nulls import biased_mean, biased_std, clean


def rollup(df: DataFrame, keys: list[str], means: list[str], stds: list[str] = (), firsts: list[str] = (), order: str | None = None) -> DataFrame:
    """Means over all rows of a group (nulls count as 0), population deviations, first non-null values.

    Rows with a null key are dropped; columns that df lacks are left out. first is by `order` where given, else any
    non-null value (for columns that a key fixes).
    """
    has = set(df.columns)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [biased_mean(c).alias(c) for c in means if c in has]
    aggs += [biased_std(c).alias(f"{c}_std") for c in stds if c in has]
    for c in firsts:
        if c in has:
            first = F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.first(c, ignorenulls=True)
            aggs.append(first.alias(c))
    return df.dropna(subset=keys).groupBy(*keys).agg(*aggs)


def with_dimension(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join; Spark broadcasts the dimension itself while it is under its size threshold."""
    return fact.join(dimension, key, "left")


def target_encode(train: DataFrame, rows: DataFrame, key: str, target: str, name: str, fill: float = 0.0) -> DataFrame:
    """Adds the training rows' mean of the target by key (unweighted over rows); unseen keys take `fill`."""
    means = train.groupBy(key).agg(F.avg(clean(target)).alias(name))
    return rows.join(means, key, "left").withColumn(name, F.coalesce(name, F.lit(fill)))


def mean_absolute_error(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(truth) - F.col(prediction))).alias("mae"), F.count(F.lit(1)).alias("n"))
