"""Deterministic splits: by groups, by rows, pseudo-random picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_split(df: DataFrame, group: str, splits: int = 3, share: float = 0.2, seed: int = 42) -> DataFrame:
    """(group, fold, is_val): ceil(share * groups) groups are for validation in each of the splits, by md5 order.

    A group's rank is the count of those with a lesser md5 beginning (4096 of them) and its rank among those with its own.
    """
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    rows = groups.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("fold").cast("string"), F.col(group).cast("string")))
    rows = rows.withColumn("__md5", order).withColumn("__head", F.substring("__md5", 1, 3))
    heads = rows.groupBy("fold", "__head").agg(F.count(F.lit(1)).alias("__n"))
    fold = Window.partitionBy("fold")
    less = F.coalesce(F.sum("__n").over(fold.orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("fold", "__head", less.alias("__less"), F.sum("__n").over(fold).alias("__all"))
    rank = F.row_number().over(Window.partitionBy("fold", "__head").orderBy("__md5", group))
    ranked = rows.withColumn("__rank", rank).join(F.broadcast(heads), ["fold", "__head"])  # at most 4096 rows a split
    return ranked.select(group, "fold", (F.col("__rank") + F.col("__less") <= F.ceil(F.lit(share) * F.col("__all"))).alias("is_val"))


def row_split(df: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds is_val by an md5 of the key: no shuffle."""
    part = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.withColumn("is_val", part < F.lit(int(share * (1 << 32))))


def pick(df: DataFrame, by: str, path: str, seed: int = 42) -> DataFrame:
    """One path of each group, by the least md5 of seed and path."""
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(path).cast("string")))
    return df.groupBy(by).agg(F.min_by(path, order).alias(path))
