"""Writers: template-ordered Parquet, sorted CSV, JSON lines without nulls, option-made names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet_like(df: DataFrame, template: list[str], path: str, mode: str = "overwrite") -> None:
    df.select(*template).write.mode(mode).parquet(path)


def sorted_csv(df: DataFrame, order: list[str], path: str, mode: str = "overwrite") -> None:
    """Sorted within and across the part files, with a header in each."""
    df.orderBy(*order).write.mode(mode).option("header", True).csv(path)


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Null fields are left out."""
    df.write.mode(mode).option("ignoreNullFields", True).json(path)


def output_name(stage: str, language: str, strategy: str, suffix: str = "jsonl") -> str:
    return "-".join([language, stage, strategy]) + f".{suffix}"


def lead_signals(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(record_id, lead, signal array<float>)."""
    df.select("record_id", "lead", F.col("signal").cast("array<float>").alias("signal")).write.mode(mode).parquet(path)


def outcome_counts(df: DataFrame, error: str = "error") -> DataFrame:
    """How many records went well, and how many didn't."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(error).isNull().cast("long")).alias("n_ok"), F.sum(F.col(error).isNotNull().cast("long")).alias("n_failed"))
