"""Packing snippets into a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.8


def budget_chars(tokens: int) -> int:
    return int(tokens * CHARS_PER_TOKEN)


def pack_prefix(df: DataFrame, by: list[str], order: list, size: str, budget: int) -> DataFrame:
    """The rows before the first that doesn't fit."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def pack_prefix_with_substitute(df: DataFrame, by: list[str], order: list, size: str, substitute: str, budget: int, least: int = 200) -> DataFrame:
    """As pack_prefix; the first row that doesn't fit enters by its substitute's size if over `least` are left and that is less.

    Adds size_used and substituted.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumn("used", F.sum(size).over(w)).withColumn("left", F.lit(budget) - (F.col("used") - F.col(size)))
    first = (F.col("used") > budget) & (F.col("left") >= 0)
    over = F.sum((F.col("used") > budget).cast("int")).over(w)
    swapped = first & (over == 1) & (F.col("left") > least) & (F.col(substitute) < F.col("left"))
    out = run.withColumn("substituted", swapped).where((F.col("used") <= budget) | F.col("substituted"))
    return out.withColumn("size_used", F.when(F.col("substituted"), F.col(substitute)).otherwise(F.col(size))).drop("left")


def packed_array(entries: Column, budget: int) -> Column:
    """Greedy fold over an ordered array of structs with a field `size`: what doesn't fit is skipped."""
    kind = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("i"))

    def step(state, e):
        fits = state["used"] + e["size"] <= budget
        return F.struct(
            (state["used"] + F.when(fits, e["size"]).otherwise(0)).cast("long").alias("used"),
            F.when(fits, F.concat(state["kept"], F.array(state["i"]))).otherwise(state["kept"]).alias("kept"),
            (state["i"] + 1).alias("i"),
        )

    return F.aggregate(entries, kind, step)["kept"]


def pack_skip(df: DataFrame, by: list[str], order: list[str], columns: list[str], size: str, budget: int) -> DataFrame:
    """The rows that a greedy pass in the given ascending order admits, those that don't fit being skipped; ties go by size, then a hash of the columns.

    Rows over the budget go first. The fold runs over (order, size) of what is left, and columns that aren't in the order
    are joined to the few admitted rows, so texts are in no array.
    """
    more = [c for c in dict.fromkeys(columns) if c not in order and c not in by]
    fits = df.where(F.col(size) <= budget).select(*by, *order, *more, F.col(size).cast("long").alias("__size"))
    fits = fits.withColumn("__h", F.xxhash64(*more) if more else F.lit(0).cast("long"))
    one = F.struct(*order, F.col("__size").alias("size"), F.col("__h").alias("h"))
    grouped = fits.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("entries"))
    kept = F.transform(packed_array(F.col("entries"), budget), lambda i: F.element_at("entries", i + 1))
    admitted = grouped.select(*by, F.posexplode(kept).alias("pos", "e")).select(*by, "pos", "e.*")
    out = [*by, "pos", *order, *more, "size"]
    if not more:
        return admitted.select(*out)
    keys = [*by, *order, "__size", "__h"]
    texts = fits.dropDuplicates(keys).select(*(F.col(k).alias(f"__t{i}") for i, k in enumerate(keys)), *more)
    same = [admitted[k].eqNullSafe(F.col(f"__t{i}")) for i, k in enumerate([*by, *order, "size", "h"])]
    return admitted.join(texts, same).select(*out)


def compose(df: DataFrame, by: list[str], order: list[str], text: str, glue: str = "") -> DataFrame:
    """The texts of a group joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["__text"]), glue).alias("context"))


def context_summary(df: DataFrame, context: str = "context") -> DataFrame:
    chars = F.sum(F.length(context))
    return df.agg(F.count(F.lit(1)).alias("n"), chars.alias("chars"), (chars / F.lit(CHARS_PER_TOKEN)).alias("tokens"))
