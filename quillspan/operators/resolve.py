"""Import and path resolution against repository files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidate_paths(module: Column, level: Column, path: Column) -> Column:
    """`a/b.py`, `a/b/__init__.py` for a dotted module; a relative one starts at the file's folder, a level up for each dot more."""
    folder = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1 - F.greatest(level - 1, F.lit(0)), F.lit(0)))
    parts = F.filter(F.split(module, r"\."), lambda x: x != "")
    full = F.when(level > 0, F.concat(folder, parts)).otherwise(parts)
    stem = F.array_join(full, "/")
    return F.array(F.concat(stem, F.lit(".py")), F.concat(F.when(stem == "", "").otherwise(F.concat(stem, F.lit("/"))), F.lit("__init__.py")))


def resolve(wanted: DataFrame, files: DataFrame, by: list[str], key: list[str], candidates: str = "candidates") -> DataFrame:
    """(by, key, path): the first candidate that is a file, else the first file (by candidate, then scan order) that ends with one.

    files: by, path, ord. The suffix join is an equi-join: files are exploded into their path suffixes of the lengths
    that candidates have, so it's no theta join; a suffix need not begin at a folder.
    """
    asked = wanted.select(*by, *key, F.posexplode(candidates).alias("cand_ord", "cand")).where(F.col("cand") != "")
    exact = asked.join(files.select(*by, F.col("path"), F.col("path").alias("cand"), "ord"), [*by, "cand"])
    best = F.min(F.struct("cand_ord", "ord", "path")).alias("b")
    hit = exact.groupBy(*by, *key).agg(best).select(*by, *key, F.col("b.path").alias("path"), F.lit("exact").alias("how"))
    rest = asked.join(hit.select(*by, *key), [*by, *key], "left_anti")
    lengths = rest.select(*by, F.length("cand").alias("len")).distinct()
    tails = files.join(lengths, by).where(F.length("path") >= F.col("len")).select(*by, "path", "ord", F.expr("right(path, len)").alias("cand"))
    suffix = rest.join(tails, [*by, "cand"]).groupBy(*by, *key).agg(best).select(*by, *key, F.col("b.path").alias("path"), F.lit("suffix").alias("how"))
    return hit.unionByName(suffix)


def first_seen(df: DataFrame, by: list[str], item: str, order: str) -> DataFrame:
    """Distinct items in the order of their first place."""
    first = df.groupBy(*by, item).agg(F.min(order).alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("first", item)))


def containing(names: DataFrame, texts: DataFrame, by: list[str], name: str, text: str, before: str = "class ") -> DataFrame:
    """Pairs in a group where the text holds before + name (a plain substring)."""
    return names.join(texts, by).where(F.contains(F.col(text), F.concat(F.lit(before), F.col(name))))
