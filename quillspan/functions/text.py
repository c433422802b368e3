"""Tokenisers and line tools as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_TOKEN = r"[a-zA-Z_][\p{L}\p{N}_]*"
#: The part of a file next to the cursor, in characters, and how often its tokens count.
CURSOR, CURSOR_WEIGHT = 500, 3


def code_tokens(c: str | Column) -> Column:
    """Identifiers of the lower-cased text; a token may begin within a word, after a letter outside ASCII."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(CODE_TOKEN), F.lit(0))


def symbol_tokens(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CODE_TOKEN), F.lit(0))


def alnum_tokens(c: str | Column) -> Column:
    """Lower-cased letters and digits; all else, `_` too, divides."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", " "), " +"), lambda t: t != "")


def cursor_query(prefix: str, suffix: str) -> Column:
    """Tokens next to the cursor three times, the far prefix once; the far suffix is dropped."""
    p, s = F.coalesce(F.col(prefix), F.lit("")), F.coalesce(F.col(suffix), F.lit(""))
    near = F.concat(F.right(p, F.lit(CURSOR)), F.lit(" "), F.substring(s, 1, CURSOR))
    far = F.substring(p, F.lit(1), F.greatest(F.length(p) - CURSOR, F.lit(0)))
    return F.concat(F.flatten(F.array_repeat(code_tokens(near), CURSOR_WEIGHT)), code_tokens(far))


def last_lines(c: str, n: int) -> Column:
    lines = F.split(F.col(c), "\n")
    return F.array_join(F.slice(lines, -F.least(F.size(lines), F.lit(n)), F.lit(n)), "\n")


def first_lines(c: str, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.col(c), "\n"), 1, n), "\n")


def snippet(path: str, content: str, header: str = "<|file_sep|>") -> Column:
    return F.concat(F.lit(header), F.col(path), F.lit("\n"), F.col(content))


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's too."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def import_lines(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, line_no, module, level (leading dots), names: `from x import a, b as c` and `import x, y` by pattern, a row per module."""
    lines = df.select(*key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).withColumn("line", strip(F.col("line")))
    dotted = r"^from\s+(\.*)(\S*)\s+import\s+(.+)"
    plain = r"^import\s+(.+)"
    bare = lambda x: F.regexp_extract(F.trim(x), r"^(\S+)", 1)  # noqa: E731  drops ` as name`
    listed = lambda c: F.filter(F.transform(F.split(F.regexp_replace(c, r"[()]", ""), ","), bare), lambda x: x != "")
    kept = lines.where(F.col("line").rlike(r"^(from\s+\.*\S*\s+import\s+.+|import\s+.+)"))
    a = F.array(F.struct(F.regexp_extract("line", dotted, 2).alias("module"), F.length(F.regexp_extract("line", dotted, 1)).alias("level"), listed(F.regexp_extract("line", dotted, 3)).alias("names")))
    b = F.transform(listed(F.regexp_extract("line", plain, 1)), lambda m: F.struct(m.alias("module"), F.lit(0).alias("level"), F.array().cast("array<string>").alias("names")))
    return kept.withColumn("m", F.explode(F.when(F.col("line").startswith("from"), a).otherwise(b))).select(*key, "line_no", "m.module", "m.level", "m.names")
