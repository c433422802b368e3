"""Readers: tables, CSV with a schema, JSON lines, OBO stanzas, repository trees, image registries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXTENSIONS = {"python": ".py", "kotlin": ".kt"}
POINTS = "repo string, revision string, path string, prefix string, suffix string, modified array<string>"
TELEMETRY = "deviceId string, timedate string, period string, x1 double, x2 double, x3 double, deviceType double, " + ", ".join(f"t{i} double" for i in range(1, 14))


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parquet_columns(spark: SparkSession, path: str) -> list[str]:
    """The column order of a template; only footers are read."""
    return spark.read.parquet(path).columns


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header and an explicit schema; NaN and the usual missing tokens become null in numeric columns."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("nullValue", "").csv(path)
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    return df.select(*(F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in doubles else F.col(c) for c in df.columns))


def registry(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Rows of a registry with the given split; an empty one raises."""
    df = spark.read.option("header", True).schema("record_id string, png_path string, split string").csv(path).where(F.col("split") == split)
    if df.isEmpty():
        raise ValueError(f"the registry has no rows of split {split!r}")
    return df


def json_lines(spark: SparkSession, path: str, schema: str = POINTS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def class_columns(columns: list[str], prefix: str = "class_", drop: str = "class_0") -> list[str]:
    """Columns with the prefix in the order of their numbers."""
    found = [c for c in columns if re.fullmatch(rf"{prefix}\d+", c) and c != drop]
    return sorted(found, key=lambda c: int(c.removeprefix(prefix)))


def wide_to_long(df: DataFrame, key: list[str], columns: list[str], name: str = "class_id", value: str = "label") -> DataFrame:
    return df.unpivot(key, columns, name, value)


def long_to_wide(df: DataFrame, key: str, columns: list[str], name: str = "class_id", value: str = "label", constant: dict | None = None) -> DataFrame:
    """Pivot at the sink; the columns are given, so no pass is made to find them."""
    out = df.groupBy(key).pivot(name, columns).agg(F.first(value))
    for c, v in (constant or {}).items():
        out = out.withColumn(c, F.lit(v))
    return out


def obo_edges(lines: DataFrame, file: str = "file", pos: str = "pos", line: str = "line", prefix: str = "class_") -> DataFrame:
    """(child, parent, pos) of numbered lines: `id: <prefix>...` sets the current class, `is_a: <prefix>...` gives it a parent.

    The class carries over stanzas of other ids; what follows the parent's id on its line stays part of it.
    """
    text = F.trim(F.col(line))
    own = F.when(text.startswith(f"id: {prefix}"), F.trim(F.substring(text, F.lit(4), F.length(text))))
    w = Window.partitionBy(file).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    current = lines.withColumn("child", F.last(own, ignorenulls=True).over(w))
    parents = current.where(text.startswith(f"is_a: {prefix}") & F.col("child").isNotNull())
    return parents.select("child", F.trim(F.substring(text, F.lit(6), F.length(text))).alias("parent"), pos)


def obo(spark: SparkSession, path: str, prefix: str = "class_") -> DataFrame:
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return obo_edges(whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")), prefix=prefix)


def repository(spark: SparkSession, root: str, language: str = "python", strict: bool = False, least_lines: int = 0) -> DataFrame:
    """(path, content) of a tree's files by language, paths relative to the root, CRLF as LF.

    strict: files that aren't UTF-8 are left out, else bad bytes are replaced.
    """
    if language not in EXTENSIONS:
        raise ValueError(f"unknown language {language!r}")

    @F.pandas_udf("string")
    def decoded(data: pd.Series) -> pd.Series:
        def one(b: bytes) -> str | None:
            try:
                text = b.decode("utf-8") if strict else b.decode("utf-8", "replace")
            except UnicodeDecodeError:
                return None
            return text.replace("\r\n", "\n").replace("\r", "\n")

        return data.map(one)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{EXTENSIONS[language]}").load(root)
    base = re.sub(r"^\w+:/*", "/", root.rstrip("/")) + "/"
    path = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + re.escape(base), "")
    out = files.select(path.alias("path"), decoded("content").alias("content")).where("content is not null")
    ends = F.regexp_count("content", F.lit(r"\r\n|\r|\n"))
    open_line = F.col("content").rlike(r"[^\r\n]\z").cast("int")  # an end of line at the end opens no other line
    return out.where(ends + open_line >= least_lines) if least_lines else out


def archives(spark: SparkSession, root: str, extension: str = ".py") -> DataFrame:
    """(archive, path, content, error) of the files with the extension in zip archives, those within archives too."""

    def unpack(frames):
        import io
        import zipfile

        def walk(data: bytes, prefix: str):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for name in sorted(n for n in z.namelist() if not n.endswith("/")):
                    if name.endswith(".zip"):
                        yield from walk(z.read(name), f"{prefix}{name.removesuffix('.zip')}/")
                    elif name.endswith(extension):
                        yield prefix + name, z.read(name).decode("utf-8", "replace").replace("\r\n", "\n")

        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(path, p, c, None) for p, c in walk(data, "")]
                except (zipfile.BadZipFile, RuntimeError) as e:
                    rows = [(path, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["archive", "path", "content", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    return files.select("path", "content").mapInPandas(unpack, "archive string, path string, content string, error string")


def repository_folder(repo: str | F.Column, revision: str | F.Column) -> F.Column:
    return F.concat(F.regexp_replace(repo, "/", "__"), F.lit("-"), F.col(revision) if isinstance(revision, str) else revision)


def images(spark: SparkSession, registry_rows: DataFrame, root: str) -> DataFrame:
    """(record_id, image array<array<int>>, error) of the registry's PNG files; a file that can't be read gives an error."""
    from quillspan.functions.raster import read_png

    @F.pandas_udf("struct<image:array<array<int>>,error:string>")
    def decoded(data: pd.Series) -> pd.DataFrame:
        rows = []
        for b in data:
            try:
                rows.append((read_png(b).astype(int).tolist(), None))
            except Exception as e:  # one bad image doesn't end the job; the row says what was wrong
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["image", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(root)
    named = registry_rows.withColumn("__tail", F.element_at(F.split("png_path", "/"), -1))
    joined = named.join(files.withColumn("__tail", F.element_at(F.split("path", "/"), -1)), "__tail")
    return joined.where(F.col("path").endswith(F.col("png_path"))).select("record_id", decoded("content").alias("d")).select("record_id", "d.image", "d.error")


def missing_outputs(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do."""
    return wanted.join(done.select(key), key, "left_anti")


def threshold_override(spark: SparkSession, path: str, default: float) -> float:
    """A number in a side file, if there is one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return default
    return float(spark.read.text(path).first()[0].strip())
