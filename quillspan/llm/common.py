"""Shared parts: the folder all executors see, tables that cut lineage, words, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters of the contracts; everything else in ASCII separates words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_table = bytearray(range(256))
for _c in range(0x80):
    if 0x41 <= _c <= 0x5A:
        _table[_c] = _c + 32
    elif not (0x30 <= _c <= 0x39 or 0x61 <= _c <= 0x7A):
        _table[_c] = 0x20
#: Maps A-Z to a-z and every ASCII separator to a space; UTF-8 bytes of other characters stay.
FOLD = bytes(_table)


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text as UTF-8 bytes; a null text has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def without(keep: list[str], added: list[str]) -> list[str]:
    """The columns to keep: those that bear the name of an added column (in any case) give way to it."""
    taken = {a.lower() for a in added}
    return [c for c in keep if c.lower() not in taken]


def with_text(df: DataFrame, keep: list[str], column: str) -> DataFrame:
    """The columns of keep, then `column` under a name that none of them has."""
    name = "__" + column
    while name.lower() in {k.lower() for k in keep}:
        name += "_"
    return df.select(*keep, df[column].alias(name))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/quillspan/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes all that this application has stored; results that weren't written elsewhere can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage is cut and every executor can read it."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The folders of the tables stored so far and not released.
_tables: list[str] = []


def marked() -> int:
    """A mark of the tables stored so far, for release()."""
    return len(_tables)


def release(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Removes the tables stored since the mark, but not those that frames of keep read."""
    kept = {f.rsplit("/", 2)[-2] for df in keep for f in df.inputFiles()}  # folder names are unique
    for path in _tables[mark:]:
        if path.rsplit("/", 1)[1] not in kept:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            _tables.remove(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Removes tables made by stored() once nothing reads them any more."""
    for df in frames:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/quillspan/" in f:
                path = spark._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, a: str, b: str, name: str = "cc") -> DataFrame:
    """Connected components of an edge table by contraction, all in joins and aggregates.

    Returns (node, label), label the smallest node reachable; nodes are those of the edges. Every round each node moves to
    the least node among itself and its neighbours, and edges follow their ends; what becomes a loop or a repeat goes, so
    the graph shrinks until no edge is left. Labels are carried along. Rows stay linear in the edges, every round's
    tables are stored, and nothing is collected.
    """
    spark = edges.sparkSession
    left = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v")
    left, labels = stored(left.distinct(), name + "-edges"), None
    while labels is None or left.limit(1).count():
        both = left.union(left.select("v", "u"))
        moved = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")), name + "-moved")
        if labels is None:
            new = moved.select(F.col("u").alias("node"), F.col("to").alias("label"))
        else:
            new = labels.join(moved, labels["label"] == moved["u"], "left").select("node", F.coalesce("to", "label").alias("label"))
        new = stored(new, name)
        ends = left.join(moved, "u").select(F.col("to").alias("x"), "v")
        ends = ends.join(moved, ends["v"] == moved["u"]).select(F.least("x", "to").alias("u"), F.greatest("x", "to").alias("v")).where("u <> v")
        shrunk = stored(ends.distinct(), name + "-edges")
        discard(spark, left, moved, *([labels] if labels is not None else []))
        left, labels = shrunk, new
    discard(spark, left)
    return labels


def roots(link: np.ndarray) -> np.ndarray:
    """The least node of each node's component; link: the symmetric matrix of the bounded set of nodes of one task."""
    root, new = np.arange(len(link)), np.ones(len(link), bool)
    for i in range(len(link)):
        if new[i]:
            front = np.array([i])
            while len(front):
                new[front], root[front] = False, i
                front = np.flatnonzero(link[front].any(0) & new)
    return root


def owned(link: np.ndarray, groups: list, mine: int) -> np.ndarray:
    """The links that are counted in the group `mine`: those of pairs that share no group below it."""
    lower: dict = {}
    pairs = [(i, lower.setdefault(g, len(lower))) for i in np.flatnonzero(link.any(1)).tolist() for g in groups[i] if g < mine]
    if not pairs:
        return link
    m = np.zeros((len(link), len(lower)), np.float32)
    m[tuple(np.array(pairs).T)] = 1
    return link & ~(m @ m.T > 0)


class UnionFind:
    """Least-root union-find over the bounded set of nodes of one task."""

    def __init__(self, n: int):
        self.p = np.arange(n)

    def find(self, x: int) -> int:
        p = self.p
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return int(x)

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.p[max(x, y)] = min(x, y)
        return True
