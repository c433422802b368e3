"""Token counts by a separator scan of flat unindexed token files.

write_flat() tokenises documents and appends their ids to flat files of little-endian numbers (of 16 bits if all ids of the
vocabulary fit, else 32), an end-of-document id after each document, with nothing else in the files. scan() knows only the files: it deals them out in blocks of
BLOCK tokens, finds the separators of a block in one vectorised comparison, and stitches documents that run over block
bounds with a prefix scan (separators before the block; tokens since the last separator, a two-level sum within a file).
The k-th document of a file is the k-th separator.

A task holds the numbers of one file and the encoder's list of one document's ids, so memory is bounded by a
file and a document. Files go to the shared folder under names of their own for each task attempt; only files that a finished attempt lists
count, so a lost executor leaves none half-counted. A file has at most FILE_TOKENS tokens and one document more.

Defined cases: null and empty texts have no token but a separator, so a count of 0; tokens after a file's last separator
belong to no document, tails() reports them; a vocabulary that holds the separator's id is refused; repeated rows are counted for themselves; the separator's text
in a document is ordinary text; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import own_dir, stored

VOCABULARY = os.environ.get("QUILLSPAN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
EOD = 50256
FILE_TOKENS = 4_000_000
BLOCK = 1 << 16
#: Blocks summed at once in the first level of the prefix scan.
RUN = 256

LISTED = "path string, n_docs long, n_tokens long, doc_ids array<long>"


@functools.cache
def ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(vocabulary: str):
    """A byte-level BPE from a ranks file."""
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(vocabulary), special_tokens={})


def id_type(vocabulary: str, eod: int) -> str:
    """The numbers of a flat file: the narrowest that hold every id."""
    return "<u2" if max(eod, *ranks(vocabulary).values()) < 1 << 16 else "<u4"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and authority that the driver resolves it to, so that executors don't guess."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def store_of(folder: str):
    """(file system, path in it) of a qualified folder, on any process; s3a is s3 there."""
    from pyarrow import fs

    scheme, mark, rest = folder.partition("://")
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else folder)


def write_flat(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, eod: int = EOD, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the files; returns the list of them with the doc_ids in their order, as a stored table."""
    if eod in ranks(vocabulary).values():
        raise ValueError(f"the vocabulary holds the separator {eod} as a token")
    kind = id_type(vocabulary, eod)

    def run(batches) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        enc = encoder(vocabulary)
        parts, ids, n = [], [], 0

        def close():
            path = f"{root}/{uuid.uuid4().hex}.bin"
            with store.open_output_stream(path) as f:
                for p in parts:
                    f.write(p)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((path, len(ids), n, ids), kinds, strict=True)], ["path", "n_docs", "n_tokens", "doc_ids"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.array(pieces(enc, text.as_py() or ""), kind)
                parts += [own.tobytes(), np.array([eod], kind).tobytes()]
                ids.append(i)
                n += len(own) + 1
                if n >= file_tokens:
                    yield close()
                    parts, ids, n = [], [], 0
        if ids:
            yield close()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LISTED), "flat-list")


def pieces(enc, text: str) -> list[int]:
    try:
        return enc.encode_ordinary(text)
    except UnicodeEncodeError:
        return enc.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def scan(spark: SparkSession, folder: str, paths: DataFrame, eod: int = EOD, block: int = BLOCK, kind: str = "<u4") -> DataFrame:
    """path, nth, n_tokens for every document of the listed files (columns path, n_tokens) of numbers of a kind; nth counts from 0."""
    wide = np.dtype(kind).itemsize
    sizes = paths.select("path", F.col("n_tokens").alias("length"))
    blocks = sizes.withColumn("block", F.explode(F.expr(f"sequence(0L, greatest(0L, (length - 1) div {block}))"))).repartition("path", "block")

    def search(batches):
        store, _ = store_of(folder)
        for batch in batches:
            for path, length, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(path) as f:
                    f.seek(wide * block * b)
                    x = np.frombuffer(f.read(wide * min(block, length - block * b)), kind)
                at = np.flatnonzero(x == eod).astype(np.int64)
                inner = np.diff(at) - 1
                head, tail = (int(at[0]), len(x) - int(at[-1]) - 1) if len(at) else (len(x), len(x))
                one = [[path], [b], [len(at)], [head], [tail], [inner]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(one, kinds, strict=True)], ["path", "block", "seps", "head", "tail", "inner"])

    found = stored(blocks.mapInArrow(search, "path string, block long, seps long, head long, tail long, inner array<long>"), "blocks")
    # prefix scan: (separators, tokens since the last) composes; first within runs of blocks, then over a file's runs
    run = found.withColumn("run", F.expr(f"block div {RUN}"))
    return _stitched(run)


def _stitched(run: DataFrame) -> DataFrame:
    """Documents of the blocks: a block's first separator closes what is open, its last opens anew."""
    # carry of a block: tokens since the last separator at its start. Cumulative tokens minus their value at that separator.
    w1 = "partition by path, run order by block rows between unbounded preceding and 1 preceding"
    tokens = "case when seps = 0 then head else head + tail + seps + aggregate(inner, 0L, (a, x) -> a + x) end"
    cum = run.selectExpr("*", f"{tokens} as tokens").selectExpr("*", f"coalesce(sum(seps) over ({w1}), 0L) as s0", f"coalesce(sum(tokens) over ({w1}), 0L) as t0")
    # position (within the run) just after the last separator before the block
    cum = cum.selectExpr("*", f"max(case when seps > 0 then t0 + tokens - tail end) over ({w1}) as p0")
    totals = cum.groupBy("path", "run").agg(F.sum("seps").alias("seps"), F.sum("tokens").alias("tokens"), F.max(F.expr("case when seps > 0 then t0 + tokens - tail end")).alias("p"))
    w2 = "partition by path order by run rows between unbounded preceding and 1 preceding"
    totals = totals.selectExpr("path", "run", "p", f"coalesce(sum(seps) over ({w2}), 0L) as s1", f"coalesce(sum(tokens) over ({w2}), 0L) as t1")
    totals = totals.selectExpr("path", "run", "s1", "t1", f"coalesce(max(t1 + p) over ({w2}), 0L) as p1")
    placed = cum.join(totals, ["path", "run"]).selectExpr("path", "block", "seps", "head", "tail", "inner", "s0 + s1 as nth", "t0 + t1 - coalesce(p0 + t1, p1) as carry")
    return placed.selectExpr("path", "nth", "posexplode(case when seps > 0 then concat(array(carry + head), inner) else array() end) as (k, n_tokens)").selectExpr("path", "nth + k as nth", "n_tokens")


def tails(run: DataFrame, documents: DataFrame) -> DataFrame:
    """Files whose last token is no separator: path and the number of the tokens left."""
    total = run.selectExpr("path", "n_tokens as length")
    closed = documents.groupBy("path").agg(F.sum(F.col("n_tokens") + 1).alias("closed"))
    return total.join(closed, "path", "left").selectExpr("path", "length - coalesce(closed, 0) as n_left").where("n_left > 0")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, eod: int = EOD) -> DataFrame:
    """doc_id and n_tokens of every row: flat files are written and scanned for separators, then removed.

    The vocabulary must not hold the separator's id: its places would count as ends of documents.
    """
    spark = docs.sparkSession
    folder = qualified(spark, f"{own_dir(spark)}/flat-{uuid.uuid4().hex}")
    made = spark._jvm.org.apache.hadoop.fs.Path(folder)
    made.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(made)
    listed = write_flat(docs, folder, vocabulary, eod)
    names = listed.select("path", F.posexplode("doc_ids").alias("nth", "doc_id"))
    counts = scan(spark, folder, listed, eod, kind=id_type(vocabulary, eod))
    store = made.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(made, True)  # the scan's findings are a stored table; nothing reads the files again
    return names.join(counts, (names.path == counts.path) & (names.nth == counts.nth), "left").select("doc_id", "n_tokens")
