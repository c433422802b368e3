"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources are word streams: the documents of a source in hashed order, cut into blocks of equal length (a document may begin
or end within a block). A source's target gives its exact block quota. A tree divides the quota vector among output
shards: a node draws how many blocks of each source go left from the multivariate hypergeometric distribution, so every
shard gets its share of the words and each quota is met exactly. A source's blocks are permuted by a keyed Feistel
network (one for every pass over the source); shard k takes the next n(source, k) permuted blocks, so draws are disjoint,
and its pieces get local slots by a hash, which shuffles them.

At scale: the number of shards follows the words (SHARD_WORDS each, LEAST_SHARDS at least). Stream offsets come from
two-level sums over buckets of hashed rows; equal rows are numbered before they are hashed, so neither a source with a
third of all rows nor a row repeated as often meets in one task. Targets are found by aggregate rounds over the sources;
trees run on groups of sources of at most about TREE_CELLS counts and keep only counts above zero; a piece finds its shard
by a join on stretches of SPAN ranks. Texts aren't shuffled. Everything is keyed by hashes, so reruns agree.

Defined cases: a null text has size 0 and takes nothing; a null source is a source, after all others; repeated rows are
rows of their own; sources without words have target 0; an empty table gives an empty mix; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2.0
SHARD_WORDS = 1 << 27
LEAST_SHARDS = 64
SEED = 17
BLOCKS_PER_SOURCE = 512
MAX_BLOCK = 1024
BUCKET_ROWS = 2000
TREE_CELLS = 400_000
SPAN = 4096


def size_of(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """skey, source_size, n_rows (in), with weight and target: the share of all sizes by weight, capped, excess reshared."""
    spark = sizes.sparkSession
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    schema = sizes.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    table = spark.createDataFrame(ordered, f"{schema}, idx long")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("idx") % len(weights) + 1).cast("int"))
    table = stored(table.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(repeat)), "sources")
    whole = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words for each unit of weight; it rises as capped sources hand back their excess
    while True:
        capped = F.col("weight") * F.lit(level) >= F.col("cap")
        full, open_ = table.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        new = (share * whole - (full or 0.0)) / open_ if open_ else level
        if not open_ or new <= level:
            break
        level = new
    return table.withColumn("target", F.least("cap", F.col("weight") * F.lit(level))).drop("cap", "idx")


def split_tree(quota: np.ndarray, shards: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By recursive hypergeometric halving, shard by shard: (shard, the sources that give it blocks, how many each gives)."""
    todo = [(0, shards, np.flatnonzero(quota), quota[quota > 0])]
    while todo:
        lo, hi, who, have = todo.pop()
        if not len(who):
            continue
        if hi - lo < 2:
            yield lo, who, have
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = draw(rng, have, int(have.sum()) * (mid - lo) // (hi - lo))
        right = have - left
        todo += [(mid, hi, who[right > 0], right[right > 0]), (lo, mid, who[left > 0], left[left > 0])]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good, by inversion of the distribution function, at every size.

    The probabilities run from the mode by their exact ratios; what lies over 12 deviations and 30 away is left out (under
    1e-30 of the whole).
    """
    low, high, total = max(0, n - bad), min(n, good), good + bad
    if low >= high:
        return high
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    reach = 30 + int(12 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5)
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=float)
    step = np.log((good - k[:-1]) / (k[:-1] + 1)) + np.log((n - k[:-1]) / (bad - n + k[:-1] + 1))
    log_p = np.append(0, np.cumsum(step))
    below = np.cumsum(np.exp(log_p - log_p.max()))
    return int(k[min(np.searchsorted(below, rng.random() * below[-1], "right"), len(k) - 1)])


def draw(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw, one marginal after the other."""
    out, left, rest = np.zeros_like(have), n, int(have.sum())
    for i, h in enumerate(have.tolist()):
        rest -= h
        out[i] = k = hypergeometric(rng, h, rest, left)
        left -= k
    return out


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of 0..n-1: a Feistel network over the next even power of two, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(v):
        a, b = v >> np.uint64(half), v & mask
        for r in range(6):
            f = (b + np.uint64(key & 0xFFFFFFFF) + np.uint64(r * 0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((f >> np.uint64(31)) & mask)
        return (a << np.uint64(half)) | b

    y = once(x.astype(np.uint64))
    while (out := y >= np.uint64(n)).any():
        y[out] = once(y[out])
    return y.astype(np.int64)


def row_hash() -> Column:
    return F.xxhash64("doc_id", "text", F.col("source").cast("string"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (h and rid, the part and the place in it) with h made distinct: equal rows are numbered part by part, and those of a part meet in one task at most."""
    part = rows.withColumn("part", F.shiftright("rid", 33))
    counts = part.groupBy("h", "part").count()
    before = counts.selectExpr("h", "part", "sum(count) over (partition by h order by part) - count as before", "sum(count) over (partition by h) as copies").where("copies > 1")
    own = part.withColumn("nth", F.expr("row_number() over (partition by h, part order by rid) - 1"))
    placed = own.join(before, ["h", "part"], "left").withColumn("nth", F.col("nth") + F.coalesce("before", F.lit(0)))
    return placed.withColumn("h2", F.xxhash64("h", "nth")).drop("part", "before", "copies", "nth")


PIECES = "array<struct<shard:int,slot:long,pass:int,start:long,n:long>>"


def plan(docs: DataFrame, keep: list[str], shards: int | None = None, seed: int = SEED, weights: tuple = WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """The columns of keep with __h, __size, source_size, target and pieces: what of a row goes where, in words of the row."""
    text, kept = F.col("text"), [f"__k_{c}" for c in keep]
    base = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), row_hash().alias("h"))
    skey = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    rows = stored(base.withColumn("skey", skey).withColumn("rid", F.monotonically_increasing_id()), "sized")
    sizes = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    table = source_targets(sizes, weights, share, repeat)
    b = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.expr(f"source_size div {BLOCKS_PER_SOURCE}"))).cast("long")
    table = table.withColumn("block", b).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    table = table.withColumn("quota", F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("blocks"))).otherwise(0).cast("long"))
    table = stored(table.withColumn("buckets", F.ceil(F.col("n_rows") / F.lit(BUCKET_ROWS)).cast("int")).drop("source", "n_rows"), "quotas")
    if shards is None:
        words = table.agg(F.sum(F.col("quota") * F.col("block"))).first()[0] or 0
        shards = max(LEAST_SHARDS, -(-words // SHARD_WORDS))

    def trees(batches):
        held: list = []
        for batch in batches:
            held += batch.to_pylist()
        held.sort(key=lambda r: (r["grp"], r["skey"]))
        i = 0
        while i < len(held):
            j = i
            while j < len(held) and held[j]["grp"] == held[i]["grp"]:
                j += 1
            names = np.array([r["skey"] for r in held[i:j]], object)
            given = np.zeros(j - i, np.int64)
            for shard, who, n in split_tree(np.array([r["quota"] for r in held[i:j]], np.int64), shards, seed + held[i]["grp"]):
                yield pa.RecordBatch.from_arrays([pa.array(names[who], pa.string()), pa.array([shard] * len(who), pa.int32()), pa.array(given[who]), pa.array(given[who] + n)], ["skey", "shard", "lo", "hi"])
                given[who] += n
            i = j

    cells = table.agg(F.sum(F.least(F.col("quota"), F.lit(shards)))).first()[0] or 0
    groups = max(1, -(-cells // TREE_CELLS))
    grouped = table.withColumn("grp", F.pmod(F.xxhash64("skey"), F.lit(groups)).cast("int")).select("grp", "skey", "quota").repartition(groups, "grp")
    bounds = stored(grouped.mapInArrow(trees, "skey string, shard int, lo long, hi long"), "bounds")
    bounds = bounds.withColumn("stretch", F.explode(F.expr(f"sequence(lo div {SPAN}, (hi - 1) div {SPAN})")))

    placed = numbered(rows).join(table.select("skey", "buckets"), "skey").withColumn("bucket", F.pmod(F.col("h2"), F.col("buckets")).cast("int"))
    sums = placed.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    before = "coalesce(sum(words) over (partition by skey order by bucket rows between unbounded preceding and 1 preceding), 0)"
    sums = sums.select("skey", "bucket", F.expr(before).alias("base"))
    within = f"sum(size) over (partition by skey, bucket order by h2, size, {', '.join(kept)} rows between unbounded preceding and current row) - size"
    offsets = placed.withColumn("__in", F.expr(within)).join(sums, ["skey", "bucket"]).join(table.drop("buckets"), "skey")
    carried = ["rid", *kept, "h", "size", "source_size", "target"]
    ready = offsets.select(*carried, "skey", (F.col("base") + F.col("__in")).alias("at"), "block", "blocks", "quota")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields[: len(carried) + 1])

    def drawn(batches):
        import xxhash

        for batch in batches:
            names = batch.schema.names
            at, size, block, blocks, quota = (np.array(batch.column(names.index(c)), np.int64) for c in ("at", "size", "block", "blocks", "quota"))
            ranks: list[list] = [[] for _ in range(batch.num_rows)]
            spans: dict = {}
            for i, k in enumerate(batch.column(names.index("skey")).to_pylist()):
                if size[i] > 0:
                    spans.setdefault(k, []).append(i)
            for k, mine in spans.items():
                mine = np.array(mine)
                b, nb, q = int(block[mine[0]]), int(blocks[mine[0]]), int(quota[mine[0]])
                first, last = at[mine] // b, (at[mine] + size[mine] - 1) // b
                count = last - first + 1
                row = np.repeat(mine, count)
                blk = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                lo = np.maximum(blk * b, at[row]) - at[row]
                hi = np.minimum((blk + 1) * b, at[row] + size[row]) - at[row]
                for turn in range(-(-q // nb)):
                    rank = turn * nb + permute(blk, nb, xxhash.xxh3_64_intdigest(f"{seed}/{turn}/{k}"))
                    taken = rank < q
                    slot = permute(rank[taken], max(q, 1), seed * 31 + turn)
                    for r, x, o, a, e in zip(row[taken].tolist(), rank[taken].tolist(), slot.tolist(), lo[taken].tolist(), hi[taken].tolist(), strict=True):
                        ranks[r].append({"rank": x, "slot": o, "pass": turn, "start": a, "n": e - a})
            kind = pa.list_(pa.struct([("rank", pa.int64()), ("slot", pa.int64()), ("pass", pa.int32()), ("start", pa.int64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried) + 1], pa.array(ranks, kind)], [*names[: len(carried) + 1], "ranks"])

    done = ready.mapInArrow(drawn, f"{schema}, ranks array<struct<rank:long,slot:long,pass:int,start:long,n:long>>")
    each = done.withColumn("r", F.explode_outer("ranks")).drop("ranks").withColumn("stretch", F.expr(f"r.rank div {SPAN}"))
    found = _in_shards(each, bounds)
    piece = F.when(F.col("shard").isNotNull(), F.struct("shard", F.col("r.slot").alias("slot"), F.col("r.pass").alias("pass"), F.col("r.start").alias("start"), F.col("r.n").alias("n")))
    per_row = found.groupBy("rid").agg(*(F.first(c).alias(c) for c in carried[1:]), F.collect_list(piece).cast(PIECES).alias("pieces"))
    return per_row.select(*(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), F.col("h").alias("__h"), F.col("size").alias("__size"), "source_size", "target", "pieces")


def _in_shards(ranked: DataFrame, bounds: DataFrame) -> DataFrame:
    """The shard of each rank; rows without a rank keep a null."""
    held = bounds.select(F.col("skey").alias("__skey"), F.col("stretch").alias("__stretch"), "shard", "lo", "hi")
    return ranked.join(held, F.expr("skey = __skey and stretch = __stretch and r.rank >= lo and r.rank < hi"), "left")


def taken(pieces: str = "pieces") -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + p["n"])


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: shard, slot, pass, doc_id, source, start, n_words and text of every piece.

    Rows of a shard stand together, in the order of a hash of source, pass and slot (the local shuffle); the text of a piece
    is cut from its document without changing it.
    """
    # equal rows are interchangeable, so theirs are gathered: texts are shuffled once, by the keys of the join
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("__id"), "__h"]
    plans = plan(docs.select("doc_id", "text", "source"), ["doc_id"], **options).where(F.size("pieces") > 0)
    plans = plans.groupBy(*keys).agg(F.flatten(F.collect_list("pieces")).alias("pieces"))
    texts = docs.select("doc_id", "source", "text", row_hash().alias("__h")).groupBy(*keys).agg(*(F.first(c).alias(c) for c in ("doc_id", "source", "text")))
    rows = texts.join(plans, ["__id", "__h"]).select("doc_id", "source", "text", "pieces")

    def cut(batches):
        import re

        run = re.compile(r"[^\x20\x09-\x0D]+")
        names = ["shard", "slot", "pass", "doc_id", "source", "start", "n_words", "text"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                out = []
                for r in batch.slice(lo, 200).to_pylist():
                    spans = [m.span() for m in run.finditer(r["text"])]
                    for p in r["pieces"]:
                        a, e = spans[p["start"]][0], spans[p["start"] + p["n"] - 1][1]
                        out.append((p["shard"], p["slot"], p["pass"], r["doc_id"], r["source"], p["start"], p["n"], r["text"][a:e]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    made = rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(cut, "shard int, slot long, pass int, doc_id long, source string, start long, n_words long, text string")
    return made.repartition("shard").sortWithinPartitions("shard", F.xxhash64("source", "pass", "slot"), "doc_id", "start")
