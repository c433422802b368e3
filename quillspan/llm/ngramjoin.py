"""N-gram Jaccard join by MinHash banding.

Every whole text becomes the set of its word n-grams (five words; a shorter text is one n-gram of all its words). Texts of
equal sets are one node, so copies never meet pairwise. Nodes are shuffled on their band hashes, with band and row counts
chosen for a target recall at the threshold. Nodes that share a bucket are tied to the bucket's least node, which gives
candidate groups in rows linear in the nodes. A group's n-gram sets then go to one task once, where every pair that shares
a band is verified on the full sets by counting common n-grams; a group of more than BLOCK nodes is cut into blocks, and
each pair of blocks is a task of bounded size. Pairs aren't emitted: a task returns, for every node, its number of links
(each weighted by the partner's copies) and a spanning link.

Recall: a pair at the threshold shares a band with probability of at least RECALL, a more similar pair with more; what
shares a band is verified, so no link is false. N-grams and sets are known by 64-bit hashes.

Defined cases: null and wordless texts link with nothing and are their own class; copies link with each other; repeated
rows are copies; of a class the least doc_id is the class id, a null doc_id is after all others (9223372036854775807);
extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import components, owned, roots, stored, words_of

N = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 140
BLOCK = 128
BLOCK_GRAMS = 1_000_000
LAST = 9223372036854775807


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with which the recall is reached within the hashes."""
    for rows in range(most, 0, -1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold**rows < 1 else 1
        if bands * rows <= most:
            return bands, rows
    return most, 1


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_MULT = np.uint64(0x9E3779B97F4A7C15)


def gram_set(text: str | None, hashes: Hashes, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a whole text."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    m = max(1, len(w) - n + 1)
    h = np.full(m, np.uint64(min(n, len(w))))
    for i in range(min(n, len(w))):
        h = (h ^ w[i : i + m]) * _MULT
        h ^= h >> np.uint64(29)
    return np.unique(h)


class MinHash:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20240229)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.c = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max)
        for i in range(0, len(grams), 2048):
            low = np.minimum(low, (grams[None, i : i + 2048] * self.a[:, None] + self.c[:, None]).min(1))
        low = low.reshape(self.bands, self.rows)
        return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), seed=i) for i, r in enumerate(low)], np.uint64).view(np.int64)


SIGNED = "key long, th long, node long, n_grams int, bands array<long>"


def signatures(docs: DataFrame, bands: int, rows: int, n: int = N) -> DataFrame:
    """key (doc_id), th (hash of the text), node (hash of the n-gram set, null if empty), n_grams, bands."""

    def run(batches):
        hashes, minhash = Hashes(), MinHash(bands, rows)
        for batch in batches:
            node, size, sign = [], [], []
            for text in batch.column(2):
                g = gram_set(text.as_py(), hashes, n)
                size.append(len(g))
                node.append(int(np.uint64(xxhash.xxh3_64_intdigest(g.tobytes())).astype(np.int64)) if len(g) else None)
                sign.append(minhash.band_hashes(g) if len(g) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(sign, pa.list_(pa.int64()))], ["key", "th", "node", "n_grams", "bands"])

    return keyed(docs).select("__key", "__th", "text").mapInArrow(run, SIGNED)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("__th", F.xxhash64("text"))


def common_counts(sets: list[np.ndarray], cand: np.ndarray) -> np.ndarray:
    """Numbers of common n-grams of the candidate pairs (upper triangle) of a task."""
    n = len(sets)
    inter = np.zeros((n, n), np.int64)
    size = np.fromiter(map(len, sets), np.int64, n)
    pairs = np.argwhere(cand)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(n), size)
    grams, inv, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[inv] > 1  # what one set has alone is common to no pair
    code = np.cumsum(seen > 1) - 1
    inv, who, v = code[inv[shared]], who[shared], int((seen > 1).sum())
    if len(pairs) * 3e-5 < n * n * v / 1.5e10:
        ends = np.cumsum(np.bincount(who, minlength=n))
        for i, j in pairs:
            inter[i, j] = len(np.intersect1d(inv[ends[i - 1] if i else 0 : ends[i]], inv[ends[j - 1] if j else 0 : ends[j]], assume_unique=True))
        return inter
    step = 4096
    total = np.zeros((n, n), np.float32)
    order = np.argsort(inv, kind="stable")
    inv, who = inv[order], who[order]
    for lo in range(0, v, step):
        a, b = np.searchsorted(inv, [lo, lo + step])
        m = np.zeros((n, min(step, v - lo)), np.float32)
        m[who[a:b], inv[a:b] - lo] = 1
        total += m @ m.T
    return np.where(cand, total.astype(np.int64), 0)


def verify(sets: list[np.ndarray], bands: np.ndarray, side: np.ndarray, copies: np.ndarray, threshold: float, groups: list | None = None, mine: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node (weighted by copies) and the root of each in the spanning forest.

    side: 0 to compare all pairs, else 1 and 2 to compare across; groups: those of each node, if pairs are to be counted in
    the first group of both only, `mine` being this one.
    """
    n = len(sets)
    cand = np.zeros((n, n), bool)
    for col in bands.T:
        cand |= col[:, None] == col[None, :]
    cand &= np.triu(np.ones((n, n), bool), 1)
    if side.any():
        cand &= side[:, None] != side[None, :]
    if groups is not None:
        cand = owned(cand | cand.T, groups, mine) & np.triu(np.ones((n, n), bool), 1)
    inter = common_counts(sets, cand)
    size = np.fromiter(map(len, sets), np.int64, n)
    union = size[:, None] + size[None, :] - inter
    link = cand & (inter >= threshold * union - 1e-9)
    link |= link.T
    return link @ copies, roots(link)


def units_of(nodes: DataFrame, block: int, block_grams: int) -> DataFrame:
    """A row for each node and unit of work: node, unit, units (of the node, null in a candidate group), parts (blocks of the unit); nodes in no pair have none."""
    buckets = nodes.select("node", "n_grams", F.posexplode("bands").alias("band", "h")).select("node", "n_grams", F.xxhash64("band", "h").alias("bucket"))
    # buckets of equal members have equal sums (without carry) of hashes
    shape = buckets.groupBy("bucket").agg(
        F.min("node").alias("leader"), F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams"),
        F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s2"),
    ).where("n > 1")
    parts = lambda n, grams: F.ceil(F.greatest(F.col(n) / F.lit(block), F.col(grams) / F.lit(block_grams))).cast("int")
    shape = stored(shape.select("bucket", "leader", F.xxhash64("leader", "n", "s1", "s2").alias("unit"), "n", parts("n", "grams").alias("parts")), "buckets")
    held = stored(buckets.join(shape, "bucket").groupBy("node", "unit").agg(F.first("leader").alias("leader"), F.first("parts").alias("parts"), F.first("n_grams").alias("n_grams")), "held")
    groups = components(held.where("node <> leader").select("node", "leader"), "node", "leader", "candidates")
    # the texts that would go out of a group by its blocks and by its buckets
    once = shape.groupBy("unit").agg(F.first("leader").alias("node"), F.first(F.col("n") * F.col("parts")).alias("work"))
    by_bucket = once.join(groups, "node").groupBy("label").agg(F.sum("work").alias("bucket_work"))
    by_block = nodes.select("node", "n_grams").join(groups, "node").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams"))
    work = by_block.select("label", "n", parts("n", "grams").alias("group_parts")).join(by_bucket, "label")
    work = stored(work.select("label", "group_parts", F.expr("group_parts = 1 or n * group_parts <= bucket_work").alias("whole")), "work")
    placed = stored(groups.join(work, "label"), "groups")
    whole = placed.where("whole").select("node", F.col("label").alias("unit"), F.lit(None).cast("array<long>").alias("units"), F.col("group_parts").alias("parts"))
    split = held.join(placed.where("not whole").select("node"), "node").select("node", "unit", "parts")
    units = split.groupBy("node").agg(F.collect_list("unit").alias("units"))  # as many as bands at most
    return whole.unionByName(split.join(units, "node").select("node", "unit", "units", "parts"))


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Per document row: key, th, n_grams, class_key, class_th (its class's representative), n_links."""
    bands, rows = bands_for(threshold, recall)
    signed = stored(signatures(docs, bands, rows, n), "signed")
    nodes = stored(
        signed.where("node is not null").groupBy("node").agg(F.min(F.struct("key", "th")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")), "nodes"
    )
    members = units_of(nodes.select("node", "n_grams", "bands"), block, block_grams).join(nodes.select("node", "rep", "copies", "bands"), "node")
    own = F.pmod(F.xxhash64("node", "unit"), F.col("parts")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    side = F.expr("case when own = other then 0 when own < other then 1 else 2 end")
    task = F.xxhash64("unit", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select("node", "rep", "copies", "bands", (F.expr("parts > 1 or units is not null")).alias("large"), side.alias("side"), task.alias("task"), "unit", "units")
    texts = keyed(docs).select("__key", "__th", "text")
    found = stored(_verified(dealt.join(texts, (F.col("rep.key") == F.col("__key")) & (F.col("rep.th") == F.col("__th"))), threshold, n), "links")
    small = found.where("not large").select("node", "links", "root")
    large = found.where("large")
    if large.limit(1).count():
        label = components(large, "node", "root", "large").select("node", F.col("label").alias("root"))
        counted = large.groupBy("node").agg(F.sum("links").alias("links"))
        small = small.unionByName(counted.join(label, "node", "left").select("node", "links", F.coalesce("root", "node").alias("root")))
    classes = stored(small.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("class")), "representatives")
    placed = small.join(classes, "root").select("node", "links", "class")
    whole = nodes.join(placed, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("class", "rep").alias("class"))
    whole = stored(whole, "classes")  # both sides of the last join are plain exchanges, so Spark splits a node of very many copies
    out = signed.drop("bands").join(whole, "node", "left")
    return out.select("key", "th", "n_grams", F.coalesce("class.key", "key").alias("class_key"), F.coalesce("class.th", "th").alias("class_th"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _verified(rows: DataFrame, threshold: float, n: int) -> DataFrame:
    """Runs verify() on every task; tasks follow each other within a partition."""

    def run(batches):
        hashes = Hashes()
        held: list = []

        def done():
            seen: dict = {}
            for r in held:
                seen.setdefault(r[1], r)
            mine = [seen[k] for k in sorted(seen)]  # so that a root is its task's least node
            sets = [gram_set(r[6], hashes, n) for r in mine]
            node, copies, side = (np.array([r[i] for r in mine], np.int64) for i in (1, 2, 4))
            links, root = verify(sets, np.array([r[5] for r in mine]), side, copies, threshold, None if mine[0][8] is None else [r[8] for r in mine], mine[0][7])
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(node[root]), pa.array([r[3] for r in mine])], ["node", "links", "root", "large"])

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if held and held[0][0] != r[0]:
                    yield done()
                    held = []
                held.append(r)
        if held:
            yield done()

    ready = rows.select("task", "node", "copies", "large", "side", "bands", "text", "unit", "units").repartition("task").sortWithinPartitions("task")
    return ready.mapInArrow(run, "node long, links long, root long, large boolean")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that represent their class, a row each, and all wordless rows, with the columns of docs."""
    kept = found.where("key = class_key and th = class_th").groupBy(F.col("key").alias("__key"), F.col("th").alias("__th")).agg(F.max(F.col("n_grams") > 0).alias("__words"))
    rows = keyed(docs).join(kept, ["__key", "__th"])
    once = rows.where("__words").dropDuplicates(["__key", "__th"])
    return once.unionByName(rows.where("not __words")).select(*docs.columns)
