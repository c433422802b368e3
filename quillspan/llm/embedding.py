"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors are one node with a count, so copies never meet pairwise. Pivots (a hash sample of nodes, without those
that link with an earlier one, so that a tight group stays whole) cut the nodes into overlapping cluster shards: every
node joins its nearest pivots. With more nodes than PIVOT_SAMPLE pivots can cut, each of their shards has pivots of its
own, and a node joins the nearest of those of all its shards. In each shard a flat graph is built by greedy search and
robust pruning; the adjacency lists of a node from all its shards are united. The united lists lead across shards: a node
joins the first shard of each neighbour within twice the angle of the threshold, where what lies in range of both is
found. The search starts at the shard's medoid, follows the united lists greedily to the query and then expands over all
neighbours in range, so it finds whole balls; what was found is made symmetric, and all pairs of what it connected
are verified by their cosines in double precision. A shard of more than BLOCK nodes is cut into blocks and each pair of
blocks is a task, so tasks are bounded whatever a cluster's size. Pairs aren't emitted: of the tasks that hold both nodes
only one counts the link, and a task returns each node's number of links and a spanning link.

The overlap follows the number of pivots: it is the least at which pairs made at the threshold share a shard in SHARED of
cases. Recall is audited: nodes in hashed order, AUDIT at first and AUDIT_MOST at most, are compared with every vector by
brute force until AUDIT_LINKED of them have a true link within a small group; recall is the mean over such queries, or over all
that have links if that is less. Below TARGET the index is built again with twice the overlap and beam; below it at
OVERLAP_MOST too, all pairs of blocks are compared, in work that grows with the square of the nodes. Where no query has a true
link, recall is null: not measured.

Defined cases: null, zero and non-finite vectors, and those with null components, link with nothing and are components of
their own; vectors of another dimension than the query's never link with it; rows that repeat a vector are copies;
a null vec_id gives a null component unless it has copies or links; extra columns (labels too) are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import components, owned, roots, stored

THRESHOLD = 0.95
PIVOT_SAMPLE = 16_384
PER_SHARD = 600
OVERLAP = 2
OVERLAP_MOST = 16
SHARED = 0.98
#: Rows that meet a shard's own pivots in one task.
SALT_ROWS = 20_000
BLOCK = 1024
DEGREE = 24
BEAM = 40
ALPHA = 1.2
AUDIT = 512
AUDIT_MOST = 4096
AUDIT_LINKED = 64
SMALL_GROUP = 32
TARGET = 0.9


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double> of length 1, null if the vector can link with nothing)."""

    def scale(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            begins = np.cumsum(sizes) - sizes
            flat = pa.compute.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False)
            out: list = [None] * len(sizes)
            for d in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == d)
                x = flat[begins[at][:, None] + np.arange(d)]
                at, x = at[np.isfinite(x).all(1)], x[np.isfinite(x).all(1)]
                top = np.abs(x).max(1)
                at, x = at[top > 0], x[top > 0] / top[top > 0][:, None]  # no overflow or underflow in the squares
                for i, u in zip(at.tolist(), x / np.sqrt((x * x).sum(1))[:, None], strict=True):
                    out[i] = u
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "v"])

    picked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return picked.mapInArrow(scale, "vec_id long, v array<double>")


def matrix(rows: list) -> np.ndarray:
    return np.array(rows, np.float64)


def thinned(x: np.ndarray, threshold: float) -> np.ndarray:
    """The vectors that don't link with an earlier one, by number."""
    kept: list[int] = []
    for i in range(len(x)):
        if not kept or (x[kept] @ x[i]).max() < threshold:
            kept.append(i)
    return np.array(kept, np.int64)


def pivots_of(nodes: DataFrame, n: int, threshold: float = THRESHOLD, seed: int = 0) -> np.ndarray:
    """Pivots: of a hash sample of at most PIVOT_SAMPLE nodes, those that don't link with an earlier one."""
    wanted = min(PIVOT_SAMPLE, max(1, 3 * n // PER_SHARD))
    sample = nodes.select("v", F.xxhash64("node", F.lit(seed)).alias("h")).orderBy("h").limit(wanted).select("v").toLocalIterator()
    rows = [r["v"] for r in sample]
    sizes = [len(v) for v in rows]
    usual = max(set(sizes), key=lambda d: (sizes.count(d), d))
    x = matrix([v for v in rows if len(v) == usual])  # the usual dimension's
    return x[thinned(x, threshold)[: max(1, -(-n // PER_SHARD))]]


def overlap_for(pivots: np.ndarray, threshold: float, least: int = OVERLAP, share: float = SHARED, pairs: int = 2048) -> int:
    """The least overlap at which pairs with a cosine of threshold share a shard in `share` of cases, as drawn between and away from pivots."""
    k, d = pivots.shape
    if k <= least or d < 2:
        return least
    rng = np.random.default_rng(k)

    def unit(v):
        return v / np.sqrt((v * v).sum(1))[:, None]

    x = unit(rng.normal(size=(pairs, d)))
    near = np.arange(pairs) % 2 == 0  # half of them as the data lie
    x[near] = unit(pivots[rng.integers(0, k, near.sum())] + pivots[rng.integers(0, k, near.sum())] + 1e-3 * x[near])
    away = rng.normal(size=x.shape)
    away = unit(away - (away * x).sum(1)[:, None] * x)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * away
    most = min(OVERLAP_MOST, k)
    first = np.empty(pairs)  # the overlap from which a pair shares a shard
    for lo in range(0, pairs, 128):
        a, b = (np.argsort(-(v[lo : lo + 128] @ pivots.T), 1, kind="stable")[:, :most] for v in (x, y))
        rank = np.maximum(np.arange(most)[:, None], np.arange(most)[None, :]) + 1
        first[lo : lo + 128] = np.where(a[:, :, None] == b[:, None, :], rank, most + 1).min((1, 2))
    return max(least, next((o for o in range(least, most) if min((first[near] <= o).mean(), (first[~near] <= o).mean()) >= share), most))


def greedy(x: np.ndarray, lists: list[np.ndarray], start: int, q: np.ndarray, beam: int, radius: float | None = None) -> tuple[list[int], list[int]]:
    """(visited nodes, nodes with cosine >= radius): best-first with a beam, then over all neighbours in range."""
    seen = np.zeros(len(x), bool)
    seen[start] = True
    s = float(x[start] @ q)
    heap, best, visited = [(-s, start)], [s], []
    reach = 2.0 if radius is None else radius
    inside = [start] if s >= reach else []
    while heap:
        s, node = heapq.heappop(heap)
        if -s < best[0] and len(best) >= beam and -s < reach:
            break
        visited.append(node)
        new = lists[node]
        new = new[~seen[new]]
        if not len(new):
            continue
        seen[new] = True
        near = x[new] @ q
        if len(best) >= beam:  # the rest can't enter
            good = near > min(best[0], reach)
            new, near = new[good], near[good]
        for y, c in zip(new.tolist(), near.tolist(), strict=True):
            if c >= reach:
                inside.append(y)
            elif len(best) >= beam and c <= best[0]:
                continue
            heapq.heappush(heap, (-c, y))
            if len(best) < beam:
                heapq.heappush(best, c)
            elif c > best[0]:
                heapq.heapreplace(best, c)
    return visited, inside


def robust_prune(x: np.ndarray, node: int, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The nearest of the pool that no kept neighbour is much nearer to (squared distances 2 - 2 cos)."""
    pool = pool[pool != node]
    near = x[pool] @ x[node]
    order = np.argsort(-near, kind="stable")
    pool, d = pool[order], 2 - 2 * near[order]
    own = x[pool]
    alive, kept = np.ones(len(pool), bool), []
    for i in range(len(pool)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= alpha * (2 - 2 * (own @ own[i])) > d
    return pool[kept]


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[list[np.ndarray], int]:
    """Adjacency lists and the medoid of a shard."""
    n = len(x)
    medoid = int(np.argmax(x @ x.mean(0)))
    rng = np.random.default_rng(n)
    lists: list[np.ndarray] = [np.empty(0, np.int64)] * n
    for node in [medoid, *rng.permutation(n).tolist()]:
        visited, _ = greedy(x, lists, medoid, x[node], beam)
        pool = np.unique(np.concatenate([np.array(visited, np.int64), *(lists[v] for v in visited[:8]), lists[node]]))
        lists[node] = robust_prune(x, node, pool, degree, alpha)
        for y in lists[node].tolist():
            if not (lists[y] == node).any():
                lists[y] = np.append(lists[y], node)
                if len(lists[y]) > 2 * degree:
                    lists[y] = robust_prune(x, y, lists[y], degree, alpha)
    return lists, medoid


def nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the k nearest pivots of each vector, nearest first, and their cosines."""
    c = x @ pivots.T
    k = min(k, c.shape[1])
    top = np.argpartition(-c, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(c, top, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(top, order, 1), np.take_along_axis(near, order, 1)


PLACED = "node long, copies long, v array<double>, shards array<long>"


def placed_rows(nodes: DataFrame, pivots: np.ndarray, overlap: int, threshold: float = THRESHOLD) -> DataFrame:
    """node, copies, v and shards, the nearest pivot's first."""

    def assign(batches):
        for batch in batches:
            rows = batch.column(2).to_pylist()
            near: list = [[-len(r)] for r in rows]  # another dimension: a shard of its own
            same = [i for i, r in enumerate(rows) if len(r) == pivots.shape[1]]
            if same:
                for i, top in zip(same, nearest(matrix([rows[i] for i in same]), pivots, overlap)[0].tolist(), strict=True):
                    near[i] = top
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int64()))], ["node", "copies", "v", "shards"])

    placed = stored(nodes.select("node", "copies", "v").mapInArrow(assign, PLACED), "placed")
    return placed if len(pivots) < PIVOT_SAMPLE else _placed_within(placed, overlap, threshold)


def _placed_within(placed: DataFrame, overlap: int, threshold: float) -> DataFrame:
    """The same with shards within shards: each has pivots of its own, a hash sample thinned in one task."""
    rows = placed.select("node", "v", F.explode("shards").alias("shard"))
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / F.lit(SALT_ROWS)).cast("int")
    part = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(sizes, "shard").where(part < 1 / PER_SHARD).withColumn("task", F.col("shard"))

    def thin(held):
        kept = thinned(matrix([r["v"] for r in held]), threshold).tolist()
        columns = [[held[i][c] for i in kept] for c in ("shard", "node", "v")]
        return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["shard", "node", "v"])]

    local = stored(_by_task(chosen, ["task", "shard", "node", "v"], thin, "shard long, node long, v array<double>"), "pivots")
    salted = rows.join(sizes, "shard").withColumn("salt", F.pmod(F.xxhash64("node"), parts).cast("int"))
    copied = local.join(sizes, "shard").withColumn("salt", F.explode(F.expr("sequence(0, cast(ceil(n / {}) as int) - 1)".format(SALT_ROWS))))
    both = copied.select("shard", "salt", F.lit(0).alias("kind"), "node", "v").unionByName(salted.select("shard", "salt", F.lit(1).alias("kind"), "node", "v"))

    def assign(batches):
        key, kept, names, x = None, [], [], None
        for batch in batches:
            held = batch.to_pylist()
            for r in held:
                r["key"] = (r["shard"], r["salt"])
            lo = 0
            while lo < len(held):
                hi = lo
                while hi < len(held) and held[hi]["key"] == held[lo]["key"] and held[hi]["kind"] == held[lo]["kind"]:
                    hi += 1
                if held[lo]["key"] != key:
                    key, kept, names = held[lo]["key"], [], []
                if held[lo]["kind"] == 0:
                    kept += [r["v"] for r in held[lo:hi]]
                    names += [r["node"] for r in held[lo:hi]]
                    x = matrix(kept)
                else:
                    mine = held[lo:hi]
                    if names and x.shape[1] == len(mine[0]["v"]):
                        top, cos = nearest(matrix([r["v"] for r in mine]), x, overlap)
                        shards, cos = np.array(names, np.int64)[top].tolist(), cos.tolist()
                    else:  # a shard without pivots stays whole
                        shards, cos = [[r["shard"]] for r in mine], [[-1.0]] * len(mine)
                    yield pa.RecordBatch.from_arrays([pa.array([r["node"] for r in mine], pa.int64()), pa.array(shards, pa.list_(pa.int64())), pa.array(cos, pa.list_(pa.float64()))], ["node", "shards", "cos"])
                lo = hi

    found = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind", "node").mapInArrow(assign, "node long, shards array<long>, cos array<double>")
    pairs = found.select("node", F.expr("transform(arrays_zip(cos, shards), x -> named_struct('c', -x.cos, 's', x.shards))").alias("p"))
    best = pairs.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))).alias("p"))  # at most overlap squared for a node
    best = best.select("node", F.expr(f"transform(slice(p, 1, {overlap}), x -> x.s)").alias("shards"))
    return stored(placed.drop("shards").join(best, "node").select("node", "copies", "v", "shards"), "placed")


def dealt_rows(placed: DataFrame, block: int) -> DataFrame:
    """A row for each node and task: task, shard, own block, diag, shards (all shards of the node), node, v, copies."""
    sizes = placed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts"))
    rows = placed.withColumn("shard", F.explode("shards")).join(sizes, "shard").withColumn("own", F.pmod(F.xxhash64("node", "shard"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return rows.select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "shard", "own", (F.col("own") == F.col("other")).alias("diag"), "shards", "node", "copies", "v")


def _by_task(rows: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """Runs work on the rows of every task, a bounded list; tasks follow each other within a partition."""

    def run(batches):
        held: list = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["task"] != r["task"]:
                    yield from work(held)
                    held = []
                held.append(r)
        if held:
            yield from work(held)

    return rows.select(*columns).repartition("task").sortWithinPartitions("task", "node").mapInArrow(run, schema)


def _builder(threshold: float):
    reach = 2 * threshold * threshold - 1  # the cosine of twice the threshold's angle

    def work(rows: list) -> list:
        x = matrix([r["v"] for r in rows])
        lists, _ = build_graph(x)
        ids = np.array([r["node"] for r in rows], np.int64)
        close = [ids[y[x[y] @ x[i] >= reach]] if len(y) else ids[:0] for i, y in enumerate(lists)]
        return [pa.RecordBatch.from_arrays([pa.array(ids), pa.array([ids[y] for y in lists], pa.list_(pa.int64())), pa.array(close, pa.list_(pa.int64()))], ["node", "near", "close"])]

    return work


def _result(rows: list, link: np.ndarray, ids: np.ndarray) -> list:
    """Of a task's links (symmetric): those counted here, and the root of each node. Blocks of one shard meet in one task."""
    own, copies = np.array([r["own"] for r in rows]), np.array([r["copies"] for r in rows], np.int64)
    if not all(r["diag"] for r in rows):
        link = link & (own[:, None] != own[None, :])
    counted = owned(link, [r["shards"] for r in rows], rows[0]["shard"])
    return [pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counted @ copies), pa.array(ids[roots(link)])], ["node", "links", "root"])]


def _searcher(threshold: float, beam: int):
    def work(rows: list) -> list:
        x = matrix([r["v"] for r in rows])
        n = len(rows)
        ids = np.array([r["node"] for r in rows], np.int64)
        place = {int(i): k for k, i in enumerate(ids)}
        near = [[place[y] for y in r["near"] or () if y in place] for r in rows]
        for i, ys in enumerate(list(map(tuple, near))):  # search needs both directions
            for y in ys:
                near[y].append(i)
        lists = [np.unique(np.array(y, np.int64)) for y in near]
        medoid = int(np.argmax(x @ x.mean(0)))
        found = np.zeros((n, n), bool)
        for i in range(n):
            _, inside = greedy(x, lists, medoid, x[i], beam, threshold - 1e-9)
            found[i, inside] = True
        found |= found.T
        np.fill_diagonal(found, False)
        # the exact check: every pair of what the search has connected
        link, root = np.zeros((n, n), bool), roots(found)
        for r in np.unique(root[found.any(1)]):
            at = np.flatnonzero(root == r)
            link[np.ix_(at, at)] = x[at] @ x[at].T >= threshold
        link |= link.T
        np.fill_diagonal(link, False)
        return _result(rows, link, ids)

    return work


def _counter(threshold: float):
    """All links of a task by products of its vectors."""

    def work(rows: list) -> list:
        x = matrix([r["v"] for r in rows])
        link = np.triu(x @ x.T >= threshold, 1)
        return _result(rows, link | link.T, np.array([r["node"] for r in rows], np.int64))

    return work


COLUMNS = ["task", "shard", "own", "diag", "shards", "node", "copies", "v"]


def all_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """As graph_links(), of all pairs: every dimension is one shard, of which each two blocks are a task."""
    whole = nodes.select("node", "copies", "v", F.array(F.size("v").cast("long")).alias("shards"))
    return stored(_by_task(dealt_rows(whole, BLOCK), COLUMNS, _counter(threshold), "node long, links long, root long"), "found")


def graph_links(nodes: DataFrame, pivots: np.ndarray, threshold: float, overlap: int, beam: int, across: bool = True) -> DataFrame:
    """Per node: links (weighted by copies) and the roots of its tasks' forests; nodes: node, copies, v.

    across: whether nodes follow the united lists into their neighbours' shards.
    """
    placed = placed_rows(nodes, pivots, overlap, threshold)
    built = _by_task(dealt_rows(placed, BLOCK), ["task", "node", "v"], _builder(threshold), "node long, near array<long>, close array<long>")
    gathered = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    united = stored(built.groupBy("node").agg(gathered("near"), gathered("close")), "graph")
    if across:
        first = placed.select(F.col("node").alias("other"), F.col("shards")[0].alias("first"))
        edges = united.select("node", F.explode("close").alias("other"))
        edges = edges.union(edges.select("other", "node"))
        more = edges.join(first, "other").groupBy("node").agg(F.collect_set("first").alias("more"))
        placed = stored(placed.join(more, "node", "left").select("node", "copies", "v", F.array_union("shards", F.coalesce("more", F.expr("array()").cast("array<long>"))).alias("shards")), "placed")
    rows = dealt_rows(placed, BLOCK).join(united.select("node", "near"), "node")
    return stored(_by_task(rows, [*COLUMNS, "near"], _searcher(threshold, beam), "node long, links long, root long"), "found")


def audit(nodes: DataFrame, links: DataFrame, threshold: float) -> float | None:
    """Mean share of true links found, over sampled nodes that have some; None if none of them has. Truth is by brute force over all vectors."""
    order = nodes.select("node", "v").orderBy(F.xxhash64("node", F.lit(7)))
    queries = AUDIT
    while True:
        q = order.limit(queries).collect()
        rates = _audited(nodes, links, threshold, q) if q else []
        small = [r for r, n in rates if n <= SMALL_GROUP]
        if len(small) >= AUDIT_LINKED or len(q) < queries or queries >= AUDIT_MOST:
            return min(float(np.mean(x)) for x in (small, [r for r, _ in rates]) if x) if rates else None
        queries = min(AUDIT_MOST, 8 * queries)


def _audited(nodes: DataFrame, links: DataFrame, threshold: float, q: list) -> list[tuple[float, int]]:
    """(share of true links found, number of neighbours) of the nodes of q that have true links."""
    groups = [(np.array([r["node"] for r in q if len(r["v"]) == d], np.int64), matrix([r["v"] for r in q if len(r["v"]) == d])) for d in sorted({len(r["v"]) for r in q})]

    def count(batches):
        sums = [np.zeros((2, len(ids)), np.int64) for ids, _ in groups]
        for batch in batches:
            v, copies, node = batch.column(2).to_pylist(), np.array(batch.column(1)), np.array(batch.column(0))
            for (ids, x), held in zip(groups, sums, strict=True):
                same = np.array([i for i, r in enumerate(v) if len(r) == x.shape[1]], np.int64)
                for lo in range(0, len(same), 256):
                    part = same[lo : lo + 256]
                    near = (matrix([v[i] for i in part]) @ x.T >= threshold) & (node[part][:, None] != ids[None, :])
                    held += np.array([copies[part] @ near, near.sum(0)])
        for (ids, _), held in zip(groups, sums, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, held)], ["node", "truth", "near"])

    truth = nodes.select("node", "copies", "v").mapInArrow(count, "node long, truth long, near long").groupBy("node").agg(F.sum("truth").alias("truth"), F.sum("near").alias("near"))
    found = truth.where("truth > 0").join(links, "node", "left").select(F.least(F.coalesce("links", F.lit(0)), "truth") / F.col("truth"), "near").collect()
    return [(float(r[0]), int(r[1])) for r in found]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, beam: int = BEAM, target: float = TARGET) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept, recall (as audited, null if no true link was seen)."""
    all_rows = stored(usable(vectors).withColumn("vh", F.xxhash64("v")), "vectors")
    good = all_rows.where("v is not null").withColumn("vh", F.xxhash64("v"))
    nodes = stored(good.groupBy("vh").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")).withColumnRenamed("vh", "node"), "nodes")
    n, recall = nodes.count(), None
    if n:
        pivots = pivots_of(nodes, n, threshold)
        overlap = overlap_for(pivots, threshold, overlap)
        while True:
            whole = overlap > OVERLAP_MOST
            found = all_links(nodes, threshold) if whole else graph_links(nodes, pivots, threshold, overlap, beam)
            links = found.groupBy("node").agg(F.sum("links").alias("links"))
            recall = audit(nodes, links, threshold)
            if whole or recall is None or recall >= target:
                break
            overlap, beam = OVERLAP_MOST + 1 if overlap == OVERLAP_MOST else min(2 * overlap, OVERLAP_MOST), 2 * beam
        label = components(found, "node", "root", "balls")
        least = label.join(nodes, "node").groupBy("label").agg(F.min("rep").alias("component"))
        placed = nodes.join(links, "node", "left").join(label, "node", "left").join(least, "label", "left")
        placed = placed.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    else:
        placed = nodes.select("node", F.col("copies").alias("n_links"), F.col("rep").alias("component_id"))
    placed = stored(placed, "placed-nodes")  # plain exchanges on both sides of the last join: a vector of very many copies is split
    out = all_rows.withColumn("node", F.when(F.col("v").isNotNull(), F.col("vh"))).drop("v", "vh").join(placed, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select("*", (F.col("vec_id") == F.col("component_id")).alias("kept"), F.lit(recall).cast("double").alias("recall"))
