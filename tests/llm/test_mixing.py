import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillspan.llm import mixing
from tests.llm.fixtures import awkward, empty


def water_fill(sizes):
    """Targets by repeated resharing, stated anew."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = (total - sum(out.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return out


def planned(docs):
    return mixing.plan(docs, ["doc_id", "source"]).withColumn("taken", mixing.taken()).collect()


def test_targets_quotas_and_reruns(spark):
    docs = awkward(spark)
    rows = planned(docs)
    assert len(rows) == docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["__size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["__size"]
    expected = water_fill(sizes)
    for s in sizes:
        assert abs(target[s] - expected[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= max(2, 0.01 * target[s])
    key = lambda rs: sorted((repr((r["doc_id"], r["source"], r["__size"], r["taken"])) for r in rs))
    assert key(planned(docs.repartition(7))) == key(rows)


def test_sizes(spark):
    texts = ["a b", "", "  ", None, "a\u00a0b c\x0bd\x0c\te", "x" * 10]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(mixing.size_of(F.col("text"))).collect()] == [2, 0, 0, 0, 4, 1]


def test_tree_meets_quotas_exactly():
    quota = np.array([1000, 37, 0, 5], np.int64)
    parts = np.zeros((4, 16), np.int64)
    for shard, who, n in mixing.split_tree(quota, 16, 3):
        assert (n > 0).all()
        parts[who, shard] = n
    assert (parts.sum(1) == quota).all()
    assert set(parts.sum(0)) <= {quota.sum() // 16, quota.sum() // 16 + 1}


def test_draws_follow_the_hypergeometric_distribution():
    """Against the exact probabilities of small urns, and the moments of urns beyond 10**9."""
    rng = np.random.default_rng(5)
    for good, bad, n in ((5, 7, 4), (1, 30, 15), (40, 2, 20), (3, 3, 6), (0, 4, 2)):
        got = Counter(mixing.hypergeometric(rng, good, bad, n) for _ in range(4000))
        for k in range(n + 1):
            p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) if k <= good else 0
            assert abs(got[k] / 4000 - p) < 5 * (p * (1 - p) / 4000) ** 0.5 + 1e-12
    good, bad, n = 9_000_000_000, 7_000_000_000, 8_000_000_000
    draws = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(200)], float)
    total = good + bad
    mean, sd = n * good / total, (n * good / total * bad / total * (total - n) / (total - 1)) ** 0.5
    assert abs(draws.mean() - mean) < 5 * sd / 200**0.5 and 0.8 < draws.std() / sd < 1.2
    left = mixing.draw(rng, np.array([3 * 10**9, 10**10, 5, 0]), 6 * 10**9)
    assert left.sum() == 6 * 10**9 and left[2] <= 5 and left[3] == 0


def test_equal_rows_are_numbered(spark):
    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 7, id) as h", "id % 2 as x").repartition(5).withColumn("rid", F.monotonically_increasing_id())
    found = mixing.numbered(mixing.stored(rows, "t")).collect()
    assert len(found) == 1000 and len({r["h2"] for r in found}) == 1000 == len({r["rid"] for r in found})


def test_many_shards_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 7)
    monkeypatch.setattr(mixing, "TREE_CELLS", 50)
    docs = awkward(spark)
    rows = mixing.plan(docs, ["doc_id", "source"], shards=500).collect()
    plain = mixing.plan(docs, ["doc_id", "source"], shards=3).withColumn("taken", mixing.taken()).collect()
    assert len(rows) == docs.count()
    assert sum(p["n"] for r in rows for p in r["pieces"]) == sum(r["taken"] for r in plain)
    assert {p["shard"] for r in plain for p in r["pieces"]} == {0, 1, 2} and len({p["shard"] for r in rows for p in r["pieces"]}) > 300


def test_shards_follow_the_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 400)
    shards = {r["shard"] for r in mixing.mix(awkward(spark)).collect()}
    assert len(shards) > 100 and shards == set(range(len(shards)))


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 99).tolist()) == list(range(n))


def test_mixture_pieces(spark):
    docs = awkward(spark)
    rows = mixing.mix(docs).collect()
    plans = planned(docs)
    assert sum(r["n_words"] for r in rows) == sum(r["taken"] for r in plans)
    held = defaultdict(set)
    for r in docs.collect():
        held[r["doc_id"]].add(r["text"])
    for r in rows:
        assert any(t is not None and r["text"] in t for t in held[r["doc_id"]])
    shards = Counter()
    for r in rows:
        shards[r["shard"]] += r["n_words"]
    assert len(shards) == mixing.LEAST_SHARDS


def test_empty(spark):
    assert mixing.plan(empty(spark), ["doc_id"]).count() == 0
    assert mixing.mix(empty(spark)).count() == 0
