import random

from quillspan.llm import ngramjoin
from tests.llm.fixtures import awkward, empty

LAST = ngramjoin.LAST


def brute(rows):
    h = ngramjoin.Hashes()
    sets = [set(ngramjoin.gram_set(t, h).tolist()) for _, t in rows]
    keys = [LAST if i is None else i for i, _ in rows]
    links, comp = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and inter >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                comp[find(a)] = find(b)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), LAST), keys[i])
    return sorted((keys[i], least[find(i)], links[i]) for i in range(len(rows)))


def near_copies(n=80, seed=1):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        words = base[:]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(150)] = f"x{rng.randrange(1000)}"
        rows.append((1000 + i, " ".join(words)))
    return rows


def run(docs, **options):
    return sorted((r["key"], r["class_key"], r["n_links"]) for r in ngramjoin.join(docs, **options).collect())


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert run(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_large_group_in_blocks(spark):
    rows = near_copies() + [(5, "a b c"), (6, "A, b. c"), (7, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = brute(rows)
    assert run(docs) == truth
    assert run(docs, block=16) == truth


def test_chains_are_verified_by_bucket(spark):
    """Each text is like the next ones only: a long group without a large bucket."""
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 150])) for i in range(60)] + near_copies(20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bands = ngramjoin.bands_for()
    nodes = ngramjoin.signatures(docs, *bands).select("node", "n_grams", "bands")
    units = ngramjoin.units_of(nodes, 2, 10**6)
    assert units.where("units is not null").count() and not ngramjoin.units_of(nodes, 100, 10**6).where("units is not null").count()
    truth = brute(rows)
    for block in (2, 3, 100):
        assert run(docs, block=block) == truth
    assert run(docs, block_grams=300) == truth


def test_both_ways_of_counting_agree():
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(12)]
    cand = np.triu(np.ones((12, 12), bool), 1)
    got = ngramjoin.common_counts(sets, cand)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(12) for j in range(i + 1, 12))


def test_bands_reach_the_recall():
    bands, rows = ngramjoin.bands_for()
    assert bands * rows <= ngramjoin.MAX_HASHES and 1 - (1 - 0.8**rows) ** bands >= ngramjoin.RECALL


def test_one_of_each(spark):
    docs = awkward(spark)
    kept = ngramjoin.one_of_each(docs, ngramjoin.join(docs))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 0 in ids and 105 not in ids and 100 in ids and 101 in ids
    assert len(ids) == len(set(ids))


def test_empty(spark):
    assert ngramjoin.join(empty(spark)).count() == 0


def test_wordless_rows_stay_apart(spark):
    rows = [(None, None), (None, None), (None, "--"), (None, "--"), (7, None), (7, None), (None, "a b c"), (None, "a b c"), (3, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in ngramjoin.one_of_each(docs, ngramjoin.join(docs)).collect()]
    assert sorted(kept, key=repr) == sorted([*rows[:6], (3, "a b c")], key=repr)
