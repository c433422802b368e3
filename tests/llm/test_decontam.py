import random

import numpy as np

from quillspan.llm import decontam
from tests.llm.fixtures import awkward, empty, prose

ITEM = "item_id long, text string, doc_id long"


def digest(docs, items, **options):
    return sorted((tuple(r)[:6] for r in decontam.digest(decontam.decontaminate(docs, items, **options)).collect()), key=repr)


def planted(spark):
    docs = awkward(spark)
    texts = [r["text"] for r in docs.where("doc_id < 20").orderBy("doc_id").collect()]
    rng = random.Random(1)
    items = [(i, " ".join(t.split()[:14]), 0) for i, t in enumerate(texts[:8])]
    items += [(50, "ZEBRA unseen words " * 6, 0), (51, None, 0), (52, "", 0), (53, "!!", 0), (54, "river stone", 0), (3, items[3][1], 0), (10, items[2][1], 0), (60, prose(rng, "de", 30), 0)]
    return docs, spark.createDataFrame(items, ITEM)


def expected(docs, items):
    pick = lambda df, c: [(r[c], r["text"]) for r in df.collect()]
    return sorted(decontam.brute_force(pick(docs, "doc_id"), pick(items, "item_id")), key=repr)


def test_same_as_brute_force(spark):
    docs, items = planted(spark)
    found = digest(docs, items)
    assert found == expected(docs, items)
    assert any(r[5] for r in found)


def shuffled(spark):
    """Documents of few words, items that are pieces of them with words moved, left out and put in."""
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(41, None), (42, "a")]
    items = []
    for i in range(25):
        w = (docs[i][1] or "").split()[3:16]
        for _ in range(i % 4):
            if len(w) > 2:
                k = rng.randrange(len(w) - 1)
                w[k], w[k + 1] = w[k + 1], w[k]
        items.append((i % 20, " ".join(w)))
    items += [(None, docs[3][1]), (70, "a"), (71, "b l")]
    return docs, items


def test_proximity_same_as_brute_force(spark):
    docs, items = shuffled(spark)
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    true = dict(zip((d for d, _ in docs), decontam.brute_near(docs, items), strict=True))
    assert sum(true.values()) > 20
    for block_words in (decontam.BLOCK_WORDS, 12):
        found = decontam.decontaminate(*tables, block_words=block_words)
        assert {r["doc_id"]: len(r["near_items"]) for r in found.collect()} == true


def test_blocks_are_bounded_and_lose_no_window():
    items = [("1", " ".join(f"w{i}" for i in range(50))), ("2", "a b"), ("3", None), ("4", "!"), ("5", "c " * 11)]
    whole = {(b.ids[o], tuple(w)) for b in decontam.blocks_of(items) for w, o in zip(*b.windows(), strict=True)}
    few = list(decontam.blocks_of(items, block_words=15))
    assert len(few) > 5 and all(b.words <= 15 for b in few)
    assert {(b.ids[o], tuple(w)) for b in few for w, o in zip(*b.windows(), strict=True)} == whole


def test_blocks_give_the_same(spark):
    docs, items = planted(spark)
    assert digest(docs, items, block_words=60) == expected(docs, items)


def test_small_segments_give_the_same(spark, monkeypatch):
    docs, items = planted(spark)
    monkeypatch.setattr(decontam, "SEGMENT_BYTES", 100)
    assert digest(docs, items) == expected(docs, items)


def test_empty_tables(spark):
    docs, items = planted(spark)
    assert digest(empty(spark), items) == []
    assert not any(r[5] for r in digest(docs, items.where("1 = 0")))


def test_proximity_finds_moved_words(spark):
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:5] + ["extra"] + words[5:])), (3, " ".join(reversed(words)))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontam.decontaminate(docs, items, slop=1).collect()}
    assert found[1]["items"] == ["7"] and found[1]["near_items"] == []
    assert found[2]["items"] == [] and found[2]["near_items"] == ["7"]
    assert found[3]["items"] == [] and found[3]["near_items"] == []


def test_intersect_starts_with_the_rarest():
    # term 0 stands at every place, term 1 once
    keys = np.array([*range(100), (1 << 32) | 40], np.int64)
    who, start = decontam.intersect(keys, np.array([100, 1]), np.array([[0, 1, 0]]), 0)
    assert who.tolist() == [0] and start.tolist() == [39]
