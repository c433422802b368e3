import math
import random
import re

import numpy as np
import xxhash

from quillspan.llm import toxicity
from tests.llm.fixtures import awkward, empty, prose


def corpus(spark, n=600):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        parts = [prose(rng, "en", rng.randint(4, 10)).replace(".", "") + "." for _ in range(rng.randint(2, 12))]
        if bad:
            parts[rng.randrange(len(parts))] = f"the {rng.choice(['vile', 'rotten', 'nasty'])} river stone."
        rows.append((i, " ".join(parts)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_and_located(spark):
    docs, labels = corpus(spark)
    rows = toxicity.toxicity(docs, labels, ["doc_id", "text"]).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 60
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    bad = [r for r in rows if r["doc_id"] % 4 == 0 and r["score"] >= 0.5]
    spans = [r["text"][s["start"] : s["stop"]] for r in bad for s in r["sentences"]]
    assert spans and np.mean([any(w in s for w in ("vile", "rotten", "nasty")) for s in spans]) > 0.95


def plain(text, weigh, bias):
    """Noisy-or of the sentences' logistic scores, word by word."""
    clean, some = 1.0, False
    for part in re.split(r"[.!?\n]", text or ""):
        words = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), part)))
        if words:
            some = True
            z = bias + sum(weigh(w) + sum(weigh("\0" + w[:k]) for k in toxicity.STARTS if len(w) > k) for w in words)
            clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean if some else 0.0


def test_scores_same_as_brute_force(spark):
    docs = awkward(spark)
    w = np.random.default_rng(3).normal(0, 1, 1 << toxicity.BITS).astype(np.float32)
    weigh = lambda x: float(w[xxhash.xxh3_64_intdigest(x.encode()) >> (64 - toxicity.BITS)])
    rows = toxicity.score(docs, (w, -3.0), ["doc_id", "text"], 0.3).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert abs(r["score"] - plain(r["text"], weigh, -3.0)) < 1e-6
        for s in r["sentences"]:
            assert abs(s["score"] - plain(r["text"][s["start"] : s["stop"]], weigh, -3.0)) < 1e-6


def test_gradient_steps_lower_the_loss():
    texts = [f"good word{i}. {'badly done. ' if i % 3 == 0 else ''}fine day" for i in range(60)] + ["badness again", "a fine one"]
    w, bias = toxicity.train(texts, [int(i % 3 == 0) for i in range(60)] + [1, 0])
    weights = toxicity.Weights(w)
    assert toxicity.noisy_or(toxicity.bag("they behaved badly"), weights, bias) > 0.5
    assert toxicity.noisy_or(toxicity.bag("a baddish day"), weights, bias) > toxicity.noisy_or(toxicity.bag("a good day"), weights, bias)  # by its beginning
    assert toxicity.noisy_or([], weights, bias) == 0


def test_clashing_names(spark):
    docs, labels = corpus(spark, 60)
    docs = docs.selectExpr("*", "1 as toxic", "2 as __id", "'x' as held_out", "'y' as score", "0 as Sentences")
    found = toxicity.toxicity(docs, labels.selectExpr("*", "'z' as text"), docs.columns)
    assert found.columns == ["doc_id", "text", "toxic", "__id", "held_out", "score", "n_sentences", "sentences"]
    assert found.count() == 60 and dict(found.dtypes)["score"] == "double"


def test_ties_and_repeats(spark):
    docs, labels = corpus(spark, 60)
    one = {(r["doc_id"], r["score"]) for r in toxicity.toxicity(docs.union(docs), labels, ["doc_id"]).collect()}
    assert len(one) == 60


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels, docs.columns, prefix="__").collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["__score"] <= 1 for r in rows)
    assert all(r["__score"] == 0 for r in rows if not (r["text"] or "").strip())
    nothing = toxicity.toxicity(docs, labels.where("1 = 0"), ["doc_id"]).collect()
    assert all(r["score"] < 0.5 for r in nothing)
    assert toxicity.toxicity(empty(spark), labels, ["doc_id"]).count() == 0
