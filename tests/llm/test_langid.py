import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillspan.llm import langid
from tests.llm.fixtures import awkward, empty, prose


def test_awkward_rows_and_held_out_accuracy(spark):
    docs = awkward(spark, n=240)
    rows = langid.identify(docs.withColumn("truth", F.col("lang")), ["doc_id", "text", "truth"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = r["text"] is not None and any(map(str.isalpha, r["text"]))
        assert (r["lang_pred"] == "und") == (not letters)
        assert 0 <= r["score"] <= 1
    test = [r for r in rows if r["held_out"] and r["doc_id"] < 240]
    assert len(test) > 30
    assert sum(r["truth"] == r["lang_pred"] for r in test) / len(test) > 0.95
    assert all(not r["held_out"] for r in rows if r["doc_id"] is None)


def test_predictions_ignore_labels(spark):
    docs = awkward(spark, n=120)
    a = {(r["doc_id"], r["text"]): r["lang_pred"] for r in langid.identify(docs, ["doc_id", "text"]).collect()}
    other = docs.withColumn("lang", F.when(langid.fold(docs, 4) == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    b = {(r["doc_id"], r["text"]): r["lang_pred"] for r in langid.identify(other, ["doc_id", "text"]).collect()}
    assert a == b


def test_mixture_shares(spark):
    rng = random.Random(3)
    docs = awkward(spark, n=240)
    model = langid.fit(docs)
    text = prose(rng, "en", 120) + " " + prose(rng, "de", 60)
    _, share, shares = langid.infer([text, prose(rng, "fr", 80)], *model)
    assert set(shares[0]) == {"en", "de"} and abs(shares[0]["en"] - 2 / 3) < 0.1
    assert set(shares[1]) == {"fr"} and share[1] == 1


def test_nothing_to_learn(spark):
    docs = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(docs, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(empty(spark), ["doc_id"]).count() == 0


def plain(text, langs, logp):
    """Prediction and share of one text by loops: EM over its words, then language sets by BIC."""
    if text is None or not any(map(str.isalpha, text)):
        return "und", 0.0
    scores, _ = langid.word_scores([text], logp)
    words = [[math.exp(float(x) - max(map(float, w))) for x in w] for w in scores]

    def em(pi, rounds):
        for _ in range(rounds):
            new = [0.0] * len(langs)
            for w in words:
                total = max(sum(a * b for a, b in zip(w, pi, strict=True)), 1e-30)
                for k in range(len(langs)):
                    new[k] += w[k] * pi[k] / total
            pi = [x / len(words) for x in new]
        return pi, sum(math.log(max(sum(a * b for a, b in zip(w, pi, strict=True)), 1e-30)) for w in words)

    pi, _ = em([1 / len(langs)] * len(langs), langid.ROUNDS)
    order = sorted(range(len(langs)), key=lambda k: (-pi[k], k))
    best, bic = None, None
    for m in range(1, len(langs) + 1):
        start = [float(k == order[0]) if m == 1 else (pi[k] + 1e-3) * (k in order[:m]) for k in range(len(langs))]
        p, like = em([x / sum(start) for x in start], 0 if m == 1 else langid.ROUNDS // 2)
        new = -2 * like + (m - 1) * math.log(len(words) + 1)
        if bic is not None and new >= bic:
            break
        best, bic = p, new
    return langs[max(range(len(langs)), key=lambda k: best[k])], max(best)


def test_same_as_brute_force(spark):
    docs = awkward(spark)
    langs, logp = langid.fit(docs.select("doc_id", "text", "lang"))
    rng = random.Random(4)
    texts = [r["text"] for r in docs.collect() if len(r["text"] or "") < 5000] + [prose(rng, "en", n) + " " + prose(rng, "de", 20 - n) for n in range(0, 21, 4)]
    pred, share, shares = langid.infer(texts, langs, logp)
    for text, p, s, many in zip(texts, pred, share, shares, strict=True):
        name, top = plain(text, langs, logp)
        assert (p, round(float(s), 2)) == (name, round(top, 2)) or abs(s - top) < 0.01, text
        assert p == "und" or abs(sum(many.values()) - 1) < 1e-3
    assert max(map(len, shares)) > 1  # some texts are mixtures


def test_word_likelihoods_by_hand(spark):
    """Counts of n-gram bins of a language, smoothed, from the words of its texts."""
    table = spark.createDataFrame([(1, "ab b", "x"), (2, "ba", "y")], "doc_id long, text string, lang string")
    langs, logp = langid.fit(table)
    assert langs == ["x", "y"]
    for k, words in enumerate((["ab", "b"], ["ba"])):
        counts = np.full(1 << langid.BITS, langid.SMOOTH)
        for w in words:
            bins, _, _ = langid.grams([w.encode()])
            for b in bins.ravel():
                counts[b] += b >= 0
        assert np.allclose(logp[:, k], np.log(counts / counts.sum()), atol=1e-5)


def test_pieces_change_nothing(monkeypatch):
    rng = random.Random(6)
    texts = [prose(rng, "fr", n) for n in (1, 300, 2, 5, 400)] + ["x" * 900, "", "é " * 500]
    logp = np.log(np.random.default_rng(1).dirichlet([1, 1, 1], 1 << langid.BITS)).astype(np.float32)
    whole = langid.word_scores(texts, logp)
    monkeypatch.setattr(langid, "PIECE", 64)
    cut = langid.word_scores(texts, logp)
    assert np.array_equal(whole[1], cut[1]) and np.allclose(whole[0], cut[0])


def test_clashing_names_and_ties(spark):
    docs = awkward(spark).selectExpr("*", "1 as lang_pred", "2 as shares", "3 as __text")
    found = langid.identify(docs, docs.columns)
    assert len({c.lower() for c in found.columns}) == len(found.columns)
    tied = langid.infer(["qqq"], ["a", "b"], np.zeros((1 << langid.BITS, 2), np.float32))
    assert tied[0] == ["a"]
