"""Language identification by multilingual mixture inference.

fit() counts hashed byte n-grams of words for each language; score() gives every word of a document a log-likelihood
under each language, estimates the document's language proportions by expectation-maximisation over its words, and
selects the language set by penalised likelihood (BIC): sets grow by the language of the next-largest proportion while
the penalised likelihood improves. All documents of an Arrow batch go through each step together.

The model is fitted on about FIT_ROWS whole documents of each of the MOST_LANGS most frequent languages at most
(documented bounds; rows are taken by a hash of doc_id and text). Everything else reads every row. Predictions depend on
the text alone. Texts are read in pieces of PIECE bytes; besides, a task holds 4 bytes a language for each word of PIECE
bytes of text or of one document.

Defined cases: a null text, or one without a letter, gives `und` with score 0; with nothing to learn from (no labelled
rows) every text gives `und`; a null doc_id is neither learned from nor held out; ties go to the first language by code
point; repeated rows change nothing; a kept column with the name
of an added one gives way; other extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import with_text, without

FIT_ROWS = 1500
MOST_LANGS = 1024
PIECE = 1 << 20
BITS = 15
SMOOTH = 0.2
ROUNDS = 12

_word = np.zeros(256, bool)
_word[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_fold = np.arange(256, dtype=np.uint8)
_fold[0x41:0x5B] += 32
_letter = np.zeros(256, bool)
_letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def texts_at_once(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A few MB of text at a time, or one document."""
    lengths, lo = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(lengths[lo:]), PIECE)))
        yield batch.slice(lo, hi - lo)
        lo = hi


def pieces(texts: list[str]) -> Iterator[tuple[list[bytes], int]]:
    """The texts as bytes with the number of the first, at most about PIECE bytes at a time: a longer text is cut between words."""
    raw, first, size = [], 0, 0
    for i, text in enumerate(texts):
        t = text.encode("utf-8", "surrogatepass")
        if raw and size + len(t) > PIECE:
            yield raw, first
            raw, first, size = [], i, 0
        while len(t) > PIECE:
            outside = np.flatnonzero(~_word[np.frombuffer(t, np.uint8, PIECE)])
            cut = int(outside[-1]) + 1 if len(outside) else next((k for k in range(PIECE, len(t)) if not _word[t[k]]), len(t))
            yield [t[:cut]], i
            t = t[cut:]
            first = i
        raw.append(t)
        size += len(t)
    if raw:
        yield raw, first


def grams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a few texts: the hashed n-gram bins at each byte of a word [bytes, 3], the word of each byte, the text of each word."""
    data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    inside = _word[data]
    begins = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    folded = np.where(inside, _fold[data], 0).astype(np.uint32)
    at = np.flatnonzero(inside)
    word = np.cumsum(np.isin(at, begins, assume_unique=True)) - 1
    one, two = folded[at - 1], folded[np.maximum(at - 2, 0)] * (folded[at - 1] > 0)
    three, after = folded[np.maximum(at - 3, 0)] * (two > 0), folded[at + 1] == 0
    mix = lambda x: ((x * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
    tri = folded[at] | (one << 8) | (two << 16)
    bins = np.stack([mix(tri + np.uint32(0x3000000)), mix((tri | (three << 24)) ^ np.uint32(0x5BD1E995)), np.where(after, mix(tri ^ np.uint32(0x1B873593)), -1)], 1)
    ends = np.cumsum([len(r) + 1 for r in raw])
    return bins, word, np.searchsorted(ends, begins, "right")


def word_scores(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log-likelihood of every word under each language, and the text of each word."""
    scores, docs = [np.zeros((0, logp.shape[1]), np.float32)], [np.zeros(0, np.int64)]
    for raw, first in pieces(texts):
        bins, word, doc = grams(raw)
        if len(word):
            ll = (logp[bins[:, 0]] + logp[bins[:, 1]] + np.where(bins[:, 2:] >= 0, logp[bins[:, 2]], 0)).astype(np.float32)
            scores.append(np.add.reduceat(ll, np.flatnonzero(np.diff(word, prepend=-1)), axis=0))
            docs.append(doc + first)
    return np.concatenate(scores), np.concatenate(docs)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """labelled: (doc_id, text, lang). Returns the languages and log-probabilities [bins, languages]."""
    usable = labelled.where("text is not null and lang is not null")
    # a row a language, as the model below has; texts aren't shuffled by so skewed a key
    known = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS)
    rates = {r["lang"]: fit_rows / r["count"] for r in known.collect()}
    if not rates:
        return [], np.zeros((1 << BITS, 0), np.float32)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    rate = F.create_map(*(F.lit(x) for pair in rates.items() for x in pair))
    sample = usable.where(part < F.try_element_at(rate, F.col("lang"))).select("lang", "text")

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for few in texts_at_once(batch, 1):
                langs = few.column(0).to_pylist()
                names = sorted(set(langs))
                for raw, first in pieces(few.column(1).to_pylist()):
                    bins, word, doc = grams(raw)
                    own = np.searchsorted(names, np.array(langs))[first + doc[word]] if len(word) else np.empty(0, int)
                    for i, name in enumerate(names):
                        b = bins[own == i].ravel()
                        seen[name] = seen.get(name, 0) + np.bincount(b[b >= 0], minlength=1 << BITS)
        for name, c in seen.items():
            nz = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(nz)), pa.array(nz), pa.array(c[nz].astype(np.int64))], ["lang", "bin", "n"])

    rows = sample.mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("bins"))
    table = {r["lang"]: r["bins"] for r in rows.toLocalIterator()}  # at most 2**BITS bins for each language
    langs = sorted(table)
    counts = np.full((1 << BITS, len(langs)), SMOOTH)
    for k, name in enumerate(langs):
        counts[[b for b, _ in table[name]], k] += [n for _, n in table[name]]
    return langs, np.log(counts / counts.sum(0)).astype(np.float32)


def infer(texts: list[str | None], langs: list[str], logp: np.ndarray) -> tuple[list[str], np.ndarray, list[dict]]:
    """The predicted language, its share, and the shares of the selected set, for each text."""
    n, k = len(texts), len(langs)
    usable = [t if t is not None and any(map(str.isalpha, t)) else "" for t in texts] if k else [""] * n
    share, best = np.zeros((n, max(k, 1))), np.zeros((n, max(k, 1)), bool)
    q, doc = word_scores(usable, logp)
    if len(q):
        top = q.max(1)
        q = np.exp(q - top[:, None])
        heads = np.flatnonzero(np.diff(doc, prepend=-1))
        docs, size = doc[heads], np.diff(np.r_[heads, len(doc)])
        of = np.repeat(np.arange(len(docs)), size)

        def em(pi, which, rounds):
            """Proportions and log-likelihoods of the chosen documents."""
            rows = np.flatnonzero(np.isin(of, which)) if len(which) < len(docs) else slice(None)
            qq, sz = q[rows], size[which]
            h, o = np.cumsum(sz) - sz, np.repeat(np.arange(len(which)), sz)
            for _ in range(rounds):
                r = qq * pi[o]
                r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
                pi = np.add.reduceat(r, h, axis=0) / sz[:, None]
            like = np.log(np.maximum((qq * pi[o]).sum(1), 1e-30))
            return pi, np.add.reduceat(like.astype(np.float64), h)

        every = np.arange(len(docs))
        pi, _ = em(np.full((len(docs), k), 1 / k, np.float32), every, ROUNDS)
        order = np.argsort(-pi, axis=1, kind="stable")
        chosen = np.zeros((len(docs), k), np.float32)
        chosen[every, order[:, 0]] = 1
        _, like = em(chosen, every, 0)
        bic, active = -2 * like, every
        for m in range(2, k + 1):
            keep = np.zeros((len(active), k), np.float32)
            np.put_along_axis(keep, order[active, :m], 1, 1)
            start = pi[active] * keep + 1e-3 * keep
            p, like = em(start / start.sum(1, keepdims=True), active, ROUNDS // 2)
            new = -2 * like + (m - 1) * np.log(size[active] + 1)
            won = new < bic[active]
            chosen[active[won]], bic[active[won]] = p[won], new[won]
            active = active[won]
            if not len(active):
                break
        share[docs] = chosen
        best[docs] = chosen > 0
    pred = [langs[i] if s else "und" for i, s in zip(share.argmax(1), best.any(1), strict=True)]
    return pred, share.max(1).clip(0, 1), [{langs[j]: float(share[i, j]) for j in np.flatnonzero(best[i])} for i in range(n)]


def score(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], prefix: str = "") -> DataFrame:
    """The columns of keep with lang_pred, score and shares added, under names with the prefix."""
    langs, logp = model
    added = [f"{prefix}{c}" for c in ("lang_pred", "score", "shares")]
    keep = without(keep, added)
    picked = with_text(docs, keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            for few in texts_at_once(batch, len(keep)):
                pred, share, shares = infer(few.column(len(keep)).to_pylist(), langs, logp)
                add = [pa.array(pred, pa.string()), pa.array(share, pa.float64()), pa.array([list(s.items()) for s in shares], pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*few.columns[:-1], *add], [*keep, *added])

    return picked.mapInArrow(run, ", ".join([*([schema] if schema else []), *(f"`{c}` {t}" for c, t in zip(added, ("string", "double", "map<string,double>"), strict=True))]))


def fold(docs: DataFrame, modulus: int):
    """crc32 of doc_id as text, modulo; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def identify(docs: DataFrame, keep: list[str], fit_rows: int = FIT_ROWS, prefix: str = "") -> DataFrame:
    """Fits on the rows that aren't held out, predicts every row."""
    model = fit(docs.where(fold(docs, 4) != 2).select("doc_id", "text", "lang"), fit_rows)
    held_out = f"{prefix}held_out"
    return score(docs.withColumn(held_out, F.coalesce(fold(docs, 4) == 2, F.lit(False))), model, [*without(keep, [held_out]), held_out], prefix)
