"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its distinct words, each of which weighs as
much as itself and its beginnings (of STARTS characters, so that unseen words of a known stem count) together; the
document's score is the noisy-or of its sentences' scores, 1 - prod(1 - p). The weights are trained from document labels
alone, by full-batch gradient steps on the noisy-or likelihood with an L1 proximal step, then the sentence scores locate
offending sentences.

The classifier is fitted on a bounded sample of the labelled rows (rows are taken by a hash of doc_id and text): about
FIT_ROWS whole documents and FIT_CHARS characters, and none of more than FIT_CHARS / 64 characters; so it takes one task
of bounded size. Features of fewer than MIN_DOCS of the sample's documents have no weight. Everything else reads every
row, whole texts.

Defined cases: null and empty texts have no sentence and take the score 0; without a label to learn from every score is 0;
a null doc_id is neither learned from nor held out; repeated label rows count as often as they stand; a kept column with
the name of an added one gives way; other extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import FOLD, with_text, without
from quillspan.llm.langid import fold

FIT_ROWS = 12_000
FIT_CHARS = 64 << 20
BITS = 18
MIN_DOCS = 4
STARTS = (3, 5, 7)
ROUNDS = 150
RATE = 0.15
L1 = 2e-4
START = -9.0
OUT = ("double", "int", "array<struct<start:int,stop:int,score:double>>")

_SPLIT = bytes(0x0A if c in b".!?\n" else FOLD[c] for c in range(256))
_sentence = re.compile(r"[^.!?\n]*[^.!?\n\s][^.!?\n]*[.!?]*")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, stop) of the sentences of a whole text: they end at . ! ? or a line end; those without text are left out."""
    return [(m.start(), m.end()) for m in _sentence.finditer(text or "")]


def features(word: bytes) -> list[int]:
    """The bins of a word and of its beginnings."""
    read = word.decode("utf-8", "replace")
    starts = [f"\x00{read[:k]}".encode("utf-8", "replace") for k in STARTS if len(read) > k]
    return [xxhash.xxh3_64_intdigest(x) >> (64 - BITS) for x in (word, *starts)]


def bag(text: str | None) -> list[set[bytes]]:
    """The distinct words of each sentence; a sentence here is a stretch with at least a word."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT).split(b"\n")
    return [set(words) for part in parts if (words := part.split())]


class Weights(dict):
    """Word to the sum of its features' weights; emptied when it grows large."""

    def __init__(self, w: np.ndarray):
        super().__init__()
        self.w = w

    def __missing__(self, word: bytes) -> float:
        if len(self) > 500_000:
            self.clear()
        self[word] = s = float(self.w[features(word)].sum())
        return s


def noisy_or(bags: list[set[bytes]], weights: Weights, bias: float) -> float:
    """1 - prod(1 - p) over the sentences, 0 without any."""
    if not bags:
        return 0.0
    z = np.array([sum(map(weights.__getitem__, sorted(words))) for words in bags]) + bias
    return float(-np.expm1(-np.logaddexp(0, z).sum()))


def instances(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sentence and the word (a number) of every instance's word, the document of every sentence, and the word and the bin of every feature."""
    number: dict[bytes, int] = {}
    s, w, d = array("i"), array("i"), array("i")
    for i, text in enumerate(texts):
        for words in bag(text):
            w.extend([number.setdefault(word, len(number)) for word in sorted(words)])
            s.append(len(words))
            d.append(i)
    size, flat = array("i"), array("i")
    for word in number:
        bins = features(word)
        size.append(len(bins))
        flat.extend(bins)
    plain = lambda x: np.array(x, np.int32)
    return np.repeat(np.arange(len(d), dtype=np.int32), plain(s)), plain(w), plain(d), np.repeat(np.arange(len(size), dtype=np.int32), plain(size)), plain(flat)


def seen_in(s: np.ndarray, word: np.ndarray, d: np.ndarray, of: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The number of documents that hold each bin; some hundred documents at a time."""
    size, begin = np.bincount(of), np.flatnonzero(np.diff(of, prepend=-1))
    seen, doc = np.zeros(1 << BITS, np.int64), d[s]
    for lo in range(0, int(d[-1]) + 1, 256):
        a, b = np.searchsorted(doc, [lo, lo + 256])
        pair = np.unique((doc[a:b].astype(np.int64) << 32) | word[a:b])
        which = pair & 0xFFFFFFFF
        n = size[which]
        at = np.repeat(begin[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        held = np.unique((np.repeat(pair >> 32, n) << BITS) | flat[at])
        seen += np.bincount(held & ((1 << BITS) - 1), minlength=1 << BITS)
    return seen


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """Weights of the bins and the intercept."""
    full, y = np.zeros(1 << BITS), np.array(labels, float)
    s, word, d, of, flat = instances(texts)
    if not len(d) or not any(labels):
        return full, START * 10
    n, n_words = len(d), int(of[-1]) + 1
    used = np.flatnonzero(seen_in(s, word, d, of, flat) >= MIN_DOCS)
    code = np.full(1 << BITS, -1)
    code[used] = np.arange(len(used))
    of, b = of[code[flat] >= 0], code[flat[code[flat] >= 0]]
    weighed = np.zeros(n_words, bool)
    weighed[of] = True
    s, word = s[weighed[word]], word[weighed[word]]
    w = np.zeros(len(used))
    bias, m, v, mb, vb = START, np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z = np.bincount(s, np.bincount(of, w[b], n_words)[word], n) + bias
        log_not = -np.logaddexp(0, z)  # log(1 - p) of a sentence
        clean = np.exp(np.minimum(np.bincount(d, log_not, len(y)), -1e-9))
        p = 1 / (1 + np.exp(-z))
        # d loss / d z: p for clean bags, -p * q / (1 - q) for toxic ones, q the bag's clean probability
        g = p * np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0)[d] / len(y)
        grad, gb = np.bincount(b, np.bincount(word, g[s], n_words)[of], len(used)), g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        step = RATE / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = w - step * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(step, 1e3) * L1, 0)
        bias -= RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    full[used] = w
    return full, float(bias)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """labelled: (doc_id, text, chars, toxic); chars: the text's length, so that counting needs no text beyond the scan."""
    usable = labelled.where("toxic is not null").where(F.col("chars") <= FIT_CHARS // 64)
    n, chars = usable.agg(F.count(F.lit(1)), F.sum("chars")).first()
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = usable.where(part < min(fit_rows / max(n, 1), FIT_CHARS / max(chars or 0, 1))).select("text", "toxic").repartition(1)

    def run(batches):
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += [int(x > 0) for x in batch.column(1).to_pylist()]
        order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))  # sums don't depend on the order of arrival
        w, bias = train([texts[i] for i in order], [labels[i] for i in order])
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([float(bias)])], ["w", "bias"])

    rows = sample.mapInArrow(run, "w binary, bias double").collect()  # a row of 1 MB
    return (np.frombuffer(rows[0]["w"], np.float32), rows[0]["bias"]) if rows else (np.zeros(1 << BITS, np.float32), START * 10)


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], locate: float | None = None, prefix: str = "") -> DataFrame:
    """The columns of keep with score and n_sentences, under names with the prefix; locate: also the sentences that score as much, with character offsets."""
    w, bias = model
    added = [f"{prefix}{c}" for c in ("score", "n_sentences", "sentences")]
    keep = without(keep, added)
    picked = with_text(docs, keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def run(batches):
        weights = Weights(w)
        for batch in batches:
            out, counts, spans = [], [], []
            for text in batch.column(len(keep)):
                text = text.as_py()
                bags = bag(text)
                out.append(noisy_or(bags, weights, bias))
                counts.append(len(bags))
                found = []
                if locate is not None and out[-1] >= locate:
                    for a, e in sentences(text):
                        p = noisy_or(bag(text[a:e]), weights, bias)
                        if p >= locate:
                            found.append({"start": a, "stop": e, "score": p})
                spans.append(found)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64()), pa.array(counts, pa.int32()), pa.array(spans, kind)], [*keep, *added])

    return picked.mapInArrow(run, ", ".join([*([schema] if schema else []), *(f"`{c}` {t}" for c, t in zip(added, OUT, strict=True))]))


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str], fit_rows: int = FIT_ROWS, locate: float | None = 0.5, prefix: str = "") -> DataFrame:
    """Fits on labelled rows that aren't held out, scores every row."""
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic"))
    labelled = docs.where(fold(docs, 5) != 0).select("doc_id", "text", F.length("text").alias("chars")).join(known, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "chars", F.col("__toxic").alias("toxic"))
    model = fit(labelled, fit_rows)
    held_out = f"{prefix}held_out"
    return score(docs.withColumn(held_out, F.coalesce(fold(docs, 5) == 0, F.lit(False))), model, [*without(keep, [held_out]), held_out], locate, prefix)
