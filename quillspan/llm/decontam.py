"""Benchmark decontamination by a distributed positional inverted index.

build_index() cuts the corpus into document-sharded segments and stores, for every segment, the posting lists of all its
words: sorted (term, position), positions counted over the segment with a gap between documents. It knows nothing of a
test set, so one index serves every block of windows and every test set. search() takes the test windows and, segment by
segment, starts from the posting list of each window's rarest term and intersects it with the offset-adjusted lists of its
other terms, rarest first. Exact matches have every term at its place; proximity matches have an alignment of the window
at which every term stands within `slop` words of its place. A segment holds at most SEGMENT_BYTES of text or one
document, so memory doesn't grow with the corpus; nothing is shuffled by term, so common words make no hot task.

Terms are 64-bit hashes of words (xxh3). The test set is streamed through the driver; windows go to the executors in
blocks of at most BLOCK_WORDS words, counted as they are made (a longer item is split between windows), and every block
is a pass over the stored index.

Defined cases: null or wordless texts have no words and no hits; null or wordless items match nothing; rows with a null
item_id mark their words but are not listed; repeated items or rows count once by item_id; every input row gives a row;
an item that a document holds exactly is not listed as a proximity match too; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import stored, words_of

WINDOW = 10
SEGMENT_BYTES = 8 << 20
BLOCK_WORDS = 250_000
SLOP = 2
GAP = 64

MATCH = "seg string, place int, doc_id long, key long, n_words long, hits array<int>, items array<string>, near_items array<string>"


def term(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & 0x7FFFFFFFFFFFFFFF


class Block:
    """Items of a test set, or parts of long ones: their ids and their terms, one after the other."""

    def __init__(self, width: int = WINDOW):
        self.width, self.ids, self.parts = width, [], []
        self.words = 0

    def add(self, item_id: str | None, terms: np.ndarray) -> None:
        self.ids.append(item_id), self.parts.append(terms)
        self.words += len(terms)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(terms[w, width] padded with -1, item index of each window)."""
        made = [np.full((0, self.width), -1, np.int64)]
        for t in self.parts:
            if len(t) < self.width:
                made.append(np.append(t, np.full(self.width - len(t), -1, np.int64))[None])
            else:
                made.append(np.lib.stride_tricks.sliding_window_view(t, self.width))
        return np.concatenate(made), np.repeat(np.arange(len(self.parts)), [len(m) for m in made[1:]])


def blocks_of(items: Iterator[tuple], width: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """Blocks of (item_id, text) rows; at most block_words words each, and windows aren't lost where an item is split."""
    block = Block(width)
    for item_id, text in items:
        terms = np.array([term(w) for w in words_of(text)], np.int64)
        step = max(1, block_words - width + 1)  # windows of a part
        for lo in range(0, max(1, len(terms) - width + 1) if len(terms) else 0, step):
            part = terms[lo : lo + step + width - 1]
            if block.words and block.words + len(part) > block_words:
                yield block
                block = Block(width)
            block.add(item_id, part)
    if block.words:
        yield block


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    ids, keys, texts, size = [], [], [], 0
    for batch in batches:
        for i, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            t = t.as_py()
            if texts and size + len(t or "") > SEGMENT_BYTES:
                yield ids, keys, texts
                ids, keys, texts, size = [], [], [], 0
            ids.append(i), keys.append(k), texts.append(t)
            size += len(t or "")
    if texts:
        yield ids, keys, texts


INDEX = "seg string, doc_ids array<long>, keys array<long>, starts array<int>, n_words array<int>, terms binary, offsets binary, positions binary"


class _Codes(dict):
    """Word to a number, in the order of their coming."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def build_index(docs: DataFrame) -> DataFrame:
    """The index: a row per segment with its documents, its terms (sorted) and the posting list of each."""

    def build(batches):
        for ids, keys, texts in _segments(batches):
            codes, parts, starts, counts, at = _Codes(), [], [], [], 0
            for text in texts:
                words = words_of(text)
                starts.append(at), counts.append(len(words))
                parts.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                at += len(words) + GAP
            code = np.concatenate(parts)
            place = np.arange(len(code), dtype=np.int64) + np.repeat(np.array(starts) - (np.cumsum(counts) - counts), counts)
            terms = np.fromiter(map(term, codes), np.int64, len(codes))
            terms, own = np.unique(terms, return_inverse=True)
            code = own[code] if len(code) else code
            order = np.argsort(code.astype(np.uint32), kind="stable")  # places already ascend within a term
            offsets = np.append(0, np.cumsum(np.bincount(code, minlength=len(terms)))).astype(np.int32)
            one = [[uuid.uuid4().hex], [ids], [keys], [starts], [counts], [terms.tobytes()], [offsets.tobytes()], [place[order].astype(np.int32).tobytes()]]
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            names = ["seg", "doc_ids", "keys", "starts", "n_words", "terms", "offsets", "positions"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(one, kinds, strict=True)], names)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return picked.mapInArrow(build, INDEX)


def intersect(keys: np.ndarray, counts: np.ndarray, places: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences (window, start) by intersecting offset-adjusted lists, the rarest term's first.

    keys: sorted place << 32 | position; counts: list length by place; places[w, width]: terms' places, -1 padding. With a
    slop, start is where the rarest term puts the window, and every other term stands within slop of its place from there.
    """
    width = places.shape[1]
    real = places >= 0
    rank = np.where(real, counts[places], np.iinfo(np.int64).max)
    alive = np.flatnonzero((np.where(real, counts[places], 1) > 0).all(1))
    order = np.argsort(rank[alive], axis=1, kind="stable")
    first = order[:, 0]
    t0 = places[alive, first]
    n = counts[t0]
    begin = np.searchsorted(keys, t0 << 32)
    who = np.repeat(np.arange(len(alive)), n)
    idx = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
    start = (keys[idx] & 0xFFFFFFFF) - first[who]
    for step in range(1, width):
        if not len(who):
            break
        off = order[who, step]
        ok = _stands(keys, places[alive[who], off], start + off, slop)
        who, start = who[ok], start[ok]
    return alive[who], start


def _stands(keys: np.ndarray, t: np.ndarray, at: np.ndarray, slop: int) -> np.ndarray:
    """Whether term t stands within slop of `at`; true for padding."""
    lo = (t << 32) + np.maximum(at - slop, 0)
    i = np.minimum(np.searchsorted(keys, lo), len(keys) - 1)
    return (t < 0) | ((keys[i] >= lo) & (keys[i] <= (t << 32) + at + slop))


def matches(keys: np.ndarray, counts: np.ndarray, places: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, exact): exact occurrences, and alignments at which every term stands within slop of its place.

    Two terms within slop of their places at one alignment are within 2 * slop of each other's, so the lists are
    intersected with that first; all alignments of what is left are then tried.
    """
    who, start = intersect(keys, counts, places, 2 * slop)
    exact = np.ones(len(who), bool)
    for off in range(places.shape[1]):
        exact[exact] = _stands(keys, places[who[exact], off], start[exact] + off, 0)
    found = [(who[exact], start[exact], exact[exact])]
    for shift in range(-slop, slop + 1) if slop else ():
        w, a = who, start + shift
        for off in range(places.shape[1]):
            ok = _stands(keys, places[w, off], a + off, slop)
            w, a = w[ok], a[ok]
        found.append((w, a, np.zeros(len(w), bool)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search(index: DataFrame, block: Block, slop: int = SLOP) -> DataFrame:
    """For each indexed document: hit word positions, items with exact windows, items with proximity matches only."""
    ids = block.ids

    def run(batches):
        windows, owner = block.windows()
        lengths = (windows >= 0).sum(1)
        known, inverse = np.unique(windows, return_inverse=True)  # the padding, if any, comes first
        inverse = inverse.reshape(windows.shape) - int(len(known) > 0 and known[0] < 0)
        known = known[known >= 0]
        places = np.where(windows >= 0, inverse, -1)
        for batch in batches:
            for row in batch.to_pylist():
                starts, n_words = np.array(row["starts"], np.int64), np.array(row["n_words"], np.int64)
                here, off = np.frombuffer(row["terms"], np.int64), np.frombuffer(row["offsets"], np.int32).astype(np.int64)
                hits: dict[int, np.ndarray] = {}
                items: dict[int, set] = {}
                near: dict[int, set] = {}
                if len(here) and len(known):
                    at = np.searchsorted(here, known).clip(0, len(here) - 1)
                    mine = np.flatnonzero(here[at] == known)  # the lists that are read
                    counts = np.zeros(len(known), np.int64)
                    counts[mine] = n = (off[1:] - off[:-1])[at[mine]]
                    idx = np.repeat(off[at[mine]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    keys = (np.repeat(mine, n) << 32) | np.frombuffer(row["positions"], np.int32)[idx]
                    if len(keys):
                        who, start, exact = matches(keys, counts, places, slop)
                        doc = np.searchsorted(starts - slop, start, "right") - 1
                        w, a = who[exact], start[exact]
                        if len(w):
                            cover = np.zeros(int(starts[-1] + n_words[-1]) + GAP + 1, np.int32)
                            np.add.at(cover, a, 1)
                            np.add.at(cover, a + lengths[w], -1)
                            spots = np.flatnonzero(np.cumsum(cover) > 0)
                            of = np.searchsorted(starts, spots, "right") - 1
                            for d in np.unique(of):
                                hits[int(d)] = (spots[of == d] - starts[d]).astype(np.int32)
                            add_pairs(items, doc[exact], owner[w])
                        add_pairs(near, doc[~exact], owner[who[~exact]])
                many = range(len(starts))
                named = [{ids[i] for i in items.get(d, ()) if ids[i] is not None} for d in many]
                close = [sorted({ids[i] for i in near.get(d, ()) if ids[i] is not None} - named[d]) for d in many]
                columns = [[row["seg"]] * len(many), many, row["doc_ids"], row["keys"], n_words, [hits.get(d, np.empty(0, np.int32)) for d in many], [sorted(x) for x in named], close]
                types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in MATCH.split(", ")])

    return index.mapInArrow(run, MATCH)


def add_pairs(into: dict[int, set], docs: np.ndarray, owners: np.ndarray) -> None:
    if len(docs):
        for d, o in np.unique(np.stack([docs, owners], 1), axis=0).tolist():
            into.setdefault(d, set()).add(o)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS, keep_key: bool = False) -> DataFrame:
    """Per document row: doc_id, n_words, hits (word positions inside exact windows), items, near_items; key: hash of the text."""
    out = ["doc_id", *["key"] * keep_key, "n_words", "hits", "items", "near_items"]
    index = stored(build_index(docs), "postings")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    rows = (tuple(r) for r in items.toLocalIterator())
    found = [search(index, block, slop) for block in blocks_of(rows, width, block_words)] or [search(index, Block(width), slop)]
    if len(found) == 1:
        return found[0].select(*out)
    every = None
    for part in found:  # each block's findings are a table, so its pass over the index is a job of its own
        part = stored(part, "found")
        every = part if every is None else every.unionByName(part)
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    joined = every.groupBy("seg", "place").agg(*(F.first(c).alias(c) for c in ("doc_id", "key", "n_words")), *map(merged, ("hits", "items", "near_items")))
    return joined.withColumn("near_items", F.array_except("near_items", "items")).select(*out)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near"),
    )


def brute_force(docs: list, items: list, width: int = WINDOW) -> list[tuple]:
    """The contract restated on small lists, for tests."""
    wins: dict[tuple, set] = {}
    for item_id, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + width]), set()).add(item_id)
    sizes = {len(k) for k in wins}
    out = []
    for doc_id, text in docs:
        w, hit, got = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    got |= wins[tuple(w[i : i + n])]
        names = sorted(str(x) for x in got if x is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def brute_near(docs: list, items: list, width: int = WINDOW, slop: int = SLOP) -> list[int]:
    """The number of items each document holds in proximity but not exactly, restated on small lists, for tests."""
    out = []
    for _, text in docs:
        places: dict[bytes, set] = {}
        for i, w in enumerate(words := words_of(text)):
            places.setdefault(w, set()).add(i)
        exact, near = set(), set()
        for item_id, item in items:
            w = words_of(item)
            for i in range(max(1, len(w) - width + 1) if w and item_id is not None else 0):
                win = w[i : i + width]
                for a in range(-slop, len(words) + slop):
                    if all(any(p in places.get(x, ()) for p in range(a + k - slop, a + k + slop + 1)) for k, x in enumerate(win)):
                        near.add(item_id)
                        if all(a + k in places[x] for k, x in enumerate(win)):
                            exact.add(item_id)
        out.append(len(near - exact))
    return out
