"""License scans: fuzzy search for short notices.

A notice of n characters with k allowed edits is cut into k + 1 pieces; a match with at most k edits leaves a piece
unchanged (pigeonhole), so exact finds of the pieces (all notices' in one pass) locate every candidate. The regex library's bounded-error matching
then verifies the candidate's surroundings and counts its edits; the span is reported in words. Base places, where the
words of a short phrase stand consecutively, are the same search with no edits allowed.

Texts and notices are folded alike (A-Z lower-cased, other ASCII than letters and digits separates words), so a notice's
line breaks and punctuation don't matter. Every row is handled in place: no shuffle, memory bounded by a document.

Defined cases: null and wordless texts have no match, no label and the score 0; overlapping matches of a notice are
reported once, the one with the fewest edits and then the first, and of different notices those with the fewest; a notice
within a longer one of as few edits isn't reported; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillspan.llm.common import words_of

# Phrases searched exactly, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Well-known short notices, with their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "distributed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the software is provided as is without warranty of any kind": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "gnu general public license version 2": "gpl",
    "gnu general public license version 3": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common public license": "cpl",
    "common development and distribution license": "cddl",
    "redistribution and use in source and binary forms": "bsd",
    "released under the bsd license": "bsd",
    "licensed under the bsd license": "bsd",
    "bsd 2 clause license": "bsd",
    "bsd 3 clause license": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "licensed under the isc license": "isc",
    "this notice may not be removed or altered from any source distribution": "zlib",
    "distributed under the boost software license": "boost",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by nd": "cc-by-nd",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nc nd": "cc-by-nc-nd",
    "licensed under cc by nc sa": "cc-by-nc-sa",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons zero": "cc0",
    "artistic license 2 0": "artistic",
    "academic free license": "afl",
    "open software license": "osl",
    "python software foundation license": "psf",
    "sil open font license": "ofl",
    "european union public licence": "eupl",
    "microsoft public license": "ms-pl",
    "postgresql license": "postgresql",
    "php license version 3": "php",
    "w3c software notice and license": "w3c",
    "universal permissive license": "upl",
    "business source license": "busl",
    "server side public license": "sspl",
    "open data commons open database license": "odbl",
    "elastic license 2 0": "elastic",
    "all rights reserved": "all-rights-reserved",
}
#: One edit for each so many characters.
CHARS_PER_EDIT = 10

FOUND = "doc_id long, n_words long, base array<struct<label:string,word:int>>, matches array<struct<label:string,notice:string,first_word:int,last_word:int,edits:int>>"


class Notice:
    """A notice made ready: its pieces with their offsets, and the pattern that verifies."""

    def __init__(self, text: str, label: str, edits: int | None = None):
        self.text, self.label = text.encode(), label
        self.edits = len(text) // CHARS_PER_EDIT if edits is None else edits
        k, n = self.edits + 1, len(text)
        bounds = [i * n // k for i in range(k + 1)]
        self.pieces = [(self.text[a:b], a) for a, b in zip(bounds, bounds[1:], strict=False)]
        # the match begins and ends at word bounds, so that edits aren't spent on neighbours
        self.pattern = regex.compile(rb"(?b)(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(self.text, special_only=True), self.edits))

    def verified(self, text: bytes, starts: Iterable[int]) -> list[tuple[int, int, int]]:
        """(start, stop, edits) in the folded text, without overlaps; starts: where pieces found would put the notice."""
        n, found = len(self.text), []
        for start in sorted(set(starts)):
            lo, hi = max(0, start - self.edits), min(len(text), start + n + self.edits)
            # the surroundings reach to word bounds, within the notice's length
            lo, hi = text.rfind(b" ", max(0, lo - n), lo) + 1 or lo, text.find(b" ", hi, hi + n)
            if m := self.pattern.search(text, pos=lo, endpos=hi if hi >= 0 else min(len(text), start + 2 * n + self.edits)):
                if m.end() > m.start() and (m.end() == len(text) or text[m.end()] == 32):
                    found.append((sum(m.fuzzy_counts), m.start(), m.end()))
        kept: list[tuple[int, int, int]] = []
        for e, a, b in sorted(set(found)):
            if all(b <= x or a >= y for x, y, _ in kept):
                kept.append((a, b, e))
        return sorted(kept)


class Seeds:
    """The pieces of all notices in one automaton, which finds every one of them in a single pass over a text."""

    def __init__(self, notices: dict[str, str]):
        self.notices = [Notice(t, label) for t, label in notices.items()]
        owners: dict[bytes, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for piece, offset in notice.pieces:
                owners.setdefault(piece, []).append((i, offset))
        self.found_by = ahocorasick.Automaton()
        for piece, owner in owners.items():
            self.found_by.add_word(piece.decode("latin-1"), (len(piece), owner))
        if owners:
            self.found_by.make_automaton()

    def find(self, text: bytes) -> list[tuple[Notice, int, int, int]]:
        """(notice, start, stop, edits)."""
        starts: dict[int, list[int]] = {}
        if self.notices:
            for last, (size, owner) in self.found_by.iter(text.decode("latin-1")):  # a character for each byte
                for i, offset in owner:
                    starts.setdefault(i, []).append(last + 1 - size - offset)
        return [(self.notices[i], *m) for i in sorted(starts) for m in self.notices[i].verified(text, starts[i])]


def exact_places(text: bytes, phrase: bytes) -> list[int]:
    """Start words of a phrase in a folded text (words divided by one space); places may overlap."""
    padded, wanted, out, words, seen = b" " + text + b" ", b" " + phrase + b" ", [], 0, 0
    at = padded.find(wanted)
    while at >= 0:
        words += padded.count(b" ", seen, at)
        seen = at
        out.append(words)
        at = padded.find(wanted, at + 1)
    return out


def scan_text(text: str | None, seeds: Seeds, base: dict[str, str]) -> tuple[int, list[dict], list[dict]]:
    words = words_of(text)
    folded = b" ".join(words)
    places = [{"label": label, "word": w} for phrase, label in base.items() for w in exact_places(folded, phrase.encode())]
    matches = []
    for n, a, b, e in seeds.find(folded):
        first = folded.count(b" ", 0, a)
        matches.append({"label": n.label, "notice": n.text.decode(), "first_word": first, "last_word": first + folded.count(b" ", a, b), "edits": e})
    matches = [m for m in matches if not any(_stands_for(o, m) for o in matches)]
    return len(words), sorted(places, key=lambda p: (p["word"], p["label"])), sorted(matches, key=lambda m: (m["first_word"], m["notice"]))


def _stands_for(o: dict, m: dict) -> bool:
    """Of notices that claim the same words the one with the fewest edits stands, and one that holds another whole stands for it."""
    if o["first_word"] > m["last_word"] or m["first_word"] > o["last_word"]:
        return False
    covers = o["first_word"] <= m["first_word"] and m["last_word"] <= o["last_word"] and len(o["notice"]) > len(m["notice"])
    return o["edits"] < m["edits"] or o["edits"] == m["edits"] and covers


def scan(docs: DataFrame, notices: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """Per document: number of words, base places, and fuzzy matches with their spans and edits."""
    notices, base = NOTICES if notices is None else notices, BASE if base is None else base

    def run(batches):
        ready = Seeds(notices)
        place, match = pa.struct([("label", pa.string()), ("word", pa.int32())]), pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("edits", pa.int32())])
        for batch in batches:
            found = [scan_text(t.as_py(), ready, base) for t in batch.column(1)]
            n, places, matches = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(places, pa.list_(place)), pa.array(matches, pa.list_(match))], ["doc_id", "n_words", "base", "matches"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns; score is 1 for a base place, else that of the match with the fewest edits for its length."""
    return found.selectExpr(
        "doc_id",
        "n_words",
        "cast(size(base) as long) as n_base",
        "cast(array_min(transform(base, x -> x.word)) as long) as first_word",
        "cast(array_max(transform(base, x -> x.word)) as long) as last_word",
        "array_join(array_sort(array_distinct(transform(base, x -> x.label))), ',') as base_labels",
        "array_join(array_sort(array_distinct(concat(transform(base, x -> x.label), transform(matches, x -> x.label)))), ',') as labels",
        "case when size(base) > 0 then 1.0D when size(matches) > 0 then array_max(transform(matches, x -> 1.0D - cast(x.edits as double) / length(x.notice))) else 0.0D end as score",
        "cast(size(matches) as long) as n_matches",
    )
