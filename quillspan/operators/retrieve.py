"""Context retrieval for completion points: imports, symbols, modified files and BM25 under a character budget.

Three variants of one plan. Points and files are tables keyed by (repo, revision); files are ranked per point by joins
and the rest of a point's work is a fold over its repository's files, so a point's rows meet in one group.
"""

from __future__ import annotations

import math
import posixpath
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import codeast
from quillspan.operators.pack import budget_chars

# The mark before a file, and words that say nothing about the cursor.
HEADER = "<|file_sep|>"
STOP = frozenset({"self", "cls", "None", "True", "False"})
_TOKEN = re.compile(r"[a-zA-Z_]\w*")


@dataclass(frozen=True)
class Variant:
    core: int
    extended: int
    k: int
    bases: bool  # base classes and modified files count, and retrieved files stand before the core
    chunked: bool  # imported names count, methods are found, BM25 ranks definitions, imported files go by the cursor's words
    threshold: float = 1.0  # BM25 runs only while less than this share is used


# Budgets in tokens times 3.8 characters, and what the variants differ in.
VARIANTS = {
    "v1": Variant(budget_chars(6500), budget_chars(14000), 5, True, False),
    "v2": Variant(budget_chars(7500), budget_chars(7500), 3, False, False, 0.8),
    "v5": Variant(budget_chars(6500), budget_chars(14000), 10, True, True),
}


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def weighted_query(prefix: str, suffix: str) -> Counter:
    near = tokens(prefix[-500:] + " " + suffix[:500])
    far = tokens(prefix[:-500])
    return Counter(near * 3 + far)


def rank(query: Counter, corpus: list[Counter], k1: float = 1.5, b: float = 0.75) -> list[float]:
    """BM25 of each document, through postings of the query's terms only."""
    n = len(corpus)
    lengths = [sum(c.values()) for c in corpus]
    mean = sum(lengths) / n if n else 0.0
    out = [0.0] * n
    for term, q in query.items():
        hits = [(i, c[term]) for i, c in enumerate(corpus) if term in c]
        idf = math.log((n - len(hits) + 0.5) / (len(hits) + 0.5) + 1)
        for i, tf in hits:
            out[i] += q * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[i] / mean))
    return out


def resolve_module(record: dict, path: str, files: dict[str, str]) -> str | None:
    """Exact candidate first, then the first file in scan order that ends with one; the standard library is no file."""
    if not record["level"] and codeast.is_stdlib(record["module"]):
        return None
    parts = [p for p in record["module"].split(".") if p]
    folder = posixpath.dirname(path)
    for _ in range(max(record["level"] - 1, 0)):
        folder = posixpath.dirname(folder)
    stem = "/".join([folder, *parts] if record["level"] and folder else parts)
    wanted = [posixpath.normpath(f"{stem}.py") if stem else ".py", f"{stem}/__init__.py" if stem else "__init__.py"]
    return next((w for w in wanted if w in files), None) or next((f for w in wanted for f in files if f.endswith(w)), None)


class Zone:
    """Entries (path, text) under a budget of characters, with their headers."""

    def __init__(self, most: int):
        self.most, self.used, self.entries = most, 0, []

    @staticmethod
    def cost(path: str, text: str) -> int:
        return len(HEADER) + len(path) + 1 + len(text)

    def take(self, path: str, text: str) -> bool:
        fits = self.used + self.cost(path, text) <= self.most
        if fits:
            self.entries.append((path, text))
            self.used += self.cost(path, text)
        return fits

    @property
    def full(self) -> bool:
        return self.used >= self.most


class Repository:
    """The files of a repository in scan (path) order; what is made of a file once serves all points."""

    def __init__(self, files: dict[str, str]):
        self.files, self._tokens, self._bones, self._chunks = files, {}, {}, {}

    def _once(self, kept: dict, path: str, make):
        if path not in kept:
            kept[path] = make()
        return kept[path]

    def tokens(self, path: str) -> Counter:
        return self._once(self._tokens, path, lambda: Counter(tokens(self.files[path])))

    def bones(self, path: str) -> str:
        return self._once(self._bones, path, lambda: codeast.without_docstrings(codeast.skeleton(self.files[path])))

    def chunks(self, path: str) -> list[tuple[str, Counter]]:
        return self._once(self._chunks, path, lambda: [(x["text"], Counter(tokens(x["text"]))) for x in codeast.chunks(path, self.files[path])])

    def snippets(self, path: str, names: set[str], v: Variant) -> str:
        return codeast.without_docstrings(codeast.relevant_snippets(self.files[path], names, v.chunked))


@dataclass
class Asked:
    """What a point asks for."""

    paths: list[str]
    needed: set[str]
    classes: set[str]
    near: set[str]


def asked(point: dict, files: dict[str, str], v: Variant) -> Asked:
    prefix, suffix = point["prefix"] or "", point.get("suffix") or ""
    records = codeast.imports(prefix) + (codeast.imports(suffix) if suffix else [])
    found = (resolve_module(r, point["path"], files) for r in records)
    paths = list(dict.fromkeys(p for p in found if p and p != point["path"]))
    used, hints = codeast.used_symbols(prefix) | (codeast.used_symbols(suffix) if suffix else set()), codeast.type_hints(prefix)
    bases = codeast.base_classes(prefix) | (codeast.base_classes(suffix) if suffix else set()) if v.bases else set()
    names = {n for r in records for n in r["names"] if len(n) > 1 and n != "*"} if v.chunked else set()
    classes = {n for n in hints | bases | names if len(n) > 2} if v.bases else hints - {n for n in used if len(n) <= 2}
    return Asked(paths, used | hints | bases | names, classes, set(_TOKEN.findall(prefix[-500:])) - STOP)


def imported_zone(a: Asked, repo: Repository, active: str, v: Variant) -> tuple[Zone, set[str]]:
    """The needed parts of imported files, and the files that count as included."""
    texts = {}
    for p in a.paths:
        source = repo.files[p]
        if not p.endswith("__init__.py") or (len(source) >= 50 and codeast.definitions(source)):
            text = repo.snippets(p, a.needed, v)
            if text.strip():
                texts[p] = text
    order = sorted(texts, key=lambda p: sum(w in texts[p] for w in a.near)) if v.chunked else list(texts)
    zone, included = Zone(v.core), set(order) if v.chunked else set() if v.bases else set(a.paths)
    for p in order:
        if zone.full and not v.chunked:
            break
        if zone.take(p, texts[p]):
            included.add(p)
            continue
        room = zone.most - zone.used
        if room > 200 and zone.cost(p, repo.bones(p)) < room:
            zone.take(p, repo.bones(p))
            included.add(p)
        break
    return zone, included


def class_files(zone: Zone, included: set[str], a: Asked, repo: Repository, active: str, v: Variant) -> None:
    """Files with a wanted class, in scan order; the first file that is already in, or a full zone, ends the search."""
    for p, source in repo.files.items() if a.classes else ():
        if p == active:
            continue
        if p in included or zone.full:
            return
        name = next((n for n in sorted(a.classes) if f"class {n}" in source), None)
        if name is not None and zone.take(p, repo.snippets(p, {name}, v) if v.bases else repo.bones(p)):
            included.add(p)


def modified_files(zone: Zone, included: set[str], modified: list[str], a: Asked, repo: Repository, active: str, v: Variant) -> None:
    for m in modified:
        if zone.full:
            return
        if m in included or m == active:
            continue
        p = m if m in repo.files else next((f for f in repo.files if f != active and f.endswith(m)), None)
        if p is not None:
            text = repo.snippets(p, a.needed, v)
            if len(text.strip()) >= 30 and zone.take(p, text):
                included.add(p)


def ranked_files(zone: Zone, included: set[str], point: dict, repo: Repository, v: Variant) -> None:
    """The best by BM25 that aren't in: skeletons of files, or (of k files) definitions, without docstrings, of 50 characters at least."""
    query = weighted_query(point["prefix"] or "", point.get("suffix") or "")
    rest = [p for p in repo.files if p != point["path"] and p not in included and not p.endswith("__init__.py")]
    if v.chunked:
        corpus = [(p, text, words) for p in rest for text, words in repo.chunks(p)]
    else:
        corpus = [(p, None, repo.tokens(p)) for p in rest]
    scores = rank(query, [words for *_, words in corpus])
    order = sorted(range(len(corpus)), key=lambda i: (scores[i], i if v.chunked else corpus[i][0]), reverse=True)
    seen: set[str] = set()
    for i in order[: 3 * v.k if v.chunked else v.k]:
        if scores[i] <= 0 or zone.full:
            return
        p, text, _ = corpus[i]
        text = repo.bones(p) if text is None else codeast.without_docstrings(text)
        if len(text.strip()) >= 50 and zone.take(p, text):
            seen.add(p)
            if v.chunked and len(seen) >= v.k:
                return


def context_of(point: dict, files: dict[str, str] | Repository, v: Variant) -> str:
    """The context of one point. Files come in path order; names are looked up in name order."""
    repo = files if isinstance(files, Repository) else Repository(files)
    active = point["path"]
    a = asked(point, repo.files, v)
    core, included = imported_zone(a, repo, active, v)
    if not core.full:
        class_files(core, included, a, repo, active, v)
    if not v.bases:  # one zone: what BM25 finds goes on where the core ends
        if core.used < v.threshold * v.extended:
            ranked_files(core, included, point, repo, v)
        entries = core.entries
    else:
        rest = Zone(v.extended - core.used)
        modified_files(rest, included, point.get("modified") or [], a, repo, active, v)
        if not rest.full:
            ranked_files(rest, included, point, repo, v)
        entries = [*rest.entries, *core.entries]  # what is trimmed first stands first
    return "".join(f"{HEADER}{p}\n{t}" for p, t in entries)


def line_count(text: str) -> int:
    """Lines as a reader of lines counts them: an end of line at the end opens no other."""
    return len(re.findall(r"\r\n|\r|\n", text)) + (text != "" and text[-1] not in "\r\n")


def baseline_path(point: dict, files: dict[str, str], strategy: str, seed: int = 42) -> str | None:
    """A file for the context: `random`, `recent` (a modified one, else random) or `bm25` (the best by BM25, first of equals)."""
    from hashlib import md5

    usable = {p: c for p, c in files.items() if line_count(c) >= 10}
    pool = sorted(usable)
    if strategy == "recent":
        pool = [p for p in point.get("modified") or [] if p in usable] or pool
    if strategy == "bm25" and pool:
        split = lambda s: re.sub(r"[\W_]", " ", s.lower()).split()
        corpus = [Counter(split(usable[p])) for p in pool]
        n, mean = len(corpus), sum(sum(c.values()) for c in corpus) / len(corpus) or 1.0
        df = Counter(t for c in corpus for t in c)
        idf = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
        patch = 0.25 * sum(idf.values()) / max(1, len(idf))
        query = Counter(split((point["prefix"] or "") + " " + (point.get("suffix") or "")))
        score = lambda c: sum(q * (idf[t] if idf[t] >= 0 else patch) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for t, q in query.items() if t in c)
        return max(pool, key=lambda p: score(Counter(split(usable[p]))))
    return min(pool, key=lambda p: md5(f"{seed}/{p}".encode()).hexdigest()) if pool else None


def contexts(points: DataFrame, files: DataFrame, variant: str = "v2") -> DataFrame:
    """(point_id, context). points: point_id, repo, revision, path, prefix, suffix, modified; files: repo, revision, path, content."""
    v = VARIANTS[variant]

    def work(_, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        files = Repository(dict(sorted(zip(held["path"], held["content"].fillna(""), strict=True))))
        rows = [(p["point_id"], context_of(p | {"modified": list(p["modified"]) if p.get("modified") is not None else []}, files, v)) for p in asked.to_dict("records")]
        return pd.DataFrame(rows, columns=["point_id", "context"])

    keys = ["repo", "revision"]
    return points.groupBy(*keys).cogroup(files.groupBy(*keys)).applyInPandas(work, "point_id long, context string")


def submission(points: DataFrame, found: DataFrame, prefix_lines: int | None = None, suffix_lines: int | None = None) -> DataFrame:
    """context, with prefix and suffix only where trimming changed them."""
    from quillspan.functions.text import first_lines, last_lines

    out = points.join(found, "point_id")
    prefix = last_lines("prefix", prefix_lines) if prefix_lines else F.col("prefix")
    suffix = first_lines("suffix", suffix_lines) if suffix_lines else F.col("suffix")
    changed = lambda new, old: F.when(new != F.col(old), new).alias(old)
    return out.select("point_id", "context", changed(prefix, "prefix"), changed(suffix, "suffix"))
