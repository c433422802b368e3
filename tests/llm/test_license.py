import random
import re

from quillspan.llm import license
from tests.llm.fixtures import awkward, empty


def ready():
    return license.Seeds(license.NOTICES)


def found(text):
    n, base, matches = license.scan_text(text, ready(), license.BASE)
    return n, [(b["label"], b["word"]) for b in base], [(m["label"], m["first_word"], m["last_word"], m["edits"]) for m in matches]


def test_base_places_overlap_nothing_is_lost():
    assert found("MIT License mit-license x apache\nLICENSE; lesser General  Public license")[1] == [("mit", 0), ("mit", 2), ("apache", 5), ("gpl", 8)]
    assert license.exact_places(b"a a a", b"a a") == [0, 1]


def test_fuzzy_matches_report_spans_and_edits():
    assert found("x y Released under the MIT Licence. z")[2] == [("mit", 2, 6, 1)]
    n, base, matches = found("so: Licensed undr the Apache License, Version 2.0 here")
    assert base == [("apache", 4)] and matches == [("apache", 1, 8, 1)]
    assert found("Licensed under CC BY-NC 4.0.")[2] == [("cc-by-nc", 0, 4, 0)]
    assert found("the license of the river")[2] == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def corrupted(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        i = rng.randrange(len(text))
        text[i : i + 1] = rng.choice([[], ["q"], [text[i], "z"], [text[i], " "]])
    return " ".join("".join(text).split())


def test_every_notice_same_as_brute_force():
    """All stretches of whole words near a notice's length are held against it."""
    rng = random.Random(0)
    assert len(license.NOTICES) >= 50
    for notice, label in license.NOTICES.items():
        edits = license.Notice(notice, label).edits
        for k in (0, edits, edits + 1, 2 * edits + 3):
            text = f"abc def {corrupted(rng, notice, k)} ghi jkl"
            words = text.split()
            near = [" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
            truth = [d for w in near if abs(len(w) - len(notice)) <= edits and (d := distance(w, notice)) <= edits]
            found = [m for m in license.Seeds({notice: label}).find(text.encode())]
            assert bool(found) == bool(truth), (notice, text)
            if found:
                assert min(e for *_, e in found) == min(truth), (notice, text)
            for _, a, b, e in found:
                assert distance(text[a:b], notice) <= e and " " not in (text[a], text[b - 1])


def test_notices_of_every_label():
    for notice, label in license.NOTICES.items():
        assert label in {m[0] for m in found(f"River. {notice.title()}! Stone")[2]}, notice
    assert found("Creative Commons Attribution-ShareAlike")[2] == [("cc-by-sa", 0, 3, 0)]
    assert found("Licensed under CC BY-NC-SA 4.0")[2] == [("cc-by-nc-sa", 0, 5, 0)]


def base_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in license.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_columns_same_as_brute_force(spark):
    rng = random.Random(2)
    some = ["MIT", "license", "License.", "apache", "general", "public", "GENERAL", "é", "x-mit", "license-"]
    rows = [(i, " ".join(rng.choice(some) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(70, None), (71, "mit license " * 20_000), (None, "MIT\nLicense")]
    docs = spark.createDataFrame([(i, t, "l", 2) for i, t in rows], "doc_id long, text string, labels string, n_words int")
    found = license.digest(license.scan(docs)).collect()
    assert sorted((tuple(r)[:6] for r in found), key=repr) == sorted(((i, *base_by_hand(t)) for i, t in rows), key=repr)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = license.digest(license.scan(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and (r["n_base"] == 0) == (r["first_word"] is None)
    assert license.digest(license.scan(empty(spark))).count() == 0
