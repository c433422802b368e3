"""Small tables with the awkward cases."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, held_out int, label string"
WORDS = {
    "en": "the and of that with from which were there house river stone".split(),
    "de": "und der die nicht mit auch schon haus fluss stein wurde immer".split(),
    "fr": "le la les avec pour maison pierre fleuve toujours était dans leur".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def awkward(spark, seed: int = 5, n: int = 60):
    """Nulls in every column, empty and long texts, ties, repeated rows and extra columns with clashing names."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        text = prose(rng, lang, rng.randint(3, 90))
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    first = rows[0][1]
    long = prose(rng, "en", 30_000)
    rows += [
        (100, None, "en", "s0", None), (101, "", None, None, 0), (102, "   \n\t", "de", "s1", 5), (103, "1234 !!", "en", None, 7), (104, "日本語 текст", None, "s2", 9),
        (105, first, "en", "s3", 1), (105, first, "en", "s3", 1), (None, first, "en", "s3", 1), (None, None, None, None, None), (106, long, "en", "s0", len(long)),
        (107, "🎉🎉 ßß", "de", "s9", 5), (108, "x", "en", "s0", 1),
    ]
    return spark.createDataFrame([(*r, 0.5, "k", 1, "l") for r in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
