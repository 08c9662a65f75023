"""Small tables and brute-force models shared by the operator tests."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocab=400):
    return " ".join(f"w{int(vocab * rng.random() ** 2)}" + ("\n" if rng.random() < 0.1 else "") for _ in range(n))


def awkward_texts(seed=1):
    """Null, empty, blank, short, very long, repeated, odd-blank and non-ASCII texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(5, 120)) for _ in range(60)]
    long = prose(rng, 30_000, 5_000)
    return [None, "", " \t\n\x0b\x0c\r ", "one", "Ünïcode wörd  x 日本語 😀", *base, base[3], base[3], base[4] + " tail",
            "\n".join([base[5]] * 3), long, long[:5000] + " x", "a" * 70_000, "A\x1cB\x85C d\n\n\ne", base[7].upper()]


def documents(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)
