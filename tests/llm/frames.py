"""Small documents with everything that is awkward about real ones."""

from __future__ import annotations

import random

EXTRA = ("size", "h", "k", "shard", "node", "label", "good", "evidence", "host", "ids", "spans", "slice", "target", "mix_hash")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(words))


AWKWARD = [
    None,
    "",
    " ",
    "\n\n\n",
    "one",
    "two words",
    "just four words here",
    "tabs\tand\x0bvertical\x0cones",
    "Überraschung – 日本語 \U0001f600 é é",
    'token = "abcdef0123456789abcdef0123456789"\npassword: hunter2hunter2',
    "no  double   spaces \n leading\r\nline",
    "a" * 5000,
    " ".join(["again"] * 3000),
    prose(9, 20_000),
]


def awkward(spark, more=()):
    """Rows with nulls in every column, empty and very long texts, repeated rows and columns whose names operators use inside."""
    texts = [*AWKWARD, *more]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", None, 3), (None, "row without an id", None, None, None), (None, None, None, None, None), (6, "same id, other text", "en", "s1", 19)]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def simple(spark, texts, sources=None, first=0):
    rows = [(first + i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
