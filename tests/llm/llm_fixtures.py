"""Documents with every awkward case; extra columns carry clashing names."""

from __future__ import annotations

import random

import pytest

SMALL_SF = "/root/testdata/sf0.001"
DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              "size long, score double, kept boolean, id long, h long, digest string, removed string")


def prose(rng: random.Random, n: int) -> str:
    words = ["the", "of", "and", "a", "to", "in", "on", "is"] + [f"w{rng.randrange(400)}" for _ in range(60)]
    out = []
    for i in range(n):
        w = rng.choice(words)
        out.append(w.capitalize() if i % 9 == 0 else w)
        if i % 9 == 8:
            out[-1] += "."
    return " ".join(out)


def doc(i, text, lang="en", source="s0"):
    return (i, text, lang, source, len(text) if text is not None else None, 9, 0.5, True, 7, 8, "x", "y")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([doc(*r) for r in rows], DOC_SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, one word, ties, repeated rows, a long text."""
    rng = random.Random(3)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \t\n "), (7, "Word"), (8, "word"),
            (9, "two words"), (10, prose(rng, 5000)), (11, prose(rng, 80)), (11, prose(rng, 80)), (12, base), (12, base),
            (None, base), (None, prose(rng, 50)), (13, "12 34 .. !!"), (14, "é ü ñ ß"), (15, "\x00 nul \x00\x1c end")]
    return [(i, t, [None, "en", "de"][k % 3], [None, "b", "a", "ä"][k % 4]) for k, (i, t) in enumerate(rows)]
