import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# the same names as in the conftest above, whichever of the two is imported
SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """documents from (doc_id, text) or longer tuples, over a few partitions."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s1", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: frame(spark, rows)


@pytest.fixture(scope="session")
def prose():
    """n words of made-up prose, seeded."""
    def make(n, seed, vocabulary=400):
        rng = random.Random(seed)
        vocab = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
        rng = random.Random(seed * 7 + 1)
        return " ".join(rng.choice(vocab) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def odd(prose):
    """Rows with nulls, empty and long texts, ties, repeats and near copies."""
    base = prose(300, 1)
    w = base.split()
    near = [" ".join(w[:k] + ["zz"] + w[k + 1:]) for k in (3, 100, 200, 290)]
    long = prose(40_000, 2)
    passage = prose(70, 3)
    line = "This very line stands in many documents of the table."
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One TWO"), (5, base), (6, base), (7, base.upper().lower())]
    rows += [(10 + k, t) for k, t in enumerate(near)]
    rows += [(20, long), (21, long[:60_000] + " tail"), (22, "a" * 3000), (23, "a" * 2990 + "b")]
    rows += [(30 + k, f"{prose(40, 40 + k)}\n{line}\n {line.upper()} \n{passage} {prose(30, 60 + k)}") for k in range(7)]
    rows += [(50, "é" * 60 + " x"), (51, "é" * 60 + " y"), (52, "\n\n"), (53, "퟿  \x85 　 z")]
    return rows
