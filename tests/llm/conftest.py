import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def near_rows():
    """Documents with exact copies, near copies, shared passages, short, empty and null texts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.choice([3, 5, 40, 120]))) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for n in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((100 + n, rng.choice([" ", "\n", " \t "]).join(w).upper() if n % 7 == 0 else " ".join(w)))
    return rows + [(900, ""), (901, None), (902, " \n\t"), (903, ""), (904, "x"), (905, "X"), (906, "a\u00a0b c"), (907, "w1 " * 3000)]
