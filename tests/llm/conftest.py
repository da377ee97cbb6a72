import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
WORDS = [f"w{i}" for i in range(60)] + ["Été", "ß", "漢字"]


def texts(seed, n, length=60):
    """Copies of three bases with changed words, in part joined with others, cut short or repeated; nulls and blanks too."""
    rng = random.Random(seed)
    bases = [[rng.choice(WORDS) for _ in range(length)] for _ in range(3)]
    out = [None, "", " \n\t ", "one", "One two", "one two", "z " * 90, "z " * 70]
    while len(out) < n:
        x = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2, 5, 20))):
            x[rng.randrange(len(x))] = rng.choice(WORDS)
        if rng.random() < 0.3:
            x = x[rng.randrange(20) :] + rng.choice(bases)[: rng.randrange(30)]
        for k in range(9, len(x), 13):
            x[k] += "\n"
        out.append(" ".join(x))
    out[-1] = out[-2]
    return list(enumerate(out))


@pytest.fixture
def corpus():
    return texts


#: Names that operators use inside; such columns of the input mustn't matter.
CLASHING = ("n", "node", "token", "tokens", "rank", "spans", "row", "key", "length", "line", "at", "words", "item")


@pytest.fixture
def docs(spark):
    from pyspark.sql import functions as F

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.withColumns({c: F.lit("x") for c in CLASHING})

    return make
