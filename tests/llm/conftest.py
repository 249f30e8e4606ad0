import random

import pytest

WORDS = [f"w{i}" for i in range(80)]


@pytest.fixture(scope="session")
def odd_docs():
    """Texts with the cases that operators have to define: null, empty, blank and long texts, ties, repeated rows, null ids."""
    rnd = random.Random(7)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    base = [text(rnd.randint(1, 120)) for _ in range(30)]
    rows = []
    for i in range(90):
        w = rnd.choice(base).split(" ")
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        rows.append((i, "\n".join(" ".join(w[a : a + 11]) for a in range(0, len(w), 11))))
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, "É " + base[0].upper()), (204, text(6000)), (205, "x" * 5000), (206, "ab" * 700), (5, rows[5][1]), (6, rows[9][1]), (None, rows[8][1]), (None, base[1])]
    return rows


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame of (doc_id, text) with other columns whose names clash with names used inside operators."""
    from pyspark.sql import functions as F

    def make(rows, kind="doc_id bigint, text string"):
        df = spark.createDataFrame(rows, kind)
        return df.withColumns({c: F.lit(c) for c in ("id", "key", "doc", "h", "n", "rank", "source", "lang", "component", "words", "shard")}).repartition(3)

    return make


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
