import random

import pytest

SCHEMA = "doc_id long, text string, key string, rank string, node string, digest string, band int, marks string, label double"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, ties, several texts under one id, characters of every size."""
    rng = random.Random(4)
    long = prose(rng, 9000)
    base = prose(rng, 240)
    near = base.split(" ")
    near[60] = "changed"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, long), (5, long), (6, long), (None, base), (None, None), (7, base), (8, " ".join(near)),
            (9, base + "\n" + prose(rng, 90)), (10, prose(rng, 90) + "\n" + base), (11, "one two three"), (12, "one two three"), (13, "é漢😀 Ω — ½ don't"),
            (14, "same " * 400), (15, "x" * 5000), (16, "x" * 5000 + "y"), (17, prose(rng, 500)), (18, prose(rng, 3)), (-3, base), (19, "\n".join(["a line of some length"] * 3 + ["b", "", "c"]))]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same with other columns whose names the operators use themselves."""
    extra = (None, "r", None, "d", 3, None, 0.5)
    return spark.createDataFrame([r + extra for r in odd_rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tables(spark, data):
    return lambda name: spark.read.parquet(f"{data}/{name}.parquet")


@pytest.fixture(scope="session")
def documents(tables):
    return [(r["doc_id"], r["text"] or "") for r in tables("documents").select("doc_id", "text").collect()]
