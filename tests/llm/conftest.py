"""Small documents with every awkward case."""

from __future__ import annotations

import random

import pytest

WORDS = "the of and to in is that for it on with as was by are this be from or an have not".split()
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(60)) if r.random() < 0.5 else "") for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(f"x{r.randrange(9999)}" if r.random() < share else w for w in text.split())


def rows() -> list[tuple]:
    out: list[tuple] = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one"), (5, "one two"), (6, "One  TWO"), (7, LONG), (8, LONG + " tail"), (9, "ünï çödé " * 20)]
    base = [prose(k, 60 + 40 * (k % 5)) for k in range(40)]
    out += [(10 + k, t) for k, t in enumerate(base)]
    out += [(100 + k, base[k % 40]) for k in range(30)]
    out += [(200 + k, edited(base[k % 40], k, 0.01)) for k in range(60)]
    out += [(300 + k, edited(base[k % 40], k + 99, 0.04)) for k in range(40)]
    out += [(400 + k, edited(base[3], k, 0.012)) for k in range(60)]
    return [(i, t, ("en", "de", None)[i % 3], ("big", "big", f"s{i % 4}")[i % 3], None if t is None else len(t)) for i, t in out]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents() -> list[tuple]:
    return rows()


@pytest.fixture(scope="session")
def docs(spark, documents):
    """Documents, one row repeated, with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([*documents, documents[20]], SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("rep", "key", "h", "n", "component", "tokens", "topic", "shard", "score", "host", "posterior")}).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
