from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rand: random.Random, n: int) -> str:
    return " ".join("".join(rand.choice("abdeinorst") for _ in range(rand.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Documents of every awkward kind: null, empty, blank, short, copies, near copies, a very long one."""
    rand = random.Random(1)
    base = words(rand, 300)
    passage = words(rand, 60)
    other = [words(rand, rand.randint(3, 200)) for _ in range(25)]
    edited = base.split()
    edited[100] = "changed"
    out = [None, "", " \n\t ", "one", "one two three", base, base, " ".join(edited), base.upper(), f"{other[0]} {passage} {other[1]}", f"{other[2]}\n{passage}", "é𝄞 ß\x0b" + passage[:55], words(rand, 9000), "x" * 5000, "ab " * 400, passage]
    return out + other


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns whose names the operators use, or might."""
    from pyspark.sql import functions as F

    names = ["score", "label", "rep", "node", "chunk", "bucket", "data", "kept", "_row", "_text", "assign", "runs", "key", "place", "copy", "p", "domain", "n_words", "quality"]
    return docs.withColumns({n: F.lit(1) for n in names})
