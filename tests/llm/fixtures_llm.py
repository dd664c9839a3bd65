from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
WORDS = "the of and river stone light morning garden window paper a in to house small".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) * (rng.random() < 0.7) for _ in range(words))


def edge_rows() -> list[tuple]:
    """Nulls, empty, blank and very long texts, ties, repeated rows and ids."""
    copy = prose(1, 120)
    return [
        (1, copy),
        (2, None),
        (3, ""),
        (4, " \t\n "),
        (5, prose(2, 60_000)),
        (5, prose(3, 80)),
        (6, copy),
        (7, copy + " end"),
        (7, copy + " end"),
        (None, prose(4, 90)),
        (None, None),
        (8, "one two"),
        (9, "ONE two"),
        (10, "é 日本語 ﬁ İ 🙂 \x00 ▁ <|endoftext|> don't 12½"),
        (-11, "x" * 30_000),
    ]


#: Names that operators use inside.
CLASHES = "row n key1 part shard length rank id tie text_hash found by element family place word s0 y hash".split()


@pytest.fixture(scope="session")
def edge(spark):
    frame = spark.createDataFrame(edge_rows(), "doc_id long, text string")
    return frame.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r.doc_id: r.text for r in small.select("doc_id", "text").collect()}
