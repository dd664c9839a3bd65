"""Long common subsequences, lines by fixed searches, and even spreading."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from casemill.functions import forms, fuzzy
from casemill.session import spread


def common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, start=1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_over_word_borders(spark):
    rng = random.Random(1)
    rows = [("", ""), ("", "a"), ("a", ""), ("abc", "abc"), ("x" * 300, "x" * 299)]
    for _ in range(150):
        n, m = (rng.choice([1, 5, 20, 61, 62, 63, 64, 124, 125, 186, 187, 300]) for _ in "ab")
        letters = rng.choice(["ab", "abcdefgh ", "áéñ xyz"])
        a, b = ("".join(rng.choice(letters) for _ in range(k)) for k in (n, m))
        rows.append((a, a[: m // 2] + b if rng.random() < 0.3 else b))
    frame = spark.createDataFrame(rows, "a string, b string")
    got = frame.select("a", "b", fuzzy.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == common(r.a, r.b) for r in got) and len(got) == len(rows)
    nulls = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string")
    assert {r.n for r in nulls.select(fuzzy.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()} == {None}


def test_lines_as_by_patterns(spark):
    """The same value as a pattern that takes the first line with the phrase, or the one after it."""
    rng = random.Random(2)
    pieces = ["- t:", "- t: 3", "xx - t:", " ", "", "b", "- t", "ñ - t: é ", "\r"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "c string")
    got = frame.select(
        "c", forms.get_line(F.col("c"), "- t:").alias("own"), forms.get_line(F.col("c"), "- t:", 1).alias("next")
    )
    for r in got.collect():
        own = re.search(r"(?m)^[^\n]*- t:[^\n]*", r.c or "")
        after = re.search(r"(?m)^[^\n]*- t:[^\n]*\n+([^\n]*)", r.c or "")
        assert r.own == ((own[0].strip() or None) if own else None)
        assert r.next == ((after[1].strip() or None) if after else None)


def test_spread_fills_the_cores(spark, folder):
    cores = spark.sparkContext.defaultParallelism
    for name in ("part", "conversations", "documents"):
        frame = spread(spark.read.parquet(f"{folder}/{name}.parquet"))
        tasks = frame.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks == cores
