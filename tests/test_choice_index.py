"""Fuzzy joins against a table of choices."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from casemill.functions import fuzzy
from casemill.operators import choice_index, joins


def plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, start=1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, start=1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def word(rng, letters="abcdeiorstu"):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))


def changed(rng, text):
    letters = list(text)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(letters) + 1)
        letters[at : at + rng.randrange(2)] = [rng.choice("abe ")] * rng.randrange(2)
    return "".join(letters)


@pytest.mark.parametrize("near", [0.25, 0.5, 0.75, 0.99])
def test_near_words(spark, near):
    rng = random.Random(3)
    left = sorted({word(rng, "abc") for _ in range(60)} | {"aaaaaaa", "x"})
    right = sorted({word(rng, "abcd") for _ in range(60)} | {"aaaaaa", "xyz"})
    frames = (spark.createDataFrame([(w,) for w in words], "word string") for words in (left, right))
    got = {(r.word, r.other): r.distance for r in choice_index.near_words(*frames, near).collect()}
    wanted = {}
    for a in left:
        for b in right:
            d = plain_distance(a, b) / max(len(a), len(b))
            if d <= near + 1e-12:
                wanted[a, b] = d
    assert got == pytest.approx(wanted)


@pytest.mark.parametrize("cutoff", [90, 20])
def test_table_equals_list(spark, cutoff):
    rng = random.Random(cutoff)
    vocabulary = [word(rng) for _ in range(60)]
    choices = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 6))) for _ in range(80)]
    choices += ["", " - ", choices[0], choices[1].upper(), "zzz", "común"]
    keys = [changed(rng, rng.choice(choices)) for _ in range(60)]
    keys += [None, "", "...", "qqqq", "zzz zzz", "w", keys[0], " ".join(vocabulary)]
    frame = spark.createDataFrame([(k, 1) for k in keys], "text string, score int")
    table = spark.createDataFrame(list(enumerate(choices)) + [(9999, None)], "choice_order long, match string")
    table = table.withColumn("words", F.lit(0)).withColumn("other", F.lit(0)).repartition(5)
    for join in (joins.fuzzy_best, joins.fuzzy_unmatched):
        got = sorted(map(str, join(frame, "text", table, cutoff).collect()))
        assert got == sorted(map(str, join(frame, "text", choices, cutoff).collect()))


def test_table_edge_cases(spark):
    keys = spark.createDataFrame([("one",), (None,), ("",)], "text string")
    none = spark.createDataFrame([], "choice_order long, match string")
    rows = {r.key: (r.match, r.score) for r in joins.fuzzy_unmatched(keys, "text", none).collect()}
    assert rows == {"one": (None, None), "": (None, None)}
    blank = spark.createDataFrame([(5, "--"), (3, "..")], "choice_order long, match string")
    rows = {r.key: (r.match, r.score) for r in joins.fuzzy_unmatched(keys, "text", blank).collect()}
    assert rows == {"one": ("..", None), "": ("..", None)}
    assert joins.fuzzy_best(keys.limit(0), "text", blank).count() == 0
    with pytest.raises(ValueError):
        joins.fuzzy_best(keys, "text", blank, scorer=fuzzy.ratio)


def test_large_table_of_choices(spark):
    """100,000 choices, one word in all of them: found by rare words, and no pairing of all rows."""
    choices = spark.range(100_000).select(
        F.col("id").alias("choice_order"),
        F.concat(F.lit("common "), F.substring(F.md5(F.col("id").cast("string")), 1, 8), F.lit(" part")).alias("match"),
    )
    keys = choices.where("choice_order % 500 = 7").select(
        F.concat(F.col("match"), F.when(F.col("choice_order") % 1000 == 7, "s").otherwise("")).alias("key"),
        F.col("match").alias("wanted"),
    )
    got = joins.fuzzy_best(keys, "key", choices, 90)
    joined = got.join(keys.withColumnRenamed("key", "k"), F.col("key") == F.col("k"))
    assert joined.where("match = wanted").count() == 200
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
