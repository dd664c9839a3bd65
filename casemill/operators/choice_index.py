"""Best fuzzy choice out of a table of choices, by an index over their words instead of all pairs.

The token distance of a key and a choice is the mean, over the words of one side, of the distance to
the nearest word of the other side. If it is at most `t` for n words, fewer than t * n / near of them
are farther than `near` from every word of the other side. So the rarest words of a side, one more
than may be that far, must contain a word with a near partner: they are looked up in a table of near
word pairs, and only pairs of key and choice that meet there are scored. Word pairs come from an
inverted list of letter pairs (or letters) with a length and a count bound.

Rounds start at the cutoff and go down; a key leaves as soon as its best choice is found, since no
choice outside a round's pairs can score as high. What no round finds shares no letter with a choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import fuzzy
from casemill.functions import text as T
from casemill.session import for_costly_rows, written

#: Least score of the rounds after the first, whose is the cutoff.
ROUNDS = (60, 25, 1)


def words_of(c: Column) -> Column:
    """Words as the fuzzy joins compare them."""
    return T.clean_tokens(T.clean_hard(fuzzy.processed(c)))


def _grams(word: Column, size: int) -> Column:
    """Runs of `size` letters of a padded word, equal ones numbered apart."""
    padded = F.concat(F.lit("\x01" * (size - 1)), word, F.lit("\x01" * (size - 1)))
    grams = F.transform(
        F.sequence(F.lit(1), F.length(padded) - (size - 1)), lambda i: F.substring(padded, i, F.lit(size))
    )
    return T.bind(
        grams,
        lambda gs: F.transform(
            gs,
            lambda g, i: F.concat(g, F.size(F.filter(F.slice(gs, 1, i + 1), lambda x: x == g)).cast("string")),
        ),
    )


def near_words(words: DataFrame, others: DataFrame, near: float) -> DataFrame:
    """word, other, distance of all pairs whose edit distance is at most `near` of the longer length.

    Up to a half, such words share one of their padded letter pairs at least, beyond that (and below 1)
    a letter; how many they must share follows from the longer length.
    """
    size = 2 if near <= 0.5 else 1

    def listed(df: DataFrame, name: str) -> DataFrame:
        grams = df.select("word", F.explode(_grams(F.col("word"), size)).alias("gram"))
        return grams.select(F.col("word").alias(name), F.length("word").alias(f"{name}_length"), "gram")

    longer = F.greatest("word_length", "other_length")
    edits = F.floor(F.lit(near) * longer + F.lit(1e-9)).cast("int")
    shared = longer + F.lit(size - 1) - edits * size
    pairs = (
        listed(words, "word").join(listed(others, "other"), "gram")
        .where(F.abs(F.col("word_length") - F.col("other_length")) <= edits)
        .groupBy("word", "other", longer.alias("longer"), edits.alias("edits"), shared.alias("shared"))
        .agg(F.count("*").alias("found")).where(F.col("found") >= F.col("shared"))
    )
    exact = F.expr("levenshtein(word, other, edits)")
    return (
        pairs.withColumn("edit", exact).where(F.col("edit") >= 0)
        .select("word", "other", (F.col("edit") / F.col("longer")).alias("distance"))
    )


def _probes(forms: DataFrame, form: str, lists: DataFrame, word: str, t: float, near: float) -> DataFrame:
    """(form, word): of each form the rarest words, one more than can be farther than `near` from the
    other side if its mean is at most `t`. `lists` has how many forms a word leads to; a word that
    leads nowhere is the rarest of all."""
    used = F.greatest(F.ceil(F.lit(t / near) * F.col("size") - F.lit(1e-9)), F.lit(1))
    rows = forms.select(F.col(form), F.explode(form).alias("word"), F.size(form).alias("size"))
    led = rows.join(lists, "word", "left").withColumn("reach", F.coalesce("reach", F.lit(0)))
    order = Window.partitionBy(form).orderBy("reach", "word")
    chosen = led.withColumn("nth", F.row_number().over(order)).where((F.col("nth") <= used) & (F.col("reach") > 0))
    return chosen.select(form, F.col("word").alias(word)).distinct()


def _reach(near: DataFrame, word: str, other: str, uses: DataFrame) -> DataFrame:
    """word, reach: forms of the other side in which a near word of `word` is used."""
    counted = near.join(uses.select(F.col("word").alias(other), "uses"), other)
    return counted.groupBy(F.col(word).alias("word")).agg(F.sum("uses").alias("reach"))


def _uses(forms: DataFrame, form: str) -> DataFrame:
    return forms.select(F.explode(F.array_distinct(form)).alias("word")).groupBy("word").agg(F.count("*").alias("uses"))


def _round(keys: DataFrame, choices: DataFrame, least: int) -> DataFrame:
    """words, best (score, neg_order, match) of the keys whose best score is at least `least`."""
    t = 1 - least / 100
    near = max(t, 0.5)  # the farther, the fewer words are looked up, and the more word pairs are near
    key_uses, choice_uses = _uses(keys, "words"), _uses(choices, "choice_words")
    pairs = written(near_words(key_uses.select("word"), choice_uses.select("word"), near), "near-words")
    by_key = _probes(keys, "words", _reach(pairs, "word", "other", choice_uses), "word", t, near)
    by_choice = _probes(choices, "choice_words", _reach(pairs, "other", "word", key_uses), "other", t, near)
    holding = choices.select("choice_words", F.explode(F.array_distinct("choice_words")).alias("other"))
    held = keys.select("words", F.explode(F.array_distinct("words")).alias("word"))
    met = by_key.join(pairs, "word").join(holding, "other").select("words", "choice_words")
    met_back = by_choice.join(pairs, "other").join(held, "word").select("words", "choice_words")
    scored = (
        for_costly_rows(met.unionByName(met_back).distinct())
        .withColumn("score", fuzzy.token_score_words(F.col("words"), F.col("choice_words")))
        .where(F.col("score") >= least)
        .join(choices, "choice_words")
    )
    best = F.max(F.struct("score", (-F.col("choice_order")).alias("neg_order"), "match")).alias("best")
    return scored.groupBy("words").agg(best)


def best_choices(
    keys: DataFrame, column: str, choices: DataFrame, choice: str, order: str, cutoff: int,
    below: bool = True,
) -> DataFrame:
    """key, match, score of every distinct non-null key: the choice with the highest token score, of
    equal ones the one with the smallest `order` (distinct numbers). Null choices do not count.

    The match of a key is null without any choice, the score null too if the key or all choices have
    no words. Keys and choices with the same words are scored once. Without `below` only keys that reach
    the cutoff are looked for: the first round alone.
    """
    spark = keys.sparkSession
    named = written(
        keys.select(F.col(column).cast("string").alias("key")).dropna().distinct()
        .withColumn("words", words_of(F.col("key"))), "fuzzy-keys",
    )
    listed = choices.select(
        F.col(order).cast("long").alias("choice_order"), F.col(choice).cast("string").alias("match")
    ).dropna(subset=["match"])
    first = F.min(F.struct("choice_order", "match")).alias("first")
    forms = written(
        listed.withColumn("choice_words", words_of(F.col("match"))).groupBy("choice_words").agg(first)
        .select("choice_words", "first.*"), "fuzzy-choices",
    )
    worded = forms.where(F.size("choice_words") > 0)
    left = named.select("words").where(F.size("words") > 0).distinct()
    found = None
    for least in sorted({max(1, min(100, cutoff)), *(r for r in ROUNDS if r < cutoff)}, reverse=True):
        got = written(_round(left, worded, least), "fuzzy-found")
        found = got if found is None else found.unionByName(got)
        if not below:
            return named.join(found, "words").select("key", "best.match", "best.score")
        left = written(left.join(got, "words", "left_anti"), "fuzzy-left")
        if left.isEmpty():
            break
    # what is left scores 0 with every choice; without words there is no score
    zero, none = (
        rows.agg(F.min(F.struct("choice_order", "match")).alias("m")).select(F.col("m.match").alias("fallback"))
        for rows in (worded, forms)
    )
    fallback = spark.createDataFrame([(True,), (False,)], "has_words boolean")
    fallback = fallback.withColumn("fallback", F.when(F.col("has_words"), F.coalesce(zero.scalar(), none.scalar())).otherwise(none.scalar()))
    fallback = fallback.withColumn("worst", F.when(F.col("has_words") & zero.scalar().isNotNull(), 0))
    joined = named.join(found, "words", "left").withColumn("has_words", F.size("words") > 0)
    return joined.join(fallback, "has_words").select(
        "key",
        F.when(F.col("best").isNotNull(), F.col("best.match")).otherwise(F.col("fallback")).alias("match"),
        F.coalesce("best.score", "worst").alias("score"),
    )
