"""Joins and lookups.

No side is broadcast by hint: the optimizer broadcasts a table when its measured size is below the
threshold, and splits skewed partitions of the other joins at run time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions import fuzzy
from casemill.functions import text as T
from casemill.operators import choice_index
from casemill.session import for_costly_rows


def on_distinct(
    df: DataFrame, column: str, results: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """Add costly functions of a text column, computed once per distinct text.

    The copies of one text are joined back by the text; null texts get null results. The optimizer
    moves a later filter on a result, or one for null texts, below the distinct step and so computes
    it for every row; it does not move a filter below an explode, here of one element.
    """
    keyed = df.withColumn("_key", _once(F.col(column)))
    texts = for_costly_rows(df.select(_once(F.col(column)).alias("_text")).dropna().distinct())
    scored = texts.select("_text", *[f(F.col("_text")).alias(f"_r{i}") for i, f in enumerate(results.values())])
    found = F.struct(*[F.col(f"_r{i}").alias(n) for i, n in enumerate(results)])
    scored = scored.select("_text", _once(found).alias("_found")).select("_text", "_found.*")
    return keyed.join(scored, F.col("_key") == F.col("_text"), "left").drop("_key", "_text")


def _once(value: Column) -> Column:
    return F.explode_outer(F.array(value))


def manual_labels(df: DataFrame, labels: DataFrame, text: str, out: str) -> DataFrame:
    """Left lookup of a cleaned text in the manual table (x, y); x must be unique there."""
    table = labels.select(F.col("x").alias("_x"), F.col("y").alias(out))
    return df.join(table, F.col(text) == F.col("_x"), "left").drop("_x")


def align_left(studies: DataFrame, values: DataFrame, study: str = K.STUDY) -> DataFrame:
    """Add columns of another table with one row per study."""
    return studies.join(values, study, "left")


def outer_labels(
    x: DataFrame, labels: DataFrame, study: str = K.STUDY, required: str = "y_intervention"
) -> DataFrame:
    """Full outer join of texts and labels, then only rows with the required label.

    The required label is on the label side, so the filter lets the optimizer turn the full outer
    join into a one-sided one; labelled studies without text stay with null text.
    """
    return x.join(labels, study, "full_outer").dropna(subset=[required])


def two_label_sets(first: DataFrame, second: DataFrame, study: str = K.STUDY) -> DataFrame:
    return first.join(second, study, "full_outer")


def code_names(
    df: DataFrame, names: DataFrame, label: str = "y", other: str = K.OTHER, strict: bool = False
) -> DataFrame:
    """Replace codes by their names from (code, name); the rare-class label stays as it is."""
    table = names.select(F.col("code").alias("_code"), F.col("name").alias("_name"))
    joined = df.join(table, (F.col(label) == F.col("_code")) & (F.col(label) != other), "left")
    named = F.col("_name")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("unknown code: "), F.col(label))).cast("string")
        named = F.when(F.col("_code").isNotNull(), named).otherwise(unknown)
    return joined.withColumn(label, F.when(F.col(label) == other, other).otherwise(named)).drop(
        "_code", "_name"
    )


Choices = Sequence[str] | DataFrame


def fuzzy_best(
    keys: DataFrame,
    column: str,
    choices: Choices,
    cutoff: int = 90,
    scorer: fuzzy.Scorer | None = None,
    choice: str = "match",
    order: str = "choice_order",
) -> DataFrame:
    """Distinct keys with their best choice: key, match, score (only score >= cutoff).

    `choices` is a short list, or a table of any size with the columns `choice` and `order`; a table
    is searched by `choice_index` and takes the token score only.
    """
    best = _best(keys, column, choices, scorer, choice, order, cutoff, below=cutoff <= 0)
    return best.filter(F.col("score") >= cutoff)


def fuzzy_unmatched(
    keys: DataFrame,
    column: str,
    choices: Choices,
    cutoff: int = 90,
    scorer: fuzzy.Scorer | None = None,
    choice: str = "match",
    order: str = "choice_order",
) -> DataFrame:
    """Distinct keys below the cutoff, with their best choice and its score."""
    below = (F.col("score") < cutoff) | F.col("score").isNull()
    return _best(keys, column, choices, scorer, choice, order, cutoff).filter(below)


def _best(
    keys: DataFrame, column: str, choices: Choices, scorer: fuzzy.Scorer | None,
    choice: str, order: str, cutoff: int, below: bool = True,
) -> DataFrame:
    if isinstance(choices, DataFrame):
        if scorer is not None:
            raise ValueError("a table of choices is compared by token score; give other scorers a list")
        return choice_index.best_choices(keys, column, choices, choice, order, cutoff, below)
    distinct = for_costly_rows(keys.select(F.col(column).alias("key")).dropna().distinct())
    best = distinct.withColumn("_best", fuzzy.best_choice(F.col("key"), choices, scorer))
    return best.select(
        "key", F.col("_best.match").alias("match"), F.col("_best.score").alias("score")
    )


def manual_label_table(
    sheet: DataFrame, text: str = K.MANUAL_SHEET_TEXT, label: str = K.MANUAL_SHEET_LABEL
) -> DataFrame:
    """Manual label sheet as (x, y): cleaned label codes, sorted."""
    codes = T.clean_hard(F.col(f"`{label}`"))
    for name, code in K.MANUAL_RENAMES:
        codes = F.replace(codes, F.lit(name), F.lit(code))
    y = F.array_sort(F.transform(F.split(codes, r"\+"), T.strip))
    return sheet.select(F.col(f"`{text}`").alias("x"), y.alias("y"))
