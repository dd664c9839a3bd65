"""Label counts, rare-class collapsing, vocabularies and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions import fuzzy
from casemill.functions import text as T
from casemill.operators import joins
from casemill.session import for_costly_rows

SALTS = 256
#: Copies of the kept labels in their join: the rows of a frequent label spread over as many tasks.
LABEL_SALTS = 32


def value_counts(df: DataFrame, label: str) -> DataFrame:
    """label, absolute, percent, percent_not_null; nulls are a row, without percent_not_null."""
    counts = df.groupBy(F.col(f"`{label}`").alias("label")).agg(F.count("*").alias("absolute"))
    totals = counts.agg(
        F.struct(
            F.sum("absolute").alias("n"),
            F.sum(F.when(F.col("label").isNotNull(), F.col("absolute"))).alias("n_known"),
        )
    ).scalar()
    return counts.select(
        "label",
        "absolute",
        (100 * F.col("absolute") / totals["n"]).alias("percent"),
        F.when(F.col("label").isNotNull(), 100 * F.col("absolute") / totals["n_known"]).alias(
            "percent_not_null"
        ),
    )


def value_counts_exploded(df: DataFrame, labels: str) -> DataFrame:
    """`value_counts` after flattening list labels."""
    return value_counts(T.exploded(df, [], F.col(f"`{labels}`"), "label"), "label")


def intervention_counts(df: DataFrame, text: str = "intervention_raw") -> DataFrame:
    """intervention, counts, classes; by number of classes, then text."""
    counts = (
        df.filter(F.col(text).isNotNull())
        .groupBy(F.col(text).alias("intervention"))
        .agg(F.count("*").alias("counts"))
    )
    classified = for_costly_rows(counts).withColumn("classes", fuzzy.fuzzy_labels(F.col("intervention")))
    return classified.orderBy(F.size("classes"), "intervention")


def top_labels(df: DataFrame, label: str, k: int) -> DataFrame:
    """The k most frequent labels; equal counts in label order."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"))
    return counts.agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(k)


def topk_other(df: DataFrame, label: str, k: int, other: str = K.OTHER) -> DataFrame:
    """Keep the k most frequent labels, the rest becomes `other`."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1)))
    top = top_labels(df, label, k).select(F.col("label").alias("_top"), copies.alias("_copy"))
    salt = F.pmod(F.xxhash64(*[f"`{c}`" for c in df.columns]), F.lit(LABEL_SALTS))
    on = (F.col(label) == F.col("_top")) & (F.col("_salt") == F.col("_copy"))
    joined = df.withColumn("_salt", salt).join(top, on, "left").drop("_salt", "_copy")
    kept = F.when(F.col(label).isNull() | F.col("_top").isNotNull(), F.col(label)).otherwise(other)
    return joined.withColumn(label, kept).drop("_top")


def singletons_other(df: DataFrame, label: str, other: str = K.OTHER) -> DataFrame:
    """Only labels seen once become `other`.

    The count also carries the salt of its row. A label seen once has one salt, so the join key
    can hold the salt and the rows of a frequent label spread over all salts.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[f"`{c}`" for c in df.columns]), F.lit(SALTS)))
    single = (
        salted.groupBy(F.col(label).alias("_label"))
        .agg(F.count("*").alias("_n"), F.min("_salt").alias("_its_salt"))
        .filter((F.col("_n") == 1) & F.col("_label").isNotNull())
    )
    on = (F.col(label) == F.col("_label")) & (F.col("_salt") == F.col("_its_salt"))
    joined = salted.join(single, on, "left")
    rare = F.when(F.col("_n").isNotNull(), other).otherwise(F.col(label))
    return joined.withColumn(label, rare).drop("_salt", "_label", "_n", "_its_salt")


def topk_other_list(df: DataFrame, labels: str, k: int, other: str = K.OTHER) -> DataFrame:
    """Keep the k most frequent labels inside list labels, replace the others elementwise."""
    top = top_labels(T.exploded(df, [], labels, "label"), "label", k).agg(F.collect_list("label")).scalar()
    return df.withColumn("_top", top).withColumn(
        labels,
        F.transform(
            labels, lambda y: F.when(F.array_contains(F.col("_top"), y), y).otherwise(other)
        ),
    ).drop("_top")


def label_vocabulary(df: DataFrame, label: str) -> DataFrame:
    """Sorted distinct labels of a scalar or list column."""
    if df.schema[label].dataType.typeName() == "array":
        values = T.exploded(df, [], label, "label")
    else:
        values = df.select(F.col(label).alias("label"))
    return values.dropna().distinct().orderBy("label")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """The same table, or an error naming one duplicated key."""
    found = duplicate_keys(df, *keys).limit(1).collect()
    if found:
        raise ValueError(f"duplicated key {found[0].asDict()}")
    return df


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of one column."""
    return df.select(column).dropna().distinct()


def manual_table(sheet: DataFrame, **names: str) -> DataFrame:
    """Manual label table; the texts must be unique."""
    return require_unique(joins.manual_label_table(sheet, **names), "x")
