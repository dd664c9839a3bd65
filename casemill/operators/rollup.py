"""Many rows per study into one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from casemill import constants as K
from casemill.functions import forms
from casemill.operators import ranking
from casemill.operators.forms import leaf_paths


def entries(
    rows: DataFrame, columns: Sequence[str], study: str = K.STUDY, seq: str = "row_seq"
) -> DataFrame:
    """Distinct non-null values per (study, column): study, column, entry_no, value.

    Values are numbered in first-seen order of `seq`, a row number that is unique in the study.
    """
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
                for c in columns
            ]
        )
    )
    stacked = rows.filter(F.col(study).isNotNull()).select(study, seq, cells.alias("_cell"))
    first_seen = (
        stacked.select(study, seq, "_cell.*")
        .filter(F.col("value").isNotNull())
        .groupBy(study, "column", "value")
        .agg(F.min(seq).alias("_first"))
    )
    return _numbered(first_seen, [study, "column"])


def _numbered(first_seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    bucket = ranking.sequence_bucket(F.col("_first"))
    return ranking.number_rows(first_seen, keys, bucket, ["_first"], "entry_no").drop("_first")


def render(
    numbered: DataFrame, keys: Sequence[str], separator: str, out: str = "text"
) -> DataFrame:
    """One text per group: `##ENTRY_i##<separator><value>` joined by a blank line.

    Entries are joined in pieces of 1024 first, so that a group with very many entries is put
    together from a few strings. The trailing whitespace of several entries is stripped.
    """
    entry = F.concat(
        F.lit("##ENTRY_"), F.col("entry_no").cast("string"), F.lit("##" + separator), F.col("value")
    )
    pieces = (
        numbered.withColumn("_piece", F.floor((F.col("entry_no") - 1) / 1024))
        .groupBy(*keys, "_piece")
        .agg(_in_order("entry_no", entry).alias("_text"), F.count("*").alias("_n"))
    )
    whole = pieces.groupBy(*keys).agg(
        _in_order("_piece", F.col("_text")).alias("_text"), F.sum("_n").alias("_n")
    )
    stripped = F.rtrim(F.col("_text"), F.lit(K.WHITESPACE))
    return whole.select(
        *keys, F.when(F.col("_n") > 1, stripped).otherwise(F.col("_text")).alias(out)
    )


def _in_order(position: str, value: Column) -> Column:
    parts = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), value.alias("v"))))
    return F.array_join(F.transform(parts, lambda x: x["v"]), "\n\n")


def study_rollup(
    rows: DataFrame, columns: Sequence[str], study: str = K.STUDY, seq: str = "row_seq"
) -> DataFrame:
    """One row per study; each column holds its rendered distinct entries, null without any."""
    texts = render(entries(rows, columns, study, seq), [study, "column"], " ")
    wide = texts.groupBy(study).agg(
        *[F.max(F.when(F.col("column") == c, F.col("text"))).alias(c) for c in columns]
    )
    # studies with no value in any of the columns
    every = rows.filter(F.col(study).isNotNull()).select(study).distinct()
    return every.join(wide, study, "left")


def study_forms(
    rows: DataFrame,
    form_columns: Sequence[str] = tuple(K.FORM_COLUMNS),
    study: str = K.STUDY,
    seq: str = "row_seq",
) -> DataFrame:
    """Distinct form texts per study: study, entry_no, value; column order, then row order."""
    cells = F.posexplode(F.array(*[F.col(f"`{c}`") for c in form_columns])).alias("_at", "value")
    found = (
        rows.filter(F.col(study).isNotNull())
        .select(study, seq, cells)
        .filter(forms.has_form(F.col("value")))
        .groupBy(study, "value")
        .agg(F.min(F.struct("_at", seq)).alias("_first"))
    )
    at_bucket = ranking.sequence_bucket(F.col(f"_first.{seq}")).alias("rows")
    bucket = F.struct(F.col("_first._at").alias("column"), at_bucket)
    return ranking.number_rows(found, [study], bucket, ["_first"], "entry_no").drop("_first")


def form_text(study_form_rows: DataFrame, study: str = K.STUDY) -> DataFrame:
    """All forms of a study in one text column."""
    return render(study_form_rows, [study], "\n", K.FORM_OUTPUT)


def form_leaves(parsed: DataFrame, form: str = "form", study: str = K.STUDY) -> DataFrame:
    """Every present leaf of the parsed forms: study, path, value.

    Lists are one leaf, as JSON text; a map has one leaf for each of its keys, under the key's name.
    """
    plain, maps = [], []
    for path, x, kind in leaf_paths(parsed.schema[form].dataType, f"`{form}`"):
        if isinstance(kind, ST.MapType):
            maps.append(
                f"transform(coalesce(map_entries({x}), array()), e -> named_struct("
                f"'path', concat('{path}.', e.key), 'value', CAST(e.value AS STRING)))"
            )
        else:
            text = f"to_json({x})" if isinstance(kind, ST.ArrayType) else f"CAST({x} AS STRING)"
            plain.append(f"named_struct('path', '{path}', 'value', {text})")
    rows = f"concat({', '.join([f'array({", ".join(plain)})', *maps])})"
    leaves = parsed.select(study, F.expr(f"inline({rows})"))
    return leaves.filter(F.col("value").isNotNull())


def conflicts(leaves: DataFrame, study: str = K.STUDY) -> DataFrame:
    """Options of every (study, path) with more than one distinct value.

    Two counting steps spread a study with very many forms; nothing is collected per study.
    """
    options = leaves.groupBy(study, "path", "value").agg(F.count("*").alias("n_forms"))
    several = options.groupBy(study, "path").agg(F.count("*").alias("n_options"))
    return options.join(several.filter(F.col("n_options") > 1), [study, "path"])


def raise_on_conflict(leaves: DataFrame, study: str = K.STUDY) -> None:
    """Strict mode: fail with the first conflict."""
    found = conflicts(leaves, study).orderBy(study, "path", "value").limit(2).collect()
    if found:
        values = " / ".join(repr(r["value"]) for r in found)
        raise ValueError(f"forms of study {found[0][study]} disagree on {found[0]['path']}: {values}")


def merge_forms(
    parsed: DataFrame, order: Sequence[str], form: str = "form", study: str = K.STUDY
) -> DataFrame:
    """One form per study: for each top-level field the last non-null value along `order`."""
    names = parsed.schema[form].dataType.names
    at = f"struct({', '.join(order)})"
    latest = [
        F.expr(f"max_by({form}.`{n}`, CASE WHEN {form}.`{n}` IS NOT NULL THEN {at} END)").alias(n)
        for n in names
    ]
    merged = parsed.groupBy(study).agg(*latest)
    return merged.select(study, F.struct(*names).alias(form))


def sort_studies(df: DataFrame, study: str = K.STUDY) -> DataFrame:
    return df.orderBy("year", study)
