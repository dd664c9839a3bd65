"""Projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from casemill import constants as K
from casemill.functions import forms, text
from casemill.sources.names import cleaned_name


def rename_clean(df: DataFrame, columns: Sequence[str], prefix: str = "x_") -> DataFrame:
    """Rename text columns to `<prefix><cleaned name>`, blanks as underscores."""
    return df.withColumnsRenamed({c: prefix + cleaned_name(c) for c in columns})


def valid_only(df: DataFrame, flag: str = "valid") -> DataFrame:
    return df.filter(F.col(flag))


def without_studies(
    df: DataFrame, denied: Iterable[str] | DataFrame, study: str = K.STUDY
) -> DataFrame:
    """Drop denied studies, given as a short list or as a table with the study column."""
    if isinstance(denied, DataFrame):
        return df.join(denied.select(study), study, "left_anti")
    return df.filter(~F.coalesce(F.col(study).isin(list(denied)), F.lit(False)))


def with_form(df: DataFrame, column: str) -> DataFrame:
    return df.filter(forms.has_form(F.col(column)))


def labelled(df: DataFrame, *labels: str) -> DataFrame:
    return df.dropna(subset=list(labels))


def single_code(df: DataFrame, label: str) -> DataFrame:
    """Drop rows whose label holds several codes."""
    return df.filter(~F.contains(F.col(label), F.lit(",")))


def has_mandatory(
    labels: Column, mandatory: Sequence[str] = tuple(K.MANDATORY_INTERVENTIONS)
) -> Column:
    return F.arrays_overlap(labels, F.array(*[F.lit(m) for m in mandatory]))


def valid_study(form: Column) -> Column:
    """Form parsed, manual label known, mandatory intervention present."""
    return F.coalesce(has_mandatory(form["intervention_manual"]), F.lit(False))


def no_other_sample(
    df: DataFrame, labels: Sequence[str], key: str, seed: int = 0, other: str = K.OTHER
) -> DataFrame:
    """One row without nulls or rare-class labels, picked by a seeded hash of its key."""
    clean = df.dropna()
    for label in labels:
        clean = clean.filter(F.col(label) != other)
    pick = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    return clean.orderBy(pick, key).limit(1)


def prune_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Empty strings, lists and maps to null; a struct with nothing left to null, at every depth."""
    schema = df.schema
    names = df.columns if columns is None else list(columns)
    return df.withColumns({n: _pruned(F.col(f"`{n}`"), schema[n].dataType) for n in names})


def _pruned(c: Column, kind: ST.DataType) -> Column:
    if isinstance(kind, ST.StringType):
        return text.blank_to_null(c)
    if isinstance(kind, (ST.ArrayType, ST.MapType)):
        return F.when(F.size(c) > 0, c)
    if isinstance(kind, ST.StructType):
        parts = [_pruned(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
        kept = [_is_present(c[f.name], f.dataType) for f in kind.fields]
        return F.when(_any(kept), F.struct(*parts))
    return c


def _is_present(c: Column, kind: ST.DataType) -> Column:
    if isinstance(kind, ST.StringType):
        return F.coalesce(c != "", F.lit(False))
    if isinstance(kind, (ST.ArrayType, ST.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(kind, ST.StructType):
        return _any([_is_present(c[f.name], f.dataType) for f in kind.fields])
    return c.isNotNull()


def _any(conditions: Sequence[Column]) -> Column:
    result = F.lit(False)
    for c in conditions:
        result = result | c
    return result


def count_leaves(df: DataFrame, column: str) -> Column:
    """Number of leaf fields present under a column; a list is one leaf, a map one per entry."""
    return _leaves(F.col(f"`{column}`"), df.schema[column].dataType)


def _leaves(c: Column, kind: ST.DataType) -> Column:
    if isinstance(kind, ST.StructType):
        total = F.lit(0)
        for f in kind.fields:
            total = total + _leaves(c[f.name], f.dataType)
        return total
    if isinstance(kind, ST.MapType):
        return F.coalesce(F.size(c), F.lit(0))
    return c.isNotNull().cast("int")
