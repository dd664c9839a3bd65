"""Diagnosis texts with terminology codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions import text
from casemill.operators import counts, filters, joins

X_COLUMNS = ["Diagnostico"]
Y_COLUMNS = ["ConceptID_Morphologic", "CodTopografico"]


def coded_dataset(
    df: DataFrame,
    x_columns: Sequence[str] = tuple(X_COLUMNS),
    y_columns: Sequence[str] = tuple(Y_COLUMNS),
    study: str = K.STUDY,
) -> DataFrame:
    """x_/y_ columns of rows whose first text is known; `x_join` when there are several texts."""
    known = df.dropna(subset=[x_columns[0]])
    chosen = [F.col(c).alias(f"x_{c}") for c in x_columns]
    chosen += [F.col(c).alias(f"y_{c}") for c in y_columns]
    if len(x_columns) > 1:
        chosen.append(text.join_sections(list(x_columns)).alias("x_join"))
    return known.select(study, *chosen)


def topk_xy(
    df: DataFrame,
    x: str,
    y: str,
    topk: int = -1,
    other: str = K.OTHER,
    names: DataFrame | None = None,
    strict: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """x and one code y per row; rare codes as `other`; codes translated through (code, name).

    With `topk=-1` only the codes seen once are rare.
    """
    xy = df.select(*keep, F.col(x).alias("x"), F.col(y).alias("y")).dropna(subset=["x", "y"])
    xy = filters.single_code(xy, "y")
    if topk == -1:
        xy = counts.singletons_other(xy, "y", other)
    else:
        xy = counts.topk_other(xy, "y", topk, other)
    return xy if names is None else joins.code_names(xy, names, "y", other, strict)
