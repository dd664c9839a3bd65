"""The training table from studies and forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions import text as T
from casemill.operators import counts, filters, joins, labels
from casemill.sources.names import cleaned_name


def training_table(
    studies: DataFrame,
    flat_forms: DataFrame,
    x_columns: Sequence[str] = tuple(K.X_COLUMNS),
    diagnosis: str = "Diagnóstico",
    study: str = K.STUDY,
) -> DataFrame:
    """Texts of valid studies joined with every label; only rows with an intervention label.

    One join carries all labels. Labelled studies without a valid text keep null texts.
    """
    valid = filters.valid_only(studies)
    texts = filters.rename_clean(
        valid.select(study, *x_columns, T.join_sections(list(x_columns)).alias("x_join")),
        x_columns,
    )
    table = joins.outer_labels(texts, labels.form_labels(flat_forms, study), study)
    return labels.with_size_labels(table, f"x_{cleaned_name(diagnosis)}", "_form_size").drop(
        "_form_size"
    )


def intervention_table(
    studies: DataFrame,
    flat_forms: DataFrame,
    manual: DataFrame,
    x_columns: Sequence[str] = ("Datos clínicos", "Diagnóstico", "Macro"),
    study: str = K.STUDY,
) -> DataFrame:
    """X_ texts of every study with its raw intervention and the manual label of that text."""
    texts = filters.rename_clean(studies.select(study, *x_columns), x_columns, "X_")
    aligned = joins.align_left(texts, flat_forms.select(study, "intervention_raw"), study)
    return joins.manual_labels(aligned, manual, "intervention_raw", "y")


def label_counts(table: DataFrame) -> DataFrame:
    """Counts of every label column but the token ones: field, label, absolute, percents."""
    parts = []
    for name in table.columns:
        if not name.startswith("y_") or name.startswith("y_size_"):
            continue
        is_list = table.schema[name].dataType.typeName() == "array"
        count = counts.value_counts_exploded if is_list else counts.value_counts
        part = count(table, name).withColumn("label", F.col("label").cast("string"))
        parts.append(part.select(F.lit(name).alias("field"), "*"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
