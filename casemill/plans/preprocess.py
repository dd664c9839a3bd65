"""Raw report rows to studies and parsed forms."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.operators import filters, forms, rollup
from casemill.session import spread, written
from casemill.sources import writers


class Processed(NamedTuple):
    studies: DataFrame
    forms: DataFrame
    conflicts: DataFrame


def process_reports(
    rows: DataFrame,
    text_columns: Sequence[str],
    manual: DataFrame | None = None,
    form_columns: Sequence[str] = tuple(K.FORM_COLUMNS),
    study: str = K.STUDY,
    seq: str = "row_seq",
    denied: Sequence[str] | DataFrame = (),
    strict: bool = False,
) -> Processed:
    """Roll rows up to studies, parse each distinct form of a study once, merge and validate.

    Conflicting forms are reported as rows; `strict` raises on the first one. The form texts and
    the parsed forms, which several results read, are written to the scratch folder: parsing runs
    once, a lost executor does not repeat it, and the later plans stay small.
    """
    rows = filters.without_studies(rows, denied, study)
    found = written(rollup.study_forms(rows, form_columns, study, seq), "form-texts")
    parsed = written(forms.both_layouts(spread(found), "value", manual), "parsed-forms")
    leaves = rollup.form_leaves(parsed, "form", study)
    if strict:
        rollup.raise_on_conflict(leaves, study)
    merged = rollup.merge_forms(parsed, ["layout", "entry_no"], "form", study)
    studies = (
        rollup.study_rollup(rows, text_columns, study, seq)
        .join(rollup.form_text(found, study), study, "left")
        .join(merged.select(study, filters.valid_study(F.col("form")).alias("valid")), study, "left")
        .withColumn("valid", F.coalesce("valid", F.lit(False)))
    )
    return Processed(studies, merged, rollup.conflicts(leaves, study))


def process_yearly(
    rows: DataFrame,
    *args,
    study: str = K.STUDY,
    denied: Sequence[str] | DataFrame = (),
    **options,
) -> Processed:
    """`process_reports` per year: a study that appears in two years gives one row for each.

    `denied` names plain studies. Rows without a study are left out; a null year is a year.
    """
    rows = filters.without_studies(rows, denied, study).filter(F.col(study).isNotNull())
    by_year = rows.withColumn("_study", F.struct("year", study)).drop(study)
    done = process_reports(by_year.withColumnRenamed("_study", study), *args, study=study, **options)

    def split(df: DataFrame) -> DataFrame:
        return df.withColumns({"year": F.col(f"{study}.year"), study: F.col(f"{study}.{study}")})

    return Processed(*[split(df) for df in done])


def save(processed: Processed, studies_path: str, forms_path: str) -> None:
    writers.studies(rollup.sort_studies(processed.studies), studies_path)
    writers.form_json(processed.forms, forms_path)
