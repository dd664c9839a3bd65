"""Writers. Every executor writes its own part files; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions import measures


def studies(df: DataFrame, path: str) -> None:
    """Rolled-up studies as `;` separated CSV and as parquet, side by side."""
    csv(df, path + ".csv")
    df.write.mode("overwrite").parquet(path + ".parquet")


def csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"')


def form_json(df: DataFrame, path: str) -> None:
    """One JSON record per study; null fields are absent, non-ASCII characters stay."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def annotation_tasks(
    df: DataFrame, path: str, text: str = "x_join", study: str = K.STUDY, missing: str | None = None
) -> None:
    """JSON lines {text, estudio}; with `missing` only the rows whose label is null."""
    annotation_task_rows(df, text, study, missing).write.mode("overwrite").json(path)


def annotation_task_rows(
    df: DataFrame, text: str, study: str = K.STUDY, missing: str | None = None
) -> DataFrame:
    rows = df if missing is None else df.filter(F.col(missing).isNull())
    return rows.select(F.col(text).alias("text"), F.col(study).alias("estudio"))


def span_task_rows(df: DataFrame, text: str = "x_join", study: str = K.STUDY) -> DataFrame:
    """{text, estudio, spans} with the measures already found."""
    found = F.transform(
        measures.measure_spans(F.col(text)),
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")
        ),
    )
    return df.select(
        F.col(text).alias("text"), F.col(study).alias("estudio"), found.alias("spans")
    )


def span_tasks(df: DataFrame, path: str, text: str = "x_join", study: str = K.STUDY) -> None:
    span_task_rows(df, text, study).write.mode("overwrite").json(path)


def error_pair_rows(
    df: DataFrame, key: str, x: str = "x", true: str = "y_true", pred: str = "y_pred"
) -> tuple[DataFrame, DataFrame]:
    """(truth, prediction) records with the same id, for the rows where they differ."""
    wrong = df.filter(F.col(true) != F.col(pred))

    def records(label: Column) -> DataFrame:
        return wrong.select(
            F.col(key).alias("id"),
            F.struct(F.col(x).alias("text")).alias("input"),
            F.struct(label.alias("text")).alias("output"),
        )

    return records(F.col(true)), records(F.col(pred))


def error_pairs(df: DataFrame, true_path: str, pred_path: str, key: str, **columns: str) -> None:
    for rows, path in zip(error_pair_rows(df, key, **columns), (true_path, pred_path), strict=True):
        rows.write.mode("overwrite").json(path)
