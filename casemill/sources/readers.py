"""Readers. Schemas are explicit; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from casemill import constants as K
from casemill.operators import forms

ANNOTATIONS = "text string, histological_type_classification string"
SIZE_ANNOTATIONS = (
    "text string, tokens array<struct<text: string>>, "
    "spans array<struct<token_start: int, token_end: int>>"
)
CODES = "codes map<string,string>"


def yearly_extracts(
    spark: SparkSession,
    pattern: str,
    schema: str | ST.StructType,
    file_format: str = "csv",
    year_pattern: str = K.YEAR_IN_PATH,
    **options,
) -> DataFrame:
    """All yearly extracts under a path glob, with `year` from the file or folder name.

    Rows need an order column of their own: files and their parts are read in parallel.
    """
    if file_format == "csv":
        options = {"header": True, "multiLine": True, "escape": '"', **options}
    rows = spark.read.format(file_format).schema(schema).options(**options).load(pattern)
    return rows.select(
        "*", F.regexp_extract(F.col("_metadata.file_path"), year_pattern, 1).alias("year")
    )


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def csv(spark: SparkSession, path: str, schema: str | ST.StructType, sep: str = ",") -> DataFrame:
    """Quoted CSV with a header; texts may hold line breaks and doubled quotes."""
    return spark.read.schema(schema).csv(
        path, header=True, sep=sep, multiLine=True, escape='"', quote='"'
    )


def jsonl(spark: SparkSession, path: str, schema: str | ST.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def form_json(
    spark: SparkSession, path: str, form_schema: str | ST.StructType, study: str = K.STUDY
) -> DataFrame:
    """Forms as flat dotted columns from one record per study (study, form).

    This is the splittable layout that `writers.form_json` produces.
    """
    if isinstance(form_schema, str):
        form_schema = ST.StructType.fromDDL(form_schema)
    schema = ST.StructType([ST.StructField(study, ST.StringType()), ST.StructField("form", form_schema)])
    return forms.flatten(spark.read.schema(schema).json(path), "form", [study])


def form_json_document(
    spark: SparkSession, path: str, form_schema: str | ST.StructType, study: str = K.STUDY
) -> DataFrame:
    """The same from single documents `{study: form, ...}`, one document per file.

    A document is one JSON value, so one task reads it; write large collections as records.
    """
    if isinstance(form_schema, ST.StructType):
        form_schema = form_schema.simpleString()
    documents = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", f"map<string,{form_schema}>")
    rows = documents.select(F.explode(entries).alias(study, "form"))
    return forms.flatten(rows, "form", [study])


def code_names(spark: SparkSession, path: str) -> DataFrame:
    """(code, name) from a document `{"codes": {code: name}}`."""
    documents = spark.read.schema(CODES).json(path, multiLine=True)
    return documents.select(F.explode("codes").alias("code", "name"))


def manual_sheet(spark: SparkSession, path: str, extra: Sequence[str] = ()) -> DataFrame:
    """The manual label sheet; further columns of the sheet are dropped."""
    sheet = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return sheet.select(K.MANUAL_SHEET_TEXT, K.MANUAL_SHEET_LABEL, *extra)
