"""Stateless report operators on arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from casemill.session import scratch_dir
from casemill.sources import writers


def arriving_reports(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines that keep arriving in a folder."""
    return spark.readStream.schema(schema).json(folder)


def span_tasks(
    reports: DataFrame, path: str, text: str, study: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Write annotation tasks with the measures found, for everything that has arrived so far.

    Progress is kept in `checkpoint`; a restarted query goes on after the last finished batch.
    """
    rows = writers.span_task_rows(reports, text, study)
    kept = checkpoint or scratch_dir(reports.sparkSession, "progress")
    return (
        rows.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", kept)
        .trigger(availableNow=True)
        .start()
    )
