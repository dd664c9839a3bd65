from __future__ import annotations

from casemill.sources import readers
from casemill.streaming import reports


def test_span_tasks_of_arriving_files(spark, tmp_path):
    schema = "study string, text string"
    source, sink, kept = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for text in ("mide 4 cm", "sin medida"):
        spark.createDataFrame([("a", text)], schema).write.mode("append").json(source)
        stream = reports.arriving_reports(spark, source, schema)
        reports.span_tasks(stream, sink, "text", "study", kept).awaitTermination()
    got = readers.jsonl(spark, sink, "text string, spans array<struct<start: int, end: int>>").collect()
    assert sorted((r["text"], [tuple(s) for s in r["spans"]]) for r in got) == [
        ("mide 4 cm", [(5, 9)]), ("sin medida", []),
    ]
