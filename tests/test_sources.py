from __future__ import annotations

import json

from casemill import constants as K
from casemill.operators import counts
from casemill.plans import training
from casemill.sources import readers


def test_yearly_files(spark, tmp_path):
    for year in (2017, 2018):
        (tmp_path / f"reports_{year}.csv").write_text(f'Estudio,Macro\nB{year},"dos\nlíneas ""x"""\n')
    rows = readers.yearly_extracts(spark, str(tmp_path / "*.csv"), "Estudio string, Macro string").collect()
    assert sorted(tuple(r) for r in rows) == [
        ("B2017", 'dos\nlíneas "x"', "2017"), ("B2018", 'dos\nlíneas "x"', "2018"),
    ]


def test_form_document(spark, tmp_path):
    path = tmp_path / "forms.json"
    path.write_text(json.dumps({"B1": {"pt": "1c", "tumor_features": {"size": "2 cm"}}, "B2": {}}, ensure_ascii=False))
    schema = "tumor_features struct<size: string>, pt string"
    found = readers.form_json_document(spark, str(path), f"struct<{schema}>")
    assert found.columns == ["Estudio", "pt", "tumor_features.size"]
    assert sorted(tuple(r) for r in found.collect()) == [("B1", "1c", "2 cm"), ("B2", None, None)]


def test_code_names(spark, tmp_path):
    path = tmp_path / "codes.json"
    path.write_text(json.dumps({"codes": {"1": "uno", "2": "dos"}}, indent=1))
    assert {tuple(r) for r in readers.code_names(spark, str(path)).collect()} == {("1", "uno"), ("2", "dos")}


def test_manual_sheet(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text(
        f"{K.MANUAL_SHEET_TEXT},{K.MANUAL_SHEET_LABEL},value_count\n"
        "a,Mastectomía radical modificada + BSGC,3\nb,No mama,1\n"
    )
    table = counts.manual_table(readers.manual_sheet(spark, str(path)))
    assert {r["x"]: r["y"] for r in table.collect()} == {"a": ["bsgc", "mrm"], "b": ["invalid"]}


def test_training_job_separates_clear_classes(spark):
    rows = spark.range(120).selectExpr(
        "id", "concat(CASE WHEN id % 2 = 0 THEN 'ductal tumor ' ELSE 'tubular nódulo ' END, 'caso ', id % 7) AS text",
        "CASE WHEN id % 2 = 0 THEN 'cdi' ELSE 'ct' END AS y",
    )
    done = training.train(rows, "text", "y", "id", "binary", max_iter=10)
    assert done.validation.filter("y <> prediction").count() == 0
    accuracy = done.report.filter("label = 'accuracy'").collect()[0]
    assert accuracy["f1"] == 1.0 and accuracy["support"] == 18
