from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from casemill.functions import bio
from casemill.functions import text as T
from casemill.operators import (
    counts, evaluate, filters, forms, joins, labels, learn, ranking, rollup, samples,
)
from casemill.plans import preprocess, training


def test_labels_of_form_fields(spark):
    def run(values, function):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
        return [r[0] for r in rows.orderBy("i").select(function(F.col("t"))).collect()]

    degrees = [None, "grado i ( 35 puntos )", "grado iii", "Grado II", "gradoii ( 67 )", "carcinoma", "grado intermedio"]
    assert run(degrees, labels.degree) == [0, 1, 3, 2, 2, 0, 1]
    kinds = [None, "bien circunscrito", "microinvasor ( foco )", "infiltrant", "INFILTRANTE + microinvasor"]
    assert run(kinds, labels.infiltrating) == [None, None, 0.0, 1.0, 1.0]
    several = [None, "Sí ( focos )", "no", "no hay multiples", "quizá", "sin datos"]
    assert run(several, labels.multiple) == [None, 1.0, 0.0, 0.0, None, 1.0]


def test_join_sections(spark):
    rows = spark.createDataFrame([("a", None, "c")], "`Datos clínicos` string, Macro string, Micro string")
    text = rows.select(T.join_sections(rows.columns)).collect()[0][0]
    assert text == "\nDatos clínicos: a \nMicro: c"


FORM2 = """TIPO DE INTERVENCIÓN:
TUMORECTOMÍA Y BSGC

DATOS DEL TUMOR:

 1.- TIPO:
      CARCINOMA DUCTAL IN SITU
CON MICROINVASIÓN

2.- LOCALIZACIÓN: CSI
3- TAMAÑO: 1,6 CM
 - FOCO <0,2 MM
4.- GRADO NUCLEAR DE VAN NUYS  (Solo CDIS):  ALTO
5.- NECROSIS:  PRESENTE
6.- PATRÓN ARQUITECTURAL (SOLO CDIS):  SÓLIDO
7.- MÁRGENES DE LA BIOPSIA (Solo CDIS. Siempre marcados con tinta china):
 - LIBRE
8.- MICROCALCIFICACIONES:  NO
"""


def test_layout2(spark):
    rows = spark.createDataFrame([("a", FORM2), ("b", "aquí no hay nada")], "id string, text string")
    got = {r["id"]: r["form"].asDict(True) for r in forms.layout2(rows, "text").collect()}
    assert got["a"]["intervention_raw"] == "tumorectomia + bsgc"
    assert got["a"]["intervention_automatic"] == ["bsgc", "tumorectomia"]
    assert got["a"]["tumor_features"] == {
        "histological_type": "carcinoma ductal in situ\ncon microinvasión",
        "location": "csi",
        "size": "1,6 cm\n - foco <0,2 mm",
        "van_nuys_degree": "alto",
        "tumor_necrosis": "presente",
        "architectural_patern_insitu": "sólido",
        "margin": "- libre",
    }
    assert not any(got["b"].values())
    strict = forms.layout2(rows, "text", single_pattern=True).filter("id = 'a'").collect()[0]["form"]
    assert strict["tumor_features"]["histological_degree"] == "alto"


def test_long_layout2_text(spark):
    """Long fields must not overflow the regex stack."""
    text = FORM2.replace("PRESENTE", "presente " + "x \n" * 30_000)
    rows = spark.createDataFrame([("a", text)], "id string, text string")
    form = forms.layout2(rows, "text").collect()[0]["form"]
    assert len(form["tumor_features"]["tumor_necrosis"]) > 80_000


def test_conflicts(spark):
    rows = spark.createDataFrame(
        [("s", (0, 1, 2, 5)), ("s", (None, 1, 2, None)), ("s", (0, 3, 2, None)), ("t", (1, 1, 1, 1))],
        "study string, form struct<a: int, b: int, c: int, d: int>",
    )
    leaves = rollup.form_leaves(rows, "form", "study")
    found = {(r["study"], r["path"], r["value"]) for r in rollup.conflicts(leaves, "study").collect()}
    assert found == {("s", "b", "1"), ("s", "b", "3")}
    with pytest.raises(ValueError, match="disagree on b"):
        rollup.raise_on_conflict(leaves, "study")


def test_numbering_of_a_hot_group(spark):
    """A third of the rows in one group, cut into many buckets."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 997).cast("string")).alias("k"),
        F.xxhash64("id").alias("v"),
    )
    numbered = ranking.number_rows(rows, ["k"], F.floor(F.col("v") / (1 << 54)), ["v"], "n")
    got = numbered.toPandas()
    want = got.sort_values("v").groupby("k").cumcount() + 1
    assert len(got) == 30_000 and (got["n"] == want.reindex(got.index)).all()


def test_numbering_keeps_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, v int")
    got = ranking.number_rows(rows, ["k"], F.lit(0), ["v"], "n").collect()
    assert sorted((r["k"] or "", r["n"]) for r in got) == [("", 1), ("", 2), ("a", 1)]


def test_rollup_of_a_long_study(spark):
    """More entries than one piece, numbered in first-seen order."""
    rows = spark.range(5000).select(
        F.lit("s").alias("study"), F.col("id").alias("seq"),
        F.concat(F.lit("v"), (F.col("id") % 3000).cast("string")).alias("t"),
    )
    text = rollup.study_rollup(rows, ["t"], "study", "seq").collect()[0]["t"]
    assert text == "\n\n".join(f"##ENTRY_{i + 1}## v{i}" for i in range(3000))


def test_rollup_strips_only_several_entries(spark):
    rows = spark.createDataFrame(
        [("a", 1, "x \n"), ("b", 1, "p"), ("b", 2, "q \n"), ("c", 1, None)], "study string, seq int, t string"
    )
    got = {r["study"]: r["t"] for r in rollup.study_rollup(rows, ["t"], "study", "seq").collect()}
    assert got == {"a": "##ENTRY_1## x \n", "b": "##ENTRY_1## p\n\n##ENTRY_2## q", "c": None}


def test_singletons_with_a_hot_label(spark):
    rows = spark.range(2000).select(
        "id", F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("y")
    )
    got = counts.singletons_other(rows, "y").groupBy("y").count().collect()
    assert {(r["y"], r["count"]) for r in got} == {("hot", 1500), ("otro", 500)}


def test_topk_keeps_nulls(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "y string")
    got = sorted(str(r["y"]) for r in counts.topk_other(rows, "y", 1).collect())
    assert got == ["None", "a", "a", "otro"]


def test_code_names_strict(spark):
    rows = spark.createDataFrame([("1",), ("otro",)], "y string")
    names = spark.createDataFrame([("1", "uno")], "code string, name string")
    assert {r["y"] for r in joins.code_names(rows, names, strict=True).collect()} == {"uno", "otro"}
    unknown = joins.code_names(rows.withColumn("y", F.lit("9")), names, strict=True)
    with pytest.raises(Exception, match="unknown code: 9"):
        unknown.collect()


def test_require_unique(spark):
    rows = spark.createDataFrame([("a",), ("a",)], "x string")
    with pytest.raises(ValueError, match="duplicated key"):
        counts.require_unique(rows, "x")


def test_split_is_independent_of_partitioning(spark):
    rows = spark.range(500)
    first = samples.split(rows, "id", 0.2)
    second = samples.split(rows.repartition(13), "id", 0.2)
    chosen = {r["id"] for r in first.filter("is_validation").collect()}
    assert len(chosen) == 100
    assert chosen == {r["id"] for r in second.filter("is_validation").collect()}


def test_bio_rules(spark):
    cases = [
        ([], "O"), (["I-X"], "I-X"), (["O", "O"], "O"), (["B-X", "B-X"], "E"), (["B-X", "I-X", "I-X"], "B-X"),
        (["B-X", "I-Y"], "E"), (["O", "I-X"], "E"),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, l array<string>")
    got = [r[1] for r in rows.select("i", bio.aggregate_labels(F.col("l"))).orderBy("i").collect()]
    assert got == [c[1] for c in cases]
    rows = spark.createDataFrame([(["I-A", "I-A", "B-A", "I-A", "O", "I-A", "E", "I-A"],)], "l array<string>")
    fixed = rows.select(bio.repair(F.col("l"))).collect()[0][0]
    assert fixed == ["O", "O", "B-A", "I-A", "O", "O", "E", "O"]


def test_exclusive_matrix_needs_one_true_label(spark):
    rows = spark.createDataFrame([([1, 1], [1, 0])], "y array<int>, p array<int>")
    with pytest.raises(Exception, match="exactly one class"):
        evaluate.confusion_exclusive(rows, "y", "p", ["a", "b"]).collect()


def test_prune_and_count(spark):
    rows = spark.createDataFrame(
        [(("", (None, ""), [], {"a": "1", "b": "2"}),)],
        "f struct<a: string, b: struct<c: string, d: string>, e: array<string>, m: map<string,string>>",
    )
    pruned = filters.prune_nulls(rows)
    assert pruned.collect()[0]["f"].asDict(True) == {"a": None, "b": None, "e": None, "m": {"a": "1", "b": "2"}}
    assert pruned.select(filters.count_leaves(pruned, "f")).collect()[0][0] == 2


def test_process_reports_end_to_end(spark):
    rows = spark.createDataFrame(
        [
            (1, "B1", "d1", FORM2, None), (2, "B1", "d2", FORM2, "nota"), (3, "B2", "d3", None, None),
            (4, "B17-10176", "d4", FORM2, None), (5, None, "d5", FORM2, None),
        ],
        "row_seq int, Estudio string, Macro string, `Texto del complementario` string, `Notas (Muestra)` string",
    )
    sheet = spark.createDataFrame([("tumorectomia + bsgc", ["bsgc", "tumorectomia"])], "x string, y array<string>")
    done = preprocess.process_reports(rows, ["Macro"], sheet, strict=True, denied=["B17-10176"])
    got = {r["Estudio"]: r for r in done.studies.collect()}
    assert set(got) == {"B1", "B2"}
    assert got["B1"]["valid"] and not got["B2"]["valid"]
    assert got["B1"]["Macro"] == "##ENTRY_1## d1\n\n##ENTRY_2## d2"
    assert got["B1"]["Formulario"].startswith("##ENTRY_1##\nTIPO DE INTERVENCIÓN:")
    assert got["B2"]["Formulario"] is None
    assert done.conflicts.count() == 0


def test_train_checks_arguments(spark):
    rows = spark.createDataFrame([("a", "x", "y")], "k string, x string, y string")
    with pytest.raises(ValueError, match="unknown problem"):
        training.train(rows, "x", "y", "k", "regression")


def test_conflicts_of_maps_are_per_key(spark):
    rows = spark.createDataFrame(
        [("s", ({"level_1": "2"},)), ("s", ({"level_1": "2", "level_2": "1"},)), ("t", ({"level_1": "1"},)),
         ("t", ({"level_1": "3"},)), ("u", (None,))],
        "study string, form struct<n: map<string,string>>",
    )
    found = rollup.conflicts(rollup.form_leaves(rows, "form", "study"), "study").collect()
    assert {(r["study"], r["path"], r["value"]) for r in found} == {("t", "n.level_1", "1"), ("t", "n.level_1", "3")}


def test_forms_keep_their_order_at_large_row_numbers(spark):
    form = "tipo de intervención: {}"
    rows = spark.createDataFrame(
        [("s", 2**49, form.format("a"), form.format("b")), ("s", 5, None, form.format("c"))],
        "study string, row_seq long, x string, y string",
    )
    got = rollup.study_forms(rows, ["x", "y"], "study").orderBy("entry_no").collect()
    assert [r["value"][-1] for r in got] == ["a", "c", "b"]


def test_yearly_studies(spark):
    rows = spark.createDataFrame(
        [(1, "B1", "2016", "d1", FORM2), (2, "B1", "2017", "d2", None), (3, "B2", "2017", "d3", None),
         (4, "B3", "2017", "d4", FORM2), (5, None, "2017", "d5", None)],
        "row_seq int, study string, year string, Macro string, notes string",
    )
    sheet = spark.createDataFrame([("tumorectomia + bsgc", ["bsgc", "tumorectomia"])], "x string, y array<string>")
    done = preprocess.process_yearly(
        rows, ["Macro"], sheet, ["notes"], study="study", denied=["B3"]
    )
    got = {(r["year"], r["study"]): r["Macro"] for r in done.studies.collect()}
    assert {k: v.split()[-1] for k, v in got.items()} == {
        ("2016", "B1"): "d1", ("2017", "B1"): "d2", ("2017", "B2"): "d3"
    }
    assert [(r["year"], r["study"]) for r in done.forms.collect()] == [("2016", "B1")]


def test_roc_of_one_class_nulls_and_nothing(spark):
    rows = [("a", 0.9, 1), ("a", 0.1, 0), ("a", None, 1), ("b", 0.5, 0), ("b", 0.2, 0)]
    scores = spark.createDataFrame(rows, "label string, score double, truth int")
    assert {r["label"]: r["auc"] for r in evaluate.auc(scores).collect()} == {"a": 1.0, "b": None}
    points = evaluate.roc_points(scores).where("label = 'a'").collect()
    assert max(r["tpr"] for r in points) == 1.0
    assert evaluate.roc_points(scores.limit(0)).collect() == []
    empty = spark.createDataFrame([], "k int, t array<string>, p array<string>")
    assert evaluate.entity_scores(empty, "t", "p", "k").first()["accuracy"] is None


def test_every_choice_matches_itself(spark):
    choices = ["sal y pimienta", "mama mas axila", "green gear y hot", "uno-dos", "Más allá"]
    keys = spark.createDataFrame([(c,) for c in choices], "k string")
    got = {r["key"]: (r["match"], r["score"]) for r in joins.fuzzy_best(keys, "k", choices).collect()}
    assert got == {c: (c, 100) for c in choices}


def test_vocabulary_is_whole(spark):
    rows = spark.range(6).select(
        F.transform(F.sequence(F.lit(0), F.lit(263_143)), lambda i: F.concat(F.lit("t"), i.cast("string"))).alias("words")
    )
    rows = rows.union(spark.createDataFrame([(["other"],), (["one"],)], "words array<string>"))
    model = learn.fit_vectorizer(rows, "bag_of_words", min_df=1)
    assert len(model.stages[0].vocabulary) == 263_146


def test_histological_type_keeps_every_row(spark, monkeypatch):
    from casemill.operators import labels

    texts = [f"texto {k % 9} comun" for k in range(76)] + [None] * 4
    rows = spark.createDataFrame([(t, "a" if k % 2 else "b") for k, t in enumerate(texts)], "x string, y string")
    monkeypatch.setattr(labels, "histology_with_annotations", lambda *a: rows)
    done = training.histological_type(rows, rows, 4, max_iter=5)
    assert done.validation.count() == 12


def test_on_distinct_computes_once_a_text_below_a_filter(spark):
    """A later filter on the result is not moved below the distinct step, where it would run for every row."""
    rows = spark.createDataFrame([(1, "abcd"), (2, "abcd"), (3, None), (None, "ab"), (3, None)], "id int, t string")
    df = joins.on_distinct(rows, "t", {"r": lambda c: F.when(F.length(c) > 3, F.upper(c))})
    assert df.columns == ["id", "t", "r"]
    got = sorted((r.id or 0, r.t or "", r.r or "") for r in df.collect())
    assert got == [(0, "ab", ""), (1, "abcd", "ABCD"), (2, "abcd", "ABCD"), (3, "", ""), (3, "", "")]
    kept = df.dropna(subset=["r"])
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1
    assert kept.count() == 2


def test_study_forms_are_stored_before_the_parse(spark, folder, monkeypatch):
    """The parse reads evenly dealt stored rows, not the numbering's join again for each branch."""
    from casemill.checks import forms as form_checks

    plans = []

    def parsed(rows, *_):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return rows

    monkeypatch.setattr(form_checks.forms, "both_layouts", parsed)
    monkeypatch.setattr(form_checks.derive, "once", lambda spark, folder, name, build: build())
    monkeypatch.setattr(form_checks, "_reports", lambda spark, folder: spark.createDataFrame(
        [(1, "s", "Tipo de intervención: x", None)], "row_seq long, study string, extra string, notes string"
    ))
    form_checks._parsed(spark, folder)
    assert "Window" not in plans[0] and "Join" not in plans[0] and "Repartition" in plans[0]


def test_intervention_reads_two_lines(spark):
    from casemill.functions import forms as functions

    start = "tipo de intervención:"
    texts = [
        f"nota\n{start}  exeresis \r\n resto", f"{start}\n \x85\n\t\n  mrm  \n otra", f"{start}\n nº biopsias 3",
        f"{start}", f"{start} \n \n", "otra", None, f"{start} {start}\nmrm",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    found = [r[0] for r in rows.select(functions.intervention_raw(functions.prepare(F.col("t")))).collect()]
    assert found == ["exeresis", "mrm", None, None, None, None, None, "mrm"]
