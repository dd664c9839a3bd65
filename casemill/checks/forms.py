"""Form parsing, study-level form operators and form labels over derived reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.checks import derive, sql
from casemill.checks.registry import check
from casemill.checks.text import _MACRO, _SPANS
from casemill.functions import forms as form_functions
from casemill.operators import counts, evaluate, filters, forms, joins, labels, rollup
from casemill.plans import dataset, preprocess
from casemill.session import scratch_dir, spread, table, written
from casemill.sources import readers, writers

_REPORTS = derive.reports_cte()


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    return derive.reports(spark, folder)


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    """row_seq, study and the form text of every report with a form in its extra text."""
    rows = filters.with_form(_reports(spark, folder), "extra")
    return rows.select("row_seq", "study", F.col("extra").alias("form_text"))


def _manual(spark: SparkSession) -> DataFrame:
    return counts.manual_table(derive.manual_sheet(spark))


# --- SQL of the pieces ------------------------------------------------------------------------


def _prepared(source: str, text: str, keep: str) -> str:
    """t: prepared text, ls: its lines, one list of section lines per section."""
    sections = ", ".join(
        f"{sql.section('t', titles)} AS s_{name}" for name, titles in K.SECTIONS.items()
    )
    listed = ", ".join(
        f"{sql.section_lines(f's_{name}')} AS l_{name}" for name in K.SECTIONS
    )
    return f"""SELECT *, {sql.lines('t')} AS ls, {listed} FROM (
        SELECT *, {sections} FROM (
          SELECT {keep}, {sql.strip(f'lower({text})')} AS t FROM {source}))"""


_FORM_ROWS = f"""(SELECT row_seq, study, extra FROM ({_REPORTS})
    WHERE contains(lower(extra), {sql.q(K.FORM_START)}))"""
_P = f"({_prepared(_FORM_ROWS, 'extra', 'row_seq, study')})"


def _fields(table, ls: str) -> list[tuple[str, str]]:
    return [(n, sql.get_line(ls, phrase, skip, d)) for n, phrase, skip, d in table]


def _nullif_strip(x: str) -> str:
    return f"nullif({sql.strip(x)}, '')"


def _tumor_sql() -> list[tuple[str, str]]:
    line = sql.raw_line("l_tumor", "- tamaño:")
    rest = f"replace({line}, '- tamaño:', '')"
    multiple = (
        "list_filter(l_tumor, lambda v: contains(v, '- si es múltiple:') AND "
        "regexp_matches(v, 'nº de tumores:.*localización:'))[1]"
    )
    at = (
        "list_position(list_transform(l_tumor, lambda v: contains(v, '- si es múltiple:') AND "
        "regexp_matches(v, 'nº de tumores:.*localización:')), true)"
    )
    later = (
        f"CASE WHEN {multiple} IS NOT NULL THEN list_filter(list_slice(l_tumor, {at}, len(l_tumor)), "
        "lambda v: contains(v, 'tamaño del mayor:'))[1] END"
    )
    found = [
        ("size", _nullif_strip(f"split_part({rest}, 'localización:', 1)")),
        ("location", _nullif_strip(f"split_part({rest}, 'localización:', 2)")),
        ("multiple.n_tumors", _nullif_strip(f"regexp_extract({multiple}, 'nº de tumores:(.*)localización:(.*)$', 1)")),
        ("multiple.location", _nullif_strip(f"regexp_extract({multiple}, 'nº de tumores:(.*)localización:(.*)$', 2)")),
        ("multiple.biggest_size", _nullif_strip(f"regexp_extract({later}, 'tamaño del mayor:(.*)$', 1)")),
    ]
    return found + _fields(K.TUMOR_FIELDS, "l_tumor")


def _parenchyma_sql() -> list[tuple[str, str]]:
    ls = "(CASE WHEN l_parenchyma[1] = ':' THEN list_slice(l_parenchyma, 2, len(l_parenchyma)) ELSE l_parenchyma END)"
    kind = (
        f"CASE WHEN NOT contains({ls}[1], '- calcificaciones:') AND "
        f"NOT contains({ls}[1], '- mastopatía no proliferativa:') "
        f"THEN {_nullif_strip(f'''replace({ls}[1], '-', '')''')} END"
    )
    return [("type", kind)] + _fields(K.PARENCHYMA_FIELDS, ls)


def _levels_sql() -> str:
    heading = sql.first_line_at("l_nodes", K.NODE_LEVELS_HEADING)
    after = f"list_filter(list_slice(l_nodes, {heading} + 1, len(l_nodes)), lambda v: contains(v, '*nivel'))"
    values = (
        f"list_transform(range(1, len({after}) + 1), lambda i: "
        f"{sql.strip(f'''replace(({after})[i], '*nivel ' || repeat('i', i), '')''')})"
    )
    return values


def _nodes_sql() -> list[tuple[str, str]]:
    levels = [
        (f"level_{i}", f"CASE WHEN {sql.first_line_at('l_nodes', K.NODE_LEVELS_HEADING)} > 0 "
                       f"THEN nullif(({_levels_sql()})[{i}], '') END")
        for i in (1, 2)
    ]
    return _fields(K.NODE_FIELDS, "l_nodes") + levels


def _hormone_sql() -> list[tuple[str, str]]:
    rows = "list_filter(l_hormone, lambda v: contains(v, 'resultado:') AND contains(v, 're:'))"
    last, last_rp = f"({rows})[-1]", f"(list_filter({rows}, lambda v: contains(v, 'rp:')))[-1]"
    return [
        ("re", _nullif_strip(f"split_part(split_part({last}, 're:', 2), 'rp:', 1)")),
        ("rp", _nullif_strip(f"split_part(split_part({last_rp}, 're:', 2), 'rp:', 2)")),
    ]


def _her2_sql() -> list[tuple[str, str]]:
    rows = "list_filter(l_her2, lambda v: contains(v, 'resultado:'))"
    last = f"({rows})[-1]"
    scored = f"(list_filter({rows}, lambda v: contains(v, '(puntuación:')))[-1]"
    return [
        ("result", _nullif_strip(f"split_part(split_part({last}, 'resultado:', 2), '(puntuación:', 1)")),
        ("score", _nullif_strip(
            f"replace(split_part(split_part({scored}, 'resultado:', 2), '(puntuación:', 2), ')', '')"
        )),
    ]


def _stage_sql() -> list[tuple[str, str]]:
    line = sql.raw_line("ls", "- pt")
    return [
        ("pt", _nullif_strip(
            f"CASE WHEN contains({line}, 'pn') THEN regexp_extract({line}, '- pt(.*)pn', 1) "
            f"ELSE regexp_extract({line}, 'pt(.*)', 1) END")),
        ("pn", _nullif_strip(f"CASE WHEN contains({line}, 'pn') THEN regexp_extract({line}, 'pn(.*)', 1) END")),
    ]


def _raw_sql(t: str) -> str:
    body = sql.lines(f"substr({t}, instr({t}, {sql.q(K.FORM_START)}))")
    first = sql.strip(f"replace(({body})[1], {sql.q(K.FORM_START)}, '')")
    text = (
        f"CASE WHEN {first} <> '' THEN {first} WHEN NOT (contains(({body})[2], 'biopsias /') "
        f"OR contains(({body})[2], 'nº biopsias')) THEN ({body})[2] END"
    )
    return f"CASE WHEN instr({t}, {sql.q(K.FORM_START)}) > 0 THEN nullif({sql.clean_hard(text)}, '') END"


def _manual_values() -> str:
    """The manual label table, with its labels worked out in SQL from the sheet."""
    values = ", ".join(f"({sql.q(x)}, {sql.q(y)})" for x, y in derive.MANUAL_TEXTS)
    codes = sql.clean_hard("y")
    for name, code in K.MANUAL_RENAMES:
        codes = f"replace({codes}, {sql.q(name)}, {sql.q(code)})"
    return (
        f"(SELECT x, list_sort(list_transform(string_split({codes}, '+'), lambda v: {sql.strip('v')}))"
        f" AS y FROM (VALUES {values}) v(x, y))"
    )


def _select(columns: list[tuple[str, str]], source: str = _P, keep: str = "row_seq") -> str:
    listed = ", ".join(f'{x} AS "{n}"' for n, x in columns)
    return f"SELECT {keep}, {listed} FROM {source}"


def _spark_section(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = _forms(spark, folder).withColumn("t", form_functions.prepare(F.col("form_text")))
    return rows.withColumn("s", form_functions.section("t", K.SECTIONS[name]))


# --- pieces -----------------------------------------------------------------------------------


@check("flt_has_form", f"SELECT row_seq, study FROM ({_REPORTS}) WHERE contains(lower(extra), {sql.q(K.FORM_START)})")
def has_form(spark: SparkSession, folder: str) -> DataFrame:
    return filters.with_form(_reports(spark, folder), "extra").select("row_seq", "study")


_LINES = ["número de biopsias", "- caracter", "resultado:", "· grado mitósico"]


@check(
    "frm_get_line",
    _select(
        [(f"line_{i}", sql.get_line("ls", p, 0, [":"])) for i, p in enumerate(_LINES)]
        + [(f"next_{i}", sql.get_line(sql.section_lines("t"), p, 1, [r"\*", "[0-9]+"])) for i, p in enumerate(_LINES)]
    ),
)
def get_line(spark: SparkSession, folder: str) -> DataFrame:
    rows = _forms(spark, folder).withColumn("t", form_functions.prepare(F.col("form_text")))
    t = F.col("t")
    return rows.select(
        "row_seq",
        *[form_functions.get_line(t, p, 0, [":"]).alias(f"line_{i}") for i, p in enumerate(_LINES)],
        *[form_functions.get_line(t, p, 1, [r"\*", "[0-9]+"]).alias(f"next_{i}") for i, p in enumerate(_LINES)],
    )


@check("frm_sections", _select([(n, f"s_{n}") for n in K.SECTIONS]))
def sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = _forms(spark, folder).withColumn("t", form_functions.prepare(F.col("form_text")))
    return rows.select(
        "row_seq", *[form_functions.section("t", x).alias(n) for n, x in K.SECTIONS.items()]
    )


@check("frm_simple", _select(_fields(K.SIMPLE_FIELDS, "ls")))
def simple(spark: SparkSession, folder: str) -> DataFrame:
    rows = _forms(spark, folder).withColumn("t", form_functions.prepare(F.col("form_text")))
    return rows.select("row_seq", *form_functions.fields(F.col("t"), K.SIMPLE_FIELDS))


@check("frm_stage", _select(_stage_sql()))
def stage(spark: SparkSession, folder: str) -> DataFrame:
    rows = _forms(spark, folder).withColumn("t", form_functions.prepare(F.col("form_text")))
    pt, pn = form_functions.stage(F.col("t"))
    return rows.select("row_seq", pt.alias("pt"), pn.alias("pn"))


@check("frm_tumor", _select(_tumor_sql()))
def tumor(spark: SparkSession, folder: str) -> DataFrame:
    rows = _spark_section(spark, folder, "tumor")
    size, place = form_functions.tumor_size_location(F.col("s"))
    parts = zip(("n_tumors", "location", "biggest_size"), form_functions.tumor_multiple(F.col("s")), strict=True)
    return rows.select(
        "row_seq", size.alias("size"), place.alias("location"),
        *[c.alias(f"multiple.{n}") for n, c in parts],
        *form_functions.fields(F.col("s"), K.TUMOR_FIELDS),
    )


@check("frm_parenchyma", _select(_parenchyma_sql()))
def parenchyma(spark: SparkSession, folder: str) -> DataFrame:
    rows = _spark_section(spark, folder, "parenchyma")
    return rows.select(
        "row_seq",
        form_functions.parenchyma_type(F.col("s")).alias("type"),
        *form_functions.fields(F.col("s"), K.PARENCHYMA_FIELDS),
    )


@check("frm_nodes", _select(_nodes_sql()))
def nodes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _spark_section(spark, folder, "nodes").withColumn("m", form_functions.node_levels(F.col("s")))
    return rows.select(
        "row_seq",
        *form_functions.fields(F.col("s"), K.NODE_FIELDS),
        *[F.try_element_at("m", F.lit(f"level_{i}")).alias(f"level_{i}") for i in (1, 2)],
    )


@check("frm_hormone", _select(_hormone_sql()))
def hormone(spark: SparkSession, folder: str) -> DataFrame:
    rows = _spark_section(spark, folder, "hormone")
    re, rp = form_functions.hormone(F.col("s"))
    return rows.select("row_seq", re.alias("re"), rp.alias("rp"))


@check("frm_her2", _select(_her2_sql()))
def her2(spark: SparkSession, folder: str) -> DataFrame:
    rows = _spark_section(spark, folder, "her2")
    result, score = form_functions.her2(F.col("s"))
    return rows.select("row_seq", result.alias("result"), score.alias("score"))


_INTERVENTION = f"""
    SELECT row_seq, raw AS intervention_raw, array_to_string(m.y, '|') AS intervention_manual
    FROM (SELECT row_seq, {_raw_sql('t')} AS raw FROM {_P}) r
    LEFT JOIN {_manual_values()} m ON raw = m.x"""


@check("frm_intervention", _INTERVENTION)
def intervention(spark: SparkSession, folder: str) -> DataFrame:
    """The automatic labels of the same rows are in `cls_fuzzy_labels`."""
    rows = _forms(spark, folder).withColumn("t", form_functions.prepare(F.col("form_text")))
    raw = rows.withColumn("intervention_raw", form_functions.intervention_raw(F.col("t")))
    found = joins.manual_labels(raw, _manual(spark), "intervention_raw", "m")
    return found.select(
        "row_seq", "intervention_raw", F.array_join("m", "|").alias("intervention_manual")
    )


@check(
    "join_manual_labels",
    f"""SELECT p_partkey, a.x, array_to_string(m.y, '|') AS y FROM (
          SELECT p_partkey, {sql.q(derive.MANUAL_TEXTS[0][0])} AS x FROM part WHERE p_size % 3 = 0
          UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'mrm' END FROM part) a
        LEFT JOIN {_manual_values()} m ON a.x = m.x""",
)
def manual_lookup(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    first = parts.filter("p_size % 3 = 0").select("p_partkey", F.lit(derive.MANUAL_TEXTS[0][0]).alias("x"))
    second = parts.select("p_partkey", F.when(F.col("p_size") % 2 == 0, "mrm").alias("x"))
    found = joins.manual_labels(first.unionByName(second), _manual(spark), "x", "y")
    return found.withColumn("y", F.array_join("y", "|"))


@check(
    "frm_manual_norm",
    f"""SELECT row_seq, array_to_string(list_sort(list_transform(string_split(c, '+'),
                 lambda v: {sql.strip('v')})), '|') AS y
        FROM (SELECT row_seq, """
    + "replace(" * len(K.MANUAL_RENAMES)
    + "c"
    + "".join(f", {sql.q(a)}, {sql.q(b)})" for a, b in K.MANUAL_RENAMES)
    + f""" AS c FROM (SELECT row_seq, {sql.clean_hard(_raw_sql('t'))} AS c FROM {_P}))""",
)
def manual_norm(spark: SparkSession, folder: str) -> DataFrame:
    """The sheet rules over every intervention text as if it were a manual label."""
    rows = _forms(spark, folder).withColumn("t", form_functions.prepare(F.col("form_text")))
    sheet = rows.select(
        F.col("row_seq").cast("string").alias("k"),
        form_functions.intervention_raw(F.col("t")).alias("label"),
    )
    done = joins.manual_label_table(sheet, "k", "label")
    return done.select(F.col("x").cast("long").alias("row_seq"), F.array_join("y", "|").alias("y"))


# --- fuzzy interventions ----------------------------------------------------------------------


def _labels_sql(texts: str) -> str:
    """Query text: raw, labels. Walks (class, spelling) steps, pass after pass, per distinct text."""
    steps, n = [], 0
    for number, (label, spellings) in enumerate(K.INTERVENTION_CLASSES.items()):
        sizes = [len(s.split()) for s in spellings]
        low, high = max(min(sizes) - 1, 1), max(sizes) + 1
        for s in spellings:
            n += 1
            plain = " ".join("".join(c if c.isalnum() else " " for c in s).split())
            steps.append(f"({n}, {number}, {sql.q(label)}, {sql.q(plain)}, {low}, {high})")
    cleaned = "raw"
    for ch in K.INTERVENTION_CHARS_DELETE:
        cleaned = f"replace({cleaned}, {sql.q(ch)}, '')"
    cleaned = f"trim(regexp_replace({cleaned}, ' +', ' ', 'g'))"
    words = "list_filter(string_split(w.text, ' '), lambda v: v <> '')"
    grams = (
        f"flatten(list_transform(range(s.low, least(s.high, len({words})) + 1), lambda m: "
        f"list_transform(range(1, len({words}) - m + 2), lambda i: "
        f"{{'m': m, 'i': i, 'g': array_to_string(list_slice({words}, i, i + m - 1), ' ')}})))"
    )
    near = "abs(length(x.g) - length(spelling)) <= 6"
    scored = (
        f"list_transform(list_filter(grams, lambda x: {near}), lambda x: "
        f"{{'score': {sql.ratio('x.g', 'spelling')}, 'm': x.m, 'neg': -x.i, 'g': x.g}})"
    )
    return f"""
    WITH RECURSIVE steps AS (SELECT * FROM (VALUES {', '.join(steps)})
           v(n, number, label, spelling, low, high)),
    walk AS (
      SELECT raw, {cleaned} AS text, CAST([] AS VARCHAR[]) AS labels, 1 AS n, -1 AS taken,
             false AS matched FROM ({texts})
      UNION ALL
      SELECT raw, CASE WHEN hit IS NULL THEN text
                       ELSE trim(regexp_replace(replace(text, hit.g, ''), ' +', ' ', 'g')) END,
             CASE WHEN hit IS NULL OR label = '' THEN labels ELSE list_append(labels, label) END,
             CASE WHEN n < {n} THEN n + 1 ELSE 1 END,
             CASE WHEN n = {n} THEN -1 WHEN hit IS NULL THEN taken ELSE number END,
             CASE WHEN n = {n} THEN false ELSE matched OR hit IS NOT NULL END
      FROM (
        SELECT *, list_max(list_filter(scored, lambda x: x.score >= 90)) AS hit FROM (
          SELECT *, {scored} AS scored FROM (
            SELECT w.*, s.number, s.label, s.spelling,
                   CASE WHEN w.taken = s.number OR w.text = '' THEN [] ELSE {grams} END AS grams
            FROM walk w JOIN steps s ON w.n = s.n)))
      WHERE NOT (n = {n} AND NOT matched AND hit IS NULL) AND text <> '')
    SELECT raw, list_sort(arg_max(labels, len(labels))) AS labels FROM walk GROUP BY raw"""


_RAW_TEXTS = f"SELECT DISTINCT {_raw_sql('t')} AS raw FROM {_P}"


@check(
    "cls_fuzzy_labels",
    f"""SELECT r.row_seq, nullif(array_to_string(l.labels, '|'), '') AS labels
        FROM (SELECT row_seq, {_raw_sql('t')} AS raw FROM {_P}) r
        LEFT JOIN ({_labels_sql(f'SELECT raw FROM ({_RAW_TEXTS}) WHERE raw IS NOT NULL')}) l
          ON r.raw = l.raw""",
)
def fuzzy_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = _forms(spark, folder)
    found = forms.interventions(rows, "form_text")
    return found.select("row_seq", F.array_join("intervention_automatic", "|").alias("labels"))


@check(
    "agg_intervention_counts",
    f"""SELECT c.raw AS intervention, c.counts, array_to_string(l.labels, '|') AS classes
        FROM (SELECT raw, count(*) AS counts FROM (SELECT {_raw_sql('t')} AS raw FROM {_P})
              WHERE raw IS NOT NULL GROUP BY raw) c
        JOIN ({_labels_sql(f'SELECT raw FROM ({_RAW_TEXTS}) WHERE raw IS NOT NULL')}) l
          ON c.raw = l.raw
        ORDER BY len(l.labels), c.raw""",
)
def intervention_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _forms(spark, folder).withColumn("t", form_functions.prepare(F.col("form_text")))
    raw = form_functions.intervention_raw(F.col("t"))
    found = rows.select(F.nullif(raw, F.lit("")).alias("intervention_raw"))
    counted = counts.intervention_counts(found)
    return counted.select("intervention", "counts", F.array_join("classes", "|").alias("classes"))


# --- whole layouts ----------------------------------------------------------------------------


def _layout1_sql() -> list[tuple[str, str]]:
    prefixed = [
        ("tumor_features", _tumor_sql()),
        ("parenquima_features", _parenchyma_sql()),
        ("ganglion_features", [
            (n.replace("level_", "n_ganglions_lvl.level_"), x) for n, x in _nodes_sql()
        ]),
        ("hormone_receptors", _hormone_sql()),
        ("inmunohistochemical_study", _her2_sql()),
    ]
    columns = [("intervention_raw", _raw_sql("t")), *_fields(K.SIMPLE_FIELDS, "ls"), *_stage_sql()]
    return columns + [(f"{p}.{n}", x) for p, group in prefixed for n, x in group]


_LEAVES1 = _layout1_sql()


def _spread_levels(flat: DataFrame) -> DataFrame:
    name = "ganglion_features.n_ganglions_lvl"
    for i in (1, 2):
        flat = flat.withColumn(f"{name}.level_{i}", F.try_element_at(F.col(f"`{name}`"), F.lit(f"level_{i}")))
    return flat.drop(name)


def _parsed1(spark: SparkSession, folder: str) -> DataFrame:
    return forms.layout1(_forms(spark, folder), "form_text", _manual(spark))


def _flat1(spark: SparkSession, folder: str) -> DataFrame:
    """The parsed first layout as a table, the input of the label queries."""
    build = lambda: _parsed1(spark, folder).select("row_seq", "form")
    parsed = derive.once(spark, folder, "layout1", build)
    return forms.flatten(parsed, "form", ["row_seq"])


@check("frm_layout1", _select(_LEAVES1))
def layout1(spark: SparkSession, folder: str) -> DataFrame:
    flat = forms.flatten(_parsed1(spark, folder), "form", ["row_seq"])
    return _spread_levels(flat).drop("intervention_automatic", "intervention_manual")


_LAYOUT2 = {}
for _name, _title in K.LAYOUT2_TITLES.items():
    _others = [x for n, x in K.LAYOUT2_TITLES.items() if n != _name] + [K.LAYOUT2_LAST]
    _pattern = sql.q(
        rf"{K.NUMBERED}{_title}:?{K.SPACE}*((?s:.)*?){K.NUMBERED}(?:" + "|".join(_others) + ")"
    )
    _LAYOUT2[_name] = (
        f"CASE WHEN regexp_matches(t, {_pattern}) THEN "
        f"{sql.strip(f'regexp_extract(t, {_pattern}, 1)')} END"
    )
_NOTES = f"""(SELECT row_seq, study, notes FROM ({_REPORTS})
    WHERE contains(lower(notes), {sql.q(K.FORM_START)}))"""
_P2 = f"(SELECT row_seq, study, {sql.strip('lower(notes)')} AS t FROM {_NOTES})"


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    rows = filters.with_form(_reports(spark, folder), "notes")
    return rows.select("row_seq", "study", F.col("notes").alias("form_text"))


@check("frm_layout2", _select([("intervention_raw", _raw_sql("t")), *_LAYOUT2.items()], _P2))
def layout2(spark: SparkSession, folder: str) -> DataFrame:
    parsed = forms.layout2(_notes(spark, folder), "form_text")
    names = [F.col(f"form.tumor_features.{n}").alias(n) for n in K.LAYOUT2_TITLES]
    return parsed.select("row_seq", "form.intervention_raw", *names)


_SINGLE = sql.q(
    "".join(rf"{K.NUMBERED}{t}:?{K.SPACE}*((?s:.)*)" for t in K.LAYOUT2_TITLES.values())
    + K.NUMBERED + "microcalcificaciones"
)
_SINGLE_NAMES = ["histological_degree" if n == "van_nuys_degree" else n for n in K.LAYOUT2_TITLES]


@check(
    "frm_layout2_single",
    _select(
        [(n, f"CASE WHEN regexp_matches(t, {_SINGLE}) THEN "
             f"{sql.strip(f'regexp_extract(t, {_SINGLE}, {i})')} END")
         for i, n in enumerate(_SINGLE_NAMES, 1)],
        _P2,
    ),
)
def layout2_single(spark: SparkSession, folder: str) -> DataFrame:
    parsed = forms.layout2(_notes(spark, folder), "form_text", single_pattern=True)
    return parsed.select("row_seq", *[F.col(f"form.tumor_features.{n}").alias(n) for n in _SINGLE_NAMES])




@check("prj_count_leaves", f"SELECT row_seq, CAST({' + '.join(f'CAST({x} IS NOT NULL AS INTEGER)' for _, x in _LEAVES1)} AS INTEGER) AS n FROM {_P}")
def count_leaves(spark: SparkSession, folder: str) -> DataFrame:
    parsed = forms.layout1(_forms(spark, folder), "form_text")
    # automatic labels count as a leaf of their own and are left out of the comparison
    n = filters.count_leaves(parsed, "form") - F.col("form.intervention_automatic").isNotNull().cast("int")
    return parsed.select("row_seq", n.alias("n"))


@check(
    "prj_prune_nulls",
    """
    SELECT p_partkey, b IS NOT NULL OR t IS NOT NULL AS has_outer, t IS NOT NULL AS has_inner, b, t,
           len(words) > 0 AS has_list
    FROM (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS b,
                 CASE WHEN p_size % 2 <> 0 THEN p_type END AS t,
                 CASE WHEN p_size % 5 = 0 THEN [] ELSE [p_name] END AS words FROM part)""",
)
def prune_nulls(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    nested = table(spark, folder, "part").select(
        "p_partkey",
        F.struct(
            F.when(size % 3 != 0, F.col("p_brand")).otherwise("").alias("b"),
            F.struct(F.when(size % 2 != 0, F.col("p_type")).otherwise("").alias("t")).alias("inner"),
        ).alias("outer"),
        F.when(size % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name")).alias("words"),
    )
    pruned = filters.prune_nulls(nested, ["outer", "words"])
    return pruned.select(
        "p_partkey",
        F.col("outer").isNotNull().alias("has_outer"),
        F.col("outer.inner").isNotNull().alias("has_inner"),
        F.col("outer.b").alias("b"),
        F.col("outer.inner.t").alias("t"),
        F.col("words").isNotNull().alias("has_list"),
    )


@check("frm_flatten", _select(_LEAVES1))
def flatten(spark: SparkSession, folder: str) -> DataFrame:
    """Through a nested JSON file and back to dotted columns."""
    parsed = forms.layout1(_forms(spark, folder), "form_text")
    kept = [f for f in parsed.schema["form"].dataType.fields if f.name not in ("intervention_automatic", "intervention_manual")]
    rows = parsed.select(
        F.col("row_seq").cast("string").alias("study"),
        F.struct(*[F.col("form")[f.name].alias(f.name) for f in kept]).alias("form"),
    )
    path = scratch_dir(spark, "forms")
    writers.form_json(rows, path)
    flat = readers.form_json(spark, path, rows.schema["form"].dataType, "study")
    return _spread_levels(flat).withColumn("row_seq", F.col("study").cast("long")).drop("study")


# --- studies ----------------------------------------------------------------------------------

_FORM_ENTRIES = f"""
    SELECT study, v, row_number() OVER (PARTITION BY study ORDER BY min("at" * 10000000000 + seq)) AS entry_no
    FROM (SELECT study, extra AS v, 0 AS "at", row_seq AS seq FROM ({_REPORTS})
          UNION ALL SELECT study, notes, 1, row_seq FROM ({_REPORTS}))
    WHERE contains(lower(v), {sql.q(K.FORM_START)}) GROUP BY study, v"""


def _study_forms(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.study_forms(_reports(spark, folder), ["extra", "notes"], "study", "row_seq")


@check(
    "agg_form_text",
    f"""SELECT study, CASE WHEN count(*) > 1 THEN rtrim(s, {sql.q(K.WHITESPACE)}) ELSE s END AS "Formulario"
        FROM (SELECT study, v, string_agg('##ENTRY_' || CAST(entry_no AS STRING) || '##' || chr(10) || v,
                chr(10) || chr(10) ORDER BY entry_no) OVER (PARTITION BY study) AS s FROM ({_FORM_ENTRIES}))
        GROUP BY study, s""",
)
def form_text(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.form_text(_study_forms(spark, folder), "study")


_PF = f"({_prepared(f'({_FORM_ENTRIES})', 'v', 'study, entry_no')})"
_LEAVES2 = [(f"tumor_features.{n}", x) for n, x in _LAYOUT2.items()]


def _leaf_rows() -> str:
    """study, entry_no, layout, path, value of every present text leaf of both layouts."""

    def unpivot(layout: int, columns: list[tuple[str, str]]) -> str:
        rows = ", ".join(f"{{'path': {sql.q(n)}, 'value': {x}}}" for n, x in columns)
        return (
            f"SELECT study, entry_no, {layout} AS layout, unnest([{rows}], recursive := true) FROM {_PF}"
        )

    both = unpivot(1, _LEAVES1) + " UNION ALL " + unpivot(2, [_LEAVES1[0], *_LEAVES2])
    manual = f"""SELECT study, entry_no, layout, 'intervention_manual' AS path,
                        '["' || array_to_string(m.y, '","') || '"]' AS value
                 FROM (SELECT study, entry_no, unnest([1, 2]) AS layout, {_raw_sql('t')} AS raw FROM {_PF}) r
                 JOIN {_manual_values()} m ON raw = m.x"""
    return f"SELECT * FROM ({both}) WHERE value IS NOT NULL UNION ALL {manual}"


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    # stored first: after the numbering's join neither sizes nor parts tell how many rows there are
    build = lambda: forms.both_layouts(
        spread(written(_study_forms(spark, folder), "study-forms")), "value", _manual(spark)
    )
    return derive.once(spark, folder, "both-layouts", build)


_NO_LIST = "path <> 'intervention_automatic'"


@check(
    "agg_form_conflicts",
    f"""
    WITH o AS (SELECT study, path, value, count(*) AS n_forms FROM (
                 SELECT study, path, value FROM ({_leaf_rows()}))
               GROUP BY ALL)
    SELECT study, path, value, n_forms, count(*) OVER (PARTITION BY study, path) AS n_options FROM o
    QUALIFY count(*) OVER (PARTITION BY study, path) > 1""",
)
def form_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    leaves = rollup.form_leaves(_parsed(spark, folder), "form", "study")
    found = rollup.conflicts(leaves, "study").filter(_NO_LIST)
    return found.select("study", "path", "value", "n_forms", "n_options")


# the whole nested group of the last form that has any of its fields replaces earlier ones
_MERGED = f"""
    WITH leaves AS ({_leaf_rows()}),
    tops AS (SELECT *, split_part(path, '.', 1) AS top, layout * 1000000 + entry_no AS pos FROM leaves),
    last AS (SELECT study, top, max(pos) AS pos FROM tops GROUP BY study, top)
    SELECT t.study, t.path, t.value FROM tops t JOIN last l
      ON t.study = l.study AND t.top = l.top AND t.pos = l.pos"""


@check("agg_form_merge", _MERGED)
def form_merge(spark: SparkSession, folder: str) -> DataFrame:
    merged = rollup.merge_forms(_parsed(spark, folder), ["layout", "entry_no"], "form", "study")
    return rollup.form_leaves(merged, "form", "study").filter(_NO_LIST)


_VALID = f"""
    SELECT study, list_has_any(y, {K.MANDATORY_INTERVENTIONS!r}) AS valid FROM (
      SELECT study, string_split(substr(value, 3, length(value) - 4), '","') AS y
      FROM ({_MERGED}) WHERE path = 'intervention_manual')"""


@check("prd_valid_study", f"""
    SELECT s.study, coalesce(v.valid, false) AS valid
    FROM (SELECT DISTINCT study FROM ({_REPORTS})) s LEFT JOIN ({_VALID}) v ON s.study = v.study""")
def valid_study(spark: SparkSession, folder: str) -> DataFrame:
    return _processed(spark, folder).studies.select("study", "valid")


@check("flt_valid", f"SELECT study FROM ({_VALID}) WHERE valid")
def valid_only(spark: SparkSession, folder: str) -> DataFrame:
    return filters.valid_only(_processed(spark, folder).studies).select("study")


@check(
    "prd_mandatory",
    f"""SELECT row_seq, list_has_any(y, {K.MANDATORY_INTERVENTIONS!r}) AS mandatory
        FROM (SELECT row_seq, {_raw_sql('t')} AS raw FROM {_P}) JOIN {_manual_values()} m ON raw = m.x""",
)
def mandatory(spark: SparkSession, folder: str) -> DataFrame:
    rows = _forms(spark, folder).withColumn("t", form_functions.prepare(F.col("form_text")))
    raw = rows.withColumn("raw", form_functions.intervention_raw(F.col("t")))
    known = joins.manual_labels(raw, _manual(spark), "raw", "y").filter("y IS NOT NULL")
    return known.select("row_seq", filters.has_mandatory(F.col("y")).alias("mandatory"))


_X = ["clinical", "diagnosis", "macro", "micro"]


def _processed(spark: SparkSession, folder: str) -> preprocess.Processed:
    return preprocess.process_reports(
        _reports(spark, folder), [*_X, "year"], _manual(spark), ["extra", "notes"], "study", "row_seq"
    )


@check("pre_yearly")
def yearly(spark: SparkSession, folder: str) -> DataFrame:
    """Studies by year; the derived reports name a study in one year each."""
    done = preprocess.process_yearly(
        _reports(spark, folder), _X, _manual(spark), ["extra", "notes"], study="study"
    )
    return done.studies.select("year", "study", *(F.md5(c).alias(c) for c in _X), "valid")


# --- labels -----------------------------------------------------------------------------------


_TUMOR = dict(_tumor_sql())
_MULTIPLE = sql.clean_hard("is_multiple")
_CARACTER = sql.clean_hard("caracter")


@check(
    "lab_multiple",
    f"""SELECT row_seq, CASE WHEN {_MULTIPLE} LIKE 'si%' THEN 1.0 WHEN {_MULTIPLE} LIKE 'no%' THEN 0.0 END
               AS y_is_multiple FROM (SELECT row_seq, {_TUMOR['is_multiple']} AS is_multiple FROM {_P})""",
)
def multiple(spark: SparkSession, folder: str) -> DataFrame:
    flat = _flat1(spark, folder)
    return flat.select("row_seq", labels.multiple(F.col("`tumor_features.is_multiple`")).alias("y_is_multiple"))


@check(
    "lab_infiltrating",
    f"""SELECT row_seq, CASE WHEN {_CARACTER} LIKE 'infiltrant%' THEN 1.0
               WHEN {_CARACTER} LIKE 'microinvasor%' THEN 0.0 END AS y_is_caracter_infiltrante
        FROM (SELECT row_seq, {_TUMOR['caracter']} AS caracter FROM {_P})""",
)
def infiltrating(spark: SparkSession, folder: str) -> DataFrame:
    flat = _flat1(spark, folder)
    found = labels.infiltrating(F.col("`tumor_features.caracter`"))
    return flat.select("row_seq", found.alias("y_is_caracter_infiltrante"))


_DEGREE = f"CAST(coalesce(length(regexp_extract({sql.clean_hard('degree')}, 'grado\\s?(i{{1,3}})', 1)), 0) AS BIGINT)"


@check(
    "lab_degree",
    f"""SELECT row_seq, {_DEGREE} AS y_histological_degree
        FROM (SELECT row_seq, {_TUMOR['histological_degree']} AS degree FROM {_P})""",
)
def degree(spark: SparkSession, folder: str) -> DataFrame:
    flat = _flat1(spark, folder)
    found = labels.degree(F.col("`tumor_features.histological_degree`"))
    return flat.select("row_seq", found.alias("y_histological_degree"))


def _histology_sql(texts: str) -> str:
    """Query text: key (cleaned type text), y (class) of every distinct text."""
    spellings = [(s, c) for c, group in K.HISTOLOGICAL_TYPES.items() for s in group]
    values = ", ".join(f"({i}, {sql.q(s)}, {sql.q(c)})" for i, (s, c) in enumerate(spellings))
    score = sql.token_score("a", "b")
    return f"""
      SELECT key, CASE WHEN score >= 85 THEN class END AS y FROM (
        SELECT key, class, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, n) AS r
        FROM (SELECT key, class, n, {score} AS score
              FROM (SELECT key, {sql.clean_words(sql.processed('key'))} AS a FROM ({texts})
                    WHERE key IS NOT NULL) k,
                   (SELECT n, class, {sql.clean_words('s')} AS b FROM (VALUES {values}) v(n, s, class)) c))
      WHERE r = 1"""


def _histology_key(column: str) -> str:
    return f"regexp_replace({sql.clean_hard(column)}, '^ca\\s', 'carcinoma ')"


_TYPES = f"""(SELECT row_seq, {_histology_key('kind')} AS key, degree FROM (
    SELECT row_seq, {_TUMOR['histological_type']} AS kind,
           {_TUMOR['histological_degree']} AS degree FROM {_P}))"""
_CLASSED = f"""(SELECT t.row_seq, t.degree, h.y FROM {_TYPES} t LEFT JOIN (
    {_histology_sql(f'SELECT DISTINCT key FROM {_TYPES}')}) h ON t.key = h.key)"""


def _with_histology(spark: SparkSession, folder: str) -> DataFrame:
    return labels.with_histology(_flat1(spark, folder), "tumor_features.histological_type")


@check("lab_histology", f"SELECT row_seq, y AS y_histological_type FROM {_CLASSED}")
def histology(spark: SparkSession, folder: str) -> DataFrame:
    return _with_histology(spark, folder).select("row_seq", "y_histological_type")


@check("lab_is_cdi", f"SELECT row_seq, y = {sql.q(K.CDI)} AS y_is_cdi FROM {_CLASSED}")
def is_cdi(spark: SparkSession, folder: str) -> DataFrame:
    rows = _with_histology(spark, folder)
    return rows.select("row_seq", labels.is_cdi(F.col("y_histological_type")).alias("y_is_cdi"))


@check(
    "lab_degree_cdi",
    f"""SELECT row_seq, CASE WHEN y = {sql.q(K.CDI)} AND degree IS NOT NULL THEN {_DEGREE} END
               AS y_histological_degree_cdi FROM {_CLASSED}""",
)
def degree_cdi(spark: SparkSession, folder: str) -> DataFrame:
    rows = _with_histology(spark, folder)
    cdi = labels.is_cdi(F.col("y_histological_type"))
    found = labels.degree_cdi(cdi, F.col("`tumor_features.histological_degree`"))
    return rows.select("row_seq", found.alias("y_histological_degree_cdi"))


@check(
    "lab_intervention",
    f"""SELECT row_seq, CASE WHEN y <> ['invalid'] THEN array_to_string(y, '|') END AS y_intervention
        FROM (SELECT row_seq, {_raw_sql('t')} AS raw FROM {_P}) LEFT JOIN {_manual_values()} m ON raw = m.x""",
)
def intervention_label(spark: SparkSession, folder: str) -> DataFrame:
    flat = _flat1(spark, folder)
    y = labels.intervention(F.col("intervention_manual"))
    return flat.select("row_seq", F.array_join(y, "|").alias("y_intervention"))


def _size_bio(text: str, size: str) -> str:
    """SQL for the label sequence, from a row with `text` and `size` columns."""
    tokens = sql.tokens(text)
    return f"""list_transform(range(1, len({tokens}) + 1), lambda i: CASE WHEN i - 1 = hit.s THEN 'B-TUMOR_SIZE'
        WHEN i - 1 > hit.s AND i - 1 < hit.e THEN 'I-TUMOR_SIZE' ELSE 'O' END)"""


_SIZED = f"""
    SELECT row_seq, tokens, CASE WHEN hit IS NOT NULL THEN {_size_bio('t', 'size')} END AS bio FROM (
      SELECT *, list_filter(spans, lambda s: s.v = {sql.measure_values('size')} AND len(s.v) > 0)[1] AS hit
      FROM (
        SELECT row_seq, t, size, CASE WHEN size IS NOT NULL THEN {sql.tokens('t')} END AS tokens,
               (SELECT list({{'s': token_start, 'e': token_end, 'v': {sql.measure_values('measure')}}}
                            ORDER BY start_char) FROM spans p WHERE p.row_seq = r.row_seq) AS spans
        FROM source r))"""


def _spans_of(source: str) -> str:
    return _SPANS.replace(f"({_MACRO})", source)


@check(
    "lab_size_bio",
    f"""
    WITH source AS (SELECT r.row_seq, diagnosis AS t, p.size FROM ({_REPORTS}) r
                    JOIN (SELECT row_seq, {_TUMOR['size']} AS size FROM {_P}) p ON r.row_seq = p.row_seq),
    spans AS ({_spans_of('source')})
    SELECT row_seq, array_to_string(tokens, '|') AS tokens, array_to_string(bio, '|') AS bio
    FROM ({_SIZED})""",
)
def size_bio(spark: SparkSession, folder: str) -> DataFrame:
    flat = _flat1(spark, folder).select("row_seq", F.col("`tumor_features.size`").alias("size"))
    rows = _reports(spark, folder).select("row_seq", "diagnosis").join(flat, "row_seq")
    done = labels.with_size_labels(rows, "diagnosis", "size")
    return done.select(
        "row_seq",
        F.array_join("y_size_text_tokenized", "|").alias("tokens"),
        F.array_join("y_size_representation", "|").alias("bio"),
    )


# --- the training table -----------------------------------------------------------------------


def _training(spark: SparkSession, folder: str) -> DataFrame:
    done = _processed(spark, folder)
    flat = forms.flatten(done.forms, "form", ["study"])
    return dataset.training_table(done.studies, flat, _X, "diagnosis", "study")


def _rolled(column: str) -> str:
    joined = (
        "string_agg('##ENTRY_' || CAST(n AS STRING) || '## ' || v, chr(10) || chr(10) ORDER BY n)"
    )
    return f"""(SELECT study, CASE WHEN count(*) > 1 THEN rtrim({joined}, {sql.q(K.WHITESPACE)})
                ELSE {joined} END AS t FROM (
                  SELECT study, {column} AS v, row_number() OVER (PARTITION BY study ORDER BY min(row_seq)) AS n
                  FROM ({_REPORTS}) WHERE {column} IS NOT NULL GROUP BY study, {column}) GROUP BY study)"""


def _path(name: str) -> str:
    return f"max(CASE WHEN path = {sql.q(name)} THEN value END)"


_DATASET_SQL = f"""
    WITH merged AS ({_MERGED}),
    wide AS (
      SELECT study, {_path('intervention_manual')} AS manual,
             {_path('tumor_features.is_multiple')} AS is_multiple,
             {_path('tumor_features.caracter')} AS caracter,
             {_path('tumor_features.histological_degree')} AS degree,
             {_path('tumor_features.histological_type')} AS kind,
             {_path('tumor_features.size')} AS size
      FROM merged GROUP BY study),
    keyed AS (SELECT *, {_histology_key('kind')} AS key FROM wide),
    classes AS ({_histology_sql('SELECT DISTINCT key FROM keyed')}),
    valid AS (SELECT study, list_has_any(string_split(substr(manual, 3, length(manual) - 4), '","'),
                {K.MANDATORY_INTERVENTIONS!r}) AS valid FROM wide),
    x AS (SELECT v.study, {', '.join(f'{c}.t AS x_{c}' for c in _X)} FROM valid v
          {' '.join(f'LEFT JOIN {_rolled(c)} {c} ON v.study = {c}.study' for c in _X)} WHERE valid),
    numbered AS (SELECT k.*, c.y, x.x_clinical, x.x_diagnosis, x.x_macro, x.x_micro,
                        row_number() OVER (ORDER BY k.study) AS row_seq
                 FROM keyed k LEFT JOIN classes c ON k.key = c.key LEFT JOIN x ON k.study = x.study
                 WHERE manual IS NOT NULL AND manual <> '["invalid"]'),
    source AS (SELECT row_seq, x_diagnosis AS t, size FROM numbered WHERE x_diagnosis IS NOT NULL),
    spans AS ({_spans_of('source')}),
    sized AS ({_SIZED})
    SELECT n.study, n.x_clinical, n.x_diagnosis, n.x_macro, n.x_micro,
           CASE WHEN v.valid THEN concat_ws(' ', {', '.join(f"chr(10) || '{c}: ' || x_{c}" for c in _X)}) END AS x_join,
           array_to_string(string_split(substr(manual, 3, length(manual) - 4), '","'), '|') AS y_intervention,
           CASE WHEN {_MULTIPLE} LIKE 'si%' THEN 1.0 WHEN {_MULTIPLE} LIKE 'no%' THEN 0.0 END AS y_is_multiple,
           CASE WHEN {_CARACTER} LIKE 'infiltrant%' THEN 1.0 WHEN {_CARACTER} LIKE 'microinvasor%' THEN 0.0 END
             AS y_is_caracter_infiltrante,
           {_DEGREE} AS y_histological_degree, n.y AS y_histological_type, n.y = {sql.q(K.CDI)} AS y_is_cdi,
           CASE WHEN n.y = {sql.q(K.CDI)} AND degree IS NOT NULL THEN {_DEGREE} END AS y_histological_degree_cdi,
           array_to_string(s.tokens, '|') AS y_size_text_tokenized,
           array_to_string(s.bio, '|') AS y_size_representation
    FROM numbered n JOIN valid v ON n.study = v.study LEFT JOIN sized s ON n.row_seq = s.row_seq"""


@check("lab_dataset", _DATASET_SQL)
def training_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = _training(spark, folder)
    lists = ("y_intervention", "y_size_text_tokenized", "y_size_representation")
    return rows.withColumns({c: F.array_join(c, "|") for c in lists})


@check("snk_span_tasks", """
    SELECT estudio, start_char, end_char, label, substr(text, CAST(start_char AS BIGINT) + 1,
           CAST(end_char - start_char AS BIGINT)) AS measure FROM (
      SELECT r.study || '/' || CAST(r.row_seq AS STRING) AS estudio, concat_ws(' ', diagnosis, macro) AS text,
             s.start_char, s.end_char, 'MEASURE' AS label
      FROM (""" + _REPORTS + ") r JOIN (" + _spans_of(
    f"(SELECT row_seq, concat_ws(' ', diagnosis, macro) AS t FROM ({_REPORTS}) r)"
) + ") s ON r.row_seq = s.row_seq)")
def span_tasks(spark: SparkSession, folder: str) -> DataFrame:
    rows = _reports(spark, folder).select(
        F.concat_ws("/", "study", F.col("row_seq").cast("string")).alias("id"),
        F.concat_ws(" ", "diagnosis", "macro").alias("text"),
    )
    path = scratch_dir(spark, "spans")
    writers.span_tasks(rows, path, "text", "id")
    schema = "text string, estudio string, spans array<struct<start: int, end: int, label: string>>"
    found = readers.jsonl(spark, path, schema).select("text", "estudio", F.explode("spans").alias("s"))
    return found.select(
        "estudio",
        F.col("s.start").alias("start_char"),
        F.col("s.end").alias("end_char"),
        F.col("s.label").alias("label"),
        F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("measure"),
    )


@check(
    "lab_histology_annotated",
    sql.top_or_other(
        f"""SELECT regexp_replace(regexp_replace(x, '(?i)##entry_\\d*##', '', 'g'), '\\d+((,|\\.)\\d+)?', '', 'g') AS x, y
        FROM (SELECT text AS x, trim(lower(split_part(label, '.', 2))) AS y FROM (
                SELECT text, CASE WHEN item_id % 5 <> 0 THEN CAST(item_id % 4 AS STRING) || '. Carcinoma Tubular ' END AS label
                FROM benchmark) WHERE label IS NOT NULL
              UNION ALL
              SELECT r.diagnosis, c.y FROM ({_REPORTS}) r JOIN {_CLASSED} c ON r.row_seq = c.row_seq
              WHERE c.y IS NOT NULL)""",
        "y",
        3,
    ),
)
def histology_annotated(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat((F.col("item_id") % 4).cast("string"), F.lit(". Carcinoma Tubular "))
    annotations = table(spark, folder, "benchmark").select(
        "text", F.when(F.col("item_id") % 5 != 0, name).alias("histological_type_classification")
    )
    found = _with_histology(spark, folder).select("row_seq", "y_histological_type")
    rows = _reports(spark, folder).select("row_seq", F.col("diagnosis").alias("x_diagnostico"))
    return labels.histology_with_annotations(annotations, rows.join(found, "row_seq"), 3)


@check(
    "plan_intervention_table",
    f"""
    SELECT s.study, c.t AS "X_clinical", d.t AS "X_diagnosis", m.t AS "X_macro", w.raw AS intervention_raw,
           array_to_string(l.y, '|') AS y
    FROM (SELECT DISTINCT study FROM ({_REPORTS})) s
    LEFT JOIN {_rolled('clinical')} c ON s.study = c.study
    LEFT JOIN {_rolled('diagnosis')} d ON s.study = d.study
    LEFT JOIN {_rolled('macro')} m ON s.study = m.study
    LEFT JOIN (SELECT study, value AS raw FROM ({_MERGED}) WHERE path = 'intervention_raw') w ON s.study = w.study
    LEFT JOIN {_manual_values()} l ON w.raw = l.x""",
)
def intervention_table(spark: SparkSession, folder: str) -> DataFrame:
    done = _processed(spark, folder)
    flat = forms.flatten(done.forms, "form", ["study"])
    rows = dataset.intervention_table(
        done.studies, flat, _manual(spark), ["clinical", "diagnosis", "macro"], "study"
    )
    return rows.withColumn("y", F.array_join("y", "|"))


@check(
    "ev_set_accuracy",
    f"""SELECT round(avg(CAST(coalesce(l.labels, []) = list_sort(m.y) AS INTEGER)), 9) AS accuracy
        FROM (SELECT row_seq, {_raw_sql('t')} AS raw FROM {_P}) r
        JOIN {_manual_values()} m ON r.raw = m.x
        JOIN ({_labels_sql(f'SELECT raw FROM ({_RAW_TEXTS}) WHERE raw IS NOT NULL')}) l ON r.raw = l.raw""",
)
def set_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of the automatic labels where a manual label is known."""
    found = forms.interventions(_forms(spark, folder), "form_text", _manual(spark))
    known = found.filter("intervention_manual IS NOT NULL")
    auto = F.coalesce("intervention_automatic", F.array().cast("array<string>"))
    scored = evaluate.set_accuracy(known.withColumn("p", auto), "intervention_manual", "p")
    return scored.withColumn("accuracy", F.round("accuracy", 9))

