"""Filters, joins, counts, roll-ups, splits and file round trips over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.checks import sql
from casemill.checks.registry import check
from casemill.functions import text as T
from casemill.operators import coded, counts, filters, joins, rollup, samples
from casemill.session import scratch_dir, spread, table
from casemill.sources import readers, writers

# --- sources and sinks ------------------------------------------------------------------------

_ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"


@check(
    "src_yearly_extracts",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
              CAST(year(o_orderdate) AS STRING) AS year FROM orders""",
)
def yearly_extracts(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    name = F.format_string("reports_%d.csv", F.year("o_orderdate"))
    base = scratch_dir(spark, "extracts")
    orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", name.alias("extract")
    ).write.partitionBy("extract").csv(base, header=True)
    return readers.yearly_extracts(spark, f"{base}/*.csv", _ORDERS)


@check("src_parquet", "SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents")
def parquet(spark: SparkSession, folder: str) -> DataFrame:
    rows = readers.parquet(spark, f"{folder}/documents.parquet")
    return rows.select("doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars")


_TURNS_SQL = "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations"
_TURNS = "conv_id bigint, turn bigint, role string, text string"


def _turns(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@check("src_csv", _TURNS_SQL)
def csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark, "csv")
    writers.csv(table(spark, folder, "conversations"), path, ",")
    return _turns(readers.csv(spark, path, _TURNS))


@check("src_jsonl", _TURNS_SQL)
def jsonl(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark, "jsonl")
    table(spark, folder, "conversations").write.json(path)
    return _turns(readers.jsonl(spark, path, _TURNS))


_NESTED_SQL = """
    SELECT CAST(p_partkey AS STRING) AS "Estudio",
           CASE WHEN p_size % 3 <> 0 THEN p_name END AS "intervention_raw",
           p_type AS "pt",
           CASE WHEN p_size % 5 <> 0 THEN p_brand END AS "tumor_features.location",
           CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS STRING) || ' año' END AS "tumor_features.size"
    FROM part"""
_FORM = "pt string, tumor_features struct<size: string, location: string>, intervention_raw string"


def _nested(spark: SparkSession, folder: str) -> DataFrame:
    nested = F.when(
        F.col("p_size") % 5 != 0,
        F.struct(
            F.concat(F.col("p_size").cast("string"), F.lit(" año")).alias("size"),
            F.col("p_brand").alias("location"),
        ),
    )
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("Estudio"),
        F.struct(
            F.col("p_type").alias("pt"),
            nested.alias("tumor_features"),
            F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("intervention_raw"),
        ).alias("form"),
    )


@check("src_form_json", _NESTED_SQL)
def form_json(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark, "forms")
    writers.form_json(_nested(spark, folder), path)
    return readers.form_json(spark, path, _FORM)


@check(
    "snk_form_json",
    """
    SELECT CAST(p_partkey AS STRING) AS study, p_size % 3 <> 0 AS has_intervention,
           p_size % 5 <> 0 AS has_tumor, p_size % 5 <> 0 AS keeps_accents FROM part""",
)
def form_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The written lines themselves: absent fields have no key, accents are not escaped."""
    path = scratch_dir(spark, "forms")
    writers.form_json(_nested(spark, folder), path)
    line = F.col("value")
    return spark.read.text(path).select(
        F.get_json_object(line, "$.Estudio").alias("study"),
        line.contains('"intervention_raw"').alias("has_intervention"),
        line.contains('"tumor_features"').alias("has_tumor"),
        line.contains(" año").alias("keeps_accents"),
    )


@check("src_code_names", "SELECT CAST(n_nationkey AS STRING) AS code, n_name AS name FROM nation")
def code_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark, "codes")
    pairs = F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.col("n_name")))
    document = table(spark, folder, "nation").agg(F.map_from_entries(pairs).alias("codes"))
    document.write.json(path)
    return readers.code_names(spark, path)


@check(
    "snk_csv_parquet",
    """
    SELECT copy, doc_id, lang, md5(text) AS digest
    FROM documents, (VALUES ('csv'), ('parquet')) v(copy)""",
)
def csv_and_parquet(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "lang", "text")
    path = scratch_dir(spark, "studies")
    writers.studies(rows, path)
    copies = {
        "csv": readers.csv(spark, path + ".csv", "doc_id bigint, lang string, text string", ";"),
        "parquet": readers.parquet(spark, path + ".parquet"),
    }
    first, second = (
        df.select(F.lit(name).alias("copy"), "doc_id", "lang", F.md5("text").alias("digest"))
        for name, df in copies.items()
    )
    return first.unionByName(second)


@check(
    "snk_annotation_tasks",
    """
    SELECT task, estudio, md5(text) AS digest FROM (
      SELECT 'every' AS task, CAST(doc_id AS STRING) AS estudio, text FROM documents
      UNION ALL
      SELECT 'missing', CAST(d.doc_id AS STRING), d.text
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL)""",
)
def annotation_tasks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    docs = docs.withColumn("study", F.col("doc_id").cast("string"))
    results = []
    for task, missing in (("every", None), ("missing", "quality")):
        path = scratch_dir(spark, "tasks")
        writers.annotation_tasks(docs, path, "text", "study", missing)
        rows = readers.jsonl(spark, path, "text string, estudio string")
        results.append(
            rows.select(F.lit(task).alias("task"), "estudio", F.md5("text").alias("digest"))
        )
    return results[0].unionByName(results[1])


@check(
    "snk_error_pairs",
    """
    SELECT side, l.doc_id AS id, md5(d.text) AS digest,
           CASE side WHEN 'true' THEN quality ELSE toxic END AS label
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id, (VALUES ('true'), ('pred')) v(side)
    WHERE quality <> toxic""",
)
def error_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    paths = [scratch_dir(spark, side) for side in ("true", "pred")]
    writers.error_pairs(rows, *paths, "doc_id", x="text", true="quality", pred="toxic")
    schema = "id bigint, input struct<text: string>, output struct<text: int>"
    first, second = (
        readers.jsonl(spark, path, schema).select(
            F.lit(side).alias("side"), "id", F.md5("input.text").alias("digest"),
            F.col("output.text").alias("label"),
        )
        for side, path in zip(("true", "pred"), paths, strict=True)
    )
    return first.unionByName(second)


# --- projections and filters ------------------------------------------------------------------


@check(
    "prj_rename_clean",
    """SELECT doc_id AS x_numero_de_documento, md5(text) AS x_texto, lang AS x_idioma,
              source AS "x_origen_(_fuente_)", n_chars AS x_letras FROM documents""",
)
def rename_clean(spark: SparkSession, folder: str) -> DataFrame:
    titled = table(spark, folder, "documents").select(
        F.col("doc_id").alias("Número de documento"),
        F.md5("text").alias("Texto"),
        F.col("lang").alias("Idioma"),
        F.col("source").alias("Origen, (fuente)"),
        F.col("n_chars").alias("Letras"),
    )
    return filters.rename_clean(titled, titled.columns)


_CODED = """SELECT p_partkey AS "Estudio", CASE WHEN p_size % 7 <> 0 THEN p_name END AS "Diagnostico",
    CASE WHEN p_size % 4 <> 0 THEN p_type END AS "Macro",
    CASE WHEN p_size % 9 = 0 THEN p_brand || ',' || p_type ELSE p_brand END AS "ConceptID_Morphologic",
    CASE WHEN p_size % 11 <> 0 THEN p_type || CAST(p_partkey % 400 AS STRING) END AS "CodTopografico"
    FROM part"""


def _coded(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(
        _CODED.replace('"', "`").replace("FROM part", "FROM {part}"), part=table(spark, folder, "part")
    )


@check(
    "prj_snomed",
    f"""
    SELECT "Estudio", "Diagnostico" AS "x_Diagnostico", "Macro" AS "x_Macro",
           concat_ws(' ', chr(10) || 'Diagnostico: ' || "Diagnostico", chr(10) || 'Macro: ' || "Macro")
             AS x_join,
           "ConceptID_Morphologic" AS "y_ConceptID_Morphologic", "CodTopografico" AS "y_CodTopografico"
    FROM ({_CODED}) WHERE "Diagnostico" IS NOT NULL""",
)
def coded_dataset(spark: SparkSession, folder: str) -> DataFrame:
    return coded.coded_dataset(_coded(spark, folder), ["Diagnostico", "Macro"])


@check(
    "flt_denylist",
    """SELECT o_orderkey, o_custkey FROM orders
       WHERE CAST(o_custkey AS STRING) NOT IN ('1', '7', '370')""",
)
def denylist(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("study", F.col("o_custkey").cast("string"))
    kept = filters.without_studies(orders, ["1", "7", "370"], "study")
    return kept.select("o_orderkey", "o_custkey")


@check(
    "flt_denylist_table",
    """SELECT o_orderkey, o_custkey FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def denylist_table(spark: SparkSession, folder: str) -> DataFrame:
    denied = table(spark, folder, "customer").filter("c_acctbal < 0")
    denied = denied.select(F.col("c_custkey").alias("o_custkey"))
    kept = filters.without_studies(table(spark, folder, "orders"), denied, "o_custkey")
    return kept.select("o_orderkey", "o_custkey")


@check(
    "flt_label_not_null",
    """SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       WHERE l.quality IS NOT NULL""",
)
def label_not_null(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return filters.labelled(docs, "quality").select("doc_id", "quality")


@check("flt_single_code", "SELECT doc_id, lang FROM documents WHERE NOT contains(text, ',')")
def single_code(spark: SparkSession, folder: str) -> DataFrame:
    return filters.single_code(table(spark, folder, "documents"), "text").select("doc_id", "lang")


@check(
    "flt_no_other_sample",
    """
    SELECT o_orderkey, a, b FROM (
      SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'otro' ELSE o_orderstatus END AS a,
             CASE WHEN o_orderpriority LIKE '5%' THEN 'otro'
                  WHEN o_orderpriority NOT LIKE '4%' THEN o_orderpriority END AS b FROM orders)
    WHERE a <> 'otro' AND b <> 'otro'
    ORDER BY md5(CAST(o_orderkey AS STRING) || '|7'), o_orderkey LIMIT 1""",
)
def no_other_sample(spark: SparkSession, folder: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(status == "F", "otro").otherwise(status).alias("a"),
        F.when(priority.startswith("5"), "otro").when(~priority.startswith("4"), priority).alias("b"),
    )
    return filters.no_other_sample(rows, ["a", "b"], "o_orderkey", 7)


# --- joins ------------------------------------------------------------------------------------


@check(
    "join_align_left",
    """SELECT d.doc_id, d.lang, l.quality, l.toxic
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def align_left(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return joins.align_left(docs, table(spark, folder, "labels"), "doc_id")


@check(
    "join_outer_labels",
    """
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, l.quality, l.toxic
    FROM (SELECT doc_id, lang FROM documents WHERE lang <> 'en') d
    FULL JOIN (SELECT doc_id, CASE WHEN toxic = 0 THEN quality END AS quality, toxic FROM labels) l
      ON d.doc_id = l.doc_id
    WHERE l.quality IS NOT NULL""",
)
def outer_labels(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "documents").filter("lang <> 'en'").select("doc_id", "lang")
    labels = table(spark, folder, "labels").withColumn(
        "quality", F.when(F.col("toxic") == 0, F.col("quality"))
    )
    return joins.outer_labels(x, labels, "doc_id", "quality")


@check(
    "join_two_label_sets",
    """
    SELECT coalesce(o.k, l.k) AS order_key, o.o_orderpriority AS y_top, l.y_morf
    FROM (SELECT o_orderkey AS k, o_orderpriority FROM orders WHERE o_orderstatus <> 'F') o
    FULL JOIN (SELECT l_orderkey AS k, max(l_returnflag) AS y_morf FROM lineitem
               WHERE l_quantity > 20 GROUP BY 1) l ON o.k = l.k""",
)
def two_label_sets(spark: SparkSession, folder: str) -> DataFrame:
    first = table(spark, folder, "orders").filter("o_orderstatus <> 'F'")
    first = first.select(F.col("o_orderkey").alias("order_key"), F.col("o_orderpriority").alias("y_top"))
    second = table(spark, folder, "lineitem").filter("l_quantity > 20")
    second = second.groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.max("l_returnflag").alias("y_morf")
    )
    return joins.two_label_sets(first, second, "order_key")


@check(
    "join_code_names",
    """
    SELECT c_custkey, CASE WHEN c_nationkey % 6 = 0 THEN 'otro' ELSE n_name END AS y
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 7 <> 3""",
)
def code_names(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_nationkey")
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.when(key % 6 == 0, "otro").otherwise(key.cast("string")).alias("y")
    )
    names = table(spark, folder, "nation").filter("n_nationkey % 7 <> 3").select(
        F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name")
    )
    return joins.code_names(customers, names)


# --- counts -----------------------------------------------------------------------------------

_PERCENTS = """round(100.0 * count(*) / sum(count(*)) OVER (), 9) AS percent,
    CASE WHEN label IS NOT NULL THEN round(100.0 * count(*) / sum(CASE WHEN label IS NOT NULL
      THEN count(*) END) OVER (), 9) END AS percent_not_null"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: F.round(c, 9) for c in ("percent", "percent_not_null")}
    )


@check(
    "agg_value_counts",
    f"""
    SELECT label, count(*) AS absolute, {_PERCENTS}
    FROM (SELECT l.quality AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    GROUP BY label""",
)
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    docs = docs.join(table(spark, folder, "labels"), "doc_id", "left")
    return _rounded(counts.value_counts(docs, "quality"))


@check(
    "agg_value_counts_exploded",
    f"""
    SELECT label, count(*) AS absolute, {_PERCENTS}
    FROM (SELECT unnest({sql.tokens('text')}) AS label FROM documents) GROUP BY label""",
)
def value_counts_exploded(spark: SparkSession, folder: str) -> DataFrame:
    words = spread(table(spark, folder, "documents")).select(T.tokens(F.col("text")).alias("words"))
    return _rounded(counts.value_counts_exploded(words, "words"))


@check(
    "agg_topk_other",
    "SELECT doc_id, y FROM (" + sql.top_or_other("SELECT doc_id, source AS y FROM documents", "y", 5) + ")",
)
def topk_other(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("y"))
    return counts.topk_other(docs, "y", 5)


_SINGLE = "p_name || CAST(floor(p_retailprice) % 300 AS STRING)"


@check(
    "agg_singletons_other",
    f"""
    SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY y) = 1 THEN 'otro' ELSE y END AS y
    FROM (SELECT p_partkey, {_SINGLE.replace('floor(p_retailprice)', 'CAST(floor(p_retailprice) AS BIGINT)')} AS y FROM part)""",
)
def singletons_other(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").selectExpr("p_partkey", f"{_SINGLE} AS y")
    return counts.singletons_other(rows, "y")


@check(
    "agg_topk_other_list",
    f"""
    WITH w AS (SELECT doc_id, {sql.tokens('text')} AS y FROM documents),
         top AS (SELECT list(t) AS ts FROM (SELECT t FROM (SELECT unnest(y) AS t FROM w)
                 GROUP BY t ORDER BY count(*) DESC, t LIMIT 5))
    SELECT doc_id, len(y) AS n, md5(array_to_string(list_transform(y,
             lambda t: CASE WHEN list_contains(ts, t) THEN t ELSE 'otro' END), '|')) AS digest
    FROM w, top""",
)
def topk_other_list(spark: SparkSession, folder: str) -> DataFrame:
    words = spread(table(spark, folder, "documents")).select("doc_id", T.tokens(F.col("text")).alias("y"))
    kept = counts.topk_other_list(words, "y", 5)
    return kept.select(
        "doc_id", F.size("y").alias("n"), F.md5(F.array_join("y", "|")).alias("digest")
    )


@check("agg_label_vocab", "SELECT DISTINCT p_type AS label FROM part ORDER BY 1")
def label_vocab(spark: SparkSession, folder: str) -> DataFrame:
    return counts.label_vocabulary(table(spark, folder, "part"), "p_type")


@check(
    "agg_label_vocab_list",
    f"SELECT DISTINCT unnest({sql.tokens('text')}) AS label FROM conversations ORDER BY 1",
)
def label_vocab_list(spark: SparkSession, folder: str) -> DataFrame:
    words = spread(table(spark, folder, "conversations")).select(T.tokens(F.col("text")).alias("y"))
    return counts.label_vocabulary(words, "y")


@check(
    "agg_key_unique",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1",
)
def key_unique(spark: SparkSession, folder: str) -> DataFrame:
    counts.require_unique(table(spark, folder, "orders"), "o_orderkey")
    return counts.duplicate_keys(table(spark, folder, "orders"), "o_custkey")


# --- roll-up ----------------------------------------------------------------------------------

# (conversation, column, value) with first position; roles repeat, texts seldom do
_ENTRIES = """
    SELECT conv_id, c AS "column", v AS value,
           row_number() OVER (PARTITION BY conv_id, c ORDER BY min(turn)) AS entry_no
    FROM (SELECT conv_id, turn, 'role' AS c, CASE WHEN turn % 5 <> 4 THEN role END AS v
          FROM conversations
          UNION ALL SELECT conv_id, turn, 'text', text FROM conversations)
    WHERE v IS NOT NULL GROUP BY conv_id, c, v"""


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").withColumn(
        "role", F.when(F.col("turn") % 5 != 4, F.col("role"))
    )


@check("win_entry_number", f'SELECT conv_id, "column", md5(value) AS digest, entry_no FROM ({_ENTRIES})')
def entry_number(spark: SparkSession, folder: str) -> DataFrame:
    entries = rollup.entries(_conversations(spark, folder), ["role", "text"], "conv_id", "turn")
    return entries.select("conv_id", "column", F.md5("value").alias("digest"), "entry_no")


def _rendered(column: str) -> str:
    joined = (
        "string_agg('##ENTRY_' || CAST(entry_no AS STRING) || '## ' || value, chr(10) || chr(10) "
        "ORDER BY entry_no)"
    )
    stripped = f"rtrim({joined}, {sql.q(sql.K.WHITESPACE)})"
    return f"""(SELECT conv_id, CASE WHEN count(*) > 1 THEN {stripped} ELSE {joined} END AS t
                FROM ({_ENTRIES}) WHERE "column" = '{column}' GROUP BY conv_id)"""


@check(
    "agg_study_rollup",
    f"""
    SELECT c.conv_id, r.t AS role, md5(x.t) AS digest, length(x.t) AS n_chars
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN {_rendered('role')} r ON c.conv_id = r.conv_id
    LEFT JOIN {_rendered('text')} x ON c.conv_id = x.conv_id""",
)
def study_rollup(spark: SparkSession, folder: str) -> DataFrame:
    wide = rollup.study_rollup(_conversations(spark, folder), ["role", "text"], "conv_id", "turn")
    return wide.select(
        "conv_id", "role", F.md5("text").alias("digest"), F.length("text").alias("n_chars")
    )


@check(
    "srt_year_study",
    """SELECT CAST(year(o_orderdate) AS STRING) AS year, o_orderkey FROM orders
       ORDER BY year, o_orderkey""",
)
def year_study(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    rows = orders.select(F.year("o_orderdate").cast("string").alias("year"), "o_orderkey")
    return rollup.sort_studies(rows, "o_orderkey")


@check(
    "set_dedup",
    "SELECT DISTINCT md5(text) AS digest, length(text) AS n FROM documents WHERE text IS NOT NULL",
)
def dedup(spark: SparkSession, folder: str) -> DataFrame:
    texts = counts.distinct_values(table(spark, folder, "documents"), "text")
    return texts.select(F.md5("text").alias("digest"), F.length("text").alias("n"))


@check(
    "set_union_labels",
    """
    SELECT md5(x) AS digest, y FROM (
      SELECT text AS x, 'cdi' AS y FROM benchmark
      UNION ALL SELECT text, source FROM documents)""",
)
def union_labels(spark: SparkSession, folder: str) -> DataFrame:
    manual = table(spark, folder, "benchmark").select(F.col("text").alias("x"), F.lit("cdi").alias("y"))
    found = table(spark, folder, "documents")
    both = manual.unionByName(found.select(F.col("text").alias("x"), F.col("source").alias("y")))
    return both.select(F.md5("x").alias("digest"), "y")


# --- splits -----------------------------------------------------------------------------------

_SPLIT = """
    SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS STRING)), doc_id)
             <= ceil(count(*) OVER () * 0.15) AS is_validation FROM documents"""


@check("smp_split", _SPLIT)
def split(spark: SparkSession, folder: str) -> DataFrame:
    return samples.split(table(spark, folder, "documents").select("doc_id"), "doc_id", 0.15)


@check(
    "smp_stratified_split",
    """
    SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
             ORDER BY md5(CAST(doc_id AS STRING)), doc_id)
             <= round(count(*) OVER (PARTITION BY lang) * 0.15) AS is_validation FROM documents""",
)
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return samples.stratified_split(docs, "doc_id", "lang", 0.15)


@check(
    "smp_stratified_single",
    f"SELECT s.doc_id, s.is_validation FROM ({_SPLIT}) s",
)
def stratified_single(spark: SparkSession, folder: str) -> DataFrame:
    """A class with one member turns the split into a plain one."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("doc_id").alias("class"))
    return samples.stratified_split(docs, "doc_id", "class", 0.15).drop("class")


# --- coded labels -----------------------------------------------------------------------------

def _xy(code: str) -> str:
    return f"""SELECT "Estudio", "Diagnostico" AS x, "{code}" AS y FROM ({_CODED})
        WHERE "Diagnostico" IS NOT NULL AND "{code}" IS NOT NULL AND NOT contains("{code}", ',')"""


_XY, _TOPO = _xy("ConceptID_Morphologic"), _xy("CodTopografico")


@check(
    "lab_topk_xy",
    f"""
    SELECT r."Estudio", r.x, CASE WHEN r.y = 'otro' THEN 'otro' ELSE n_name END AS y
    FROM ({sql.top_or_other(_XY, 'y', 12)}) r
    LEFT JOIN nation ON r.y = 'Brand#' || CAST(n_nationkey + 1 AS STRING)""",
)
def topk_xy(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "nation").select(
        F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 1).cast("string")).alias("code"),
        F.col("n_name").alias("name"),
    )
    rows = coded.coded_dataset(_coded(spark, folder))
    return coded.topk_xy(
        rows, "x_Diagnostico", "y_ConceptID_Morphologic", 12, names=names, strict=False, keep=["Estudio"]
    )


@check(
    "lab_topk_xy_singletons",
    f"""
    SELECT "Estudio", x, CASE WHEN count(*) OVER (PARTITION BY y) = 1 THEN 'otro' ELSE y END AS y
    FROM ({_TOPO})""",
)
def topk_xy_singletons(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded.coded_dataset(_coded(spark, folder))
    return coded.topk_xy(rows, "x_Diagnostico", "y_CodTopografico", keep=["Estudio"])
