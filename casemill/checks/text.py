"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.checks import derive, sql
from casemill.checks.registry import check
from casemill.functions import fuzzy, measures
from casemill.functions import text as T
from casemill.operators import joins
from casemill.session import spread, table


def _digest(df: DataFrame, key: str, out: Column) -> DataFrame:
    """Key, hash and length of a long result."""
    done = df.select(key, out.alias("_out"))
    return done.select(key, F.md5("_out").alias("digest"), F.length("_out").alias("n_chars"))


def _digest_sql(expression: str, source: str = "documents", key: str = "doc_id") -> str:
    return (
        f"SELECT {key}, md5(o) AS digest, length(o) AS n_chars "
        f"FROM (SELECT {key}, {expression} AS o FROM {source})"
    )


@check("txt_strip_accents", _digest_sql(sql.strip_accents("text")))
def strip_accents(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(spread(table(spark, folder, "documents")), "doc_id", T.strip_accents(F.col("text")))


@check("txt_clean_hard", _digest_sql(sql.clean_hard("text")))
def clean_hard(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(spread(table(spark, folder, "documents")), "doc_id", T.clean_hard(F.col("text")))


@check("txt_clean_model", lambda: _digest_sql(sql.clean_model("text")))
def clean_model(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(spread(table(spark, folder, "documents")), "doc_id", T.clean_model(F.col("text")))


@check("txt_tokens", _digest_sql(f"array_to_string({sql.tokens('text')}, '|')"))
def tokens(spark: SparkSession, folder: str) -> DataFrame:
    words = F.array_join(T.tokens(F.col("text")), "|")
    return _digest(spread(table(spark, folder, "documents")), "doc_id", words)


@check(
    "txt_word_ngrams",
    """
    SELECT doc_id, len(g) AS n_grams, md5(array_to_string(g, '|')) AS digest FROM (
      SELECT doc_id, list_concat(w, list_concat(
          list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
          list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        )) AS g
      FROM (SELECT doc_id, """ + sql.tokens("text") + """ AS w FROM documents))""",
)
def word_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    words = spread(table(spark, folder, "documents")).select("doc_id", T.tokens(F.col("text")).alias("w"))
    grams = words.select("doc_id", T.word_ngrams(F.col("w"), [1, 2, 3]).alias("g"))
    return grams.select(
        "doc_id", F.size("g").alias("n_grams"), F.md5(F.array_join("g", "|")).alias("digest")
    )


def _name_words(column: str) -> str:
    return sql.clean_words(column)


@check(
    "txt_token_distance",
    f"""
    SELECT p_partkey, round(least({sql.mean_of_best('a', 'b')}, {sql.mean_of_best('b', 'a')}), 9)
             AS distance
    FROM (SELECT p_partkey, {_name_words('p_name')} AS a,
                 {_name_words("p_type || ' y ' || p_brand")} AS b FROM part)""",
)
def token_distance(spark: SparkSession, folder: str) -> DataFrame:
    other = F.concat(F.col("p_type"), F.lit(" y "), F.col("p_brand"))
    return table(spark, folder, "part").select(
        "p_partkey", F.round(fuzzy.token_distance(F.col("p_name"), other), 9).alias("distance")
    )


@check(
    "txt_token_score",
    f"""
    SELECT p_partkey, {sql.token_score('a', 'b')} AS score
    FROM (SELECT p_partkey, {_name_words('p_name')} AS a,
                 {_name_words("p_type || ' ' || p_name || ' extra'")} AS b FROM part)""",
)
def token_score(spark: SparkSession, folder: str) -> DataFrame:
    other = F.concat(F.col("p_type"), F.lit(" "), F.col("p_name"), F.lit(" extra"))
    return table(spark, folder, "part").select(
        "p_partkey", fuzzy.token_score(F.col("p_name"), other).alias("score")
    )


@check(
    "txt_ratio",
    f"""
    WITH pairs AS (SELECT DISTINCT lower(p_name) AS a, lower(p_type) || ' ' || lower(p_name) AS b
                   FROM part),
         scored AS (SELECT a, b, {sql.ratio('a', 'b')} AS score FROM pairs)
    SELECT p_partkey, score FROM part JOIN scored
      ON a = lower(p_name) AND b = lower(p_type) || ' ' || lower(p_name)""",
)
def ratio(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(
        "p_partkey",
        F.lower("p_name").alias("a"),
        F.concat(F.lower("p_type"), F.lit(" "), F.lower("p_name")).alias("b"),
    )
    pairs = parts.select("a", "b").distinct()
    scored = pairs.withColumn("score", fuzzy.ratio(F.col("a"), F.col("b")))
    return parts.join(scored, ["a", "b"]).select("p_partkey", "score")


@check(
    "txt_join_sections",
    """
    SELECT doc_id, md5(o) AS digest, length(o) AS n_chars FROM (
      SELECT doc_id, concat_ws(' ', chr(10) || 'lang: ' || lang, chr(10) || 'source: ' || src,
                               chr(10) || 'text: ' || text) AS o
      FROM (SELECT *, CASE WHEN n_chars % 3 <> 0 THEN source END AS src FROM documents))""",
)
def join_sections(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn(
        "source", F.when(F.col("n_chars") % 3 != 0, F.col("source"))
    )
    return _digest(docs, "doc_id", T.join_sections(["lang", "source", "text"]))


_MARKED = "'##ENTRY_' || CAST(n_chars AS STRING) || '## ' || text || ' ##entry_## 12,5 y 3.4'"


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").selectExpr("doc_id", f"{_MARKED} AS text")
    return spread(rows)


_MARKED_SOURCE = f"(SELECT doc_id, {_MARKED} AS text FROM documents)"


@check(
    "txt_strip_markers",
    _digest_sql(
        "regexp_replace(regexp_replace(text, '(?i)##entry_\\d*##', '', 'g'), "
        "'\\p{Nd}+((,|\\.)\\p{Nd}+)?', '', 'g')",
        _MARKED_SOURCE,
    ),
)
def strip_markers(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(_marked(spark, folder), "doc_id", T.strip_markers(F.col("text")))


@check(
    "txt_display_clean",
    _digest_sql(
        sql.strip("replace(regexp_replace(text, '##ENTRY_\\d+##', '', 'g'), chr(10), '')"),
        _MARKED_SOURCE,
    ),
)
def display_clean(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(_marked(spark, folder), "doc_id", T.display_clean(F.col("text")))


@check("txt_model_input", _digest_sql("replace(lower(text), chr(10), ' ')"))
def model_input(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(spread(table(spark, folder, "documents")), "doc_id", T.model_input(F.col("text")))


# --- measures ---------------------------------------------------------------------------------

_MACRO = (
    "SELECT row_seq, concat_ws(' ', diagnosis, macro) AS t FROM (" + derive.reports_cte() + ") r"
)


def _macro(spark: SparkSession, folder: str) -> DataFrame:
    return derive.reports(spark, folder).select(
        "row_seq", F.concat_ws(" ", "diagnosis", "macro").alias("t")
    )


@check(
    "txt_measures",
    f"""
    SELECT row_seq, i AS position, m[i] AS measure FROM (
      SELECT row_seq, m, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT row_seq, {sql.measures('t')} AS m FROM ({_MACRO})))""",
)
def all_measures(spark: SparkSession, folder: str) -> DataFrame:
    found = _macro(spark, folder).select(
        "row_seq", F.posexplode(measures.measures(F.col("t"))).alias("i", "measure")
    )
    return found.select("row_seq", (F.col("i") + 1).cast("long").alias("position"), "measure")


@check(
    "txt_measures_sorted",
    f"""
    SELECT row_seq, array_to_string(list_sort(m), '|') AS every_measure,
           array_to_string(list_sort(list_distinct(m)), '|') AS distinct_measures
    FROM (SELECT row_seq, {sql.measures('t')} AS m FROM ({_MACRO}))""",
)
def measures_sorted(spark: SparkSession, folder: str) -> DataFrame:
    return _macro(spark, folder).select(
        "row_seq",
        F.array_join(measures.measures_sorted(F.col("t")), "|").alias("every_measure"),
        F.array_join(measures.measures_sorted(F.col("t"), True), "|").alias("distinct_measures"),
    )


# The text is split at the measures: the lengths of the pieces before a match give its offset.
_SPANS = f"""
    SELECT row_seq, s AS start_char, s + length(x) AS end_char, x AS measure,
           CAST(len({sql.tokens('substr(t, 1, s + 1)')}) - 1 AS INTEGER) AS token_start,
           CAST(len({sql.tokens('substr(t, 1, s + length(x))')}) AS INTEGER) AS token_end
    FROM (
      SELECT row_seq, t, m[i] AS x, CAST(list_sum(list_transform(range(1, i + 1),
               lambda j: length(gap[j]))) + coalesce(list_sum(list_transform(range(1, i),
               lambda j: length(m[j]))), 0) AS INTEGER) AS s
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
              SELECT row_seq, t, {sql.measures('t')} AS m,
                     string_split(regexp_replace(t, {sql.q(K.MEASURE)}, chr(1), 'g'), chr(1)) AS gap
              FROM ({_MACRO}))))"""


@check("txt_measure_spans", _SPANS)
def measure_spans(spark: SparkSession, folder: str) -> DataFrame:
    rows = _macro(spark, folder)
    spans = rows.select("row_seq", F.explode(measures.measure_spans(F.col("t"))).alias("s"))
    return spans.select(
        "row_seq",
        F.col("s.start").alias("start_char"),
        F.col("s.end").alias("end_char"),
        F.col("s.text").alias("measure"),
        F.col("s.token_start").alias("token_start"),
        F.col("s.token_end").alias("token_end"),
    )


_AREA = "(?:" + "|".join(K.AREA_SHAPES) + ")"


@check(
    "txt_measures_typed",
    f"""
    SELECT row_seq, m AS measure, CASE WHEN regexp_full_match(m, {sql.q('(?i)' + _AREA)})
             THEN 'AREA' ELSE 'DISTANCIA' END AS label, count(*) AS n
    FROM (SELECT row_seq, unnest(regexp_extract_all(t,
            {sql.q('(?i)(?:' + _AREA + '|' + K.DISTANCE_SHAPE + ')')})) AS m FROM ({_MACRO}))
    GROUP BY ALL""",
)
def measures_typed(spark: SparkSession, folder: str) -> DataFrame:
    rows = _macro(spark, folder)
    found = rows.select("row_seq", F.inline(measures.measures_typed(F.col("t"))))
    return found.groupBy("row_seq", F.col("text").alias("measure"), "label").agg(
        F.count("*").alias("n")
    )


def _value_sql(factors: dict[str, float]) -> str:
    return f"""
    SELECT row_seq, measure, i AS position, round(v[i], 9) AS value FROM (
      SELECT row_seq, measure, v, unnest(range(1, len(v) + 1)) AS i FROM (
        SELECT row_seq, measure, {sql.measure_values('measure', factors)} AS v FROM (
          SELECT row_seq, unnest({sql.measures('t')}) AS measure FROM ({_MACRO}))))"""


def _values(spark: SparkSession, folder: str, factors: dict[str, float] | None) -> DataFrame:
    found = _macro(spark, folder).select(
        "row_seq", F.explode(measures.measures(F.col("t"))).alias("measure")
    )
    values = found.select(
        "row_seq", "measure",
        F.posexplode(measures.measure_value(F.col("measure"), factors)).alias("i", "v"),
    )
    return values.select(
        "row_seq", "measure", (F.col("i") + 1).cast("long").alias("position"),
        F.round("v", 9).alias("value"),
    )


@check("txt_measure_value", _value_sql(K.PUBLISHED_FACTORS))
def measure_value(spark: SparkSession, folder: str) -> DataFrame:
    return _values(spark, folder, None)


@check("txt_measure_value_cm", _value_sql(K.CM_FACTORS))
def measure_value_cm(spark: SparkSession, folder: str) -> DataFrame:
    return _values(spark, folder, K.CM_FACTORS)


# --- fuzzy joins ------------------------------------------------------------------------------

_CHOICES = ["small rings", "red widget", "blue bolts", "green gear y hot", "steel", "cold nut"]
_BEST = f"""
    SELECT key, match, score FROM (
      SELECT key, c.match, {sql.token_score('a', 'b')} AS score,
             row_number() OVER (PARTITION BY key ORDER BY {sql.token_score('a', 'b')} DESC, n) AS r
      FROM (SELECT key, {sql.clean_words(sql.processed('key'))} AS a
            FROM (SELECT DISTINCT p_name AS key FROM part)) k,
           (SELECT n, match, {sql.clean_words('match')} AS b FROM (VALUES
              {', '.join(f"({i}, {sql.q(c)})" for i, c in enumerate(_CHOICES))}) v(n, match)) c)
    WHERE r = 1"""


@check("join_fuzzy_best", f"SELECT * FROM ({_BEST}) WHERE score >= 80")
def fuzzy_best(spark: SparkSession, folder: str) -> DataFrame:
    return joins.fuzzy_best(table(spark, folder, "part"), "p_name", _CHOICES, 80)


@check("join_fuzzy_unmatched", f"SELECT * FROM ({_BEST}) WHERE score < 80")
def fuzzy_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return joins.fuzzy_unmatched(table(spark, folder, "part"), "p_name", _CHOICES, 80)


# the same against a table of choices: every name, type and brand that occurs

_TABLE_BEST = f"""
    WITH keys AS MATERIALIZED (
           SELECT key, {sql.clean_words(sql.processed('key'))} AS a
           FROM (SELECT DISTINCT translate(p_name, 'el', 'au') || ' ' || p_type AS key FROM part)),
         choices AS MATERIALIZED (
           SELECT match, n, {sql.clean_words(sql.processed('match'))} AS b
           FROM (SELECT p_type || ' ' || p_name || ' ' || p_brand AS match, min(p_partkey) AS n FROM part GROUP BY 1)),
         scored AS MATERIALIZED (
           SELECT key, match, n, {sql.token_score('a', 'b')} AS score FROM keys, choices)
    SELECT key, match, score FROM (
      SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, n) AS r FROM scored) WHERE r = 1"""


def _table_of_choices(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, folder, "part")
    keys = part.select(F.concat(F.translate("p_name", "el", "au"), F.lit(" "), F.col("p_type")).alias("key"))
    match = F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("match")
    return keys, part.groupBy(match).agg(F.min("p_partkey").alias("choice_order"))


@check("join_fuzzy_best_table", f"SELECT * FROM ({_TABLE_BEST}) WHERE score >= 80")
def fuzzy_best_table(spark: SparkSession, folder: str) -> DataFrame:
    keys, choices = _table_of_choices(spark, folder)
    return joins.fuzzy_best(keys, "key", choices, 80)


@check("join_fuzzy_unmatched_table", f"SELECT * FROM ({_TABLE_BEST}) WHERE score < 80")
def fuzzy_unmatched_table(spark: SparkSession, folder: str) -> DataFrame:
    keys, choices = _table_of_choices(spark, folder)
    return joins.fuzzy_unmatched(keys, "key", choices, 80)
