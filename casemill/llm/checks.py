"""Thin queries over the given tables, one for each operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from casemill.llm import (
    main_text, masked_lm, neighbours, ngram_join, packing, periodic_runs, piece_ids, quality, spot_signatures,
    source_divergence, surrogates, token_store, toxicity,
)
from casemill.llm.registry import QUERIES, SQL, query
from casemill.session import table

__all__ = ["QUERIES", "SQL"]


NGRAM_JOIN_SQL = r"""
    WITH RECURSIVE
    words AS (
      SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
               lambda x: x <> '') AS w FROM documents),
    grams AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 4
               THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    shared AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g
      WHERE a.doc_id < b.doc_id GROUP BY ALL),
    links AS (
      SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
      WHERE 100 * c >= 85 * (x.n + y.n - c)),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reached AS (
      SELECT doc_id, doc_id AS other FROM documents
      UNION SELECT doc_id, b FROM reached JOIN edges ON other = a)
    SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
    FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


@query("op1_ngram_join", NGRAM_JOIN_SQL)
def ngram_join_query(spark: SparkSession, folder: str) -> DataFrame:
    linked = ngram_join.link(table(spark, folder, "documents"))
    return linked.select("doc_id", "n_shingles", "component_id")


#: The key of a run is its owner's secret; this one is for the checks alone.
CHECK_KEY = "a key for checks"


@query("op2_surrogates")
def surrogates_query(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replace(table(spark, folder, "documents"), CHECK_KEY)


@query("op3_best_fit_packing")
def packing_query(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op4_token_store")
def token_store_query(spark: SparkSession, folder: str) -> DataFrame:
    return token_store.round_trip(table(spark, folder, "documents"), end_id=2)


@query("op5_spot_signatures")
def spot_signatures_query(spark: SparkSession, folder: str) -> DataFrame:
    return spot_signatures.edited_likeness(table(spark, folder, "documents"))


@query("op6_masked_lm")
def masked_lm_query(spark: SparkSession, folder: str) -> DataFrame:
    return masked_lm.score(table(spark, folder, "documents"))


@query("op7_quality")
def quality_query(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_main_text")
def main_text_query(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract_pages(table(spark, folder, "pages"))


@query("op9_sentencepiece")
def sentencepiece_query(spark: SparkSession, folder: str) -> DataFrame:
    return piece_ids.encode_decode(table(spark, folder, "documents"))


@query("op10_neighbours")
def neighbours_query(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"))


SOURCE_DIVERGENCE_SQL = r"""
    WITH
    docs AS MATERIALIZED (
      SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
      FROM documents),
    found AS MATERIALIZED (
      SELECT d, lang, source,
             unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
    kept AS MATERIALIZED (
      SELECT lang, term, count(*) AS total FROM found GROUP BY ALL HAVING count(DISTINCT d) >= 3),
    langs AS MATERIALIZED (
      SELECT lang, count(term)::HUGEINT AS v, coalesce(sum(total), 0)::HUGEINT AS words
      FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY ALL),
    counts AS MATERIALIZED (
      SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS MATERIALIZED (
      SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS size
      FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
    shares AS MATERIALIZED (
      SELECT lang, source, term, coalesce(n, 0) AS n, total,
             1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (size + v) AS p,
             1 + 1000000000::HUGEINT * (total + 1) // (words + v) AS of_lang
      FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, term)),
    sums AS (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    rated AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (p - of_lang) * (p - of_lang) // of_lang FROM shares
      WHERE n > 0 AND p > of_lang),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rated)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
    WHERE part = 'pair' OR rank <= 200"""


@query("op11_source_divergence", SOURCE_DIVERGENCE_SQL)
def source_divergence_query(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.audit(table(spark, folder, "documents"))


@query("op12_toxicity")
def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_periodic_runs")
def periodic_runs_query(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.detect(table(spark, folder, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline_query(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
