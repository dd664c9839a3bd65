"""Token labels, vectorisers, models and evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.checks import sql
from casemill.checks.registry import check
from casemill.functions import bio
from casemill.functions import text as T
from casemill.operators import alignment, evaluate, labels, learn, multilabel
from casemill.plans import training
from casemill.session import scratch_dir, spread, table

# --- token labels -----------------------------------------------------------------------------

_KEYS = ["conv_id", "turn"]
_LABEL = """CASE length({w}) % 5 WHEN 0 THEN 'B-A' WHEN 1 THEN 'I-A' WHEN 2 THEN 'I-A'
    WHEN 3 THEN 'I-B' ELSE 'O' END"""
_PREDICTED = """CASE length({w}) % 6 WHEN 0 THEN 'B-A' WHEN 1 THEN 'I-A' WHEN 2 THEN 'I-A'
    WHEN 3 THEN 'I-B' WHEN 5 THEN 'B-A' ELSE 'O' END"""
_WORDS = f"""(SELECT conv_id, turn, w, list_transform(w, lambda v: {_LABEL.format(w='v')}) AS l,
    list_transform(w, lambda v: {_PREDICTED.format(w='v')}) AS p
    FROM (SELECT conv_id, turn, {sql.tokens('text')} AS w FROM conversations))"""
# one row per word: idx from 0
_ROWS = f"(SELECT conv_id, turn, idx, l[idx + 1] AS l, p[idx + 1] AS p FROM (SELECT *, unnest(range(0, len(w))) AS idx FROM {_WORDS}))"


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    words = spread(table(spark, folder, "conversations")).select(*_KEYS, T.tokens(F.col("text")).alias("w"))
    return words.selectExpr(
        *_KEYS,
        "w",
        f"transform(w, v -> {_LABEL.format(w='v')}) AS l",
        f"transform(w, v -> {_PREDICTED.format(w='v')}) AS p",
    )


@check(
    "bio_aggregate",
    f"""
    SELECT conv_id, turn, idx, CASE
        WHEN len(g) = 0 THEN 'O' WHEN len(g) = 1 THEN g[1]
        WHEN len(list_distinct(g)) = 1 AND g[1] NOT LIKE 'B%' THEN g[1]
        WHEN g[1] LIKE 'B%' AND g[2] LIKE 'I%' AND substr(g[1], 2) = substr(g[2], 2)
             AND len(list_distinct(list_slice(g, 2, len(g)))) = 1 THEN g[1] ELSE 'E' END AS label
    FROM (SELECT conv_id, turn, idx, list_slice(l, idx + 1, idx + length(w[idx + 1]) % 4) AS g
          FROM (SELECT *, unnest(range(0, len(w))) AS idx FROM {_WORDS}))""",
)
def bio_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labelled(spark, folder).select(*_KEYS, "w", "l", F.posexplode("w").alias("idx", "v"))
    group = F.slice("l", F.col("idx") + 1, F.length("v") % 4)
    return rows.select(
        *_KEYS, F.col("idx").cast("long").alias("idx"), bio.aggregate_labels(group).alias("label")
    )


# the label before a run of I decides about the whole run
_REPAIRED = f"""
    SELECT conv_id, turn, idx, p, CASE WHEN l LIKE 'I%' AND coalesce(last_value(CASE WHEN l NOT LIKE 'I%' THEN l END
             IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY idx), 'O') NOT LIKE 'B%'
           THEN 'O' ELSE l END AS l FROM {_ROWS}"""


@check(
    "bio_repair",
    f"""SELECT conv_id, turn, coalesce(labels, '') AS labels FROM conversations LEFT JOIN (
          SELECT conv_id, turn, string_agg(l, ' ' ORDER BY idx) AS labels
          FROM ({_REPAIRED}) GROUP BY conv_id, turn) USING (conv_id, turn)""",
)
def bio_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn; one without words has no labels."""
    fixed = F.coalesce(F.array_join(bio.repair(F.col("l")), " "), F.lit(""))
    return _labelled(spark, folder).select(*_KEYS, fixed.alias("labels"))


@check(
    "bio_to_spans",
    f"""
    SELECT conv_id, turn, CAST(min(idx) AS BIGINT) AS start,
           CAST(max(CASE WHEN l <> 'O' THEN idx END) + 1 AS BIGINT) AS stop,
           arg_min(split_part(l, '-', 2), idx) AS label
    FROM (SELECT *, sum(CASE WHEN l LIKE 'B%' THEN 1 ELSE 0 END)
                      OVER (PARTITION BY conv_id, turn ORDER BY idx) AS g FROM {_ROWS})
    WHERE g > 0 GROUP BY conv_id, turn, g""",
)
def bio_to_spans(spark: SparkSession, folder: str) -> DataFrame:
    spans = alignment.span_rows(_labelled(spark, folder), "l", _KEYS)
    return spans.select(
        *_KEYS, F.col("start").cast("long"), F.col("end").cast("long").alias("stop"), "label"
    )


# words with offsets, and pieces of four characters that ignore word borders
_OFFSETS = f"""(SELECT conv_id, turn, idx, word, s, s + length(word) AS e FROM (
    SELECT conv_id, turn, idx, regexp_replace(raw, '^{sql.K.SPACE}+', '') AS word,
           sum(length(raw)) OVER (PARTITION BY conv_id, turn ORDER BY idx)
             - length(regexp_replace(raw, '^{sql.K.SPACE}+', '')) AS s
    FROM (SELECT conv_id, turn, r[idx + 1] AS raw, idx FROM (
            SELECT *, unnest(range(0, len(r))) AS idx FROM (
              SELECT conv_id, turn, regexp_extract_all(text, '{sql.K.SPACE}*{sql.K.NOT_SPACE}+') AS r
              FROM conversations)))))"""
_PIECES = """(SELECT conv_id, turn, pidx, 4 * pidx AS ps, least(4 * pidx + 4, n) AS pe FROM (
    SELECT conv_id, turn, length(text) AS n, unnest(range(0, CAST(ceil(length(text) / 4) AS BIGINT))) AS pidx
    FROM conversations))"""
_PAIRS = f"""(SELECT o.conv_id, o.turn, idx, pidx, word, ps,
      {_LABEL.format(w='word')} AS l,
      CASE pidx % 4 WHEN 0 THEN 'B-A' WHEN 3 THEN 'O' ELSE 'I-A' END AS pl
    FROM {_OFFSETS} o JOIN {_PIECES} p
      ON o.conv_id = p.conv_id AND o.turn = p.turn AND o.s < p.pe AND p.ps < o.e)"""


def _words(spark: SparkSession, folder: str) -> DataFrame:
    words = alignment.token_rows(spread(table(spark, folder, "conversations")), "text", _KEYS)
    return words.withColumn("label", F.expr(_LABEL.format(w="token")))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "conversations").filter(F.length("text") > 0)
    n = F.length("text")
    starts = F.sequence(F.lit(0), n - 1, F.lit(4))
    rows = texts.select(*_KEYS, n.alias("n"), F.posexplode(starts).alias("index", "start"))
    label = F.expr("CASE index % 4 WHEN 0 THEN 'B-A' WHEN 3 THEN 'O' ELSE 'I-A' END")
    end = F.least(F.col("start") + 4, F.col("n"))
    return rows.select(*_KEYS, "index", "start", end.alias("end"), label.alias("label"))


@check(
    "bio_project_down",
    f"""
    SELECT p.conv_id, p.turn, p.pidx AS piece, coalesce(x.l, 'O') AS label FROM {_PIECES} p
    LEFT JOIN (
      SELECT conv_id, turn, pidx, arg_max(CASE WHEN nth > 1 THEN replace(l, 'B-', 'I-') ELSE l END, idx) AS l
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, idx ORDER BY ps) AS nth FROM {_PAIRS})
      GROUP BY conv_id, turn, pidx) x
      ON p.conv_id = x.conv_id AND p.turn = x.turn AND p.pidx = x.pidx""",
)
def project_down(spark: SparkSession, folder: str) -> DataFrame:
    done = alignment.project_down(_words(spark, folder), _pieces(spark, folder), _KEYS)
    return done.select(*_KEYS, F.col("index").cast("long").alias("piece"), "label")


@check(
    "bio_project_up",
    f"""
    SELECT o.conv_id, o.turn, o.idx AS word, CASE
        WHEN g IS NULL THEN 'O' WHEN len(g) = 1 THEN g[1]
        WHEN len(list_distinct(g)) = 1 AND g[1] NOT LIKE 'B%' THEN g[1]
        WHEN g[1] LIKE 'B%' AND g[2] LIKE 'I%' AND len(list_distinct(list_slice(g, 2, len(g)))) = 1
        THEN g[1] ELSE 'E' END AS label
    FROM {_OFFSETS} o LEFT JOIN (
      SELECT conv_id, turn, first_word, list(pl ORDER BY pidx) AS g FROM (
        SELECT conv_id, turn, pidx, any_value(pl) AS pl, min(idx) AS first_word FROM {_PAIRS}
        GROUP BY conv_id, turn, pidx) GROUP BY conv_id, turn, first_word) x
      ON o.conv_id = x.conv_id AND o.turn = x.turn AND o.idx = x.first_word""",
)
def project_up(spark: SparkSession, folder: str) -> DataFrame:
    done = alignment.project_up(_words(spark, folder), _pieces(spark, folder), _KEYS)
    return done.select(*_KEYS, F.col("index").cast("long").alias("word"), "label")


# annotation spans over the words of a turn: words 1-2 and the 4th; headings by word number
_ANNOTATED = f"""(SELECT conv_id, turn, w, list_transform(w, lambda v, i: CASE
      WHEN i - 1 IN (1, 4) THEN 'B-TUMOR_SIZE' WHEN i - 1 = 2 THEN 'I-TUMOR_SIZE' ELSE 'O' END) AS l
    FROM (SELECT conv_id, turn, list_transform(w, lambda v, i: CASE i WHEN 1 THEN 'Datos'
            WHEN 3 THEN 'Diagnóstico' WHEN 8 THEN 'Macro' ELSE v END) AS w FROM {_WORDS}))"""


def _annotations(spark: SparkSession, folder: str) -> DataFrame:
    words = F.transform(
        "w",
        lambda v, i: F.struct(
            F.when(i == 0, "Datos").when(i == 2, "Diagnóstico").when(i == 7, "Macro").otherwise(v).alias("text")
        ),
    )
    spans = F.expr(
        "array(named_struct('token_start', 1, 'token_end', 2), named_struct('token_start', 4, 'token_end', 4))"
    )
    rows = _labelled(spark, folder)
    return rows.select(*_KEYS, F.array_join("w", " ").alias("text"), words.alias("tokens"), spans.alias("spans"))


def _joined(df: DataFrame) -> DataFrame:
    return df.select(
        *_KEYS, "x_text", F.array_join("y_tokens", " ").alias("y_tokens"),
        F.array_join("y_labels", " ").alias("y_labels"),
    )


@check(
    "lab_spans_to_bio",
    f"""SELECT a.conv_id, a.turn, array_to_string(b.w, ' ') AS x_text, array_to_string(a.w, ' ') AS y_tokens,
               array_to_string(a.l, ' ') AS y_labels
        FROM {_ANNOTATED} a JOIN {_WORDS} b ON a.conv_id = b.conv_id AND a.turn = b.turn""",
)
def spans_to_bio(spark: SparkSession, folder: str) -> DataFrame:
    return _joined(labels.annotations_to_labels(_annotations(spark, folder)))


@check(
    "lab_spans_to_bio_section",
    f"""SELECT conv_id, turn, array_to_string(list_slice(w, a + 1, b - 1), ' ') AS x_text,
               array_to_string(list_slice(w, a + 1, b - 1), ' ') AS y_tokens,
               array_to_string(list_slice(l, a + 1, b - 1), ' ') AS y_labels
        FROM (SELECT *, list_position(w, 'Diagnóstico') AS a, list_position(w, 'Macro') AS b FROM {_ANNOTATED})
        WHERE a > 0 AND b > 0""",
)
def spans_to_bio_section(spark: SparkSession, folder: str) -> DataFrame:
    return _joined(labels.annotations_to_labels(_annotations(spark, folder), "Diagnóstico"))


def _chunks(column: str) -> str:
    """SQL for entity rows: a new one at B, or at I after O or after another type."""
    return f"""(SELECT conv_id, turn, min(idx) AS s, max(idx) + 1 AS e, arg_min(kind, idx) AS label FROM (
      SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY idx) AS g FROM (
        SELECT conv_id, turn, idx, split_part({column}, '-', 2) AS kind, {column} AS x,
               {column} LIKE 'B%' OR ({column} LIKE 'I%' AND split_part({column}, '-', 2) IS DISTINCT FROM
                 lag(split_part({column}, '-', 2)) OVER (PARTITION BY conv_id, turn ORDER BY idx)) AS new
        FROM {_ROWS})) WHERE x <> 'O' GROUP BY conv_id, turn, g)"""


@check(
    "ev_entities",
    f"""
    SELECT round(hit / pred, 9) AS precision, round(hit / truth, 9) AS recall,
           round(2 * hit / (truth + pred), 9) AS f1, round(accuracy, 9) AS accuracy
    FROM (SELECT count(*) AS truth FROM {_chunks('l')}), (SELECT count(*) AS pred FROM {_chunks('p')}),
         (SELECT count(*) AS hit FROM (SELECT * FROM {_chunks('l')} INTERSECT SELECT * FROM {_chunks('p')})),
         (SELECT avg(CAST(l = p AS INTEGER)) AS accuracy FROM {_ROWS})""",
)
def entities(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labelled(spark, folder).withColumn("doc", F.struct(*_KEYS))
    return _round(evaluate.entity_scores(rows, "l", "p", "doc"))


# --- vectorisers ------------------------------------------------------------------------------


def _words_sql() -> str:
    return (
        "(SELECT doc_id, list_filter(string_split(o, ' '), lambda v: v <> '') AS w "
        f"FROM (SELECT doc_id, {sql.clean_model('text')} AS o FROM documents))"
    )


def _document_words(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents")).select(
        "doc_id", T.clean_tokens(T.clean_model(F.col("text"))).alias("w")
    )


def _counts_sql() -> str:
    return f"""WITH words AS MATERIALIZED {_words_sql()},
      tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY ALL),
      n AS MATERIALIZED (SELECT count(*) AS n FROM documents),
      df AS MATERIALIZED (SELECT term, count(*) AS df FROM tf, n GROUP BY term, n HAVING count(*) >= 5 AND count(*) <= 0.9 * n)"""


@check("ml_bow", lambda: f"{_counts_sql()} SELECT tf.doc_id, tf.term, tf.tf FROM tf JOIN df ON tf.term = df.term")
def bag_of_words(spark: SparkSession, folder: str) -> DataFrame:
    return learn.bag_of_words(_document_words(spark, folder), "doc_id", "w")


@check(
    "ml_tfidf",
    lambda: f"""{_counts_sql()},
      raw AS (SELECT tf.doc_id, tf.term, tf.tf * (ln((1 + n) / (1 + df.df)) + 1) AS w
              FROM tf JOIN df ON tf.term = df.term, n)
      SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""",
)
def tfidf(spark: SparkSession, folder: str) -> DataFrame:
    weights = learn.tfidf(_document_words(spark, folder), "doc_id", "w")
    return weights.withColumn("weight", F.round("weight", 6))


_CLASSES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO"]


@check(
    "ml_label_binarize",
    "SELECT p_partkey, " + ", ".join(
        f"CAST(list_contains([p_type, upper(split_part(p_name, ' ', 1))], '{c}') AS INTEGER) AS y_{c}" for c in _CLASSES
    ) + " FROM part",
)
def label_binarize(spark: SparkSession, folder: str) -> DataFrame:
    first = F.upper(F.split_part("p_name", F.lit(" "), F.lit(1)))
    y = learn.binarize(F.array("p_type", first), _CLASSES)
    rows = table(spark, folder, "part").select("p_partkey", y.alias("y"))
    return rows.select("p_partkey", *[F.col("y")[i].alias(f"y_{c}") for i, c in enumerate(_CLASSES)])


@check(
    "ml_class_weights",
    """SELECT source AS label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight
       FROM documents GROUP BY source""",
)
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    return _round(learn.class_weights(table(spark, folder, "documents"), "source"))


@check(
    "ml_predict_topn",
    """
    SELECT vec_id, rank, class, round(score, 9) AS score FROM (
      SELECT vec_id, class, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) AS rank
      FROM (SELECT vec_id, i - 1 AS class, CAST(embedding[i] AS DOUBLE) AS score
            FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)))
    WHERE rank <= 5""",
)
def predict_topn(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    best = rows.select("vec_id", F.posexplode(learn.top_n(F.col("embedding"), 5)).alias("i", "b"))
    return best.select(
        "vec_id",
        (F.col("i") + 1).cast("long").alias("rank"),
        F.col("b.class").cast("long").alias("class"),
        F.round(F.col("b.score").cast("double"), 9).alias("score"),
    )


# --- models (fitted weights have no SQL form) --------------------------------------------------


def _rated(spark: SparkSession, folder: str) -> DataFrame:
    rated = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return rated.select("doc_id", "text", "lang", "quality", "toxic")


@check("ml_train_class")
def train_class(spark: SparkSession, folder: str) -> DataFrame:
    done = training.train(_rated(spark, folder), "text", "quality", "doc_id", "binary")
    return done.report


@check("ml_train_multiclass")
def train_multiclass(spark: SparkSession, folder: str) -> DataFrame:
    done = training.train(
        _rated(spark, folder), "text", "lang", "doc_id", "multiclass", weighted=True
    )
    return done.report


def _flags(spark: SparkSession, folder: str) -> DataFrame:
    y = F.array_compact(
        F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"), "lang")
    )
    return _rated(spark, folder).withColumn("y", y)


@check("ml_train_multilabel")
def train_multilabel(spark: SparkSession, folder: str) -> DataFrame:
    done = training.train(_flags(spark, folder), "text", "y", "doc_id", "multilabel")
    return done.validation.select("doc_id", F.array_join("y", ",").alias("y"), "prediction")


@check("ml_train_multilabel_cv")
def train_multilabel_cv(spark: SparkSession, folder: str) -> DataFrame:
    """Balanced weights, penalties by cross-validation; the report by label and its averages."""
    done = training.train(
        _flags(spark, folder), "text", "y", "doc_id", "multilabel", weighted=True, folds=3,
        strengths=(0.1, 1.0, 10.0), max_iter=50,
    )
    return done.report


@check("ml_predict_scores")
def predict_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The two most likely labels of every document, from a fitted model."""
    model = multilabel.train(_flags(spark, folder), "doc_id", "text", "y", vectorizer="bag_of_words", max_iter=50)
    scored = multilabel.scores(model, table(spark, folder, "documents"), "text", "doc_id")
    return multilabel.best_labels(scored, "doc_id", 2)


@check("ml_train_cv")
def train_cv(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rated(spark, folder)
    done = training.train(rows, "text", "quality", "doc_id", "binary", weighted=True, folds=5)
    return done.report


@check("ml_train_entry")
def train_entry(spark: SparkSession, folder: str) -> DataFrame:
    done = training.train(
        _rated(spark, folder), "text", "toxic", "doc_id", "binary", "bag_of_words", 0.2
    )
    return done.validation.select("doc_id", "y", "prediction")


@check("ml_predict")
def predict(spark: SparkSession, folder: str) -> DataFrame:
    model = learn.train_classes(_rated(spark, folder), "text", "lang")
    found = learn.predict(model, table(spark, folder, "documents"), "text", "doc_id")
    return found.withColumn("is_english", learn.yes_no(F.col("prediction"), "en"))


@check("ml_save_load")
def save_load(spark: SparkSession, folder: str) -> DataFrame:
    model = learn.train_classes(_rated(spark, folder), "text", "quality")
    path = scratch_dir(spark, "model")
    model.save(path)
    return learn.predict(learn.TextModel.load(path), table(spark, folder, "documents"), "text", "doc_id")


# --- evaluation -------------------------------------------------------------------------------


def _round(df: DataFrame) -> DataFrame:
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, 9) for c in doubles})


_GRID = "(SELECT t.v AS t, p.v AS p FROM (VALUES (0), (1)) t(v), (VALUES (0), (1)) p(v))"
_CELLS = f"""(SELECT g.t AS "true", g.p AS pred, count(l.doc_id) AS value FROM {_GRID} g
    LEFT JOIN labels l ON l.quality = g.t AND l.toxic = g.p GROUP BY g.t, g.p)"""


@check("ev_confusion", f"SELECT * FROM {_CELLS}")
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion(table(spark, folder, "labels"), "quality", "toxic", labels=[0, 1])


@check(
    "ev_confusion_normalized",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS norm, "true", pred, round(coalesce(value / nullif(sum(value) OVER ({over}), 0), 0), 9)
            AS value FROM {_CELLS}"""
        for n, over in (("true", 'PARTITION BY "true"'), ("pred", "PARTITION BY pred"), ("all", ""))
    ),
)
def confusion_normalized(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels")
    parts = [
        evaluate.confusion(rows, "quality", "toxic", labels=[0, 1], normalize=n).select(
            F.lit(n).alias("norm"), "*"
        )
        for n in ("true", "pred", "all")
    ]
    return _round(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@check(
    "ev_confusion_weighted",
    """SELECT quality AS "true", toxic AS pred, sum(n_chars) AS value
       FROM labels JOIN documents USING (doc_id) GROUP BY ALL""",
)
def confusion_weighted(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").join(
        table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    return evaluate.confusion(rows, "quality", "toxic", "n_chars")


@check(
    "ev_confusion_per_label",
    f"""
    SELECT label, t AS "true", p AS pred, count(x) AS value
    FROM (SELECT name AS label, t, p FROM {_GRID}, (VALUES ('quality'), ('toxic')) v(name)) g
    LEFT JOIN (SELECT 'quality' AS l, quality AS a, CAST(doc_id % 3 = 0 AS INTEGER) AS b, doc_id AS x FROM labels
               UNION ALL SELECT 'toxic', toxic, CAST(doc_id % 2 = 0 AS INTEGER), doc_id FROM labels)
      ON l = label AND a = t AND b = p
    GROUP BY ALL""",
)
def confusion_per_label(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("doc_id")
    rows = table(spark, folder, "labels").select(
        F.array("quality", "toxic").alias("y"),
        F.array((key % 3 == 0).cast("int"), (key % 2 == 0).cast("int")).alias("p"),
    )
    return evaluate.confusion_per_label(rows, "y", "p", ["quality", "toxic"])


@check(
    "ev_confusion_exclusive",
    f"""
    SELECT g.t AS "true", g.p AS pred, count(x) AS value
    FROM (SELECT a.v AS t, b.v AS p FROM (VALUES ('good'), ('bad')) a(v), (VALUES ('good'), ('bad')) b(v)) g
    LEFT JOIN (SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS t,
                      CASE WHEN toxic = 0 OR doc_id % 3 = 0 THEN 'good' ELSE 'bad' END AS p, 1 AS x FROM labels) l
      ON g.t = l.t AND g.p = l.p GROUP BY ALL""",
)
def confusion_exclusive(spark: SparkSession, folder: str) -> DataFrame:
    y, toxic, key = F.col("quality"), F.col("toxic"), F.col("doc_id")
    # no predicted label at all goes to the first class
    rows = table(spark, folder, "labels").select(
        F.array(y, F.lit(0), 1 - y).alias("y"),
        F.array(F.when(key % 3 == 0, 1).otherwise(0), F.lit(1), F.when(key % 3 == 0, 1).otherwise(toxic)).alias("p"),
    )
    return evaluate.confusion_exclusive(rows, "y", "p", ["good", "other", "bad"], ["good", "bad"])


def _report_sql() -> str:
    classes = """(SELECT c.v AS label, sum(CAST(quality = v AND toxic = v AS INTEGER)) AS tp,
        sum(CAST(quality = v AS INTEGER)) AS s, sum(CAST(toxic = v AS INTEGER)) AS p
        FROM labels, (VALUES (0), (1)) c(v) GROUP BY c.v)"""
    scored = f"""(SELECT label, s, tp, coalesce(tp / nullif(p, 0), 0) AS pr, coalesce(tp / nullif(s, 0), 0) AS re,
        coalesce(2 * tp / nullif(s + p, 0), 0) AS f FROM {classes})"""
    return f"""
    SELECT label, round(pr, 9) AS precision, round(re, 9) AS recall, round(f, 9) AS f1, CAST(s AS BIGINT) AS support
    FROM (SELECT CAST(label AS VARCHAR) AS label, pr, re, f, s FROM {scored}
          UNION ALL SELECT 'accuracy', sum(tp) / sum(s), sum(tp) / sum(s), sum(tp) / sum(s), sum(s) FROM {scored}
          UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f), sum(s) FROM {scored}
          UNION ALL SELECT 'weighted avg', sum(pr * s) / sum(s), sum(re * s) / sum(s), sum(f * s) / sum(s), sum(s)
                    FROM {scored})"""


@check("ev_report", _report_sql())
def report(spark: SparkSession, folder: str) -> DataFrame:
    return _round(evaluate.report(table(spark, folder, "labels"), "quality", "toxic"))


@check(
    "ev_report_averaged",
    """SELECT round(tp / p, 9) AS precision, round(tp / s, 9) AS recall, round(2 * tp / (s + p), 9) AS f1,
              round(acc, 9) AS accuracy
       FROM (SELECT sum(quality * toxic) AS tp, sum(quality) AS s, sum(toxic) AS p,
                    avg(CAST(quality = toxic AS INTEGER)) AS acc FROM labels)""",
)
def report_averaged(spark: SparkSession, folder: str) -> DataFrame:
    return _round(evaluate.averaged_metrics(table(spark, folder, "labels"), "quality", "toxic", 2))


_GUESS = "CASE WHEN doc_id % 3 = 0 THEN 'src0' WHEN n_chars % 2 = 0 THEN source ELSE 'src' || CAST(n_chars % 7 AS STRING) END"


def _guessed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr("doc_id", "source", f"{_GUESS} AS guess")


_GUESSED = f"(SELECT doc_id, source, {_GUESS} AS guess FROM documents)"
_ACCURACY = f"""SELECT source AS label, count(*) AS support, round(avg(CAST(source = guess AS INTEGER)), 9) AS accuracy
    FROM {_GUESSED} GROUP BY source"""


@check("ev_class_accuracy", _ACCURACY)
def class_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return _round(evaluate.class_accuracy(_guessed(spark, folder), "source", "guess"))


@check("lim_topn", f"SELECT * FROM ({_ACCURACY}) ORDER BY accuracy DESC, support DESC, label LIMIT 5")
def top_classes(spark: SparkSession, folder: str) -> DataFrame:
    accuracies = evaluate.class_accuracy(_guessed(spark, folder), "source", "guess")
    return _round(evaluate.top_classes(_round(accuracies)))


_CONFUSED = f"""SELECT greatest(source, guess) AS label1, least(source, guess) AS label2, count(*) / 2 AS corr
    FROM {_GUESSED} WHERE source <> guess GROUP BY ALL"""


@check("ev_confused_pairs", _CONFUSED)
def confused_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confused_pairs(_guessed(spark, folder), "source", "guess")


@check("ev_confused_pairs_top", f"SELECT * FROM ({_CONFUSED}) ORDER BY corr DESC, label1, label2 LIMIT 5")
def confused_pairs_top(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.top_pairs(evaluate.confused_pairs(_guessed(spark, folder), "source", "guess"))


@check(
    "ev_set_errors",
    f"""SELECT doc_id AS x, source AS y, guess AS y_pred FROM {_GUESSED} WHERE source <> guess AND doc_id % 2 = 1
        UNION ALL SELECT doc_id, source, guess FROM {_GUESSED} WHERE source <> guess AND doc_id % 2 = 0""",
)
def set_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Two-label lists in different order are equal; rows whose sets differ remain."""
    rows = _guessed(spark, folder).select(
        "doc_id", F.array("source", F.lit("z")).alias("a"), F.array(F.lit("z"), "guess").alias("b")
    )
    wrong = evaluate.set_errors(rows, "doc_id", "a", "b")
    return wrong.select("x", F.col("y")[0].alias("y"), F.col("y_pred")[1].alias("y_pred"))


_SCORES = """(SELECT 'quality' AS label, n_chars AS score, quality AS truth FROM labels JOIN documents USING (doc_id)
    UNION ALL SELECT 'toxic', n_chars % 1000, toxic FROM labels JOIN documents USING (doc_id))"""


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").join(
        table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    pairs = F.array(
        F.struct(F.lit("quality").alias("label"), F.col("n_chars").alias("score"), F.col("quality").alias("truth")),
        F.struct(F.lit("toxic").alias("label"), (F.col("n_chars") % 1000).alias("score"), F.col("toxic").alias("truth")),
    )
    return rows.select(F.inline(pairs))


def _steps(scores: str) -> str:
    return f"""(SELECT label, score, tp, fp, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp,
        lead(tp) OVER w AS ntp, lead(fp) OVER w AS nfp, row_number() OVER w AS nth,
        sum(tp) OVER (PARTITION BY label) AS p, sum(fp) OVER (PARTITION BY label) AS n
      FROM (SELECT label, score, sum(truth) AS tp, sum(1 - truth) AS fp FROM {scores} GROUP BY ALL)
      WINDOW w AS (PARTITION BY label ORDER BY score DESC))"""


def _points(scores: str) -> str:
    return f"""(SELECT label, CAST(score AS DOUBLE) AS score, cfp / n AS fpr, ctp / p AS tpr FROM {_steps(scores)}
        WHERE nth = 1 OR ntp IS NULL OR ntp <> tp OR nfp <> fp
      UNION ALL SELECT DISTINCT label, NULL, 0.0, 0.0 FROM {scores})"""


@check("ev_roc", f"SELECT label, score, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM {_points(_SCORES)}")
def roc(spark: SparkSession, folder: str) -> DataFrame:
    return _round(evaluate.roc_points(_scores(spark, folder)))


_MICRO = f"(SELECT 'micro' AS label, score, truth FROM {_SCORES})"


def _auc(scores: str) -> str:
    """SQL: trapezoids between consecutive points."""
    return f"""SELECT label, round(sum((fpr - pf) * (tpr + pt) / 2), 9) AS auc FROM (
      SELECT label, cfp / n AS fpr, ctp / p AS tpr, (cfp - fp) / n AS pf, (ctp - tp) / p AS pt FROM {_steps(scores)})
      GROUP BY label"""


@check("ev_roc_auc", f"{_auc(_SCORES)} UNION ALL {_auc(_MICRO)}")
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    scores = _scores(spark, folder)
    return _round(evaluate.auc(scores).unionByName(evaluate.auc(evaluate.micro(scores))))


_MACRO_POINTS = f"""WITH pts AS MATERIALIZED (SELECT label, fpr, min(tpr) AS y_in, max(tpr) AS y_out
      FROM {_points(_SCORES)} GROUP BY ALL),
    grid AS (SELECT DISTINCT g.fpr, l.label FROM pts g, (SELECT DISTINCT label FROM pts) l),
    lft AS (SELECT g.label, g.fpr, p.fpr AS x0, p.y_out AS y0 FROM grid g ASOF JOIN pts p
            ON g.label = p.label AND g.fpr >= p.fpr),
    rgt AS (SELECT g.label, g.fpr, p.fpr AS x1, p.y_in AS y1 FROM grid g ASOF JOIN pts p
            ON g.label = p.label AND g.fpr <= p.fpr),
    macro AS (SELECT l.fpr, avg(CASE WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) / (x1 - x0) * (l.fpr - x0) END) AS tpr
              FROM lft l JOIN rgt r ON l.label = r.label AND l.fpr = r.fpr GROUP BY l.fpr)"""


@check("ev_roc_macro", f"{_MACRO_POINTS} SELECT round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM macro")
def roc_macro(spark: SparkSession, folder: str) -> DataFrame:
    return _round(evaluate.roc_macro(_scores(spark, folder), ["quality", "toxic"]))


@check(
    "ev_roc_macro_auc",
    f"""{_MACRO_POINTS} SELECT round(sum((fpr - pf) * (tpr + pt) / 2), 9) AS auc FROM (
        SELECT fpr, tpr, lag(fpr) OVER w AS pf, lag(tpr) OVER w AS pt FROM macro WINDOW w AS (ORDER BY fpr))""",
)
def roc_macro_auc(spark: SparkSession, folder: str) -> DataFrame:
    curve = evaluate.roc_macro(_scores(spark, folder), ["quality", "toxic"])
    return _round(evaluate.curve_area(curve))
