"""Moving token labels between two tokenisations of the same text.

Tokens are rows (doc, index, start, end) with character offsets, end exclusive. Two tokens belong
together when their character ranges overlap. The overlap join is an equi-join on (doc, block of
characters), so no document pairs all of its words with all of its pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions import bio

BLOCK = 64


def token_rows(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Whitespace tokens as rows: keys, index, token, start, end."""
    gaps = F.regexp_extract_all(F.col(text), F.lit(f"{K.SPACE}*{K.NOT_SPACE}+"), F.lit(0))
    rows = df.select(*keys, F.posexplode_outer(gaps).alias("index", "_raw")).filter(
        F.col("index").isNotNull()
    )
    before = Window.partitionBy(*keys).orderBy("index")
    token = F.regexp_replace("_raw", f"^{K.SPACE}+", "")
    rows = rows.withColumn("end", F.sum(F.length("_raw")).over(before).cast("int"))
    return rows.select(
        *keys, "index", token.alias("token"), (F.col("end") - F.length(token)).alias("start"), "end"
    )


def pieces_of(words: DataFrame, size: int, keys: Sequence[str]) -> DataFrame:
    """Cut every word into pieces of `size` characters: keys, index, token, start, end, word."""
    starts = F.sequence(F.lit(0), F.length("token") - 1, F.lit(size))
    cut = words.select(*keys, "index", "token", "start", F.explode(starts).alias("_at"))
    piece = F.substring(F.col("token"), F.col("_at") + 1, F.lit(size))
    begin = F.col("start") + F.col("_at")
    ordered = Window.partitionBy(*keys).orderBy("start")
    return (
        cut.select(
            *keys,
            F.col("index").alias("word"),
            piece.alias("token"),
            begin.alias("start"),
            (begin + F.length(piece)).alias("end"),
        )
        .withColumn("index", F.row_number().over(ordered) - 1)
    )


def _overlaps(words: DataFrame, pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, piece, word) for every overlapping pair, with both starts."""

    def blocks(df: DataFrame, name: str) -> DataFrame:
        covered = F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))
        return df.select(
            *keys,
            F.explode(covered).alias("_block"),
            F.col("index").alias(name),
            F.col("start").alias(f"{name}_start"),
            F.col("end").alias(f"{name}_end"),
        )

    w, p = blocks(words, "word"), blocks(pieces, "piece")
    joined = w.join(p, [*keys, "_block"]).filter(
        (F.col("word_start") < F.col("piece_end")) & (F.col("piece_start") < F.col("word_end"))
    )
    # a pair that shares several blocks counts in the block where its overlap starts
    first = F.floor(F.greatest("word_start", "piece_start") / BLOCK)
    return joined.filter(F.col("_block") == first).select(
        *keys, "word", "piece", "word_start", "piece_start"
    )


def project_down(
    words: DataFrame, pieces: DataFrame, keys: Sequence[str], label: str = "label"
) -> DataFrame:
    """Word labels on pieces: only the first piece of a word keeps B-, pieces without word get O.

    A piece that overlaps several words takes the label of the last one.
    """
    pairs = _overlaps(words, pieces, keys)
    in_word = Window.partitionBy(*keys, "word").orderBy("piece_start")
    labelled = pairs.withColumn("_nth", F.row_number().over(in_word)).join(
        words.select(*keys, F.col("index").alias("word"), label), [*keys, "word"]
    )
    lowered = F.when(
        (F.col("_nth") > 1) & F.contains(F.col(label), F.lit("B-")),
        F.replace(F.col(label), F.lit("B-"), F.lit("I-")),
    ).otherwise(F.col(label))
    last = labelled.groupBy(*keys, "piece").agg(F.max_by(lowered, "word").alias(label))
    joined = pieces.drop(label).join(
        last.withColumnRenamed("piece", "index"), [*keys, "index"], "left"
    )
    return joined.withColumn(label, F.coalesce(label, F.lit("O")))


def project_up(
    words: DataFrame, pieces: DataFrame, keys: Sequence[str], label: str = "label"
) -> DataFrame:
    """Piece labels on words; a piece counts for its first word, a word combines its pieces."""
    owner = _overlaps(words, pieces, keys).groupBy(*keys, "piece").agg(F.min("word").alias("word"))
    votes = owner.join(
        pieces.select(*keys, F.col("index").alias("piece"), label), [*keys, "piece"]
    )
    # the pieces of one word: bounded by the length of the word
    gathered = votes.groupBy(*keys, "word").agg(
        F.array_sort(F.collect_list(F.struct("piece", F.col(label).alias("v")))).alias("_votes")
    )
    joined = words.drop(label).join(
        gathered.withColumnRenamed("word", "index"), [*keys, "index"], "left"
    )
    values = F.coalesce(
        F.transform("_votes", lambda x: x["v"]), F.array().cast("array<string>")
    )
    return joined.withColumn(label, bio.aggregate_labels(values)).drop("_votes")


def sequences(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str], index: str = "index"
) -> DataFrame:
    """Token rows back to one row per document with parallel arrays."""
    packed = F.array_sort(F.collect_list(F.struct(index, *columns)))
    grouped = rows.groupBy(*keys).agg(packed.alias("_rows"))
    return grouped.select(
        *keys, *[F.transform("_rows", lambda r, c=c: r[c]).alias(c) for c in columns]
    )


def span_rows(df: DataFrame, labels: str, keys: Sequence[str]) -> DataFrame:
    """Spans of label sequences as rows: keys, start, end, label."""
    rows = df.select(*keys, F.inline_outer(bio.spans(F.col(labels))))
    return rows.filter(F.col("start").isNotNull())
