"""Quality scores from document statistics: random Fourier features, ridge, isotonic calibration.

Statistics of each whole text are stored once. Random Fourier features approximate a Gaussian kernel
over them; every partition sums its normal equations and Spark sums the partitions', so the fit
covers all labelled rows and only matrices of a fixed size reach the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.session import written

#: Random features of the kernel, its width in units of sqrt(statistics), and the penalty a row.
FEATURES = 256
WIDTH = 1.0
PENALTY = 1e-5
#: Bins of the raw score over [-1, 2] for the calibration.
BINS = 3000
#: Rows whose id's crc32 has remainder 0 of this are held out; remainder 4 fits the calibration.
FOLDS = 5
THRESHOLD = 0.3
#: Standardised statistics are clipped to this.
CLIP = 4.0

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digits": bytes(range(48, 58)),
    "stops": b".,;:'\"()-",
    "shouts": b"!?",
    "bars": b"|",
    "symbols": b"#$%&*@^~=+<>\\/_[]{}`",
    "blanks": b" \t\r\n\x0b\x0c",
    "wide": bytes(range(128, 256)),
}
_CLASS_OF = np.zeros(256, dtype=np.intp)
for _k, _members in enumerate(_CLASSES.values(), start=1):
    _CLASS_OF[list(_members)] = _k

NAMES = [
    *_CLASSES, "entropy", "words", "word_length", "word_spread", "distinct", "repeated", "top_word",
    "capitals", "shouted", "marked", "lines", "distinct_lines", "line_words", "stop_ends", "short_words",
]


def statistics(text: str | None) -> list[float]:
    """Numbers about the text alone, named by `NAMES`; all 0 for null and empty texts."""
    data = (text or "").encode("utf-8")
    if not data:
        return [0.0] * len(NAMES)
    histogram = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    shares = np.bincount(_CLASS_OF, weights=histogram, minlength=len(_CLASSES) + 1)[1:] / len(data)
    used = histogram[histogram > 0] / len(data)
    entropy = -float((used * np.log(used)).sum())
    words = data.split()
    n = len(words)
    if not n:
        return [*shares.tolist(), entropy, *[0.0] * (len(NAMES) - len(_CLASSES) - 1)]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    ends = np.frombuffer(b"".join([w[-1:] for w in words]), dtype=np.uint8)
    starts = np.frombuffer(b"".join([w[:1] for w in words]), dtype=np.uint8)
    seconds = np.frombuffer(b"".join([w[1:2] or b"a" for w in words]), dtype=np.uint8)
    first, second, last = _CLASS_OF[starts], _CLASS_OF[seconds], _CLASS_OF[ends]
    return [
        *shares.tolist(),
        entropy,
        math.log1p(n),
        math.log(float(lengths.mean())),
        float(lengths.std() / lengths.mean()),
        len(counts) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        max(counts.values()) / n,
        float((first == 1).mean()),
        float(((first == 1) & (second == 1)).mean()),
        float(((last == 5) | (last == 6) | (last == 7)).mean()),
        math.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        float((last == 4).mean()),
        float((lengths <= 2).mean()),
    ]


def described(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, xxhash64 of the text and the statistics of each whole text as columns s0, s1, ..."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(text) for text in batch.column(2).to_pylist()]
            columns = np.array(rows, dtype=float).reshape(-1, len(NAMES)).T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c) for c in columns)], ["doc_id", "text_hash", *_COLUMNS]
            )

    schema = "doc_id long, text_hash long, " + ", ".join(f"{c} double" for c in _COLUMNS)
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(text_column).alias("text_hash"),
        F.col(text_column).cast("string").alias("text"),
    ).mapInArrow(describe, schema)


_COLUMNS = [f"s{k}" for k in range(len(NAMES))]


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


class Scorer:
    """Standardised statistics -> random features -> ridge -> calibrated score."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray) -> None:
        rng = np.random.default_rng(20_240)
        self.mean, self.spread = mean, np.where(spread > 1e-12, spread, 1.0)
        self.waves = rng.normal(0, 1 / (WIDTH * math.sqrt(len(mean))), (len(mean), FEATURES))
        self.phase = rng.uniform(0, 2 * math.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.at, self.share = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -CLIP, CLIP)
        waves = np.cos(z @ self.waves + self.phase) * math.sqrt(2 / FEATURES)
        return np.hstack([waves, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.clip((self.raw(x) + 1) / 3 * BINS, 0, BINS - 1).astype(np.int64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp((self.raw(x) + 1) / 3 * BINS - 0.5, self.at, self.share)


def isotonic(at: np.ndarray, positive: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted places: (place, share) of each place, never falling."""
    blocks: list[list[float]] = []  # positive, rows, places
    for p, n in zip(positive, rows):
        blocks.append([p, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    # half a row of each label keeps the ends inside 0 and 1
    shares = np.concatenate([np.full(int(k), (p + 0.5) / (n + 1)) for p, n, k in blocks])
    return at, np.maximum.accumulate(shares)


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(first + k).to_numpy(zero_copy_only=False) for k in range(len(NAMES))], 1)


def fit(stored: DataFrame, labels: DataFrame, label: str = "quality") -> Scorer:
    """Scorer from stored statistics and labels (doc_id, label 0/1), without the held-out rows.

    Null labels and ids do not count; a repeated label row counts as often. Without labelled rows
    every score is 0.5.
    """
    rows = stored.join(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")),
        "doc_id",
    ).where(F.col("y").isNotNull() & (remainder(F.col("doc_id")) != 0))
    rows = written(rows.withColumn("fold", remainder(F.col("doc_id"))), "labelled")
    moments = rows.agg(
        F.count("*"), *(F.avg(c) for c in _COLUMNS), *(F.stddev_pop(c) for c in _COLUMNS)
    ).first()
    if not moments[0]:
        return Scorer(np.zeros(len(NAMES)), np.ones(len(NAMES)))
    k = len(NAMES)
    scorer = Scorer(np.array(moments[1 : k + 1]), np.array(moments[k + 1 :]))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((FEATURES + 1, FEATURES + 3)), False
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = scorer.features(_matrix(part, 1))
                y = part.column(0).to_numpy()
                total += z.T @ np.hstack([z, y[:, None], np.ones((len(y), 1))])
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(FEATURES + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                ["i", "sums"],
            )

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "sums": [np.sum(np.stack(pdf["sums"]), axis=0)]})

    inputs = rows.where("fold <> 4").select("y", *_COLUMNS)
    sums = (
        inputs.mapInArrow(equations, "i int, sums array<double>")
        .groupBy("i")
        .applyInPandas(summed, "i int, sums array<double>")
        .collect()
    )
    if sums:
        total = np.stack([r["sums"] for r in sorted(sums, key=lambda r: r["i"])])
        gram, right, n = total[:, : FEATURES + 1], total[:, FEATURES + 1], total[-1, -1]
        penalty = np.diag([PENALTY * n] * FEATURES + [1e-9])
        scorer.weights = np.linalg.solve(gram + penalty, right)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scorer.bins(_matrix(batch, 1)), pa.int64())], ["y", "bin"]
            )

    held = rows.where("fold = 4").select("y", *_COLUMNS).mapInArrow(placed, "y double, bin long")
    table = held.groupBy("bin").agg(F.sum("y").alias("p"), F.count("*").alias("n")).orderBy("bin").collect()
    if table:
        at, positive, count = (np.array([r[c] for r in table], dtype=float) for c in ("bin", "p", "n"))
        scorer.at, scorer.share = isotonic(at, positive, count)
    return scorer


def score(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label: str = "quality",
) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted, text_hash for every row of `docs`.

    Only the text is an input of a score; null counts as empty, and an empty text gets the score of
    its (all zero) statistics. A null id is not held out. Other columns are not read.
    """
    stored = written(described(docs, id_column, text_column), "statistics")
    scorer = fit(stored, labels, label)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = scorer.scores(_matrix(batch, 2)) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(got, pa.float64())], ["doc_id", "text_hash", "score"]
            )

    out = stored.mapInArrow(scored, "doc_id long, text_hash long, score double")
    return out.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "text_hash",
    )
