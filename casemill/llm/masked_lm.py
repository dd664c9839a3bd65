"""Masked pseudo-likelihood of documents under a bidirectional window network.

Each word is predicted from the two words before and the two after it, over all words of the corpus:
the network gives the probability of the word's class (a hash), drawn in two steps (first half of the
number, then the rest given the first), the corpus counts that of the word within its class. So
probabilities sum to one over the words. The corpus is dealt into training units by the hash of a
text's words; every unit trains the network from the same start in numpy, Spark sums the units'
weights, and their mean scores all texts. Neither units nor counts depend on the partitions.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.word_ids import texts_of
from casemill.session import written

#: Word classes are HALF * HALF; words before and after; width of the hidden layer.
HALF = 32
REACH = 2
WIDTH = 16
#: Words that are mixed before training, words of a step, and the step size.
BUFFER = 1 << 16
STEP_WORDS = 4096
RATE = 0.15
#: Partial sums of weights before the last sum, so that no task reads every unit's.
FAN_IN = 64
#: Words of a training unit, about.
UNIT_WORDS = 1 << 21
#: Distinct words counted before a task sends them, and the frequent words every worker holds; a join
#: finds all others.
MOST_WORDS = 200_000
MOST_HELD = 100_000

_PAD = HALF * HALF
_OFFSETS = [*range(-REACH, 0), *range(1, REACH + 1)]


class Network:
    """Window embeddings, a hidden layer and the two halves of the output."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        shapes = [(len(_OFFSETS) * (_PAD + 1), WIDTH), (WIDTH, 2 * HALF), (2 * HALF,), (HALF, HALF)]
        if weights is None:
            rng = np.random.default_rng(11)
            parts = [rng.normal(0, 0.1, s) if k < 2 else np.zeros(s) for k, s in enumerate(shapes)]
            weights = np.concatenate([p.ravel() for p in parts])
        self.weights = weights.astype(np.float32)
        at, views = 0, []
        for shape in shapes:
            size = math.prod(shape)
            views.append(self.weights[at : at + size].reshape(shape))
            at += size
        self.near, self.out, self.bias, self.second = views
        self.squares = np.full(len(self.weights), 1e-6, dtype=np.float32)

    def _forward(self, context: np.ndarray, first: np.ndarray):
        """Arrays with the words as their last axis, which numpy sums fastest."""
        hidden = self.near[context[:, 0]]
        for k in range(1, context.shape[1]):
            hidden = hidden + self.near[context[:, k]]
        hidden = np.ascontiguousarray(np.tanh(hidden).T)
        logits = self.out.T @ hidden + self.bias[:, None]
        logits[HALF:] += self.second.T[:, first]
        both = logits.reshape(2, HALF, -1)
        both -= both.max(axis=1, keepdims=True)
        p = np.exp(both)
        total = p.sum(axis=1, keepdims=True)
        return hidden, both, p, total

    def log_probabilities(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        first, rest = word // HALF, word % HALF
        _, both, _, total = self._forward(context, first)
        rows = np.arange(len(word))
        return both[0, first, rows] + both[1, rest, rows] - np.log(total).sum(axis=(0, 1))

    def train(self, context: np.ndarray, word: np.ndarray) -> None:
        """One step of adaptive gradients over the words given."""
        n = len(word)
        first, rest = word // HALF, word % HALF
        hidden, _, p, total = self._forward(context, first)
        p /= total
        rows = np.arange(n)
        p[0, first, rows] -= 1
        p[1, rest, rows] -= 1
        error = p.reshape(2 * HALF, n) / n
        back = ((self.out @ error) * (1 - hidden * hidden)).astype(np.float64)
        near = np.empty_like(self.near)
        for k in range(context.shape[1]):
            own = slice(k * (_PAD + 1), (k + 1) * (_PAD + 1))
            at = context[:, k] - own.start
            for d in range(WIDTH):
                near[own, d] = np.bincount(at, weights=back[d], minlength=_PAD + 1)
        picked = np.zeros((n, HALF), dtype=np.float32)
        picked[rows, first] = 1
        gradient = np.concatenate(
            [near.ravel(), (hidden @ error.T).ravel(), error.sum(axis=1), (error[HALF:] @ picked).T.ravel()]
        )
        self.squares += gradient * gradient
        self.weights -= RATE * gradient / np.sqrt(self.squares)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space of the whole text, A-Z in lower case."""
    return (text or "").encode("utf-8").lower().split()


def classes(text: str | None) -> np.ndarray:
    """Class of each word of the whole text."""
    return classes_of(words_of(text))


def classes_of(words: list[bytes]) -> np.ndarray:
    return (np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) * 2654435761 >> 12) % _PAD


def contexts(word: np.ndarray) -> np.ndarray:
    """Rows of the embedding table for the words around each word; past the ends a pad."""
    padded = np.r_[np.full(REACH, _PAD), word, np.full(REACH, _PAD)]
    n = len(word)
    return np.stack(
        [padded[REACH + o : REACH + o + n] + k * (_PAD + 1) for k, o in enumerate(_OFFSETS)], axis=1
    )


def _units(docs: DataFrame, text_column: str) -> DataFrame:
    """unit, words: the classes of each text's words, texts in an order of their own in each unit."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classes(text).astype("<u2").tobytes() for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["words"])

    texts = written(docs.select(F.col(text_column).cast("string")).mapInArrow(read, "words binary"), "classes")
    texts = texts.where(F.length("words") > 0)
    words = texts.agg(F.sum(F.length("words") / 2)).first()[0] or 0
    units = 1 + int(words) // UNIT_WORDS
    order = F.xxhash64("words")
    dealt = texts.select(F.pmod(order, F.lit(units)).cast("int").alias("unit"), order.alias("order"), "words")
    # rows of equal hash but other words: the words themselves decide, so the order is always the same
    return dealt.repartitionById(units, F.col("unit")).sortWithinPartitions("unit", "order", "words")


def fit(docs: DataFrame, text_column: str = "text") -> Network:
    """Network trained on every word of every text; null texts count as empty."""

    def trained(unit: int, texts: Iterator[np.ndarray]) -> pa.RecordBatch:
        network, rng, seen = Network(), np.random.default_rng(3), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def learn() -> None:
            context = np.concatenate([c for c, _ in held])
            word = np.concatenate([w for _, w in held])
            order = rng.permutation(len(word))
            for at in range(0, len(order), STEP_WORDS):
                step = order[at : at + STEP_WORDS]
                network.train(context[step], word[step])

        for word in texts:
            context = contexts(word)
            for at in range(0, len(word), BUFFER):
                held.append((context[at : at + BUFFER], word[at : at + BUFFER]))
                size += len(held[-1][1])
                if size >= BUFFER:
                    learn()
                    held.clear()
                    size = 0
            seen += len(word)
        if size:
            learn()
        pieces = np.array_split(network.weights.astype(float) * seen, WIDTH)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([unit] * WIDTH, pa.int32()),
                pa.array(range(WIDTH), pa.int32()),
                pa.array([float(seen)] * WIDTH),
                pa.array([p.astype(np.float32).tolist() for p in pieces], pa.list_(pa.float32())),
            ],
            ["part", "piece", "words", "weights"],
        )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1)))
        for unit, texts in itertools.groupby(rows, lambda row: row[0]):
            yield trained(unit, (np.frombuffer(w.as_buffer(), dtype="<u2").astype(np.int64) for _, w in texts))

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        total = np.zeros(len(pdf["weights"].iloc[0]))
        for weights in pdf["weights"]:
            total += weights
        return pd.DataFrame(
            {
                "part": [pdf["part"].iloc[0] // FAN_IN],
                "piece": [pdf["piece"].iloc[0]],
                "words": [pdf["words"].sum()],
                "weights": [total.astype(np.float32)],
            }
        )

    schema = "part int, piece int, words double, weights array<float>"
    sums = _units(docs, text_column).select("unit", "words").mapInArrow(train, schema)
    sums = sums.groupBy(F.floor(F.col("part") / FAN_IN), "piece").applyInPandas(summed, schema)
    rows = sums.groupBy("piece").applyInPandas(summed, schema).collect()
    if not rows:
        return Network()
    rows = sorted(rows, key=lambda r: r["piece"])
    return Network(np.concatenate([np.array(r["weights"]) / r["words"] for r in rows]))


def vocabulary(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """word, n, share: every distinct word, how often it occurs, log of its share of its class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            words, counts = list(seen), list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(classes_of(words), pa.int32()), pa.array(counts, pa.int64())],
                ["word", "class", "n"],
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                if len(seen) > MOST_WORDS:
                    yield sent()
        if seen:
            yield sent()

    counts = docs.select(F.col(text_column).cast("string")).mapInArrow(count, "word binary, class int, n long")
    words = written(counts.groupBy("word", "class").agg(F.sum("n").alias("n")), "words")
    totals = F.broadcast(words.groupBy("class").agg(F.sum("n").alias("total")))  # _PAD rows at most
    return words.join(totals, "class").select("word", "n", F.log(F.col("n") / F.col("total")).alias("share"))


def _held(words: DataFrame) -> dict[bytes, float]:
    """share of the frequent words: all of a count or none, MOST_HELD at most."""
    count = F.least("n", F.lit(1000))
    least, held = 1001, 0
    for r in words.groupBy(count.alias("c")).agg(F.count("*").alias("rows")).orderBy(F.desc("c")).collect():
        if held + r.rows > MOST_HELD:
            break
        least, held = r.c, held + r.rows
    return {bytes(r.word): r.share for r in words.where(count >= least).select("word", "share").collect()}


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over all words), mean_log_likelihood of each document.

    Null, empty and blank texts have no words, a sum of 0 and a null mean. Ids may be null or
    repeated; other columns are not read. No rows: no rows. A text of any length is read whole.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    weights = fit(docs).weights
    words = written(vocabulary(docs), "vocabulary")
    held = docs.sparkSession.sparkContext.broadcast(_held(words))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, share = Network(weights), held.value
        for batch in batches:
            ids, counts, sums, rest = [], [], [], []
            for doc, text in texts_of(batch):
                found = words_of(text)
                word = classes_of(found)
                total = 0.0
                if len(word):
                    context = contexts(word)
                    for at in range(0, len(word), STEP_WORDS):
                        part = slice(at, at + STEP_WORDS)
                        got = network.log_probabilities(context[part], word[part])
                        total += float(got.sum(dtype=np.float64))
                shares = np.fromiter(map(share.get, found, itertools.repeat(np.nan)), float, count=len(found))
                rare = np.isnan(shares)
                ids.append(doc)
                counts.append(len(word))
                sums.append(total + float(shares[~rare].sum()))
                rest.append([found[k] for k in np.flatnonzero(rare)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(sums, pa.float64()), pa.array(rest, pa.list_(pa.binary())),
                ],
                ["doc_id", "n_words", "known", "rest"],
            )

    out = docs.mapInArrow(scored, "doc_id long, n_words long, known double, rest array<binary>")
    # stored with their numbers: ids may be null or repeated
    out = written(out.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = out.select("row", F.explode("rest").alias("word")).join(words, "word")
    sums = rare.groupBy("row").agg(F.sum("share").alias("rare"))
    total = F.col("known") + F.coalesce("rare", F.lit(0.0))
    out = out.drop("rest").join(sums, "row", "left").select("doc_id", "n_words", total.alias("log_likelihood"))
    return out.withColumn(
        "mean_log_likelihood", F.try_divide(F.col("log_likelihood"), F.col("n_words").cast("double"))
    )
