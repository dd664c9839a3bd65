"""Toxicity scores: two Kneser-Ney models of the letters of words, one of toxic texts, one of ordinary.

The models read each word byte by byte, from a run of blanks to the blank that ends it. The highest
order (`ORDER` bytes) is counted for each class; all lower orders are one interpolated Kneser-Ney model
of the continuation counts of both classes, to which rare expressions fall back with a weight that the
classes share too. Where neither class has seen a byte after its context, that part cancels, so the ratio
of the two models is a table of byte sequences and a table of contexts. A text's score is calibrated from two length-normalised numbers:
the mean log-likelihood ratio of its words, and the mean by which words pass a ratio of e ** STRONG.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.session import written

#: Bytes of the longest sequences (at most 7: they are packed in a 64-bit number).
ORDER = 7
#: Absolute discount, and what is taken off each class count besides, in its standard deviations.
DISCOUNT = 0.75
DOUBT = 1.0
#: Log-likelihood ratio of a word beyond which it counts as strong.
STRONG = 3.0
#: Rows whose id's crc32 has remainder 0 of this are held out; remainder 4 fits the calibration.
FOLDS = 5
THRESHOLD = 0.5
#: Words a worker keeps in each of two generations of its table, and words counted before a task sends.
MOST_WORDS = 200_000
#: Penalty of the slopes of the calibration, a unit of weight.
PENALTY = 1e-5

#: Letters and bytes beyond ASCII stay, all else parts words.
_LETTERS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of letters; null has none."""
    return (text or "").lower().encode("utf-8").translate(_LETTERS).split()


def grams(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Packed byte sequences of `words`, one for each byte and the blank after it, and each one's word."""
    pad = b" " * (order - 1)
    data = np.frombuffer(b"".join([b"%b%b " % (pad, w) for w in words]), dtype=np.uint8).astype(np.int64)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    word = np.repeat(np.arange(len(words)), length)
    last = np.arange(len(word)) + (word + 1) * (order - 1)
    packed = np.zeros(len(word), dtype=np.int64)
    for back in range(order - 1, -1, -1):
        packed = (packed << 8) | data[last - back]
    return packed, word


def _grouped(keys: np.ndarray, *values: np.ndarray) -> tuple:
    """Distinct keys and the sums of `values` for each."""
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, *(np.bincount(which, weights=v, minlength=len(distinct)) for v in values)


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `keys` in a sorted table that is not empty, and whether they are there."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def shared_shares(seen: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Interpolated Kneser-Ney probability of the last byte of each of the distinct sequences `seen`,
    from continuation counts of all orders below theirs."""
    levels, current = [], seen
    for length in range(order - 1, 0, -1):
        current, count = np.unique(current & ((1 << (8 * length)) - 1), return_counts=True)
        levels.append((length, current, count))
    share = np.full(len(seen), 1 / 256)
    for length, table, count in reversed(levels):
        context, total, kinds = _grouped(table >> 8, count, np.ones(len(table)))
        own = count[np.searchsorted(table, seen & ((1 << (8 * length)) - 1))]
        of = np.searchsorted(context, (seen & ((1 << (8 * length)) - 1)) >> 8)
        share = np.maximum(own - DISCOUNT, 0) / total[of] + DISCOUNT * kinds[of] / total[of] * share
    return share


class Model:
    """Log-likelihood ratio (toxic less ordinary) of bytes after their contexts, and the calibration."""

    def __init__(self, seen: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray, order: int = ORDER) -> None:
        self.order = order
        self.seen, self.contexts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ratio, self.unseen = np.zeros(0), np.zeros(0)
        self.mean, self.spread = np.zeros(2), np.ones(2)
        self.slopes = np.zeros(3)
        if not len(seen) or not ordinary.any() or not toxic.any():
            return  # one class alone tells nothing: all ratios are 1
        order_of = np.argsort(seen)
        self.seen = seen[order_of]
        shared = shared_shares(self.seen, order)
        self.contexts, of = np.unique(self.seen >> 8, return_inverse=True)
        n = len(self.contexts)
        counts = [c[order_of].astype(float) for c in (ordinary, toxic)]
        off = [np.minimum(c, DISCOUNT + DOUBT * np.sqrt(c)) for c in counts]
        summed = [[np.bincount(of, weights=w, minlength=n) for w in pair] for pair in (counts, off)]
        # both classes give the shared part the same weight, so that their sizes do not tell them apart
        shared_weight = sum(summed[1]) / sum(summed[0])
        logs, left = [], []
        for count, less, total, taken in zip(counts, off, *summed):
            rest = total - taken
            back = np.where(rest > 1e-9, shared_weight, 1.0)
            own = (count - less) / np.where(rest > 1e-9, rest, 1.0)[of]
            logs.append(np.log((1 - back[of]) * own + back[of] * shared))
            left.append(np.log(back))
        self.ratio, self.unseen = logs[1] - logs[0], left[1] - left[0]

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood ratio of each word."""
        if not words or not len(self.seen):
            return np.zeros(len(words))
        packed, word = grams(words, self.order)
        packed, which = np.unique(packed, return_inverse=True)
        at, found = _at(self.seen, packed)
        context, known = _at(self.contexts, packed >> 8)
        value = np.where(found, self.ratio[at], np.where(known, self.unseen[context], 0.0))
        return np.bincount(word, weights=value[which], minlength=len(words))

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = np.hstack([(features - self.mean) / self.spread, np.ones((len(features), 1))])
        return 1 / (1 + np.exp(-np.clip(z @ self.slopes, -500, 500)))

    def calibrate(self, held: DataFrame) -> None:
        """Logistic regression of `y` on `mean` and `strong` with a small penalty, by Newton steps from
        zero; no rows: 0.5. Every step sums over all rows in Spark, the driver gets ten numbers."""
        names = ("mean", "strong")
        first = held.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in names)).first()
        if not first["n"]:
            return
        self.mean = np.array([first[c] for c in names])
        squares = held.agg(*(F.avg((F.col(c) - float(m)) ** 2).alias(c) for c, m in zip(names, self.mean))).first()
        spread = np.sqrt([squares[c] for c in names])
        self.spread = np.where(spread > 1e-12, spread, 1.0)
        z = [(F.col(c) - float(m)) / float(d) for c, m, d in zip(names, self.mean, self.spread)]
        rows = held.select("y", z[0].alias("z0"), z[1].alias("z1"), F.lit(1.0).alias("z2"))
        pairs = [(i, j) for i in range(3) for j in range(i, 3)]
        penalty = np.array([PENALTY, PENALTY, 1e-6]) * first["n"]
        for _ in range(50):
            at = sum(F.col(f"z{i}") * float(v) for i, v in enumerate(self.slopes))
            scored = rows.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), at)))))
            bend = F.col("p") * (1 - F.col("p"))
            sums = scored.agg(
                *(F.sum(F.col(f"z{i}") * F.col(f"z{j}") * bend) for i, j in pairs),
                *(F.sum(F.col(f"z{i}") * (F.col("y") - F.col("p"))) for i in range(3)),
            ).first()
            bends = np.zeros((3, 3))
            for (i, j), v in zip(pairs, sums):
                bends[i, j] = bends[j, i] = v
            step = np.linalg.solve(bends + np.diag(penalty + 1e-9), np.array(sums[6:]) - penalty * self.slopes)
            self.slopes = self.slopes + np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break


class _Ratios:
    """Ratios of words in a worker: a table of two generations of bounded size."""

    def __init__(self, model: Model) -> None:
        self.model, self.new, self.old = model, {}, {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Mean ratio and mean strong excess of each text's words; zeros without words."""
        split = [words_of(text) for text in texts]
        missing = list({w for words in split for w in words if w not in self.new})
        if len(self.new) + len(missing) > MOST_WORDS:
            self.old, self.new = self.new, {}
            missing = list({w for words in split for w in words})
        known = {w: self.old[w] for w in missing if w in self.old}
        rest = [w for w in missing if w not in known]
        self.new.update(known)
        self.new.update(zip(rest, self.model.of_words(rest).tolist()))
        out = np.zeros((len(split), 2))
        for k, words in enumerate(split):
            if words:
                ratio = np.fromiter(map(self.new.__getitem__, words), dtype=float, count=len(words))
                out[k] = ratio.mean(), np.maximum(ratio - STRONG, 0).mean()
        return out


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def labelled(labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, y, fitting of every labelled id that is not held out.

    Remainder 4 is for the calibration, the rest fits the models. Null ids and labels do not count, a
    repeated row counts once.
    """
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id IS NOT NULL AND y IN (0, 1)").distinct()
        .withColumn("fold", remainder(F.col("doc_id"))).where("fold <> 0")
        .withColumn("fitting", F.col("fold") != 4).drop("fold")
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Model from all labelled rows of `docs` (doc_id, text); see `labelled` for their parts."""
    # labels grow with the texts: a join that is the same at every size
    marked = labelled(labels, label).hint("merge")
    known = written(docs.join(marked, "doc_id").select("y", "fitting", "text"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def sent() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            packed, word = grams(words)
            counts = [np.array([c[w] for w in words], dtype=np.int64) for c in seen]
            packed, *sums = _grouped(packed, *(c[word] for c in counts))
            arrays = [pa.array(packed), *(pa.array(s.astype(np.int64)) for s in sums)]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, ["gram", "ordinary", "toxic"])

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y].update(words_of(text))
                if len(seen[0]) + len(seen[1]) > MOST_WORDS:
                    yield sent()
        if seen[0] or seen[1]:
            yield sent()

    counted = (
        known.where("fitting").select("y", "text")
        .mapInArrow(count, "gram long, ordinary long, toxic long")
        .groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    )
    counted = written(counted, "grams")
    # as columns: a Python object for every number would be most of the driver's memory
    table = counted.toArrow()
    model = Model(*(table[c].to_numpy() for c in ("gram", "ordinary", "toxic")))

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = _Ratios(shared.value)
        for batch in batches:
            for part in _parts(batch):
                found = ratios.features(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], ["y", "mean", "strong"]
                )

    held = known.where("NOT fitting").select("y", "text").mapInArrow(described, "y int, mean double, strong double")
    model.calibrate(written(held, "ratios"))
    return model


def _parts(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def score(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label: str = "toxic",
) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted, mean_ratio, strong_ratio for every row of `docs`.

    Only the whole text is an input of a score. Null and empty texts, and those without letters, have the
    ratios 0 and the score that belongs to them; so have all texts if only one class is labelled, and
    without labels for the calibration every score is 0.5. A null id is not held out; repeated rows and
    equal texts get equal scores. A text of any length is read whole. Other columns are not read; no rows
    give no rows.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")
    )
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, label))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = _Ratios(model.value)
        for batch in batches:
            for part in _parts(batch):
                found = ratios.features(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(model.value.scores(found)),
                        pa.array(found[:, 0]), pa.array(found[:, 1]),
                    ],
                    ["doc_id", "score", "mean_ratio", "strong_ratio"],
                )

    out = rows.mapInArrow(scored, "doc_id long, score double, mean_ratio double, strong_ratio double")
    return out.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "mean_ratio",
        "strong_ratio",
    )
