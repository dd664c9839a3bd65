"""Token ids of a corpus in grammar-compressed shards (Re-Pair), with random-access decoding.

A shard is a run of documents in ascending id order. Its id sequence is compressed by Re-Pair:
frequent neighbouring pairs are replaced by new symbols again and again, never across the end of a
document. A shard is one row of a Parquet table with the rules, the expansion length of each rule
and the remaining symbols, so Spark's own committer makes the files whole and a lost task harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.llm.word_ids import crc, texts_of, word_ids
from casemill.session import scratch_dir

#: Ids after which a shard is closed (a document is never divided).
SHARD_IDS = 1 << 20
#: Uses from which on a rule pays: it takes 12 bytes (two symbols, one length), each use saves 2 or more.
LEAST_PAIRS = 7
#: Symbols that fit into two bytes each.
NARROW = 1 << 16
#: In each round pairs are replaced that are at least this share as frequent as the top pair.
ROUND_SHARE = 0.05

SHARD_SCHEMA = (
    "part int, shard int, n_tokens long, doc_ids array<long>, token_counts array<int>, "
    "symbol_counts array<int>, first_rule long, rules binary, rounds array<int>, "
    "expansions binary, symbols binary"
)


def _pair_counts(keys: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and how often each can be replaced at least; `keys` are left * symbols + right."""
    ordered = np.sort(keys)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    pairs, counts = ordered[first], np.diff(np.r_[first, len(ordered)])
    twice = pairs // symbols == pairs % symbols
    counts[twice] = (counts[twice] + 1) // 2  # a pair of equal symbols may overlap itself
    return pairs, counts


def _ranks(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which of two overlapping pairs wins: the more frequent one, then by a hash, alike in all copies."""
    mixed = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    ranks = np.empty(len(pairs), dtype=np.int64)
    ranks[np.lexsort((mixed, counts))] = np.arange(len(pairs))
    return ranks


def _free_places(
    keys: np.ndarray, inside: np.ndarray, pairs: np.ndarray, ranks: np.ndarray, symbols: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sorted `pairs` that do not overlap, and which pair each place holds.

    Of a pair that overlaps itself every second place from the left is free; of two pairs that
    overlap, the one of higher rank. So the pair of the highest rank keeps all it was counted for.
    """
    starts = np.zeros(symbols, dtype=bool)
    starts[pairs // symbols] = True
    near = np.flatnonzero(starts[keys // symbols])
    of = np.minimum(np.searchsorted(pairs, keys[near]), len(pairs) - 1)
    own = pairs[of] == keys[near]
    at, of = inside[near[own]], of[own]
    place = np.arange(len(at))
    again = np.r_[False, (np.diff(at) == 1) & (of[1:] == of[:-1])]
    free = (place - np.maximum.accumulate(np.where(again, 0, place))) % 2 == 0
    at, of = at[free], of[free]
    rank, overlap = ranks[of], np.diff(at) == 1
    loses = np.zeros(len(at), dtype=bool)
    loses[1:] |= overlap & (rank[:-1] > rank[1:])
    loses[:-1] |= overlap & (rank[1:] > rank[:-1])
    return at[~loses], of[~loses]


def compress(ids: np.ndarray, lengths: np.ndarray, least: int = LEAST_PAIRS) -> dict:
    """Grammar of `ids`, which hold documents of `lengths` one after the other.

    Pairs are counted exactly in every round, and rounds go on until no pair is found `least` times
    or symbols would need more than two bytes.
    Returns `first_rule` (symbols from there on are rules), `rules` (left, right), `rounds` (rules
    made by each round, which is also their nesting order), `expansions` (ids under each rule),
    `symbols` and `symbol_counts` (symbols of each document). No ids: no rules, no symbols.
    """
    seq = ids.astype(np.int64)
    last = np.zeros(len(seq), dtype=bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    first_rule = int(seq.max()) + 1 if len(seq) else 0
    rules: list[np.ndarray] = []
    rounds: list[int] = []
    weight = np.ones(first_rule, dtype=np.int64)
    # a rule that makes all symbols wider does not pay
    most = NARROW if first_rule <= NARROW else 1 << 32
    while True:
        symbols = len(weight)
        inside = np.flatnonzero(~last[:-1])  # no pair goes over the end of a document
        if not len(inside) or symbols == most:
            break
        keys = seq[inside] * symbols + seq[inside + 1]
        pairs, counts = _pair_counts(keys, symbols)
        top = int(counts.max())
        if top < least:
            break
        chosen = np.flatnonzero(counts >= max(least, int(top * ROUND_SHARE)))
        ranks = _ranks(pairs[chosen], counts[chosen])
        enough = ranks >= len(ranks) - (most - symbols)
        chosen, ranks = pairs[chosen[enough]], ranks[enough]
        at, of = _free_places(keys, inside, chosen, ranks, symbols)
        worth = np.bincount(of, minlength=len(chosen)) >= least
        at, of = at[worth[of]], of[worth[of]]
        made = np.stack([chosen[worth] // symbols, chosen[worth] % symbols], axis=1)
        name = symbols + np.cumsum(worth) - 1
        rules.append(made)
        rounds.append(len(made))
        weight = np.r_[weight, weight[made[:, 0]] + weight[made[:, 1]]]
        seq[at] = name[of]
        last[at] = last[at + 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
    ends = np.flatnonzero(last) + 1
    counts = np.zeros(len(lengths), dtype=np.int32)
    counts[lengths > 0] = np.diff(np.r_[0, ends])
    return {
        "first_rule": first_rule,
        "rules": np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.int64),
        "rounds": rounds,
        "expansions": weight[first_rule:],
        "symbols": seq.astype(np.uint32),
        "symbol_counts": counts,
    }


def expand(symbols: np.ndarray, first_rule: int, rules: np.ndarray, rounds: list[int]) -> np.ndarray:
    """Ids under `symbols`, the latest rules first: each round's rules name only earlier symbols."""
    seq = symbols.astype(np.int64)
    stop = first_rule + len(rules)
    for made in reversed(rounds):
        start = stop - made
        nested = seq >= start
        if nested.any():
            place = np.cumsum(nested + 1) - (nested + 1)
            out = np.empty(len(seq) + int(nested.sum()), dtype=np.int64)
            pairs = rules[seq[nested] - first_rule]
            out[place[~nested]] = seq[~nested]
            out[place[nested]] = pairs[:, 0]
            out[place[nested] + 1] = pairs[:, 1]
            seq = out
        stop = start
    return seq


class Shard:
    """One stored row: whole decoding, one document, or any range of ids."""

    def __init__(self, row: dict) -> None:
        self.doc_ids = row["doc_ids"]
        self.token_counts = np.asarray(row["token_counts"], dtype=np.int64)
        self.first_rule = row["first_rule"]
        self.rules = np.frombuffer(row["rules"], dtype="<u4").astype(np.int64).reshape(-1, 2)
        self.rounds = row["rounds"]
        self.expansions = np.frombuffer(row["expansions"], dtype="<u4").astype(np.int64)
        wide = "<u2" if self.first_rule + len(self.rules) <= NARROW else "<u4"
        self.symbols = np.frombuffer(row["symbols"], dtype=wide)
        self.bounds = np.r_[0, np.cumsum(np.asarray(row["symbol_counts"], dtype=np.int64))]

    def ids(self) -> np.ndarray:
        """All ids, gathered at once from a table of what each used rule expands to."""
        used = np.unique(self.symbols[self.symbols >= self.first_rule]).astype(np.int64)
        table = expand(used, self.first_rule, self.rules, self.rounds)
        sizes = self.expansions[used - self.first_rule]
        size_of = np.ones(self.first_rule + len(self.rules), dtype=np.int64)
        start_of = np.arange(len(size_of))
        size_of[used] = sizes
        start_of[used] = self.first_rule + np.cumsum(sizes) - sizes
        table = np.r_[np.arange(self.first_rule), table]
        size = size_of[self.symbols]
        before = np.cumsum(size) - size
        return table[np.repeat(start_of[self.symbols] - before, size) + np.arange(int(size.sum()))]

    def document(self, i: int) -> np.ndarray:
        part = self.symbols[self.bounds[i] : self.bounds[i + 1]]
        return expand(part, self.first_rule, self.rules, self.rounds)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids from `start` to `stop` of the shard; only the symbols over them are expanded."""
        seq = self.symbols.astype(np.int64)
        size = np.ones(len(seq), dtype=np.int64)
        nested = seq >= self.first_rule
        size[nested] = self.expansions[seq[nested] - self.first_rule]
        ends = np.cumsum(size)
        first = int(np.searchsorted(ends, start, side="right"))
        after = int(np.searchsorted(ends, stop, side="left")) + 1
        base = int(ends[first - 1]) if first else 0
        got = expand(seq[first:after], self.first_rule, self.rules, self.rounds)
        return got[start - base : stop - base]


def _row(part: int, shard: int, docs: list, chunks: list[bytes]) -> dict:
    lengths = np.array([len(c) // 4 for c in chunks], dtype=np.int64)
    ids = np.frombuffer(b"".join(chunks), dtype="<u4")
    g = compress(ids, lengths)
    wide = "<u2" if g["first_rule"] + len(g["rules"]) <= NARROW else "<u4"
    return {
        "part": part,
        "shard": shard,
        "n_tokens": len(ids),
        "doc_ids": docs,
        "token_counts": lengths.tolist(),
        "symbol_counts": g["symbol_counts"].tolist(),
        "first_rule": g["first_rule"],
        "rules": g["rules"].astype("<u4").tobytes(),
        "rounds": g["rounds"],
        "expansions": g["expansions"].astype("<u4").tobytes(),
        "symbols": g["symbols"].astype(wide).tobytes(),
    }


_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("shard", pa.int32()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("token_counts", pa.list_(pa.int32())),
        ("symbol_counts", pa.list_(pa.int32())),
        ("first_rule", pa.int64()),
        ("rules", pa.binary()),
        ("rounds", pa.list_(pa.int32())),
        ("expansions", pa.binary()),
        ("symbols", pa.binary()),
    ]
)


def write(
    docs: DataFrame, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text",
    tokenizer: str | None = None, shard_ids: int = SHARD_IDS,
) -> None:
    """Write every document's ids and `end_id` as compressed shards in ascending id order.

    Null text counts as empty (the end id alone); null ids come first; rows that share an id are
    ordered by their text's hash; other columns are not read. No rows: an empty table.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_ids(tokenizer), TaskContext.get().partitionId()
        shard, size, ids, chunks = 0, 0, [], []
        for batch in batches:
            for doc, text in texts_of(batch):
                ids.append(doc)
                chunks.append(words.encode(text) + end)
                size += len(chunks[-1]) // 4
                if size >= shard_ids:
                    yield pa.RecordBatch.from_pylist([_row(part, shard, ids, chunks)], _ARROW)
                    shard, size, ids, chunks = shard + 1, 0, [], []
        if ids:
            yield pa.RecordBatch.from_pylist([_row(part, shard, ids, chunks)], _ARROW)

    rows = docs.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    ordered.select("id", "text").mapInArrow(encode, SHARD_SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the shards alone: doc_id, start, n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                data = memoryview(shard.ids().astype("<u4").tobytes())
                ends = np.cumsum(shard.token_counts)
                starts = ends - shard.token_counts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(ends), pa.int32()),
                        pa.array([row["shard"]] * len(ends), pa.int32()),
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(shard.token_counts, pa.int64()),
                        pa.array([crc(data[4 * a : 4 * b]) for a, b in zip(starts, ends)], pa.int64()),
                    ],
                    ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sizes = shards.select("part", "shard", "n_tokens")
    # one row for each part, as many as the writing job had tasks
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    part_start = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    starts = sizes.join(part_start, "part").select(
        "part", "shard", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("base")
    )
    decoded = shards.mapInArrow(
        decode, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    return decoded.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, end_id: int = 2, **options) -> DataFrame:
    """Write the shards below the shared folder and read them back."""
    path = scratch_dir(docs.sparkSession, "token-shards")
    write(docs, path, end_id, **options)
    return read(docs.sparkSession, path)
