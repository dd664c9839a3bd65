"""Packing token pieces into as few fixed-size sequences as it can, by linear grouping.

Only the histogram of piece lengths (at most `size` rows) reaches the driver, whatever the corpus.
There the large lengths are rounded up within groups of equal cardinality, the few rounded sizes
are packed by configurations from a linear program with column generation, real lengths take the
rounded places, and all that is left is placed best-fit. The plan says for each run of equal pieces
which sequences they go to; Spark numbers the pieces of each length and looks their places up.
"""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.word_ids import crc, texts_of, word_ids
from casemill.session import written

SEQUENCE_TOKENS = 2048
#: Groups of equal cardinality into which the large lengths are cut.
GROUPS = 200
#: Lengths above this share of a sequence are large.
LARGE_SHARE = 1 / 3
#: Rounds of column generation at most; the configurations found so far are then used.
LP_ROUNDS = 1500

Class = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many), ...) and sequences like it


def pieces(
    docs: DataFrame, size: int = SEQUENCE_TOKENS, id_column: str = "doc_id", text_column: str = "text",
    tokenizer: str | None = None, separator: int = 0,
) -> DataFrame:
    """Pieces of each document's ids and the separator: only longer documents are cut.

    doc_id, piece, start, length, ids_crc32 and the place to number it by: task and rank among the
    task's pieces of that length. Null text counts as empty; ids may be null or repeated.
    """
    end = int(separator).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_ids(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in texts_of(batch):
                ids = memoryview(words.encode(text) + end)
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    piece = ids[at : at + 4 * size]
                    length = len(piece) // 4
                    rows.append((doc, k, at // 4, length, crc(piece), part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES
            )

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column)).mapInArrow(
        cut,
        "doc_id long, piece int, start long, length long, ids_crc32 long, part int, part_rank long",
    )


_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("part", pa.int32()),
        ("part_rank", pa.int64()),
    ]
)


def _configurations(sizes: list[int], need: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Fractional cutting stock: few-size configurations and how often to use them."""
    k = len(sizes)
    size, demand = np.array(sizes), np.array(need, dtype=float)
    basis = np.diag([float(capacity // s) for s in sizes])
    used = demand / np.diag(basis)
    most = capacity // min(sizes)
    for _ in range(LP_ROUNDS):
        price = np.linalg.solve(basis.T, np.ones(k))
        # the dearest configuration: best[j][w] with j pieces in w tokens
        best, last = [np.zeros(capacity + 1)], []
        for _ in range(most):
            now, pick = best[-1].copy(), np.full(capacity + 1, -1)
            for g in range(k):
                if price[g] > 0:
                    gain = best[-1][: capacity + 1 - size[g]] + price[g]
                    better = gain > now[size[g] :] + 1e-12
                    now[size[g] :][better] = gain[better]
                    pick[size[g] :][better] = g
            best.append(now)
            last.append(pick)
        if best[-1][capacity] <= 1 + 1e-7:
            break
        column, w = np.zeros(k), capacity
        for pick in reversed(last):
            if pick[w] >= 0:
                column[pick[w]] += 1
                w -= size[pick[w]]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(np.argmin(ratio))
        used = np.maximum(used - ratio[leaves] * step, 0)
        used[leaves] = ratio[leaves]
        basis[:, leaves] = column
    return [(basis[:, j].astype(int), float(used[j])) for j in range(k)]


def _grouped(counts: dict[int, int], capacity: int) -> tuple[list[Class], dict[int, int]]:
    """Sequences of large pieces by linear grouping, and the pieces that are still to be placed."""
    left = dict(counts)
    classes: list[Class] = []
    if left.get(capacity):
        classes.append((((capacity, 1),), left.pop(capacity)))
    large = sorted((n for n in left if n > capacity * LARGE_SHARE), reverse=True)
    total = sum(left[n] for n in large)
    if not total:
        return classes, left
    share = -(-total // GROUPS)
    groups: list[deque] = []  # runs [length, how many], longest first
    room = 0
    for n in large:
        count = left.pop(n)
        while count:
            if not room:
                groups.append(deque())
                room = share
            take = min(room, count)
            groups[-1].append([n, take])
            room, count = room - take, count - take
    by_size: dict[int, deque] = {}
    for group in groups:  # groups of one rounded size are one
        by_size.setdefault(group[0][0], deque()).extend(group)
    sizes = sorted(by_size, reverse=True)
    have = {s: sum(c for _, c in by_size[s]) for s in sizes}
    for column, times in sorted(
        _configurations(sizes, [have[s] for s in sizes], capacity), key=lambda c: -c[1]
    ):
        slots = [s for s, n in zip(sizes, column) for _ in range(n)]
        whole = min([int(times + 1e-6), *(have[s] // n for s, n in zip(sizes, column) if n)])
        if not slots or whole <= 0:
            continue
        for s in slots:
            have[s] -= whole
        # real lengths take the rounded places, in runs in which every place keeps its length
        queues = [_taken(by_size[s], whole) for s in slots]
        done = 0
        while done < whole:
            run = min(q[0][1] for q in queues)
            lengths: dict[int, int] = {}
            for q in queues:
                lengths[q[0][0]] = lengths.get(q[0][0], 0) + 1
                q[0][1] -= run
                if not q[0][1]:
                    q.popleft()
            classes.append((tuple(sorted(lengths.items(), reverse=True)), run))
            done += run
    for queue in by_size.values():
        for n, count in queue:
            left[n] = left.get(n, 0) + count
    return classes, left


def _taken(queue: deque, count: int) -> deque:
    out = deque()
    while count:
        take = min(count, queue[0][1])
        out.append([queue[0][0], take])
        queue[0][1] -= take
        if not queue[0][1]:
            queue.popleft()
        count -= take
    return out


def _best_fit(classes: list[Class], left: dict[int, int], capacity: int) -> list[Class]:
    """Place what is left, longest first, each piece into the fullest sequence that takes it."""
    open_at: dict[int, list[Class]] = {}
    done: list[Class] = []

    def put(inside: tuple, sequences: int, room: int) -> None:
        if not sequences:
            return
        if not room:
            done.append((inside, sequences))
            return
        if not open_at.get(room):
            bisect.insort(rooms, room)
        open_at.setdefault(room, []).append((inside, sequences))

    rooms: list[int] = []
    for inside, sequences in classes:
        put(inside, sequences, capacity - sum(n * c for n, c in inside))
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                full, rest = divmod(count, each)
                put(((length, each),), full, capacity - each * length)
                if rest:
                    put(((length, rest),), 1, capacity - rest * length)
                break
            room = rooms[k]
            inside, sequences = open_at[room].pop()
            if not open_at[room]:
                rooms.pop(k)
            each = room // length
            full = min(sequences, count // each)
            count -= full * each
            put((*inside, (length, each)), full, room - each * length)
            sequences -= full
            if sequences and count:
                rest = min(count, each)  # fewer than `each` are left: they share one sequence
                count -= rest
                put((*inside, (length, rest)), 1, room - rest * length)
                sequences -= 1
            put(inside, sequences, room)
    return done + [c for at in open_at.values() for c in at]


def plan(counts: dict[int, int], capacity: int = SEQUENCE_TOKENS) -> list[Class]:
    """Sequences as (lengths inside, how many such sequences) for a histogram of lengths."""
    classes, left = _grouped({n: c for n, c in counts.items() if c}, capacity)
    return _best_fit(classes, left, capacity)


def places(classes: list[Class]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, pieces in each sequence), sorted."""
    rows, rank, sequence = [], {}, 0
    for inside, sequences in classes:
        offset = 0
        for length, each in inside:
            first = rank.get(length, 0)
            rows.append((length, first, sequence, offset, each))
            rank[length] = first + sequences * each
            offset += length * each
        sequence += sequences
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, size: int = SEQUENCE_TOKENS, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    Pieces of one length are alike to the plan, so any numbering of them is right; here by task and
    order within the task, over a stored table. No documents: no rows.
    """
    cut = written(pieces(docs, size, **options), "pieces")
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(counts, size))  # bounded by the number of lengths, not by the documents
    key = (table[:, 0] << 48) | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            row = table[np.searchsorted(key, (length << 48) | rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:5],
                    pa.array(row[:, 2] + nth // row[:, 4], pa.int64()),
                    pa.array(row[:, 3] + nth % row[:, 4] * length, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("part_rank")).alias("rank")
    )
    return ranked.mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
