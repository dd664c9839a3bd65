"""Exact n-gram Jaccard self-join by set relations.

Sets that are equal become one. Every set is entered into index lists whose elements are not single
n-grams (a frequent one would list a third of all rows) but whole parts of the hash range, so that
two linked sets must share an element:

* sets of `PART_LEAST` n-grams and more: the hash range is cut into more parts than two linked sets
  can have different n-grams, so that some part is the same in both; parts with fewer than two
  n-grams are left out where their number allows it;
* smaller sets: the triples of n-grams in a prefix that two linked sets must share three of.

Lists are sorted by position (n-grams before the element). Where the next position is further away
than linked sets can differ, a new block begins, and pairs of different blocks are skipped unseen.
Sets that share large blocks are a family. Each is compared with the family's hub alone, the set that
shares the most places; the answers of all others are derived from the hub's: what two sets differ
in follows from what each differs in from the hub, and only sets whose small differences share a
rare n-gram are looked at. Pairs of small blocks are compared themselves unless they are in one
group already or their distances from the hub or their sketches exclude a link: a pair that a
sketch rules out moves no set.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.components import components
from casemill.session import Stored

NGRAM_WORDS = 4
#: Two sets are linked when 100 * intersection >= this * union.
PERCENT = 85
#: Sets from this size on are indexed by parts, smaller ones by triples.
PART_LEAST = 48
#: Largest size of a level over its smallest; all sets of a level are cut into as many parts.
LEVEL_RATIO = 1.25
#: Pairs of blocks of up to so many sets are compared by themselves, not by way of a hub.
SMALL_BLOCK = 8
#: Index elements after which a task hands them on.
BATCH_ELEMENTS = 50_000
#: Copies of a hub in its join with its family.
SALTS = 8
#: Pairs of a set that the first round compares within a family.
ROUND_PAIRS = 8

_P1, _P2, _P3 = (
    np.array([x], dtype=np.uint64)
    for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _P2
    x = (x ^ (x >> np.uint64(27))) * _P3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = NGRAM_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word n-grams of the text with A-Z in lower case.

    Words lie between ASCII white space. With fewer words than an n-gram has, the whole sequence
    is the one n-gram; null, empty and blank texts have none.
    """
    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    span = min(words, len(found))
    n = len(found) - span + 1
    out = np.full(n, span, dtype=np.uint64)
    for k in range(span):
        out = out * _P1 + h[k : k + n]
    return np.unique(_mixed(out))


def most_different(a: int, b: int, percent: int = PERCENT) -> int:
    """Elements that linked sets of these sizes can have outside their intersection at most."""
    return (a + b) * (100 - percent) // (100 + percent)


@functools.cache
def levels(percent: int, top: int) -> tuple[list[int], list[int], list[int]]:
    """Smallest size, parts, and weak parts allowed of each level up to a size of `top`."""
    starts, parts, weak = [PART_LEAST], [], []
    while True:
        low = starts[-1]
        after = max(low + 1, int(low * LEVEL_RATIO))
        high = after - 1
        least = most_different(high, high * 100 // percent, percent) + 1
        m = least
        for _ in range(50):
            lam = low / m
            mean = m * math.exp(-lam) * (1 + lam)
            grown = least + math.ceil(mean + 2 * math.sqrt(mean))
            if grown <= m or grown > 2 * least:
                break
            m = grown
        parts.append(m)
        weak.append(m - least)
        if after > top:
            return starts, parts, weak
        starts.append(after)


def _by_parts(s: np.ndarray, level: int, m: int, weak: int) -> tuple[np.ndarray, np.ndarray]:
    part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    size = np.diff(np.r_[first, len(s)])
    number = part[first]
    content = np.add.reduceat(_mixed(s + _P1), first)
    strong = size >= 2
    if m - int(strong.sum()) <= weak:
        first, number, content = first[strong], number[strong], content[strong]
    elif m - len(first) > weak:  # even empty parts may be all that linked sets share
        empty = np.setdiff1d(np.arange(m, dtype=np.uint64), number)
        number, content = np.r_[number, empty], np.r_[content, np.zeros(len(empty), np.uint64)]
        first = np.r_[first, np.searchsorted(part, empty)]
    salt = np.uint64(level + 1)
    return _mixed(content + _P1 * number + _P3 * salt), first


def _by_triples(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    prefix = len(s) - -(-len(s) * percent // 100) + 3
    at = np.array(list(itertools.combinations(range(min(prefix, len(s))), 3)), dtype=np.int64)
    a, b, c = s[at[:, 0]], s[at[:, 1]], s[at[:, 2]]
    return _mixed((a * _P1 + b) * _P1 + c), at[:, 0]


def elements(s: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Index elements of a set and its n-grams before each: linked sets share one at least.

    Sets that can be linked with no other than an equal one have none.
    """
    n = len(s)
    found = []
    if n * 100 >= percent * (n + 1) or (n > 1 and (n - 1) * 100 >= percent * n):
        if n * percent <= 100 * (PART_LEAST - 1):
            found.append(_by_triples(s, percent))
    if n >= PART_LEAST:
        starts, parts, weak = levels(percent, 1 << max(10, n.bit_length()))
        k = int(np.searchsorted(starts, n, side="right")) - 1
        found.append(_by_parts(s, k, parts[k], weak[k]))
        if k and -(-n * percent // 100) < starts[k]:
            found.append(_by_parts(s, k - 1, parts[k - 1], weak[k - 1]))
    if not found:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate([e for e, _ in found]), np.concatenate([p for _, p in found])


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of n-grams in each of two to four times as many slots as the set has n-grams."""
    slots = max(8, 1 << (2 * len(s)).bit_length())
    odd = np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_different(x: bytes, y: bytes) -> int:
    """Elements outside the intersection at least, by the sketches of two sets.

    An element of both sets changes a slot in both, an element of one set alone changes one slot in
    one: so no more slots differ than elements. The finer sketch is folded to the other's size.
    """
    if len(x) < len(y):
        x, y = y, x
    fine, slots = int.from_bytes(x, "little"), 8 * len(x)
    while slots > 8 * len(y):
        slots //= 2
        fine = (fine >> slots) ^ (fine & ((1 << slots) - 1))
    return (fine ^ int.from_bytes(y, "little")).bit_count()


_SETS = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("n", pa.int64()),
        ("key1", pa.int64()),
        ("key2", pa.int64()),
    ]
)
_SETS_SQL = "row long, doc_id long, text_hash long, n long, key1 long, key2 long"


def _documents(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(text_column).alias("text_hash"),
        F.col(text_column).cast("string").alias("text"),
    )


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """One row for each document: a number, set size and key."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc, text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingles(text, words)
                key1, key2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8").tolist()
                rows.append((row, doc, text_hash, len(s), key1, key2))
                row += 1
            if rows:
                yield _batch(rows)

    return _documents(docs, "doc_id", "text").mapInArrow(describe, _SETS_SQL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), _SETS)], schema=_SETS
    )


def _most_different(a: Column, b: Column, percent: int) -> Column:
    return F.floor((a + b) * (100 - percent) / F.lit(100 + percent)).cast("long")


def _can_link(percent: int) -> Column:
    """By sizes and positions of one shared element: what differs before it and after it."""
    before = F.abs(F.col("a_place") - F.col("b_place"))
    after = F.abs(
        (F.col("a_n") - F.col("a_place")).cast("long") - (F.col("b_n") - F.col("b_place")).cast("long")
    )
    return before + after <= _most_different(F.col("a_n"), F.col("b_n"), percent)


def _not_apart(pairs: DataFrame, hashes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, a_n, b, b_n) whose sketches do not rule out a link: no set moves for the others."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, a_n, _, b_n, x, y = (c.to_pylist() for c in batch.columns)
            kept = [least_different(*p) <= most_different(m, n, percent) for m, n, *p in zip(a_n, b_n, x, y)]
            yield batch.select(["a", "a_n", "b", "b_n"]).filter(pa.array(kept, pa.bool_()))

    both = pairs.join(
        hashes.select(F.col("row").alias("a"), F.col("sketch").alias("x")), "a"
    ).join(hashes.select(F.col("row").alias("b"), F.col("sketch").alias("y")), "b")
    return both.select("a", "a_n", "b", "b_n", "x", "y").mapInArrow(near, "a long, a_n long, b long, b_n long")


def _compared(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """a, b, different (elements outside the intersection) by the sets themselves."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            different = [
                len(np.setxor1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(different, pa.int64())], ["a", "b", "different"]
            )

    sets = pairs.join(
        hashes.select(F.col("row").alias("a"), F.col("hashes").alias("x")), "a"
    ).join(hashes.select(F.col("row").alias("b"), F.col("hashes").alias("y")), "b")
    return sets.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, different long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """row, text of the wanted rows (row, doc_id, text_hash).

    Ids may be null; the hash spreads the copies of a text over the tasks. Repeated rows of a table
    are one again where they meet, without another shuffle.
    """
    id_ = F.coalesce(F.col("doc_id"), F.lit(0))
    return (
        _documents(docs, "doc_id", "text").withColumn("id", id_)
        .join(wanted.select("row", "text_hash", id_.alias("id")), ["id", "text_hash"])
        .dropDuplicates(["id", "text_hash", "row"])
        .select("row", "text")
    )


def _hashes(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """row, hashes (the set), sketch of the wanted rows, from their texts."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            values = [[s.tobytes() for s in sets], [sketch(s) for s in sets]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, pa.binary()) for v in values]], ["row", "hashes", "sketch"]
            )

    return _texts(docs, wanted).mapInArrow(hashed, "row long, hashes binary, sketch binary")


def _listed(docs: DataFrame, wanted: DataFrame, words: int, percent: int) -> DataFrame:
    """row, n, elements, places: the index elements of the wanted rows, from their texts."""

    def batch_of(parts: list[tuple]) -> pa.RecordBatch:
        sizes = [len(found) for _, _, found, _ in parts]
        rows = np.repeat(np.array([row for row, *_ in parts], dtype=np.int64), sizes)
        n = np.repeat(np.array([n for _, n, *_ in parts], dtype=np.int32), sizes)
        found = np.concatenate([f.view(np.int64) for _, _, f, _ in parts])
        places = np.concatenate([p.astype(np.int32) for *_, p in parts])
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (rows, n, found, places)], ["row", "n", "elements", "places"]
        )

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for row, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingles(text, words)
                found, places = elements(s, percent)
                if len(found):
                    parts.append((row, len(s), found, places))
                    held += len(found)
                if held >= BATCH_ELEMENTS:
                    yield batch_of(parts)
                    parts, held = [], 0
        if parts:
            yield batch_of(parts)

    return _texts(docs, wanted).mapInArrow(listed, "row long, n int, elements long, places int")


def _deltas(in_family: DataFrame, hashes: DataFrame, percent: int) -> DataFrame:
    """Every row of a family against its hub, the row that shares the most places of large blocks.

    family, row, n, hub, near (linked with the hub), delta (what is in one of the two sets alone;
    the hub's own n-grams as their complement) and added (how many are the row's, listed first).
    """
    hubs = in_family.groupBy("family").agg(
        F.max(F.struct("weight", F.negative("row").alias("row"))).alias("hub")
    )
    hubs = hubs.select("family", F.negative("hub.row").alias("hub"))
    hashes = hashes.select("row", "hashes")
    hub_sets = hubs.join(hashes.withColumnRenamed("row", "hub"), "hub").select(
        "family", "hub", F.col("hashes").alias("hub_hashes"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    salted = in_family.select("family", "row", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    rows = salted.join(hashes, "row").join(hub_sets, ["family", "salt"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, near, added, delta = [], [], [], []
            for x, h in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                x, h = np.frombuffer(x, "<u8"), np.frombuffer(h, "<u8")
                own = np.setdiff1d(x, h, assume_unique=True)
                lost = np.setdiff1d(h, x, assume_unique=True)
                sizes.append(len(x))
                added.append(len(own))
                near.append(len(own) + len(lost) <= most_different(len(x), len(h), percent))
                delta.append(np.r_[own, ~lost].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(sizes, pa.int64()),
                    batch.column(2),
                    pa.array(near, pa.bool_()),
                    pa.array(added, pa.int64()),
                    pa.array(delta, pa.list_(pa.int64())),
                ],
                ["family", "row", "n", "hub", "near", "added", "delta"],
            )

    return rows.select("family", "row", "hub", "hashes", "hub_hashes").mapInArrow(
        compare, "family long, row long, n long, hub long, near boolean, added long, delta array<long>"
    )


def _derived(deltas: DataFrame, percent: int) -> DataFrame:
    """a, a_n, b, b_n: pairs of a family that may be linked, of which one at least is not linked with the hub.

    For two sets x, y with deltas X, Y to the hub, |x - y| = |X| + |Y| - 2 |X and Y|. So if one is
    not linked with the hub and the two are linked, their deltas must share an element, and one of
    a prefix as long as linked sets may differ. Elements that are rare in the family come first.
    A posting is a row's number and sizes: no delta moves with it.
    """
    prefix = F.floor(F.col("n") * (100 - percent) / F.lit(percent)) + 1
    far = F.size("delta")
    sizes = deltas.select("row", "n", "near", "added", (far - F.col("added")).alias("lost"), far.alias("far"))
    listed = deltas.where(far > 0).select(
        "family", "row", "added",
        F.posexplode(F.when(F.col("added") >= prefix, F.slice("delta", F.lit(1), F.col("added").cast("int"))).otherwise(F.col("delta"))).alias("at", "element"),
    ).select("family", "row", "element", (F.col("at") >= F.col("added")).alias("of_hub"))
    of_element, of_row = Window.partitionBy("family", "element"), Window.partitionBy("row", "of_hub")
    ranked = (
        listed.withColumn("rows", F.count("*").over(of_element))
        .where("rows > 1")
        .join(sizes, "row")
        .withColumn("common", F.count("*").over(of_row))
        .withColumn("place", F.row_number().over(of_row.orderBy("rows", "element")) - 1)
    )
    before = F.when(F.col("of_hub"), F.col("added") + F.col("lost") - F.col("common")).otherwise(
        F.col("added") - F.col("common")
    )
    postings = ranked.where(before + F.col("place") < prefix)
    side = lambda p: postings.select(
        "family", "element", F.col("row").alias(p), F.col("n").alias(f"{p}_n"),
        F.col("near").alias(f"{p}_near"), F.col("far").alias(f"{p}_far"),
    )
    possible = (
        ~F.col("a_near")
        & (F.col("b_near") | (F.col("a") < F.col("b")))
        & (F.abs(F.col("a_far") - F.col("b_far")) <= _most_different(F.col("a_n"), F.col("b_n"), percent))
    )
    left, right = side("a"), side("b")
    on = (left["family"] == right["family"]) & (left["element"] == right["element"])
    return left.join(right, on & possible).select("a", "a_n", "b", "b_n").distinct()


def _linked(pairs: DataFrame, near_hub: DataFrame, hashes: DataFrame, percent: int, tables: Stored) -> DataFrame:
    """a, b: links among `pairs` that, with `near_hub`, lead to the same groups as all links.

    The first round compares up to `ROUND_PAIRS` pairs of each set, each later one twice as many; of the
    others those within one group by then need no answer, so their sets do not move.
    """
    bound = _most_different(F.col("a_n"), F.col("b_n"), percent)
    links, rest, most = pairs.select("a", "b").limit(0), pairs, ROUND_PAIRS
    while not rest.isEmpty():
        turn = rest.withColumn("turn", F.row_number().over(Window.partitionBy("a").orderBy("b")))
        now = turn.where(F.col("turn") <= most).drop("turn")
        found = _compared(now.select("a", "b"), hashes).join(now, ["a", "b"]).where(F.col("different") <= bound)
        links = tables.put(links.union(found.select("a", "b")), "derived")
        later = tables.put(turn.where(F.col("turn") > most).drop("turn"), "later")
        if later.isEmpty():
            break
        groups = components(near_hub.union(links))
        in_a, in_b = (groups.select(F.col("node").alias(p), F.col("component").alias(f"{p}_in")) for p in "ab")
        apart = later.join(in_a, "a", "left").join(in_b, "b", "left").where(
            F.coalesce("a_in", "a") != F.coalesce("b_in", "b")
        )
        rest = tables.put(apart.select(*pairs.columns), "rest")
        most *= 2
    return links


def link(
    docs: DataFrame, words: int = NGRAM_WORDS, percent: int = PERCENT, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) of each document.

    Two more columns tell one document of each group: `text_hash` (of Spark's xxhash64) and `first`,
    true for the rows with the component's smallest id and, of these, the smallest hash.

    Null, empty and blank texts have no n-grams and are linked with nothing. Rows that share an id
    stay rows of their own; a null id counts for no smallest id and, if linked with nothing, has a
    null component. Other columns are not read. No rows: no rows. (The largest long is no id.)
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    no_id = F.lit(2**63 - 1)
    tables = Stored(docs.sparkSession)
    sets = tables.put(_sets(docs, words), "sets")
    holders = tables.put(
        sets.where("n > 0").groupBy("key1", "key2").agg(
            F.min(F.struct(F.coalesce("doc_id", no_id).alias("id"), "text_hash")).alias("least"),
            F.min(F.struct("row", "doc_id", "text_hash", "n")).alias("h"),
        ).select("key1", "key2", "least", "h.*"),
        "holders",
    )

    # index lists of one set for each key, cut into blocks by position; blocks of one set are dropped
    by_place = Window.partitionBy("elements").orderBy("places", "row")
    earlier = by_place.rowsBetween(Window.unboundedPreceding, -1)
    in_block = Window.partitionBy("elements", "block")
    reach = F.floor(F.col("n") * (100 - percent) / F.lit(percent))
    several = tables.put(
        _listed(docs, holders, words, percent)
        .withColumn("last_place", F.lag("places").over(by_place))
        .withColumn("next_row", F.lead("row").over(by_place))
        .withColumn("reach", F.max(reach).over(earlier))
        .where("last_place is not null or next_row is not null")
        .withColumn("gap", F.coalesce(F.col("places") - F.col("last_place") > F.col("reach"), F.lit(False)))
        .withColumn("block", F.sum(F.col("gap").cast("int")).over(by_place))
        .withColumn("shared", F.count("*").over(in_block))
        .where("shared > 1")
        .select("elements", "block", "places", "row", F.col("n").cast("long").alias("n"), "shared"),
        "blocks",
    )

    # the sets behind the listed rows, from their texts again
    wanted = several.select("row").distinct().join(holders.select("row", "doc_id", "text_hash"), "row")
    hashes = tables.put(_hashes(docs, wanted, words), "hashes")

    # large blocks: families, each compared with its hub; the rest follows from these answers
    large = several.where(F.col("shared") > SMALL_BLOCK)
    least = F.min("row").over(in_block)
    chained = large.select("row", least.alias("least")).where("row <> least")
    families = components(chained.select(F.col("row").alias("a"), F.col("least").alias("b")))
    weight = large.groupBy("row").agg(F.sum("shared").alias("weight"))
    in_family = families.join(weight, families["node"] == weight["row"]).select(
        F.col("component").alias("family"), "row", "weight"
    )
    deltas = tables.put(_deltas(in_family, hashes, percent), "deltas")
    near_hub = deltas.where("near and row <> hub").select(F.col("row").alias("a"), F.col("hub").alias("b"))
    possible = tables.put(_derived(deltas, percent), "possible")
    possible = tables.put(_not_apart(possible, hashes, percent), "possible")
    derived = _linked(possible, near_hub, hashes, percent, tables)
    groups = components(near_hub.union(derived))

    # small blocks: pairs that are in different groups so far and not apart by their distances
    small = several.where(F.col("shared") <= SMALL_BLOCK)
    known = deltas.select("row", "family", F.size("delta").alias("far"))
    places = (
        small.join(groups.withColumnRenamed("node", "row"), "row", "left")
        .join(known, "row", "left")
        .withColumn("component", F.coalesce("component", "row"))
    )
    side = lambda p: places.select(
        "elements", "block", F.col("row").alias(p), F.col("n").alias(f"{p}_n"),
        F.col("places").alias(f"{p}_place"), F.col("component").alias(f"{p}_in"),
        F.col("family").alias(f"{p}_family"), F.col("far").alias(f"{p}_far"),
    )
    bound = _most_different(F.col("a_n"), F.col("b_n"), percent)
    apart = (F.col("a_family") == F.col("b_family")) & (F.abs(F.col("a_far") - F.col("b_far")) > bound)
    rest = (
        side("a")
        .join(side("b"), ["elements", "block"])
        .where("a < b and a_in <> b_in")
        .where(_can_link(percent))
        .where(~F.coalesce(apart, F.lit(False)))
        .select("a", "a_n", "b", "b_n")
        .distinct()
    )
    rest = tables.put(rest, "rest")
    tables.drop("blocks", "deltas", "possible", "later", "derived")
    rest = tables.put(_not_apart(rest, hashes, percent), "near")
    tables.drop("rest")
    late = _compared(rest.select("a", "b"), hashes).join(rest, ["a", "b"]).where(F.col("different") <= bound)
    links = tables.put(late.select("a", "b"), "links")
    tables.drop("hashes", "near")
    groups = components(
        links.union(
            groups.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        )
    )
    tables.drop("links")

    named = holders.join(groups.withColumnRenamed("node", "row"), "row", "left").withColumn(
        "component", F.coalesce("component", "row")
    )
    smallest = named.groupBy("component").agg(F.min("least").alias("least"))
    of_set = named.drop("least").join(smallest, "component").select("key1", "key2", "least")
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), "key1", "key2", "text_hash")
    own = F.struct(F.coalesce("doc_id", no_id).alias("id"), "text_hash")
    joined = rows.where("n_shingles > 0").join(of_set, ["key1", "key2"])
    alone = rows.where("n_shingles = 0").withColumn("least", own)
    return joined.unionByName(alone).select(
        "doc_id", "n_shingles", F.nullif(F.col("least.id"), no_id).alias("component_id"), "text_hash",
        (own == F.col("least")).alias("first"),
    )
