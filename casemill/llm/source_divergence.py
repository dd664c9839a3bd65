"""How far the sources of a language differ in their terms: counts by Arrow kernels, divergences by shards.

Texts are lower-cased, split, dictionary-encoded and counted with Arrow's compute functions inside
`mapInArrow`; each task sends one row for a (language, source, term) it has met. Spark deals these
partial counts out by (language, term) into shards of columns, which are merged run by run, and a
shard adds up the divergences of its own terms. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.session import written

#: A language keeps the terms that are in so many of its documents.
LEAST_DOCS = 3
#: Ranks of the terms of a source that are returned.
MOST_RANKS = 200
#: Bytes of text that are split at once, and pairs of sources worked on at once.
SLICE_BYTES = 8 << 20
PAIRS_AT_ONCE = 1 << 20
#: What lies between terms: ASCII without letters.
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

_PARTIAL = "lang string, source string, term string, n long, docs long"
_KEPT = "lang string, term string, total long, sources array<string>, counts array<long>"


def share(count, size):
    """floor(1e9 * count / size) for numbers, arrays and Columns of 64 bits: 1e9 = 31250 * 32000."""
    if isinstance(count, Column) or isinstance(size, Column):
        whole = F.call_function("div", count * F.lit(31_250), size)
        rest = (count * F.lit(31_250)) % size
        return whole * F.lit(32_000) + F.call_function("div", rest * F.lit(32_000), size)
    whole, rest = np.divmod(count * 31_250, size)
    return whole * 32_000 + rest * 32_000 // size


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about SLICE_BYTES of text; a longer text is a slice of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = int(size[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(size, base + SLICE_BYTES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def _counted(part: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n (occurrences), docs (rows that hold the term) of some rows."""
    lists = pc.split_pattern_regex(pc.ascii_lower(part.column(2).cast(pa.large_string())), pattern=_BETWEEN)
    terms, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    filled = pc.not_equal(pc.binary_length(terms), 0)
    coded = terms.filter(filled).dictionary_encode()
    in_rows = pa.table({"row": row.filter(filled), "term": coded.indices}).group_by(["row", "term"])
    in_rows = in_rows.aggregate([([], "count_all")])
    rows = in_rows["row"].combine_chunks()
    lang, source = (part.column(k).dictionary_encode() for k in (0, 1))
    sums = (
        pa.table(
            {
                "lang": lang.indices.take(rows),
                "source": source.indices.take(rows),
                "term": in_rows["term"],
                "n": in_rows["count_all"],
            }
        )
        .group_by(["lang", "source", "term"])
        .aggregate([("n", "sum"), ("n", "count")])
    )
    named = zip(("lang", "source", "term"), (lang.dictionary, source.dictionary, coded.dictionary))
    return pa.table(
        {k: values.cast(pa.string()).take(sums[k].combine_chunks()) for k, values in named}
        | {"n": sums["n_sum"], "docs": sums["n_count"]}
    )


def partial_counts(docs: DataFrame) -> DataFrame:
    """One row a task slice for each (lang, source, term) in it; `docs` has lang, source, text without nulls."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield from _counted(part).to_batches()

    return docs.mapInArrow(count, _PARTIAL)


def _runs(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Where a row of the sorted table differs in `columns` from the one before it."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for name in columns:
        codes = table[name].combine_chunks().dictionary_encode().indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _merged(table: pa.Table) -> pa.RecordBatch:
    """Kept terms of rows sorted by lang, term, source that hold whole terms."""
    first = _runs(table, ["lang", "term", "source"])
    n, docs = (np.add.reduceat(table[c].to_numpy(), first) for c in ("n", "docs"))
    table = table.take(pa.array(first))
    term = _runs(table, ["lang", "term"])
    size = np.diff(np.r_[term, len(first)])
    kept = np.add.reduceat(docs, term) >= LEAST_DOCS
    rows = pa.array(np.flatnonzero(np.repeat(kept, size)))
    offsets = pa.array(np.r_[0, np.cumsum(size[kept])].astype(np.int32))
    heads = table.take(pa.array(term[kept]))
    return pa.RecordBatch.from_arrays(
        [
            heads["lang"].combine_chunks(),
            heads["term"].combine_chunks(),
            pa.array(np.add.reduceat(n, term)[kept], pa.int64()),
            pa.ListArray.from_arrays(offsets, table["source"].combine_chunks().take(rows)),
            pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64()).take(rows)),
        ],
        ["lang", "term", "total", "sources", "counts"],
    )


def kept_terms(partials: DataFrame) -> DataFrame:
    """lang, term, total, sources, counts of every term in LEAST_DOCS documents of its language.

    A term's row holds its sources, not its occurrences; partial counts arrive sorted, so a task
    holds one batch and the rows of one term.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            last = int(_runs(table, ["lang", "term"])[-1])
            rest = table.slice(last)
            if last:
                yield _merged(table.slice(0, last))
        if rest is not None:
            yield _merged(rest)

    shards = partials.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return shards.mapInArrow(merge, _KEPT)


class _Language:
    """Divergence sums of a language's sources over some terms, by what differs from a count of 0 twice."""

    def __init__(self, kept: int, sizes: list[int]) -> None:
        self.size = np.array(sizes, dtype=np.int64) + kept
        self.zero = 1 + share(np.int64(1), self.size)
        self.sums = np.zeros((len(sizes), len(sizes)), dtype=np.int64)
        self.none = self.distance(self.zero[:, None], self.zero[None, :])

    @staticmethod
    def distance(p, q):
        return (p - q) * (p - q) // q

    def add(self, source: np.ndarray, count: np.ndarray, lengths: np.ndarray) -> None:
        """Terms of `lengths` sources each, one after the other."""
        p = 1 + share(count + 1, self.size[source])
        # one side has the term: each (source, share) once, times its terms
        seen, times = np.unique(np.stack([source, p]), axis=1, return_counts=True)
        step = max(1, PAIRS_AT_ONCE // len(self.size))
        for at in range(0, len(times), step):
            (s, own), k = seen[:, at : at + step], times[at : at + step, None]
            as_p = self.distance(own[:, None], self.zero[None, :]) - self.none[s]
            as_q = self.distance(self.zero[None, :], own[:, None]) - self.none.T[s]
            np.add.at(self.sums, s, k * as_p)
            np.add.at(self.sums.T, s, k * as_q)
        # both sides have it: pairs of sources of each term, in pieces of a bounded number of pairs
        start = np.repeat(np.cumsum(lengths) - lengths, lengths)
        wide = np.repeat(lengths, lengths)
        total = np.cumsum(wide)
        at = 0
        while at < len(source):
            base = int(total[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(total, base + PAIRS_AT_ONCE, side="right")))
            one = np.repeat(np.arange(at, stop), wide[at:stop])
            two = start[one] + np.arange(len(one)) - np.repeat(total[at:stop] - wide[at:stop] - base, wide[at:stop])
            one, two = one[one != two], two[one != two]
            s, t = source[one], source[two]
            both = (
                self.distance(p[one], p[two]) - self.distance(p[one], self.zero[t])
                - self.distance(self.zero[s], p[two]) + self.none[s, t]
            )
            np.add.at(self.sums, (s, t), both)
            at = stop


def _pair_sums(kept: DataFrame, stats: dict) -> DataFrame:
    """lang, source, item, part: divergence over kept terms less that of terms neither source has."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Language] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                kept_number, sizes = stats[lang]
                own = batch.filter(pc.equal(langs.indices, code))
                work = known.setdefault(lang, None) or _Language(kept_number, list(sizes.values()))
                known[lang] = work
                names = pa.array(list(sizes), pa.string())
                lists = own.column(3)
                work.add(
                    pc.index_in(pc.list_flatten(lists), names).to_numpy(zero_copy_only=False).astype(np.int64),
                    pc.list_flatten(own.column(4)).to_numpy(zero_copy_only=False),
                    pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64),
                )
        for lang, work in known.items():
            names = list(stats[lang][1])
            for s, source in enumerate(names):
                if len(names) > 1:
                    rest = [t for t in range(len(names)) if t != s]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(rest)), pa.array([source] * len(rest)),
                            pa.array([names[t] for t in rest]), pa.array(work.sums[s, rest]),
                        ],
                        ["lang", "source", "item", "part"],
                    )

    return kept.mapInArrow(pairs, "lang string, source string, item string, part long")


def _squared(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs from the others.

    Null lang, source and text are ''. Every (lang, source) that occurs is compared with every other
    source of its language (part `pair`), and its terms that are more frequent than in the language
    have a divergence from it, the first 200 of which are returned (part `term`). Texts of any length
    count whole; repeated rows are documents of their own; equal values are ranked by item; a language
    without a term in three documents has divergences of 0. No rows: no result. Other columns are not
    read. The driver and the tasks hold one row for each (lang, source), whose square by language is
    in the result.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = written(kept_terms(partial_counts(rows)), "terms")
    entry = F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"))).alias("e")
    entries = kept.select("lang", "term", "total", entry).select("lang", "term", "total", "e.source", "e.n")
    languages = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("words"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = written(
        rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left")
        .join(languages, "lang", "left").fillna(0, ["own", "terms", "words"]),
        "sources",
    )
    stats: dict[str, tuple[int, dict[str, int]]] = {}
    for r in groups.select("lang", "source", "own", "terms").orderBy("lang", "source").collect():
        stats.setdefault(r.lang, (r.terms, {}))[1][r.source] = r.own

    # terms that neither source has, as often as there are terms, and what the others add
    zero = groups.withColumn("p", F.when(F.col("terms") > 0, F.lit(1) + share(F.lit(1), F.col("own") + F.col("terms"))))
    one = zero.select("lang", "source", "terms", "p")
    two = zero.select("lang", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = _pair_sums(kept, stats).groupBy("lang", "source", "item").agg(F.sum("part").alias("part_sum"))
    pairs = (
        one.join(two, "lang").where(F.col("source") != F.col("item"))
        .join(sums, ["lang", "source", "item"], "left")
        .select(
            "lang", "source", F.lit("pair").alias("part"), "item",
            (F.coalesce(F.col("terms") * _squared(F.col("p"), F.col("q")), F.lit(0))
             + F.coalesce("part_sum", F.lit(0))).alias("value"),
        )
    )
    terms = (
        entries.join(groups, ["lang", "source"])
        .withColumn("p", F.lit(1) + share(F.col("n") + 1, F.col("own") + F.col("terms")))
        .withColumn("q", F.lit(1) + share(F.col("total") + 1, F.col("words") + F.col("terms")))
        .where(F.col("p") > F.col("q"))
        .select(
            "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
            _squared(F.col("p"), F.col("q")).alias("value"),
        )
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = lambda part: part.withColumn("rank", F.row_number().over(order))
    best = ranked(terms).where(F.col("rank") <= MOST_RANKS)
    return ranked(pairs).unionByName(best)
