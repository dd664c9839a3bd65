"""N-gram join, spot signatures, nearest neighbours and their helpers against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from casemill.llm import neighbours, ngram_join, spot_signatures
from casemill.llm.components import components

from fixtures_llm import FOLDER, WORDS, edge_rows, prose

QUERIES = entry_points.queries()


def groups(nodes, pairs):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, b) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(60)) if a != b]
    pairs += [(100 + k, 101 + k) for k in range(30)] + [(200, 201 + k) for k in range(20)]
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == groups({n for p in pairs for n in p}, pairs)
    assert len(got) == len({n for p in pairs for n in p})


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def word_sets(text, n=4):
    words = "".join(c.lower() if c.isascii() else c for c in (text or "")).split(" ")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in " ".join(words)).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1)))


def brute_join(rows):
    """(row number, id, text) -> per row number (size, smallest id of the component)."""
    sets = {k: word_sets(t) for k, _, t in rows}
    pairs = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    of = groups(sets, pairs)
    ids = {}
    for k, i, _ in rows:
        ids.setdefault(of[k], []).append(i)
    least = {c: min((i for i in own if i is not None), default=None) for c, own in ids.items()}
    return {k: (len(sets[k]), least[of[k]]) for k, _, _ in rows}


def test_join_query(spark, small, texts, database):
    want = brute_join([(i, i, t) for i, t in texts.items()])
    query = QUERIES["op1_ngram_join"](spark, FOLDER)
    assert not compare.differences(query, database, entry_points.oracle_sql()["op1_ngram_join"])
    got = ngram_join.link(small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    kept = Counter(r.component_id for r in got if r.first)
    assert set(kept.values()) == {1} and set(kept) == {c for _, c in want.values()}


def test_join_edges(edge, nothing):
    got = ngram_join.link(edge).collect()
    want = brute_join([(k, i, t) for k, (i, t) in enumerate(edge_rows())])
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(
        (i, *want[k]) for k, (i, _) in enumerate(edge_rows())
    )
    assert ngram_join.link(nothing).collect() == []


def copies(seed, base, count, most_edits):
    """Copies with words changed out of a small pool, so that copies share changes."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        words = base.split()
        for _ in range(rng.randrange(most_edits + 1)):
            at = rng.randrange(len(words))
            words[at] = f"{WORDS[at % len(WORDS)]}x{rng.randrange(3)}"
        out.append(" ".join(words))
    return out


def test_join_of_large_families(spark, monkeypatch):
    """Hub, derived answers and small blocks all take part; every link is found."""
    line = prose(99, 12)
    rows = []
    for seed, words, edits in ((1, 70, 4), (2, 150, 8), (3, 400, 20), (4, 30, 2), (5, 14, 1)):
        rows += copies(seed, prose(seed + 50, words), 60, edits)
    rows += [f"{line} {prose(1000 + k, 40)}" for k in range(120)]
    rows = [(k, k, t) for k, t in enumerate(rows)]
    frame = spark.createDataFrame([(i, t) for _, i, t in rows], "doc_id long, text string").repartition(5)
    got = ngram_join.link(frame).collect()
    want = brute_join(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 10 < len({c for _, c in want.values()}) < len(rows) - 100


def test_linked_sets_share_an_element():
    rng = np.random.default_rng(1)
    tried = 0
    for n in [*range(6, 80), 100, 150, 240, 300, 500, 1200]:
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for _ in range(10):
            most = ngram_join.most_different(n, n)
            gone = int(rng.integers(0, most // 2 + 1))
            new = rng.integers(0, 2**64, int(rng.integers(0, most - gone + 1)), dtype=np.uint64)
            y = np.unique(np.r_[np.delete(x, rng.choice(n, gone, replace=False)), new])
            shared = len(np.intersect1d(x, y))
            if 100 * shared >= 85 * (len(x) + len(y) - shared) and not np.array_equal(x, y):
                tried += 1
                assert np.intersect1d(ngram_join.elements(x)[0], ngram_join.elements(y)[0]).size
    assert tried > 300


def edited_of(rows):
    """Brute force over distinct (id, text): descending ids, null ids last."""
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, text) in enumerate(order):
        cut = len(text) // 3
        after = order[(k + 1) % len(order)][1]
        out[(i, text)] = (len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest())
    return out


def test_spot_query(spark, texts):
    got = QUERIES["op5_spot_signatures"](spark, FOLDER).collect()
    want = edited_of(texts.items())
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == {i: v for (i, _), v in want.items()}
    prints = {r.doc_id: r.fingerprint for r in got}
    by_text = {}
    for i, t in texts.items():
        by_text.setdefault(t or "", set()).add(prints[i])
    assert all(len(p) == 1 for p in by_text.values())
    assert len({next(iter(p)) for p in by_text.values()}) >= 0.99 * len(by_text)
    sets = lambda p: {p[k : k + 8] for k in range(0, len(p), 8)}
    order = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in got}
    for k, i in enumerate(order):
        own, other = sets(prints[i]), sets(prints[order[(k + 1) % len(order)]])
        edited = sets(rows[i].edited_fingerprint)
        assert rows[i].near_next == pytest.approx(len(own & other) / len(own | other))
        assert rows[i].near_edited == pytest.approx(len(own & edited) / len(own | edited))


def test_spot_edges(edge, nothing):
    rows = [(i, t) for i, t in edge_rows() if i != 5]  # two texts of one id: order by hash
    got = spot_signatures.edited_likeness(edge.where("doc_id is null or doc_id <> 5")).collect()
    want = edited_of(rows)
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    by_id = {(i, v[0]): v[1] for (i, _), v in want.items() if i is not None}
    assert all(by_id[r.doc_id, r.n_chars] == r.edited_sha256 for r in got if r.doc_id is not None)
    assert spot_signatures.edited_likeness(edge).count() == len(edge_rows())
    assert spot_signatures.edited_likeness(nothing).collect() == []


def test_spot_sets(spark):
    texts = [
        "The quick brown fox jumps over the lazy dog and cat",  # the quick brown, the lazy dog
        "a of the",
        "and the quick, the brown fox",
        "the " * 200_000 + "end of it all " + "a " * 200_000,
    ]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    sets = {r[0]: r[1] for r in frame.select("k", spot_signatures.spots(F.col("t"))).collect()}
    assert [len(sets[k]) for k in range(3)] == [2, 1, 2]
    assert len(sets[3]) >= 1


def test_spots_cover_texts_without_common_words(spark):
    russian = [f"слово{k}" for k in range(120)]
    other = [f"иное{k}" for k in range(120)]
    texts = [" ".join(russian), " ".join(russian[:2] + other[2:]), " ".join(russian[:80] + other[80:])]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    sets = {r[0]: set(r[1]) for r in frame.select("k", spot_signatures.spots(F.col("t"))).collect()}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert len(sets[0]) > 10 and near(0, 1) < 0.2 and 0.2 < near(0, 2) < 0.9


def test_similar_pairs(spark):
    texts = copies(7, prose(70, 200), 25, 3) + [prose(200 + k, 100) for k in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {r.doc_id: frozenset(r.spots) for r in spot_signatures.members(frame).collect()}
    least = {}
    for i, s in sorted(sets.items()):
        least.setdefault(s, i)
    want = {
        (i, j) for s, i in least.items() for t, j in least.items()
        if i < j and len(s & t) >= 0.8 * len(s | t)
    }
    got = spot_signatures.similar_pairs(frame, 0.8).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 10


def vectors(n, seed=0, width=12):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, width)) * rng.uniform(0.5, 2, size=(n, 1))


def test_neighbours_of_uneven_lengths(spark):
    x = vectors(1500)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(frame).toPandas()
    hit = 0
    for query, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and query not in set(own.vec_id)
        scores = x @ x[query]
        assert np.allclose(own.score, scores[own.vec_id], rtol=1e-12)
        assert own.score.is_monotonic_decreasing
        scores[query] = -np.inf
        hit += len(set(np.argsort(-scores)[:20]) & set(own.vec_id))
    assert got.query_id.nunique() == 75 and hit / 1500 >= 0.9


def test_neighbours_query(spark):
    got = QUERIES["op10_neighbours"](spark, FOLDER).toPandas()
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas().set_index("vec_id").embedding
    ids, x = table.index.to_numpy(), np.stack(table).astype(float)
    hit = total = 0
    for query, own in got.groupby("query_id"):
        scores = x @ np.asarray(table[query], dtype=float)
        scores[ids == query] = -np.inf
        hit += len(set(ids[np.argsort(-scores)[:20]]) & set(own.vec_id))
        total += 20
    assert total == 20 * sum(i % 20 == 0 for i in ids) and hit / total >= 0.9


def test_neighbours_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
        (6, [None, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, [-3.0, 0.0]), (None, [5.0, 5.0]), (20, [0.0, 2.0]),
        (9, [-3.0, 0.0]), (40, [nan, nan]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    frame = frame.select("*", F.lit(1).alias("v"), F.lit(1).alias("a"), F.lit(2).alias("rank"))
    got = [tuple(r) for r in neighbours.search(frame).orderBy("query_id", "rank").collect()]
    assert got == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (0, 4, 9, -3.0), (0, 5, 9, -3.0),
        (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0), (20, 4, 9, 0.0), (20, 5, 9, 0.0),
    ]
    assert neighbours.search(frame.limit(0)).collect() == []
    assert neighbours.search(frame.where("vec_id = 0")).collect() == []


def test_sketches_bound_what_sets_differ_in():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 60, 500, 3000):
        for share in (0.0, 0.05, 0.2, 0.6):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.r_[a[int(n * share) :], rng.integers(0, 2**63, int(n * share)).astype(np.uint64)])
            b = b if n < 7 else b[: len(b) - len(b) // 9]  # another size, at times another number of slots
            different = len(np.setxor1d(a, b))
            least = ngram_join.least_different(ngram_join.sketch(a), ngram_join.sketch(b))
            assert least == ngram_join.least_different(ngram_join.sketch(b), ngram_join.sketch(a))
            assert 0.6 * min(different, n) <= least <= different


def test_pairs_far_apart_move_no_sets(spark, monkeypatch):
    """Pairs of a shared passage that are far from linked are left out before sets are joined."""
    rng = np.random.default_rng(6)
    passage = [f"p{i}" for i in range(300)]
    texts = [" ".join(passage + [f"w{x}" for x in rng.integers(0, 10**9, 300)]) for _ in range(6)]
    texts.append(texts[0] + " one more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, compared = [], ngram_join._compared

    def counted(pairs, hashes):
        seen.append(pairs.count())
        return compared(pairs, hashes)

    monkeypatch.setattr(ngram_join, "_compared", counted)
    found = {r.doc_id: r.component_id for r in ngram_join.link(docs, words=5, percent=80).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0}
    assert seen == [1]


def test_postings_carry_no_deltas_and_groups_need_few_answers(spark, monkeypatch):
    """Pairs of a family are numbers and sizes, and those already in one group move no sets."""
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(1, 1 << 62, 80).astype(np.uint64))
    sets = [np.sort(np.r_[base[:70], np.uint64(k)]) for k in range(1, 13)]
    rows = [(k, bytearray(s.tobytes()), bytearray(ngram_join.sketch(s))) for k, s in enumerate(sets)]
    hashes = spark.createDataFrame(rows, "row long, hashes binary, sketch binary")
    hub = np.sort(rng.integers(1, 1 << 62, 200).astype(np.uint64))
    deltas = [
        (99, k, len(s), 99, False, len(s), np.r_[s, ~hub].view(np.int64).tolist()) for k, s in enumerate(sets)
    ]
    deltas = spark.createDataFrame(
        deltas, "family long, row long, n long, hub long, near boolean, added long, delta array<long>"
    )
    pairs = ngram_join._derived(deltas, 80)
    assert pairs.columns == ["a", "a_n", "b", "b_n"] and pairs.count() == 66
    seen, compared = [], ngram_join._compared

    def counted(pairs, hashes):
        seen.append(pairs.count())
        return compared(pairs, hashes)

    monkeypatch.setattr(ngram_join, "_compared", counted)
    monkeypatch.setattr(ngram_join, "ROUND_PAIRS", 1)
    none = spark.createDataFrame([], "a long, b long")
    links = ngram_join._linked(pairs, none, hashes, 80, ngram_join.Stored(spark))
    assert {r.component for r in ngram_join.components(links).collect()} == {0}
    assert seen == [11]
