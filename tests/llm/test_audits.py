"""Source divergence, toxicity and periodic runs."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from casemill.llm import periodic_runs, source_divergence, toxicity

from fixtures_llm import FOLDER

QUERIES = entry_points.queries()


# --- periodic runs


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """Every (start, length, smallest period), by comparing all words at all distances."""
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_row(doc_id, text) -> tuple:
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def found_rows(frame) -> Counter:
    return Counter(tuple(r) for r in frame.select(*RUN_COLUMNS).collect())


def test_runs_of_given_documents(spark, texts):
    got = found_rows(QUERIES["op13_periodic_runs"](spark, FOLDER))
    short = {i: t for i, t in texts.items() if len((t or "").split()) <= 3000}
    assert len(short) > 0.9 * len(texts)
    wanted = Counter(plain_row(i, t) for i, t in short.items())
    assert Counter({k: v for k, v in got.items() if k[0] in short}) == wanted
    assert sum(k[1] > 0 for k in wanted) > 10


def odd_sequences(seed: int):
    rng = random.Random(seed)
    a, b = ["a"], ["a", "b"]
    while len(b) < 600:
        a, b = b, b + a
    yield b
    yield [str(i.bit_count() & 1) for i in range(600)]
    for n in (0, 1, 11, 12, 13, 400, 5000):
        yield ["x"] * n
    for _ in range(40):
        size = rng.randrange(2, 26)
        letters = "abcdefghijklmnopqrstuvwxyz"[:size]
        out: list[str] = []
        for _ in range(rng.randrange(1, 8)):
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, 60))]
            if rng.random() < 0.3:
                unit = ["x", "y"] * rng.randrange(1, 20) + unit[:2]
            out += (unit * 6)[: rng.randrange(1, 250)]
        yield out


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_odd_sequences(seed):
    sequences = [[w.encode() for w in words] for words in odd_sequences(seed)]
    lengths = np.array([len(words) for words in sequences])
    bounds = np.r_[0, np.cumsum(lengths)]
    ids = np.concatenate([periodic_runs.numbered(w, int(at)) for w, at in zip(sequences, bounds)])
    s, e, q = periodic_runs.find(ids, lengths)
    wanted = [(at + a, at + a + n, p) for words, at in zip(sequences, bounds.tolist()) for a, n, p in plain_runs(words)]
    assert list(zip(s.tolist(), e.tolist(), q.tolist())) == wanted


def test_grammar_leaves_no_pair_twice():
    words = [w.encode() for w in (["a", "b", "c", "d"] * 100 + ["e", "a", "b"] * 30)]
    ids = periodic_runs.numbered(words, 0)
    g = periodic_runs.re_pair(ids, np.array([0]))
    assert len(g["top"]) < 40
    spans = {}
    for rule, place in zip(g["used"].tolist(), g["place"].tolist()):
        size = g["hi"][rule] - g["lo"][rule]
        spans.setdefault(rule, set()).add(tuple(ids[place : place + size].tolist()))
    assert all(len(texts) == 1 for texts in spans.values())
    top = np.r_[g["top"], len(ids)]
    symbols = [tuple(ids[a:b].tolist()) for a, b in zip(top, top[1:])]
    pairs = Counter(zip(symbols, symbols[1:]))
    assert max(pairs.values()) == 1


def test_runs_edge_cases(spark, edge, nothing):
    frame = periodic_runs.detect(edge)
    assert frame.columns[0] == "doc_id" and frame.count() == edge.count()
    long = "one two three four five six seven " * 30_000
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "a " * 40), (5, long), (5, long), (6, "a\x00 b c " * 9)]
    got = found_rows(periodic_runs.detect(spark.createDataFrame(rows, "doc_id long, text string")))
    small = [r for r in rows if r[0] != 5]
    assert Counter({k: v for k, v in got.items() if k[0] != 5}) == Counter(plain_row(*r) for r in small)
    (five,) = (k for k in got if k[0] == 5)
    assert got[five] == 2 and five[1:5] == (1, 0, 210_000, 7) and five[5] == 30_000_000
    assert periodic_runs.detect(nothing).count() == 0


def test_very_long_text_among_others():
    rng = random.Random(3)
    unit = [b"%d" % rng.randrange(4000) for _ in range(70_000)]
    words = unit * 3
    s, e, q = periodic_runs.find(periodic_runs.numbered(words, 0), np.array([len(words)]))
    assert (0, len(words), len(unit)) in zip(s.tolist(), e.tolist(), q.tolist())


# --- toxicity


def plain_ratio(counts: tuple[Counter, Counter], word: bytes, order: int) -> float:
    """Log-likelihood ratio of a word by the definition, with dictionaries."""
    discount, doubt = toxicity.DISCOUNT, toxicity.DOUBT
    off = lambda n: min(n, discount + doubt * math.sqrt(n)) if n else 0
    lower, current = {}, set(counts[0]) | set(counts[1])
    for k in range(order - 1, 0, -1):
        lower[k] = Counter(g[1:] for g in current)
        current = set(lower[k])

    def shared(gram: bytes) -> float:
        p = 1 / 256
        for k in range(1, order):
            g = gram[-k:]
            total = sum(n for x, n in lower[k].items() if x[:-1] == g[:-1])
            kinds = sum(x[:-1] == g[:-1] for x in lower[k])
            if total:
                p = max(lower[k][g] - discount, 0) / total + discount * kinds / total * p
        return p

    def chance(y: int, gram: bytes) -> float:
        under = lambda c, f: sum(f(n) for g, n in c.items() if g[:-1] == gram[:-1])
        total = under(counts[0], float) + under(counts[1], float)
        rest = under(counts[y], lambda n: n - off(n))
        if not total or rest <= 1e-9:
            return shared(gram)
        back = (under(counts[0], off) + under(counts[1], off)) / total
        n = counts[y][gram]
        return (1 - back) * (n - off(n)) / rest + back * shared(gram)

    padded = b" " * (order - 1) + word + b" "
    grams = [padded[i : i + order] for i in range(len(padded) - order + 1)]
    return sum(math.log(chance(1, g) / chance(0, g)) for g in grams)


@pytest.mark.parametrize("order", [2, 3, 5])
def test_ratios_by_definition(order):
    rng = random.Random(order)
    words = [[bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 6))) for _ in range(60)] for _ in range(2)]
    words[1] += [b"dada"] * 20
    counts = (Counter(), Counter())
    for y in (0, 1):
        for w in words[y]:
            padded = b" " * (order - 1) + w + b" "
            counts[y].update(padded[i : i + order] for i in range(len(padded) - order + 1))
    grams = sorted(set(counts[0]) | set(counts[1]), key=lambda g: hash(g))
    pack = np.array([int.from_bytes(g, "big") for g in grams])
    model = toxicity.Model(pack, *(np.array([c[g] for g in grams]) for c in counts), order)
    tried = [b"dada", b"a", b"abc", b"zz", b"abcz", b"ddddd", *words[0][:5]]
    got = model.of_words(tried)
    assert got == pytest.approx([plain_ratio(counts, w, order) for w in tried], abs=1e-9)
    # the shared part is a distribution over bytes
    context = pack[0] >> 8
    kinds = np.array([(context << 8) | b for b in range(256)])
    seen = toxicity.shared_shares(np.sort(pack), order)
    own = (np.sort(pack) >> 8) == context
    assert 0 < seen[own].sum() <= 1 and len(kinds) == 256


def test_grams_are_windows():
    packed, word = toxicity.grams([b"ab", b"c"], 3)
    assert [p.to_bytes(3, "big") for p in packed.tolist()] == [b"  a", b" ab", b"ab ", b"  c", b" c "]
    assert word.tolist() == [0, 0, 0, 1, 1]
    assert toxicity.words_of("É-mail DON'T\x00x1y") == ["é".encode(), b"mail", b"don", b"t", b"x", b"y"]


def auc(score: np.ndarray, y: np.ndarray) -> float:
    a, b = score[y == 1], score[y == 0]
    return float(((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2))


def test_toxicity_query_on_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op12_toxicity"](spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert len(rows) == 1000 and rows["score"].between(0, 1).all()
    assert ((rows["score"] >= 0.5) == (rows["predicted"] == 1)).all()
    held = rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    assert (held == rows["held_out"]).all()
    joined = rows[held].merge(labels, on="doc_id")
    assert auc(joined["score"].to_numpy(), joined["toxic"].to_numpy()) > 0.9
    assert joined.loc[joined["toxic"] == 0, "predicted"].mean() < 0.03


def test_held_out_labels_are_not_read(spark, small):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    held = toxicity.remainder(F.col("doc_id")) == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (
        {r.doc_id: round(r.score, 9) for r in toxicity.score(small, l).collect()} for l in (labels, turned)
    )
    assert one == two


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    for name in ("MODEL_DOCS", "CALIBRATION_DOCS"):  # the sizes of a former sample
        monkeypatch.setattr(toxicity, name, 5, raising=False)
    labels = spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic").union(
        spark.createDataFrame([(1, 1), (None, 1), (3, None)], "doc_id long, toxic int"))
    wanted = {k for k in range(3000) if zlib.crc32(str(k).encode()) % 5}
    rows = toxicity.labelled(labels).collect()
    assert len(rows) == len(wanted) and {r.doc_id for r in rows} == wanted
    assert all(r.fitting == (zlib.crc32(str(r.doc_id).encode()) % 5 != 4) for r in rows)


def test_toxicity_gathers_columns_and_joins_alike_at_every_size(spark, monkeypatch):
    """The byte sequences come to the driver as Arrow columns, and no plan hangs on the size of the labels."""
    frame = spark.createDataFrame([(k, f"some words {k}") for k in range(20)], "doc_id long, text string")
    labels = frame.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    plans = []
    monkeypatch.setattr(type(frame), "toPandas", lambda self: pytest.fail("row objects on the driver"))
    kept = toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().toString())) or kept(df, name))
    assert len(toxicity.fit(frame, labels).seen)
    plan = dict(plans)["labelled"]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_toxicity_calibration_is_the_penalised_optimum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 2)) * [1.0, 0.2] + [0.5, 0.1]
    y = (x[:, 0] + rng.normal(size=500) > 0.8).astype(int)
    model = toxicity.Model(*(np.zeros(0, dtype=np.int64),) * 3)
    model.calibrate(spark.createDataFrame([(int(t), *map(float, v)) for t, v in zip(y, x)], "y int, mean double, strong double"))
    z = np.hstack([(x - x.mean(axis=0)) / x.std(axis=0), np.ones((500, 1))])
    p = 1 / (1 + np.exp(-z @ model.slopes))
    slope = z.T @ (y - p) - 500 * np.array([toxicity.PENALTY, toxicity.PENALTY, 1e-6]) * model.slopes
    assert np.abs(slope).max() < 1e-6


def test_toxicity_edge_cases(spark, edge, nothing):
    labels = spark.createDataFrame(
        [(i, i % 2 if i != 3 else None) for i in range(-11, 11)] + [(None, 1), (4, 0), (4, 0)],
        "doc_id long, toxic int",
    )
    got = toxicity.score(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (2, 3, 4)}
    assert len(empty) == 1
    assert all(not r.held_out for r in got if r.doc_id is None)
    assert {r.score for r in toxicity.score(edge, labels.limit(0)).collect()} == {0.5}
    one = toxicity.score(edge, labels.withColumn("toxic", F.lit(1))).collect()
    assert len({round(r.score, 9) for r in one}) == 1
    assert toxicity.score(nothing, labels).count() == 0


# --- source divergence


def plain_audit(rows: list[tuple]) -> Counter:
    import re

    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[str, Counter] = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts.setdefault((lang, source), Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    out = Counter()
    for lang, found in docs.items():
        kept = {t for t, n in found.items() if n >= 3}
        of = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        whole = {t: sum(c[t] for c in of.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}
        p = {s: share(c) for s, c in of.items()}
        q = share(whole)
        for s in of:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in of if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, values in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(values), start=1):
                    if part == "pair" or rank <= 200:
                        out[lang, s, part, item.decode(), -value, rank] += 1
    return out


def audited(frame) -> Counter:
    return Counter(tuple(r) for r in source_divergence.audit(frame).collect())


def test_audit_of_odd_texts(spark):
    rng = random.Random(1)
    words = ["Of", "of", "ÉTÉ", "été", "naïve", "x", "日本語", "ﬁ", "a1b2", "don't", "\x00z", "İ", "x" * 5000]
    rows = []
    for _ in range(300):
        size = rng.choice([0, 1, 5, 60])
        text = rng.choice([" ", "-", "\n", "_"]).join(rng.choice(words) + str(rng.randrange(9)) for _ in range(size))
        lang = rng.choice([None, "", "en", "en", "en", "fr", "one"])
        rows.append((rng.choice([text, text, text, None]), lang, rng.choice([None, "a", "b", "ç", "Z"]) if lang != "one" else "a"))
    rows += [("few words here", "rare", "a"), (None, "rare", "b"), ("", "rare", "c")] + [("same text", "en", "a")] * 5
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    clashes = frame.select("*", *(F.lit(k).alias(c) for k, c in enumerate(["term", "n", "p", "q", "value", "own"])))
    wanted = plain_audit(rows)
    assert any(k[0] == "rare" and k[4] == 0 for k in wanted)
    assert audited(clashes.repartition(7)) == wanted
    assert audited(frame.limit(0)) == Counter()


def test_audit_over_small_slices(spark, small, monkeypatch):
    """The same result whatever the slices of text and of pairs."""
    rows = [tuple(r) for r in small.select("text", "lang", "source").collect()]
    monkeypatch.setattr(source_divergence, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(source_divergence, "SLICE_BYTES", 5000)
    assert audited(small) == plain_audit(rows)


def test_shares_of_large_counts():
    for count, size in ((1, 3), (10**12, 3 * 10**13), (7, 10**14), (123_456_789_012, 98_765_432_109_876)):
        assert int(source_divergence.share(np.int64(count), np.int64(size))) == 10**9 * count // size


def test_toxicity_keeps_every_byte_sequence(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 5, raising=False)
    rows = [(i, f"{'vile' if i % 2 else 'kind'} word{chr(97 + i)}", i % 2) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    fitting = {r.doc_id for r in toxicity.labelled(frame).where("fitting").collect()}
    words = sorted({w for i, text, _ in rows if i in fitting for w in toxicity.words_of(text)})
    assert model.seen.tolist() == sorted(set(toxicity.grams(words)[0].tolist()))
