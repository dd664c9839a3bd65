"""Surrogates, quality, language-model scores, main text and the pipeline."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from casemill.llm import main_text, masked_lm, quality, surrogates

from fixtures_llm import FOLDER, edge_rows, prose

QUERIES = entry_points.queries()
KINDS = [
    r"[\w.+-]+@[\w-]+\.[\w.]*\w", r"\b[0-9a-fA-F]{40}\b", r"\+\d+ \(\d{3}\) \d{3}-\d{4}", r"\b\d{16}\b",
    r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
]


def replaced(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in surrogates.replace(frame, "key").orderBy("doc_id").collect()]


def test_surrogate_query(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op2_surrogates"](spark, FOLDER).collect()}
    assert got.keys() == texts.keys()
    seen = 0
    for i, text in texts.items():
        found = [m for kind in KINDS for m in re.findall(kind, text or "")]
        seen += len(found)
        assert not any(m in got[i].text for m in found)
        assert found or got[i].text == text and got[i].n_entities == 0
        for kind in KINDS:
            assert len(re.findall(kind, got[i].text or "")) == len(re.findall(kind, text or ""))
    assert seen > 10


def test_coreference_and_layout(spark):
    a, b, c = replaced(
        spark,
        [
            "Call +1 (017) 555-7713, or +1-017-555-7713. Card 9807915762804490, 9807 9157 6280 4490.",
            "JO.DOE99@MAIL7.EXAMPLE.COM is jo.doe99@mail7.example.com; IBAN DE89 3704 0044 0532 0130 00.",
            "Mr. John Smith, Herr John Smith, Mrs. John Smith; г-н Иван Петров и г-жа Анна Петрова",
        ],
    )
    digits = re.findall(r"\+[\d() -]+\d", a)
    assert re.sub(r"\D", "", digits[0]) == re.sub(r"\D", "", digits[1]) != "10175557713"
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4}, or \+1-\d{3}-\d{3}-\d{4}\. Card (\d{16}), (\d{4} ?){4}\.", a)
    cards = re.search(r"Card (\d+), ([\d ]+)\.", a)
    assert cards[1] == cards[2].replace(" ", "") != "9807915762804490"
    upper, lower = re.findall(r"\S+@\S+[A-Za-z]", b)
    assert upper == upper.upper() and upper.lower() == lower and lower.endswith(".com")
    assert re.search(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d\.", b)
    names = re.match(r"Mr\. (.*), Herr (.*), Mrs\. (.*); г-н (.*) и г-жа (.*)", c).groups()
    assert names[0] == names[1] and names[0] != names[2]
    assert names[0].split()[0] in surrogates.GIVEN["latin"]["m"]
    assert names[2].split()[0] in surrogates.GIVEN["latin"]["f"]
    assert names[3].split()[0] in surrogates.GIVEN["cyrillic"]["m"]
    assert names[4].split()[0] in surrogates.GIVEN["cyrillic"]["f"]


def test_distinct_although_draws_collide(spark):
    """Few possible surrogates: the rounds go on until all differ and none is a real entity."""
    frame = spark.createDataFrame([("other", f"{k:02d}") for k in range(40)], "kind string, entity string")
    got = surrogates.assigned(frame, "key").collect()
    real = {f"{k:02d}" for k in range(40)}
    assert {r.entity for r in got} == real and len(got) == 40
    assert len({r.surrogate for r in got}) == 40 and not {r.surrogate for r in got} & real


def test_more_entities_than_short_surrogates(spark, monkeypatch):
    monkeypatch.setitem(surrogates.SYLLABLES, "latin", ["ba", "den"])
    stored = []

    def written(frame, name, store=surrogates.written):
        stored.append(name)
        assert len(stored) < 40, "the rounds do not end"
        return store(frame, name)

    monkeypatch.setattr(surrogates, "written", written)
    real = [("name", f"{'mf'[k % 2]}/latin/name{k}") for k in range(40)]
    real += [("email", f"{a}@{b}.com") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrst"]
    real += [("name", "m/latin/babababa")]  # what a draw may give
    got = surrogates.assigned(spark.createDataFrame(real, "kind string, entity string"), "key").collect()
    assert {(r.kind, r.entity) for r in got} == set(real) and len(got) == len(real)
    drawn = {(r.kind, r.surrogate.lower()) for r in got}
    assert len(drawn) == len(real) and not drawn & (set(real) | {("name", "babababa")})


WHOLE = [
    "+1 (826) 555-4081", "+14155552671", "+33 6 12 34 56 78", "+33.6.12.34.56.78", "826 555 4081", "190.137.223.204",
    "078-05-1120", "9807915762804490", "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "a.doe@mail.example.com",
    "Mr. McDonald", "Mr. Juan de la Cruz", "Ms. ANNA SMITH", "Herr von Berg", "Mr. A B C D Smith",
    "Mr. J. O'Neil", "Frau Anna-Maria Schmidt",
]


def test_nothing_of_an_entity_stays(spark):
    """Each entity alone and every pair of neighbours is found whole."""
    texts = [[a] for a in WHOLE] + [[a, b] for a in WHOLE for b in WHOLE]
    frame = spark.createDataFrame([(" ".join(t), t) for t in texts], "text string, want array<string>")
    found = frame.select("want", F.regexp_extract_all("text", F.lit(surrogates.ANY), F.lit(0)).alias("found"))
    wrong = [(r.want, r.found) for r in found.collect() if r.want != r.found]
    assert not wrong, wrong
    kinds = frame.where("size(want) = 1").select("text", surrogates.kind_of(F.col("text")).alias("kind")).collect()
    assert all(r.kind == ("phone" if r.text[0] == "+" else r.kind) != "other" for r in kinds)
    name = "Mr. " + "Ab " * 50_000
    assert "Ab" not in replaced(spark, [name])[0]


def test_long_runs_take_no_stack(spark):
    long = ["x@a" + ".b" * 100_000, "1" * 100_000, "1 " * 50_000, "Mr. " * 50_000, "a." * 100_000, "1.2." * 50_000]
    got = replaced(spark, long)
    assert [len(got[k]) for k in (0, 1, 2, 4)] == [len(long[k]) for k in (0, 1, 2, 4)]
    assert got[0] != long[0] and got[4] == long[4]


def test_key_matters_and_runs_repeat(spark):
    frame = spark.createDataFrame([(1, "97.51.17.173 and 97.51.17.174")], "doc_id long, text string")
    one, again, other = (surrogates.replace(frame, k).first().text for k in ("a", "a", "b"))
    assert one == again != other
    assert all(0 < int(x) < 255 for x in re.findall(r"\d+", one)) and len(set(one.split(" and "))) == 2


def test_surrogate_edges(edge, nothing):
    got = surrogates.replace(edge, "key")
    assert got.columns == [*edge.columns, "n_entities"]
    assert Counter((r.doc_id, r.text, r.found) for r in got.collect()) == Counter(
        (r.doc_id, r.text, r.found) for r in edge.collect()
    )
    assert surrogates.replace(nothing, "key").collect() == []
    twice = edge.withColumn("text", F.concat(F.lit("to 97.51.17.173 "), "text")).union(edge)
    assert surrogates.replace(twice, "key").where("text like '%97.51.17.173%'").count() == 0


def test_quality_query(spark):
    got = QUERIES["op7_quality"](spark, FOLDER.replace("0.001", "0.01")).toPandas()
    labels = spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/labels.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    auc = np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good])
    assert auc > 0.97 and (held.predicted == held.quality).mean() > 0.95


def test_quality_without_held_out_labels(spark):
    """Labels of held-out rows, and rows without a label, do not change a score."""
    folder = FOLDER
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    turned = labels.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    turned = turned.union(spark.createDataFrame([(None, 0, 0), (3, None, 0)], labels.schema))
    one = quality.score(docs, labels).orderBy("doc_id").collect()
    two = quality.score(docs, turned).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in one], [r.score for r in two], atol=1e-6)


def test_quality_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)], "doc_id long, quality int")
    got = quality.score(edge, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in edge_rows())
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert quality.score(nothing, labels).collect() == []
    assert {r.score for r in quality.score(edge, labels.limit(0)).collect()} == {0.5}


def test_isotonic_is_the_best_rising_fit():
    at, share = quality.isotonic(np.arange(5.0), np.array([0, 3, 1, 2, 9.0]), np.array([10, 10, 10, 10, 10.0]))
    assert share.tolist() == pytest.approx([0.5 / 11, *[6.5 / 31] * 3, 9.5 / 11])


def test_model_probabilities_sum_to_one():
    network = masked_lm.Network()
    network.weights[:] = np.random.default_rng(1).normal(0, 0.5, len(network.weights))
    words = masked_lm.classes(prose(1, 30))
    context = masked_lm.contexts(words)
    every = np.arange(masked_lm.HALF**2)
    for row in context[:5]:
        p = np.exp(network.log_probabilities(np.repeat(row[None], len(every), axis=0), every))
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_model_gradient():
    """A step moves the mean log-probability as the numeric gradient of some weights says."""
    rng = np.random.default_rng(2)
    words = masked_lm.classes(prose(3, 200))
    context = masked_lm.contexts(words)
    start = rng.normal(0, 0.3, len(masked_lm.Network().weights)).astype(np.float32)
    network = masked_lm.Network(start.copy())
    network.squares[:] = 1e-12
    network.train(context, words)
    gradient = np.sqrt(network.squares)  # its size, of a first step
    for k in rng.choice(np.flatnonzero(gradient > np.quantile(gradient[gradient > 0], 0.9)), 5):
        near = []
        for step in (1e-2, -1e-2):
            moved = start.copy()
            moved[k] += step
            near.append(masked_lm.Network(moved).log_probabilities(context, words).mean(dtype=float))
        assert abs(near[0] - near[1]) / 2e-2 == pytest.approx(gradient[k], rel=0.1)


def test_model_prefers_text_to_shuffled_text(spark):
    rng = np.random.default_rng(4)
    chains = ["the river runs to the sea", "a stone lies in the garden", "of paper and of light we speak"]
    lines = [" ".join(rng.choice(chains, 30)) for _ in range(200)]
    shuffled = [" ".join(rng.permutation(x.split())) for x in lines[:40]]
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    weights = masked_lm.fit(frame).weights
    network = masked_lm.Network(weights)
    mean = lambda texts: np.mean(
        [network.log_probabilities(masked_lm.contexts(w), w).mean() for w in map(masked_lm.classes, texts)]
    )
    assert mean(lines[:40]) > mean(shuffled) + 0.5
    got = masked_lm.score(frame).orderBy("doc_id").collect()
    words = masked_lm.classes(lines[0])
    assert got[0].n_words == len(words)
    want = float(network.log_probabilities(masked_lm.contexts(words), words).sum())
    assert got[0].log_likelihood == pytest.approx(want, rel=0.05)


def test_model_edges(spark, edge, nothing):
    got = masked_lm.score(edge).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((i, len((t or "").split(" ")) if (t or "").strip() and "\t" not in t else 0) for i, t in edge_rows())
    assert all(r.log_likelihood <= 0 for r in got)
    assert all((r.mean_log_likelihood is None) == (r.n_words == 0) for r in got)
    assert masked_lm.score(nothing).collect() == []
    assert QUERIES["op6_masked_lm"](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_model_predicts_words(spark, monkeypatch):
    """Words of one class are told apart, by counts of the corpus; the shares of a class sum to one."""
    pair = {}
    for k in range(100_000):
        first = pair.setdefault(int(masked_lm.classes(f"w{k}")[0]), f"w{k}")
        if first != f"w{k}":
            break
    often, rare = first, f"w{k}"
    frame = spark.createDataFrame([(1, f"x {often} y"), (2, f"x {rare} y"), *[(3, often)] * 8], "doc_id long, text string")
    shares = masked_lm.vocabulary(frame).collect()
    total = Counter()
    for r in shares:
        total[int(masked_lm.classes(bytes(r.word).decode())[0])] += np.exp(r.share)
    assert len(shares) == 4 and list(total.values()) == pytest.approx([1.0] * len(total))
    for held in (masked_lm.MOST_HELD, 1, 0):  # from the workers' table and by the join
        monkeypatch.setattr(masked_lm, "MOST_HELD", held)
        got = {r.doc_id: r.log_likelihood for r in masked_lm.score(frame).collect()}
        assert got[1] - got[2] == pytest.approx(np.log(9), abs=1e-4)


def test_model_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "UNIT_WORDS", 2000)
    frame = spark.createDataFrame([(k, prose(k, 100)) for k in range(80)], "doc_id long, text string")
    first, second = (
        {r.doc_id: r.log_likelihood for r in masked_lm.score(frame.repartition(n)).collect()} for n in (2, 7)
    )
    assert first == pytest.approx(second, rel=1e-9)


def article_of(page):
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    inside = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inside))
    inside = re.sub(r"&(amp|lt|gt|quot|#39);", lambda m: {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "#39": "'"}[m[1]], inside)
    return re.sub(r"\s+", " ", inside).strip()


def test_main_text_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = QUERIES["op8_main_text"](spark, FOLDER).collect()
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in got} == {
        i: (p.url, article_of(p.html), len(article_of(p.html))) for i, p in pages.items()
    }


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="post-page"><div id=header>Site name</div>
<div class="main-menu"><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div><div class="cookie-notice">We use
cookies, here; and there.</div><div class="wrap"><div class="story"><h2>Title &amp; more</h2>
<div class="text">First part, with <b>bo</b>ld  text,
long enough, indeed. It goes on.</div><!-- <p>hidden, text.</p> --><div class=text>Second part here; also with text &lt;b&gt;. And more,
and more.</div><ul><li>Point one<li>Point two, fine</ul><table><tr><td>A<td>B<tr><td>C<td>D</table><p>Last<br>line.
<form><input value=x>Search it, here.</form></div>
<div class="sidebar">Other stories, some text here. More, of it.</div><div class="ads"><p>Buy this, now. Or that, then.</p></div>
<div id="comments"><p>I disagree, totally. You are all wrong, very wrong, about this.</p></div></div>
<script>if (a < b) { document.write("<p>no, no, no.</p>") }</script><footer>(c) 2020, us.</footer></body></html>"""


def test_main_text_without_article():
    assert main_text.extract(PAGE) == (
        "Title & more First part, with bold text, long enough, indeed. It goes on. Second part here; also with "
        "text <b>. And more, and more. Point one Point two, fine A B C D Last line."
    )


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("  \n", ""), ("plain text, no tags", "plain text, no tags"), ("<p>a<p>b <script>x", "a b"),
        ("<article><header><h1>T</h1></header><p>x y</p><section class=comments><p>no</p></section></article>", "T x y"),
        ("<div>", ""), ("</p></div>x", "x"), ("<p>1 &lt; 2 &amp;&nbsp;3</p>", "1 < 2 & 3"), ("a <!-- b", "a"),
        ("<main><p>a.</p><aside>b.</aside></main><nav>c.</nav>", "a."), ("<b " + "x" * 50, ""),
        ("<article>" + "<div>" * 300 + "deep, text." + "</div>" * 300 + "</article>", "deep, text."),
    ],
)
def test_main_text_of_odd_pages(page, text):
    assert main_text.extract(page) == text


def test_main_text_edges(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>" + "word, " * 50_000), (2, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = Counter((r.page_id, r.url, r.n_chars) for r in main_text.extract_pages(pages).collect())
    assert got == Counter([(1, "u", 0), (1, "u", 0), (None, None, 299_999), (2, None, 0)])
    assert main_text.extract_pages(pages.limit(0)).collect() == []


def test_pipeline(spark, tmp_path):
    folder = FOLDER
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, before, folder).write.parquet(path)
        after = spark.read.parquet(path)
        if name == "quality":
            kept = {r.doc_id for r in quality.score(before, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
            assert sorted(r.doc_id for r in after.collect()) == sorted(kept)
        elif name == "near_duplicates":
            from test_similarity import brute_join

            rows = [(r.doc_id, r.doc_id, r.text) for r in before.collect()]
            want = {i for i, (n, c) in brute_join(rows).items() if i == c}
            assert sorted(r.doc_id for r in after.collect()) == sorted(want)
        elif name == "personal_data":
            old, new = ({r.doc_id: r for r in f.collect()} for f in (before, after))
            assert old.keys() == new.keys() and any(old[i].text != new[i].text for i in old)
            assert all(r.n_chars == len(r.text) for i, r in new.items() if r.text and r.text != old[i].text)
        else:
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
        if name != "packing":
            assert after.columns == docs.columns
        before = after
    got = QUERIES["pipeline"](spark, folder)
    assert Counter(r.length for r in got.collect()) == Counter(r.length for r in before.collect())


def test_near_copies_from_four_fifths_on(spark):
    words = [f"w{k}" for k in range(100)]
    other = lambda k: " ".join(words[: 100 - k] + [f"x{j}" for j in range(k)])
    # 96 n-grams of five words each: 86 of 106 are shared, then 85 of 107 (0.81 and 0.79)
    for changed, kept in ((10, [1]), (11, [1, 2])):
        docs = spark.createDataFrame([(1, other(0)), (2, other(changed))], "doc_id long, text string")
        got = corpus_pipeline.one_of_each_group(spark, docs, FOLDER)
        assert sorted(r.doc_id for r in got.collect()) == kept


def test_stages_keep_odd_rows(spark, edge, nothing):
    wide = edge.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).withColumn("__n", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, wide, FOLDER)
        assert got.columns == wide.columns
        ids = Counter(r.doc_id for r in got.collect())
        if name == "near_duplicates":
            assert ids == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 2, None: 2, 8: 1, 10: 1, -11: 1})
        elif name == "personal_data":
            assert ids == Counter(i for i, _ in edge_rows())
        assert stage(spark, wide.limit(0), FOLDER).collect() == []


def test_quality_stage_keeps_clean_documents(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.good_quality(spark, docs, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    wrong = kept.join(labels.where("quality = 0"), "doc_id").count() / max(1, labels.where("quality = 0").count())
    clean = labels.where("quality = 1").join(docs, "doc_id").count()
    assert wrong <= 0.1 and kept.join(labels.where("quality = 1"), "doc_id").count() >= 0.99 * clean


STORY = "<p>" + "This is a story, told in whole sentences. It goes on. " * 8 + "</p>"


@pytest.mark.parametrize(
    "around",
    [
        "<div class='has-sidebar'><article>%s</article></div>",
        "<form id='aspnetForm'><div class='x'>%s</div></form>",
        "<article><div class='elementor-widget-container'>%s</div></article>",
        "<div class='post no-comments'>%s</div>",
        "<div class='menu-open page'><nav>x</nav><div>%s</div><div class='comments'><p>I like it.</p></div></div>",
    ],
)
def test_main_text_keeps_article_in_marked_elements(around):
    page = f"<html><body>{around % STORY}<footer>Foot, note.</footer></body></html>"
    assert main_text.extract(page) == STORY[3:-4].strip()
