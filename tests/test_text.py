from __future__ import annotations

import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions import fuzzy, measures
from casemill.functions import text as T


def one(spark, values, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


def test_strip_accents_whole_plane(spark):
    """Every character up to U+FFFF, against the Unicode tables."""
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    chunks = ["".join(map(chr, codes[i : i + 512])) for i in range(0, len(codes), 512)]
    got = one(spark, chunks, T.strip_accents(F.col("t")))
    want = [unicodedata.normalize("NFD", c).encode("ascii", "ignore").decode() for c in chunks]
    assert [g[0] for g in got] == want


def test_whitespace_is_complete():
    assert set(K.WHITESPACE) == {chr(c) for c in range(sys.maxunicode) if chr(c).isspace()}


def test_tokens_split_like_python(spark):
    texts = ["a b c", "\x1c x \x85 y　", "", "  ", "solo"]
    got = one(spark, texts, T.tokens(F.col("t")), T.strip(F.col("t")))
    assert got == [(t.split(), t.strip()) for t in texts]


def test_clean_hard(spark):
    texts = ["Tumorectomía, y BSGC", "A mas B y y C", "M.R.M.-x (pieza)/otra+z", "ÑANDÚ ß º", ""]
    want = ["tumorectomia + bsgc", "a + b + y c", "mrmx ( pieza ) / otra + z", "nandu", ""]
    assert [g[0] for g in one(spark, texts, T.clean_hard(F.col("t")))] == want


def test_clean_model_keeps_unreachable_stopwords(spark):
    got = one(spark, ["El tumor de la mama; también está [aquí] @x"], T.clean_model(F.col("t")))
    assert got == [("tumor mama tambien aqui x",)]


def test_word_ngrams(spark):
    grams = T.word_ngrams(T.tokens(F.col("t")), [1, 2])
    assert one(spark, ["a b c", "", "x"], grams) == [(["a", "b", "c", "a b", "b c"],), ([],), (["x"],)]
    with pytest.raises(ValueError):
        T.word_ngrams(F.col("t"), 0)


def test_token_score(spark):
    pairs = [("carcinoma ductal", "carcinoma ductal infiltrante", 100), ("gato", "pato", 75), ("", "a", None)]
    rows = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    got = [r[0] for r in rows.select(fuzzy.token_score(F.col("a"), F.col("b"))).collect()]
    assert got == [p[2] for p in pairs]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    return round(200 * lcs(a, b) / (len(a) + len(b)))


def test_ratio_with_and_without_cutoff(spark):
    words = ["bsgc", "bsg", "bs gc", "mastectomia", "mastectomia simple", "tumorectmia", "tumorectomia", "x", "aab", "aba"]
    pairs = [(a, b) for a in words for b in words]
    rows = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = rows.select("a", "b", fuzzy.ratio(a, b).alias("r"), fuzzy.ratio(a, b, 90).alias("c")).collect()
    for r in got:
        assert r["r"] == ratio(r["a"], r["b"])
        assert (r["c"] >= 90) == (r["r"] >= 90) and (r["c"] == r["r"] or r["c"] == 0)


def plain(text):
    return "".join(c if c.isalnum() else " " for c in text).lower().strip()


def brute_labels(text):
    """Straight-line version of the matching rules for single texts."""
    for ch in K.INTERVENTION_CHARS_DELETE:
        text = text.replace(ch, "")
    text = " ".join(text.split())
    labels, going = [], bool(text)
    while going:
        going = False
        for label, spellings in K.INTERVENTION_CLASSES.items():
            sizes = [len(s.split()) for s in spellings]
            for spelling in spellings:
                words = text.split()
                grams = [
                    (ratio(plain(g), " ".join(plain(spelling).split())), m, -i, g)
                    for m in range(max(min(sizes) - 1, 1), max(sizes) + 2)
                    for i in range(len(words) - m + 1)
                    for g in [" ".join(words[i : i + m])]
                ]
                hits = [g for g in grams if g[0] >= 90]
                if hits:
                    labels += [label] if label else []
                    text = " ".join(text.replace(max(hits)[3], "").split())
                    going = bool(text)
                    break
    return sorted(labels)


def test_fuzzy_labels_against_brute_force(spark):
    texts = [
        "tumorectomia de mama izquierda con ampliacion de margenes inferosuperointerno",
        "tumorectomia guiada por arpon + bsgc", "mastectomia radical modificada", "mrm mrm bsgc bsgc",
        "mastectomia simple + linfadenectomia", "exeresis", "extirpacion ampliacion margenes", "", "+ ( )",
        "biopsia selectiva de ganglio centinela + cuadrantectomia", "tumorectmia linfadenectomias",
        "mastectomia mastectomia radical", "nada de nada", "bs gc", "m r m", "mastectomia simplemente",
    ]
    got = one(spark, texts, fuzzy.fuzzy_labels(F.col("t")))
    assert [g[0] for g in got] == [brute_labels(t) for t in texts]


def test_fuzzy_labels_need_ordered_classes():
    with pytest.raises(ValueError):
        fuzzy.fuzzy_labels(F.col("t"), {"mr": ["a"], "mrm": ["b"], "ms": ["c"]})


def test_measure_spans(spark):
    text = "Mide entre 20 x 5,5 cms, (3.2 CM) y 4 cm.\nOtro de 7 x 4 x 2 mm; 10 y 11. Nº12"
    spans = one(spark, [text], measures.measure_spans(F.col("t")))[0][0]
    assert [s["text"] for s in spans] == ["20 x 5,5 cms", "3.2 CM", "4 cm", "7 x 4 x 2 mm"]
    words = text.split()
    for s in spans:
        assert text[s["start"] : s["end"]] == s["text"]
        assert s["text"] in " ".join(words[s["token_start"] : s["token_end"]])


def test_measure_values(spark):
    texts = ["5,5 x 3 MM", "3 m", "2'5cm", "4 por 2 cm", "nada", None]
    got = [g[0] for g in one(spark, texts, measures.measure_value(F.col("t")))]
    assert got == [[55.0, 30.0], [0.03], [2.5], [], [], None]
    in_cm = [g[0] for g in one(spark, texts[:2], measures.measure_value(F.col("t"), K.CM_FACTORS))]
    assert in_cm == [pytest.approx([0.55, 0.3]), [300.0]]


def test_stopword_file_is_the_default_list(spark):
    from pyspark.ml.feature import StopWordsRemover

    from casemill.functions.text import spanish_stopwords

    assert spanish_stopwords() == list(StopWordsRemover.loadDefaultStopWords("spanish"))
