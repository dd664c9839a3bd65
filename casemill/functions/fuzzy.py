"""String similarity and fuzzy classification as native Column expressions.

Choices are driver-side vocabularies of fixed size; they become literal arrays in the expression, so
no join is needed. Callers apply these on distinct texts (`operators.joins.on_distinct`).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions import text as T

Scorer = Callable[[Column, Column], Column]


def processed(c: Column) -> Column:
    """Lower case, everything but word characters to blanks, stripped."""
    return T.strip(F.lower(F.regexp_replace(c, r"(?U)\W", " ")))


def token_distance(a: Column, b: Column) -> Column:
    """Mean over words of the best normalised edit distance; the better of both directions.

    Null when either side has no words.
    """
    words = F.struct(
        T.clean_tokens(T.clean_hard(a)).alias("x"), T.clean_tokens(T.clean_hard(b)).alias("y")
    )
    return T.bind(words, lambda w: _token_distance(w["x"], w["y"]))


def _mean_of_best(words: Column, others: Column) -> Column:
    def best(w: Column) -> Column:
        return F.array_min(
            F.transform(
                others, lambda v: F.levenshtein(w, v) / F.greatest(F.length(w), F.length(v))
            )
        )

    total = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + best(w))
    return total / F.size(words)


def _token_distance(x: Column, y: Column) -> Column:
    both = (F.size(x) > 0) & (F.size(y) > 0)
    return F.when(both, F.least(_mean_of_best(x, y), _mean_of_best(y, x)))


def token_score(a: Column, b: Column) -> Column:
    """`100 * (1 - token_distance)`, truncated."""
    return (100 * (1 - token_distance(a, b))).cast("int")


def token_score_words(x: Column, y: Column) -> Column:
    """`token_score` over word arrays that are already clean."""
    return (100 * (1 - _token_distance(x, y))).cast("int")


#: Letters in one 64-bit word of the table below; the rest is room for the carry.
_WORD = 62


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings.

    A row of the usual table is kept as bits, one for each letter of the shorter string, in words of
    62 bits: a letter of the longer string turns it into the next row by an addition and three
    bit operations a word, with a carry from word to word. Zeros mark where the length grows.
    """
    shorter = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    longer = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    zero, full = F.lit(0).cast("long"), F.lit((1 << _WORD) - 1)

    def mask(block: Column, ch: Column) -> Column:
        return F.aggregate(block, zero, lambda m, x: m * 2 + F.when(x == ch, 1).otherwise(0))

    def ones(size: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1

    def zeros(row: Column, size: Column) -> Column:
        return size - F.bit_count(row.bitwiseAND(ones(size)))

    def one_word(p: Column) -> Column:
        def step(row: Column, ch: Column) -> Column:
            return T.bind(
                F.struct(row.alias("v"), F.element_at(p["masks"], ch).alias("m")),
                lambda s: (s["v"] + s["v"].bitwiseAND(s["m"])).bitwiseOR(
                    s["v"].bitwiseAND(F.bitwise_not(s["m"]))
                ).bitwiseAND(full),
            )

        return zeros(F.aggregate(p["letters"], ones(p["size"]), step), p["size"])

    def several_words(p: Column) -> Column:
        def next_row(row: Column, masks: Column) -> Column:
            def word(state: Column, k: Column) -> Column:
                def sums(v: Column) -> Column:
                    total = v["v"] + v["v"].bitwiseAND(v["m"]) + state["carry"]
                    kept = v["v"].bitwiseAND(F.bitwise_not(v["m"]))
                    return F.struct(
                        F.shiftright(total, _WORD).alias("carry"),
                        F.concat(state["row"], F.array(total.bitwiseOR(kept).bitwiseAND(full))).alias("row"),
                    )

                return T.bind(F.struct(F.get(row, k).alias("v"), F.get(masks, k).alias("m")), sums)

            start = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("row"))
            places = F.sequence(F.lit(0), F.size(row) - 1)
            return F.aggregate(places, start, word, lambda s: s["row"])

        start = F.transform(p["blocks"], lambda block: ones(F.size(block)))
        last = F.aggregate(p["letters"], start, lambda row, ch: next_row(row, F.element_at(p["masks"], ch)))
        counts = F.zip_with(last, p["blocks"], lambda row, block: zeros(row, F.size(block)))
        return F.aggregate(counts, F.lit(0), lambda total, n: total + n)

    def run(s: Column) -> Column:
        letters, size = F.split(s["longer"], ""), F.length(s["shorter"])
        distinct = F.array_distinct(letters)
        table = lambda of: F.map_from_arrays(distinct, F.transform(distinct, of))
        backward = F.reverse(F.split(s["shorter"], ""))
        starts = F.sequence(F.lit(0), F.floor((size - 1) / _WORD).cast("int"))
        blocks = F.transform(
            starts, lambda k: F.reverse(F.slice(F.split(s["shorter"], ""), k * _WORD + 1, F.lit(_WORD)))
        )
        short = T.bind(
            backward,
            lambda back: one_word_of(letters, size, table(lambda ch: mask(back, ch))),
        )
        long = T.bind(
            blocks,
            lambda bs: several_of(letters, bs, table(lambda ch: F.transform(bs, lambda block: mask(block, ch)))),
        )
        return F.when(size == 0, 0).when(size <= _WORD, short).otherwise(long)

    def one_word_of(letters: Column, size: Column, masks: Column) -> Column:
        return T.bind(F.struct(letters.alias("letters"), size.alias("size"), masks.alias("masks")), one_word)

    def several_of(letters: Column, blocks: Column, masks: Column) -> Column:
        return T.bind(F.struct(letters.alias("letters"), blocks.alias("blocks"), masks.alias("masks")), several_words)

    return T.bind(F.struct(shorter.alias("shorter"), longer.alias("longer")), run)


def ratio(a: Column, b: Column, cutoff: int = 0) -> Column:
    """Similarity 0..100 from insertions and deletions only, rounded half-even.

    Below `cutoff` the value may be 0: the edit distance, which never exceeds the
    insert/delete distance, rules such pairs out before the quadratic part runs.
    """
    def score(p: Column) -> Column:
        x, y = p["x"], p["y"]
        total = F.length(x) + F.length(y)
        exact = F.bround(200 * lcs_length(x, y) / total, 0).cast("int")
        if cutoff <= 0:
            return F.when(x == y, 100).otherwise(exact)
        # score >= cutoff means (total - d) / total >= (cutoff - 0.5) / 100
        limit = total * (1 - (cutoff - 0.5) / 100)
        near = (F.abs(F.length(x) - F.length(y)) <= limit) & (F.levenshtein(x, y) <= limit)
        return F.when(x == y, 100).when(near, exact).otherwise(0)

    return T.bind(F.struct(a.alias("x"), b.alias("y")), score)


def best_choice(
    key: Column, choices: Sequence[str], scorer: Scorer | None = None
) -> Column:
    """Best of `choices` as struct(score, match, choice_order); ties go to the earlier choice."""
    if scorer is None:
        options = F.expr(
            _array(
                f"named_struct('neg', {-i}, 'match', {T.sql_literal(c)}, 'words', "
                f"{_array(map(T.sql_literal, _clean_words(c)))})"
                for i, c in enumerate(choices)
            )
        )
        return T.bind(
            T.clean_tokens(T.clean_hard(processed(key))),
            lambda words: F.array_max(
                F.transform(
                    options,
                    lambda o: F.struct(
                        token_score_words(words, o["words"]).alias("score"),
                        o["neg"].alias("neg"),
                        o["match"].alias("match"),
                    ),
                )
            ),
        )

    def scored(done: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    scorer(done, processed(F.lit(c))).alias("score"),
                    F.lit(-i).alias("neg"),
                    F.lit(c).alias("match"),
                )
                for i, c in enumerate(choices)
            ]
        )

    return F.array_max(T.bind(processed(key), scored))


def _array(items: Iterable[str]) -> str:
    return f"array({', '.join(items)})"


def _clean_words(choice: str) -> list[str]:
    """Words of a fixed spelling, cleaned on the driver as `clean_hard` cleans the keys."""
    plain = "".join(ch if ch.isalnum() or ch == "_" else " " for ch in choice).lower().strip()
    folded = unicodedata.normalize("NFD", plain).encode("ascii", "ignore").decode()
    return folded.replace(" mas ", " + ").replace(" y ", " + ").split()


def fuzzy_labels(
    intervention: Column,
    classes: Mapping[str, Sequence[str]] | None = None,
    cutoff: int = 90,
    scorer: Scorer | None = None,
) -> Column:
    """Multi-label classification by consuming fuzzy n-gram matches, as a sorted array.

    Passes over the ordered classes repeat while one of them matched something. In a pass a class
    takes the first of its spellings with an n-gram scoring at least `cutoff`; the best n-gram
    (then the longest, then the first) is cut out of the text. Class "" consumes without a label.
    """
    classes = K.INTERVENTION_CLASSES if classes is None else classes
    order = [c for c in classes if c in K.MASTECTOMY_ORDER]
    if order != K.MASTECTOMY_ORDER:
        raise ValueError(f"classes must list {K.MASTECTOMY_ORDER} in this order")
    score = scorer or (lambda a, b: ratio(a, b, cutoff))

    entries = []
    for number, (label, spellings) in enumerate(classes.items()):
        sizes = [len(s.split()) for s in spellings]
        for s in spellings:
            plain = " ".join("".join(x if x.isalnum() else " " for x in s).split())
            entries.append(
                f"named_struct('number', {number}, 'label', {T.sql_literal(label)}, "
                f"'spelling', {T.sql_literal(plain)}, "
                f"'low', {max(min(sizes) - 1, 1)}, 'high', {max(sizes) + 1})"
            )
    options = F.expr(_array(entries))

    longest = max(len(s.split()) for group in classes.values() for s in group) + 1

    start = F.translate(intervention, K.INTERVENTION_CHARS_DELETE, "")
    start = F.trim(F.regexp_replace(start, K.SPACE + "+", " "))

    def grams_of(text: Column) -> Column:
        """Every n-gram of a text, with the plain form that is scored."""

        def of_size(p: Column, m: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(1), F.size(p["words"]) - m + 1),
                lambda i: F.struct(
                    m.alias("words"),
                    (-i).alias("neg"),
                    F.array_join(F.slice(p["words"], i, m), " ").alias("gram"),
                    T.strip(F.array_join(F.slice(p["plain"], i, m), " ")).alias("plain"),
                ),
            )

        def every(p: Column) -> Column:
            sizes = F.sequence(F.lit(1), F.least(F.size(p["words"]), F.lit(longest)))
            grams = F.flatten(F.transform(sizes, lambda m: of_size(p, m)))
            return F.when(F.size(p["words"]) > 0, grams)

        words = T.clean_tokens(text)
        pair = F.struct(
            words.alias("words"),
            F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"(?U)\W", " "))).alias("plain"),
        )
        return T.bind(pair, every)

    def worth_scoring(g: Column, option: Column) -> Column:
        fits = (g["words"] >= option["low"]) & (g["words"] <= option["high"])
        if scorer is not None:
            return fits
        # lengths alone bound the score: most n-grams stop here
        both = F.length(g["plain"]) + F.length(option["spelling"])
        apart = F.abs(F.length(g["plain"]) - F.length(option["spelling"]))
        return fits & (apart <= both * (1 - (cutoff - 0.5) / 100))

    def try_option(state: Column, option: Column) -> Column:
        scored = F.transform(
            F.filter(state["grams"], lambda g: worth_scoring(g, option)),
            lambda g: F.struct(
                score(g["plain"], option["spelling"]).alias("score"),
                g["words"].alias("words"),
                g["neg"].alias("neg"),
                g["gram"].alias("gram"),
            ),
        )
        best = F.array_max(F.filter(scored, lambda g: g["score"] >= cutoff))

        def settle(b: Column) -> Column:
            rest = F.replace(state["text"], b["gram"], F.lit(""))
            rest = F.trim(F.regexp_replace(rest, " +", " "))
            label = F.when(option["label"] != "", F.array(option["label"])).otherwise(
                F.array().cast("array<string>")
            )

            def cut(text: Column) -> Column:
                return F.struct(
                    text.alias("text"),
                    F.concat(state["labels"], label).alias("labels"),
                    option["number"].alias("taken"),
                    F.lit(True).alias("matched"),
                    grams_of(text).alias("grams"),
                )

            return F.when(b.isNotNull(), T.bind(rest, cut)).otherwise(state)

        skip = (state["taken"] == option["number"]) | (state["text"] == "")
        return F.when(skip, state).otherwise(T.bind(best, settle))

    def one_pass(state: Column, _: Column) -> Column:
        fresh = F.struct(
            state["text"].alias("text"),
            state["labels"].alias("labels"),
            F.lit(-1).alias("taken"),
            F.lit(False).alias("matched"),
            state["grams"].alias("grams"),
        )
        ran = F.aggregate(options, fresh, try_option)
        return F.when(state["matched"] & (state["text"] != ""), ran).otherwise(state)

    def run(text: Column) -> Column:
        begin = F.struct(
            text.alias("text"),
            F.array().cast("array<string>").alias("labels"),
            F.lit(-1).alias("taken"),
            F.lit(True).alias("matched"),
            grams_of(text).alias("grams"),
        )
        # every pass that matches removes text, so the word count bounds the passes
        passes = F.sequence(F.lit(1), F.greatest(F.size(T.clean_tokens(text)), F.lit(1)))
        return F.aggregate(passes, begin, one_pass, lambda s: F.array_sort(s["labels"]))

    return T.bind(start, run)
