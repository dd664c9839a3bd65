"""Building blocks of the SQL texts that the registered queries are compared with."""

from __future__ import annotations

from casemill import constants as K
from casemill.functions.text import spanish_stopwords

NL = "chr(10)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {q(K.WHITESPACE)})"


def strip_accents(x: str) -> str:
    return f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"


def clean_hard(x: str) -> str:
    s = strip_accents(f"lower({x})")
    s = f"replace(replace(replace({s}, '.', ''), '-', ''), ',', ' ')"
    s = f"replace(replace({s}, ' mas ', ' + '), ' y ', ' + ')"
    s = f"regexp_replace({s}, '([/()+])', ' \\1 ', 'g')"
    return f"trim(regexp_replace({s}, '[\\t-\\r\\x1c-\\x20]+', ' ', 'g'))"


def clean_model(x: str) -> str:
    words = "[" + ", ".join(q(w) for w in spanish_stopwords()) + "]"
    spaced = clean_hard(x)
    for ch in K.MODEL_SPACE_CHARS:
        spaced = f"replace({spaced}, {q(ch)}, ' ')"
    return (
        f"array_to_string(list_filter(string_split({spaced}, ' '), "
        f"lambda w: w <> '' AND NOT list_contains({words}, w)), ' ')"
    )


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q(K.NOT_SPACE + '+')})"


def lines(x: str) -> str:
    return (
        f"list_filter(list_transform(string_split({x}, {NL}), lambda v: {strip('v')}), "
        "lambda v: v <> '')"
    )


def section_lines(x: str) -> str:
    return (
        f"list_transform(list_filter(string_split({x}, {NL}), lambda v: v <> ''), "
        f"lambda v: {strip('v')})"
    )


def first_line_at(ls: str, phrase: str) -> str:
    return f"nullif(list_position(list_transform({ls}, lambda v: contains(v, {q(phrase)})), true), 0)"


def raw_line(ls: str, phrase: str) -> str:
    return f"({ls})[{first_line_at(ls, phrase)}]"


def get_line(ls: str, phrase: str, skip: int, deletes: list[str]) -> str:
    value = f"({ls})[{first_line_at(ls, phrase)} + {skip}]"
    for d in deletes:
        value = f"regexp_replace({value}, {q(d)}, '', 'g')"
    return f"nullif({strip(value)}, '')"


def section(t: str, titles: list[str]) -> str:
    parts = []
    for title in titles:
        body = f"split_part({t}, {q(title)}, 2)"
        later = K.TITLES[K.TITLES.index(title) + 1 :]
        cuts = " ".join(
            f"WHEN contains({t}, {q(x)}) THEN split_part({body}, {q(x)}, 1)" for x in later
        )
        parts.append(
            f"WHEN contains({t}, {q(title)}) THEN {strip(f'CASE {cuts} ELSE {body} END')}"
        )
    return "CASE " + " ".join(parts) + " END"


def clean_words(x: str) -> str:
    return f"list_filter(string_split({clean_hard(x)}, ' '), lambda w: w <> '')"


def mean_of_best(a: str, b: str) -> str:
    return (
        f"list_sum(list_transform({a}, lambda w: list_min(list_transform({b}, "
        "lambda v: levenshtein(w, v) / greatest(length(w), length(v))))))"
        f" / len({a})"
    )


def token_score(a: str, b: str) -> str:
    """Over word lists."""
    return (
        f"CAST(trunc(100 * (1 - least({mean_of_best(a, b)}, {mean_of_best(b, a)}))) AS INTEGER)"
    )


def processed(x: str) -> str:
    return strip(f"lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'))")


def lcs(a: str, b: str) -> str:
    columns = f"list_transform(range(1, length({b}) + 1), lambda j: [j])"
    row = (
        f"list_reduce(list_prepend([0], {columns}), lambda acc, jj: list_append(acc, "
        f"CASE WHEN substr({a}, ii[1], 1) = substr({b}, jj[1], 1) THEN row[jj[1]] + 1 "
        "ELSE greatest(row[jj[1] + 1], acc[len(acc)]) END))"
    )
    zero = f"list_transform(range(0, length({b}) + 1), lambda z: 0)"
    rows = f"list_transform(range(1, length({a}) + 1), lambda i: [i])"
    return f"list_last(list_reduce(list_prepend({zero}, {rows}), lambda row, ii: {row}))"


def ratio(a: str, b: str) -> str:
    return f"CAST(round_even(200.0 * {lcs(a, b)} / (length({a}) + length({b})), 0) AS INTEGER)"


def measure_values(x: str, factors: dict[str, float] | None = None) -> str:
    factors = K.PUBLISHED_FACTORS if factors is None else factors
    c = f"translate(replace({strip(f'lower({x})')}, ' ', ''), ',''', '..')"
    unit = f"regexp_extract({c}, {q(K.MEASURE_VALUE)}, 4)"
    cases = " ".join(f"WHEN {q(u)} THEN CAST({f} AS DOUBLE)" for u, f in factors.items())
    numbers = ", ".join(f"regexp_extract({c}, {q(K.MEASURE_VALUE)}, {g})" for g in (1, 2, 3))
    return (
        f"CASE WHEN {x} IS NOT NULL THEN list_transform(list_filter([{numbers}], "
        f"lambda n: n <> ''), lambda n: CAST(n AS DOUBLE) * CASE {unit} {cases} END) END"
    )


def measures(x: str) -> str:
    return f"regexp_extract_all({x}, {q(K.MEASURE)})"


def top_or_other(rows: str, label: str, k: int) -> str:
    """Query text: rows with the k most frequent labels kept, the others collapsed."""
    return (
        f"SELECT r.* REPLACE (CASE WHEN r.{label} IS NULL OR t.{label} IS NOT NULL "
        f"THEN r.{label} ELSE 'otro' END AS {label}) FROM ({rows}) r LEFT JOIN ("
        f"SELECT {label} FROM ({rows}) WHERE {label} IS NOT NULL GROUP BY {label} "
        f"ORDER BY count(*) DESC, {label} LIMIT {k}) t ON r.{label} = t.{label}"
    )
