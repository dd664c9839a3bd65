"""Parsing of report forms embedded in free text, as native Column expressions.

Every function takes the prepared form text (`prepare`: lower case, stripped) or the text of one
section. Whole layouts are assembled in `operators.forms`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions import text as T

LINES = "(?md)"  # ^ and $ at \n only


def prepare(c: Column) -> Column:
    return T.strip(F.lower(c))


def has_form(c: Column) -> Column:
    return F.contains(F.lower(c), F.lit(K.FORM_START))


def lines(c: Column) -> Column:
    """Stripped lines without blank ones."""
    return F.filter(F.transform(F.split(c, "\n"), T.strip), lambda x: x != "")


def _quote(literal: str) -> str:
    return r"\Q" + literal + r"\E"


def _found(c: Column, pattern: str, group: int) -> Column:
    """Stripped group of the first match, null when there is none."""
    whole = F.regexp_substr(c, F.lit(pattern))
    return T.strip(F.regexp_extract(whole, pattern, group) if group else whole)


def _line_of(c: Column, phrase: str, skip: int = 0) -> Column:
    """The first line with `phrase`, or the line after it and any empty lines; "" when there is none.

    Found by searches for fixed strings alone: what is before the phrase ends with the line's
    beginning, what follows starts with its rest.
    """
    # no field's title has a line break, so its first place is in the first line that has it
    before = F.substring_index(c, phrase, 1)

    def cut(p: Column) -> Column:
        rest = F.substr(p["c"], F.length(p["before"]) + 1)
        tail = F.substring_index(rest, "\n", 1)
        if skip == 0:
            return F.concat(F.substring_index(p["before"], "\n", -1), tail)
        following = F.substr(rest, F.length(tail) + 1)
        return F.substring_index(F.ltrim(following, F.lit("\n")), "\n", 1)

    found = T.bind(F.struct(c.alias("c"), before.alias("before")), cut)
    return F.when(c.isNotNull(), F.when(F.contains(c, F.lit(phrase)), found).otherwise(""))


def get_line(c: Column, phrase: str, skip: int = 0, deletes: Sequence[str] = ()) -> Column:
    """The first line with `phrase`, or the next non-empty line, with regexes deleted.

    Null when there is no such line.
    """
    if skip not in (0, 1):
        raise ValueError("a value is on the line of its title or on the next one")
    value = T.strip(_line_of(c, phrase, skip))
    for d in deletes:
        if re.escape(d) == d.replace(" ", r"\ ").replace("-", r"\-"):
            value = F.replace(value, F.lit(d), F.lit(""))
        else:
            value = F.regexp_replace(value, "(?U)" + d, "")
    return T.blank_to_null(T.strip(value))


def section(text: str, titles: Sequence[str]) -> Column:
    """Text after a title up to the first *listed* later title that occurs anywhere; else the rest.

    `text` names the prepared column.
    """
    cases = []
    for title in titles:
        body = f"split_part(`{text}`, {T.sql_literal(title)}, 2)"
        cuts = " ".join(
            f"WHEN contains(`{text}`, {t}) THEN split_part({body}, {t}, 1)"
            for t in map(T.sql_literal, K.TITLES[K.TITLES.index(title) + 1 :])
        )
        cases.append(
            f"WHEN contains(`{text}`, {T.sql_literal(title)}) THEN CASE {cuts} ELSE {body} END"
        )
    return T.strip(F.expr(f"CASE {' '.join(cases)} END"))


def fields(c: Column, table: Sequence[tuple[str, str, int, Sequence[str]]]) -> list[Column]:
    return [get_line(c, phrase, skip, deletes).alias(name) for name, phrase, skip, deletes in table]


def intervention_raw(c: Column) -> Column:
    """Cleaned text after the form start; the second line when the first is empty.

    A second line that is already the next field gives null.
    """
    body = F.substring(c, F.instr(c, K.FORM_START), F.length(c))
    found = F.struct(body.alias("body"), F.substring_index(body, "\n", 1).alias("line"))

    def pick(p: Column) -> Column:
        # only two lines are needed: all others stay uncut
        first = T.strip(F.replace(T.strip(p["line"]), F.lit(K.FORM_START), F.lit("")))
        rest = F.ltrim(F.substr(p["body"], F.length(p["line"]) + 1), F.lit(K.WHITESPACE))
        second = T.blank_to_null(T.strip(F.substring_index(rest, "\n", 1)))
        next_field = F.lit(False)
        for mark in K.NEXT_FIELD_MARKS:
            next_field = next_field | F.contains(second, F.lit(mark))
        return F.when(first != "", first).when(~next_field, second)

    return F.when(F.contains(c, F.lit(K.FORM_START)), T.clean_hard(T.bind(found, pick)))


def tumor_size_location(c: Column) -> tuple[Column, Column]:
    line = get_raw_line(c, "- tamaño:")
    rest = F.replace(line, F.lit("- tamaño:"), F.lit(""))
    size = T.strip(F.split_part(rest, F.lit("localización:"), F.lit(1)))
    place = T.strip(F.split_part(rest, F.lit("localización:"), F.lit(2)))
    return T.blank_to_null(size), T.blank_to_null(place)


def get_raw_line(c: Column, phrase: str) -> Column:
    return T.strip(_line_of(c, phrase))


# A line of the multiple-tumor block. `location` takes everything up to the end of the line.
_MULTIPLE = r"^(?=[^\n]*- si es múltiple:)[^\n]*?nº de tumores:([^\n]*)localización:([^\n]*)$"


def tumor_multiple(c: Column) -> list[Column]:
    """n_tumors, location and biggest_size (on that line or a later one)."""
    block = LINES + _MULTIPLE
    biggest = (
        LINES
        + r"^(?=[^\n]*- si es múltiple:)(?=[^\n]*nº de tumores:[^\n]*localización:)"
        + r"[\s\S]*?tamaño del mayor:([^\n]*)$"
    )
    parts = [(block, 1), (block, 2), (biggest, 1)]
    return [T.blank_to_null(T.strip(F.regexp_extract(c, p, group))) for p, group in parts]


def parenchyma_type(c: Column) -> Column:
    """First line (a lone ":" is skipped) unless it is already one of the later fields."""
    first = T.strip(F.regexp_extract(c, rf"^(?::[^\S\n]*\n+)?([^\n]*)", 1))
    taken = F.lit(False)
    for _, phrase, _, _ in K.PARENCHYMA_FIELDS:
        taken = taken | F.contains(first, F.lit(phrase))
    value = T.strip(F.replace(first, F.lit("-"), F.lit("")))
    return F.when(~taken & (c != ":"), T.blank_to_null(value))


def node_levels(c: Column) -> Column:
    """Map level_1.. -> count, from the lines with `*nivel` after the heading."""
    after = F.regexp_extract(
        c, rf"{LINES}^[^\n]*{_quote(K.NODE_LEVELS_HEADING)}[^\n]*\n([\s\S]*)", 1
    )
    rows = F.filter(F.split(after, "\n"), lambda x: F.contains(x, F.lit("*nivel")))
    entries = F.transform(
        rows,
        lambda x, i: F.struct(
            F.concat(F.lit("level_"), (i + 1).cast("string")).alias("key"),
            T.strip(
                F.replace(T.strip(x), F.concat(F.lit("*nivel "), F.repeat(F.lit("i"), i + 1)), F.lit(""))
            ).alias("value"),
        ),
    )
    kept = F.filter(entries, lambda e: e["value"] != "")
    return F.when(F.size(kept) > 0, F.map_from_entries(kept))


def _stripped_lines(c: Column, wanted: Callable[[Column], Column]) -> Column:
    """The wanted lines, stripped; `wanted` must not depend on white space at the ends."""
    return F.transform(F.filter(F.split(c, "\n"), wanted), T.strip)


def hormone(c: Column) -> list[Column]:
    """re and rp of the last result line; rp may come from an earlier line."""
    rows = _stripped_lines(
        c, lambda x: F.contains(x, F.lit("resultado:")) & F.contains(x, F.lit("re:"))
    )
    with_rp = F.filter(rows, lambda x: F.contains(x, F.lit("rp:")))

    def part(x: Column, n: int) -> Column:
        after = F.split_part(x, F.lit("re:"), F.lit(2))
        return T.blank_to_null(T.strip(F.split_part(after, F.lit("rp:"), F.lit(n))))

    return [part(F.try_element_at(rows, F.lit(-1)), 1), part(F.try_element_at(with_rp, F.lit(-1)), 2)]


def her2(c: Column) -> list[Column]:
    """result and score of the last result line; the score may come from an earlier line."""
    rows = _stripped_lines(c, lambda x: F.contains(x, F.lit("resultado:")))
    with_score = F.filter(rows, lambda x: F.contains(x, F.lit("(puntuación:")))

    def part(x: Column, n: int) -> Column:
        after = F.split_part(x, F.lit("resultado:"), F.lit(2))
        return F.split_part(after, F.lit("(puntuación:"), F.lit(n))

    result = T.strip(part(F.try_element_at(rows, F.lit(-1)), 1))
    score = F.replace(part(F.try_element_at(with_score, F.lit(-1)), 2), F.lit(")"), F.lit(""))
    return [T.blank_to_null(result), T.blank_to_null(T.strip(score))]


def stage(c: Column) -> list[Column]:
    """pt and pn of the first line with `- pt`."""
    line = get_raw_line(c, "- pt")
    has_pn = F.contains(line, F.lit("pn"))
    pt = F.when(has_pn, F.regexp_extract(line, r"- pt([^\n]*)pn", 1)).otherwise(
        F.regexp_extract(line, r"pt([^\n]*)", 1)
    )
    pn = F.when(has_pn, F.regexp_extract(line, r"pn([^\n]*)", 1))
    return [T.blank_to_null(T.strip(pt)), T.blank_to_null(T.strip(pn))]


def layout2_fields(c: Column) -> dict[str, Column]:
    """The numbered fields; each ends at any other numbered title or a numbered end of text.

    One search for any numbered title comes first: a text of the other layout has none.
    """
    numbered = F.regexp_like(c, F.lit(rf"{K.NUMBERED}(?:" + "|".join(K.LAYOUT2_TITLES.values()) + ")"))
    found = {}
    for name, title in K.LAYOUT2_TITLES.items():
        others = [t for n, t in K.LAYOUT2_TITLES.items() if n != name] + [K.LAYOUT2_LAST]
        pattern = (
            rf"{K.NUMBERED}{title}:?{K.SPACE}*([\s\S]*?){K.NUMBERED}(?:" + "|".join(others) + ")"
        )
        found[name] = F.when(numbered, _found(c, pattern, 1))
    return found


_SEPARATOR = "\x00\x01\x02"


def layout2_single_fields(c: Column) -> dict[str, Column]:
    """Strict variant: one pattern with every field in order, all null when any is missing."""
    names = ["histological_degree" if n == "van_nuys_degree" else n for n in K.LAYOUT2_TITLES]
    pattern = "".join(
        rf"{K.NUMBERED}{title}:?{K.SPACE}*([\s\S]*)" for title in K.LAYOUT2_TITLES.values()
    )
    last = "microcalcificaciones"
    pattern += K.NUMBERED + last
    # all groups out of one match: the match alone, then its groups joined by a separator
    whole = F.when(F.contains(c, F.lit(last)), F.regexp_substr(c, F.lit(pattern)))
    groups = _SEPARATOR.join(f"${i}" for i in range(1, len(names) + 1))
    parts = F.split(F.regexp_replace(whole, pattern, groups), _SEPARATOR)
    return {name: T.strip(F.get(parts, i)) for i, name in enumerate(names)}
