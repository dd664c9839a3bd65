"""Personal data replaced by keyed surrogates of the same kind, in DataFrame functions alone.

Entities are found by patterns. Every distinct entity of the corpus gets one surrogate: the same one
wherever and however formatted it occurs (coreference), another one than every other entity's
(distinctness), and none that is itself a real entity. Candidates come from keyed digests; those
that collide are drawn again until none is left. A surrogate keeps kind, gender, script, case and
layout: digits stay digits, letters letters of their script, separators stay where they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.session import written

#: Copies of the surrogate table in its join with the occurrences: an entity that a third of all
#: documents name is spread over as many tasks.
SALTS = 16
#: Rounds that keep an entity's length (names: their four syllables a word in the first alone);
#: each later one draws from longer surrogates, so that there are enough for any number of entities.
SAME_LENGTH = 4

_EDGE = r"(?<![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_ADDRESS = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\p{{N}}|\.\d)"
_NUMBER = r"\d{3}-\d{2}-\d{4}(?!\d)"
# What begins after a blank is another entity, not a further group of digits.
_OTHER = rf"(?!{_ADDRESS}|{_NUMBER}|\d{{13}})"
_CALL = r"(?!\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}(?!\d)|\d{4}(?:[ -]\d{4}){3}(?!\d|[ -]\d{4}(?!\d)))"
_GROUP = rf"(?:\.|[ -]{_OTHER}{_CALL})"
# A word of a name goes up to its edge: inner capitals, all capitals, hyphens, apostrophes; or an initial.
_WORD = r"(?:\p{Lu}\.(?= \p{Lu})|\p{Lu}[\p{L}\p{M}]*+(?:[-’'][\p{L}\p{M}]++)*+)"
# Small words between those of a name (fixed).
_PARTICLES = (
    "de del della di da do das dos du des la las le los van von der den dem ter ten zu zum zur af av bin ibn al el"
).split()

# Titles that tell a gender (fixed), the two lists side by side: male, female.
TITLES = {
    "m": ["Mr.", "Mr", "Herrn", "Herr", "Monsieur", "M.", "Señor", "Sr.", "г-н", "господин", "κύριος"],
    "f": ["Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Señorita", "Sra.",
          "г-жа", "госпожа", "κυρία"],
}
# Given names by script and gender (fixed).
GIVEN = {
    "latin": {
        "m": ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Gustav", "Hugo", "Ivan", "Jonas",
              "Karim", "Leon", "Martin", "Noah", "Oskar", "Paul"],
        "f": ["Anna", "Berta", "Clara", "Diana", "Emma", "Frida", "Greta", "Helena", "Ines", "Julia",
              "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    },
    "cyrillic": {
        "m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим",
              "Никита", "Олег", "Павел", "Роман", "Степан", "Тимур"],
        "f": ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Инна", "Ксения", "Лидия", "Мария",
              "Нина", "Ольга", "Полина", "Римма", "София", "Тамара"],
    },
    "greek": {
        "m": ["Άρης", "Βασίλης", "Γιάννης", "Δήμος", "Ηλίας", "Θωμάς", "Κώστας", "Λεωνίδας", "Μάρκος",
              "Νίκος", "Πέτρος", "Σπύρος", "Στέφανος", "Τάσος", "Φώτης", "Χρήστος"],
        "f": ["Άννα", "Βάσω", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηρώ", "Θάλεια", "Ιωάννα", "Κατερίνα",
              "Λίνα", "Μαρία", "Νίκη", "Σοφία", "Τασία", "Χριστίνα"],
    },
}
# Syllables that family names are made of, by script (fixed).
SYLLABLES = {
    "latin": "ba den for gal hol ker lan mar nes per ron sal ter vin wel zan".split(),
    "cyrillic": "ба ве го ди жа зе ка ло ми на по ро са ту фе че".split(),
    "greek": "βα γε δο ζη θα κε λο μα νι πα ρο σα τε φι χα ψη".split(),
}

_TITLE = "|".join(t.replace(".", "[.]") for ts in TITLES.values() for t in ts)
# Kinds in the order in which they are looked for. Loops over groups are possessive or bounded: in
# very long texts others would overrun the stack.
PATTERNS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}][\p{L}\p{N}-]*+(?:\.[\p{L}\p{N}][\p{L}\p{N}-]*+)++",
    "secret": r"(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[a-z]_[0-9A-Za-z]{36})(?![\p{L}\p{N}])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])".replace(" ?", rf"(?: {_OTHER})?"),
    "card": (
        r"(?:\d{13,19}(?![\p{L}\p{N}])"
        rf"|\d{{4}}(?:[ -]\d{{4}}){{3}}(?:[ -]{_OTHER}\d{{1,3}}(?![\p{{L}}\p{{N}}])(?![ .-]\d))?(?![\p{{L}}\p{{N}}])"
        rf"|\d(?:(?:[ -]{_OTHER}{_CALL})?\d){{12,18}}(?![\p{{L}}\p{{N}}]))"
    ),
    "address": _ADDRESS,
    "number": _NUMBER,
    "phone": (
        r"(?:\+\d{8,15}(?!\d)"
        rf"|\+\d(?:(?:{_GROUP}|[ -]?[()][ .-]?)?\d){{7,14}}(?!\d|\.\d)(?![ -]{_OTHER}{_CALL}\d)"
        rf"|(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{2,4}}\)|\d{{2,4}})[ .-]?\d{{3,4}}{_GROUP}\d{{3,4}}"
        rf"(?:{_GROUP}\d{{2,4}}(?!\d|\.\d))?(?!\d))"
    ),
    "name": (
        rf"(?:{_TITLE}) (?:(?:{'|'.join(_PARTICLES)}) ){{0,3}}(?!(?:{_TITLE}) ){_WORD}"
        rf"(?: (?:(?:{'|'.join(_PARTICLES)}) ){{0,3}}(?!(?:{_TITLE}) |[\p{{L}}\p{{N}}._%+-]++@){_WORD}(?![\p{{L}}\p{{M}}\p{{N}}]))*+"
    ),
}
ANY = _EDGE + "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"


def kind_of(surface: Column) -> Column:
    whole = reduce(
        lambda when, k: when.when(surface.rlike(f"^(?:{PATTERNS[k]})$"), k),
        PATTERNS,
        F.when(F.lit(False), F.lit("")),
    )
    return whole.otherwise("other")


def _title(surface: Column) -> Column:
    return F.substring_index(surface, " ", 1)


def canonical(kind: Column, surface: Column) -> Column:
    """What makes two mentions one entity: digits alone, lower case, or gender, script and name."""
    digits = F.regexp_replace(surface, r"\D", "")
    bare = F.substr(surface, F.length(_title(surface)) + 2)
    name = F.concat(_gender(surface), F.lit("/"), _script(bare), F.lit("/"), F.lower(bare))
    return (
        F.when(kind.isin("card", "number"), digits)
        .when(kind == "phone", F.concat(F.when(surface.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "iban", F.replace(surface, F.lit(" "), F.lit("")))
        .when(kind == "name", name)
        .when(kind == "address", surface)
        .otherwise(F.lower(surface))
    )


def _gender(surface: Column) -> Column:
    return F.when(_title(surface).isin(TITLES["f"]), "f").otherwise("m")


def _script(text: Column) -> Column:
    return (
        F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic")
        .when(text.rlike(r"\p{IsGreek}"), "greek")
        .otherwise("latin")
    )


def _digest(key: str, attempt: int, kind: Column, entity: Column) -> Column:
    """256 hexadecimal digits that nobody can foretell without the key."""
    secret = F.lit(key)
    inner = F.sha2(F.concat_ws("\x1f", secret, F.lit(str(attempt)), kind, entity).cast("binary"), 256)
    return F.concat(
        *(F.sha2(F.concat(secret, F.lit(f"/{k}/"), inner).cast("binary"), 512) for k in range(2))
    )


def _draw(digest: Column, i: Column | int) -> Column:
    """A number from 0 to 65535 for place i (from 0)."""
    at = F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(63)) * 4 + 1
    return F.conv(F.substr(digest, at, F.lit(4)), 16, 10).cast("int")


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))) + 1)


_ALPHABETS = {
    r"\d": "0123456789",
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
    r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
}


def _same_shape(entity: Column, digest: Column, alphabets: dict[str, str], keep: Column) -> Column:
    """Each letter and digit by another of its kind; the first `keep` characters stay."""

    def one(c: Column, i: Column) -> Column:
        number = _draw(digest, i)
        changed = reduce(
            lambda when, a: when.when(
                c.rlike(a), F.substr(F.lit(alphabets[a]), F.pmod(number, F.lit(len(alphabets[a]))) + 1, F.lit(1))
            ),
            alphabets,
            F.when(i < keep, c),
        )
        return changed.otherwise(c)

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def candidate(kind: Column, entity: Column, digest: Column, attempt: int = 0) -> Column:
    """Surrogate of a canonical entity, in canonical form; longer in later attempts."""
    none = F.lit(0)
    more = max(0, attempt + 1 - SAME_LENGTH)
    # one decimal digit or letter a place, from the end of the digest
    longer = lambda values: F.concat(F.lit(""), *(_pick([*values], _draw(digest, 62 - k)) for k in range(more)))
    hexadecimal = {r"\d": "0123456789", "[a-f]": "abcdef"} | _ALPHABETS
    octets = F.array_join(F.array(*(F.pmod(_draw(digest, k), F.lit(254)) + 1 for k in range(4))), ".")
    # the country code of a phone number, of an IBAN and the end of a mail address stay
    stem = F.regexp_replace(entity, r"\.[^.@]*$", "")
    mail = F.concat(
        longer(_ALPHABETS["[a-z]"]), _same_shape(stem, digest, _ALPHABETS, none), F.substr(entity, F.length(stem) + 1)
    )
    parts = F.split(entity, "/")
    gender, script, name = F.element_at(parts, 1), F.element_at(parts, 2), F.element_at(parts, 3)
    given = reduce(
        lambda when, sg: when.when((script == sg[0]) & (gender == sg[1]), _pick(GIVEN[sg[0]][sg[1]], _draw(digest, 0))),
        [(s, g) for s in GIVEN for g in GIVEN[s]],
        F.when(F.lit(False), F.lit("")),
    )

    syllables = 4 + attempt

    def family(place: int) -> Column:
        made = lambda s: F.initcap(
            F.concat(*(_pick(SYLLABLES[s], _draw(digest, syllables * place + k + 1)) for k in range(syllables)))
        )
        return reduce(lambda when, s: when.when(script == s, made(s)), SYLLABLES, F.when(F.lit(False), ""))

    words = F.size(F.split(name, " "))
    whole = F.concat_ws(
        " ", F.when(words > 1, given), family(0), F.when(words > 2, family(1))
    )
    digits = longer("0123456789")
    shape = lambda alphabets, keep: F.concat(_same_shape(entity, digest, alphabets, keep), digits)
    return (
        F.when(kind == "email", mail)
        .when(kind == "secret", shape(hexadecimal, none))
        .when(kind == "address", F.concat(octets, F.lit(":"), digits) if more else octets)
        .when(kind == "iban", shape(_ALPHABETS, F.lit(2)))
        .when(kind == "phone", shape(_ALPHABETS, F.when(entity.startswith("+"), 2).otherwise(0)))
        .when(kind == "name", whole)
        .otherwise(shape(_ALPHABETS, none))
    )


def in_layout(kind: Column, surface: Column, surrogate: Column) -> Column:
    """The canonical surrogate with the layout of one mention: separators, spaces, case, title."""
    count = lambda i: F.length(
        F.regexp_replace(F.substr(surface, F.lit(1), i + 1), r"[^\p{L}\p{N}]", "")
    )
    letters = F.regexp_replace(surrogate, r"[^\p{L}\p{N}]", "")

    def one(i: Column) -> Column:
        c = F.substr(surface, i + 1, F.lit(1))
        return F.when(c.rlike(r"[\p{L}\p{N}]"), F.substr(letters, count(i), F.lit(1))).otherwise(c)

    filled = F.array_join(F.transform(F.sequence(F.lit(0), F.length(surface) - 1), one), "")
    # a surrogate longer than the mention goes on at its end
    filled = F.concat(filled, F.substr(letters, count(F.length(surface)) + 1))
    bare = F.substr(surface, F.length(_title(surface)) + 2)
    upper = (bare == F.upper(bare)) & (bare != F.lower(bare))
    return (
        F.when(kind.isin("card", "number", "phone", "iban"), filled)
        .when(kind == "name", F.concat(_title(surface), F.lit(" "), F.when(upper, F.upper(surrogate)).otherwise(surrogate)))
        .when(kind == "address", surrogate)
        .when((surface == F.upper(surface)) & (surface != F.lower(surface)), F.upper(surrogate))
        .otherwise(surrogate)
    )


def _form(kind: Column, text: Column) -> Column:
    """In what entities and surrogates are compared: names by their letters alone, in lower case."""
    return F.when(kind == "name", F.lower(F.element_at(F.split(text, "/"), -1))).otherwise(text)


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """kind, entity, surrogate for distinct (kind, entity): no two alike, none a real entity.

    Each round draws for the entities that have none yet. Of those that draw the same, the least
    keeps it; draws that an earlier round gave away or that are real entities are void. Later rounds
    draw from ever more surrogates, so that they end for any number of entities; each stores its table.
    """
    kind = F.col("kind")
    real = entities.select("kind", _form(kind, F.col("entity")).alias("form"))
    done, left, attempt = None, entities, 0
    while True:
        # a column of its own: it is read for every character
        digest = _digest(key, attempt, kind, F.col("entity"))
        drawn = (
            left.withColumn("digest", digest)
            .withColumn("surrogate", candidate(kind, F.col("entity"), F.col("digest"), attempt))
            .withColumn("form", _form(kind, F.col("surrogate")))
        )
        taken = real if done is None else real.union(done.select("kind", _form(kind, F.col("surrogate"))))
        first = (
            drawn.groupBy("kind", "form")
            .agg(F.min(F.struct("entity", "surrogate")).alias("least"))
            .join(taken, ["kind", "form"], "left_anti")
            .select("kind", "least.entity", "least.surrogate")
        )
        first = written(first, "surrogates")
        left = written(left.join(first, ["kind", "entity"], "left_anti"), "without-surrogate")
        done = first if done is None else done.union(first)
        if left.isEmpty():
            return done
        attempt += 1


def replace(
    docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """`docs` with every entity in the text column replaced, and the column `n_entities`.

    All other columns and rows stay as they are, but `n_entities`, which is replaced if it is
    there. Null and empty texts stay; rows may repeat, ids may be null. No entities: texts stay.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    row = docs.select(F.struct(*columns).alias("row")).select(
        "row",
        F.coalesce(F.col(f"row.`{id_column}`").cast("string"), F.lit("")).alias("id"),
        F.col(f"row.`{text_column}`").cast("string").alias("text"),
    )
    keyed = row.withColumn("hash", F.xxhash64("text"))
    found = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    mentions = written(
        keyed.select("id", "hash", found.alias("found"))
        .where(F.size("found") > 0)
        .dropDuplicates(["id", "hash"])
        .select("id", "hash", F.posexplode("found").alias("place", "surface"))
        .withColumn("kind", kind_of(F.col("surface")))
        .withColumn("entity", canonical(F.col("kind"), F.col("surface"))),
        "mentions",
    )
    table = assigned(mentions.select("kind", "entity").distinct(), key)
    salt = F.pmod(F.xxhash64("id", "hash"), F.lit(SALTS)).cast("int")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    replaced = (
        mentions.withColumn("salt", salt)
        .join(salted, ["kind", "entity", "salt"])
        .select("id", "hash", "place", in_layout(F.col("kind"), F.col("surface"), F.col("surrogate")).alias("by"))
        .groupBy("id", "hash")
        .agg(F.array_sort(F.collect_list(F.struct("place", "by"))).alias("by"))
    )
    gaps = F.split(F.col("text"), ANY, -1)
    pieces = F.zip_with(
        gaps, F.col("by.by"), lambda gap, by: F.concat(gap, F.coalesce(by, F.lit("")))
    )
    joined = keyed.join(replaced, ["id", "hash"], "left")
    new = F.when(F.col("by").isNotNull(), F.array_join(pieces, "")).otherwise(F.col("text"))
    return joined.select(
        *((new if c == text_column else F.col(f"row.`{c}`")).alias(c) for c in columns),
        F.coalesce(F.size("by"), F.lit(0)).alias("n_entities"),
    )
