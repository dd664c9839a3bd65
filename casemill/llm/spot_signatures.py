"""Document fingerprints from spot signatures, in DataFrame functions alone.

A spot is a common word (anchor) before a content word and the chain of content words that begins
there; common words in between are passed over. The set of a text's spots is its fingerprint. Likeness is the Jaccard
index of two sets; the join compares only sets in the same or in neighbouring length partitions
that share a spot of their prefixes, and leaves a pair out as soon as its lengths forbid a match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.ordering import successors
from casemill.session import written

#: Content words of a chain.
CHAIN = 2
#: In texts with fewer common words than one in so many, every content word is an anchor.
SPARSE = 20

# Common words of English, German, French and Spanish: anchors, and passed over in chains (fixed).
COMMON_WORDS = (
    "the a an of and or to in on at by for from with as is are was were be been it its this that these "
    "those he she they we you not but has have had will would can which who there their his her "
    "der die das den dem des ein eine einen einem einer und oder zu im am mit von für auf ist sind war "
    "nicht auch als sich wie aus bei nach über es er sie wir "
    "le la les un une du de et ou à au aux en dans sur par pour avec est sont il elle que qui ne pas "
    "ce cette ces son sa ses se "
    "el los las una del y al con por para no su sus lo como más pero este esta son fue"
).split()

_WORD_GAP = r"[^\p{L}\p{N}]+"
_MARK = "_"
_CONTENT = r"[^_ ][^ ]*"
# possessive: a run of common words of any length takes no stack, and is looked at once a chain
_SPOT = rf"(?=(?<![^ ])(_[^ ]+ {_CONTENT}(?:(?: _[^ ]+)*+ {_CONTENT}){{{CHAIN - 1}}})(?: |$))"


def spots(text: Column) -> Column:
    """Sorted distinct 32-bit hashes of a text's spots; its beginning counts as an anchor too.

    Where a text has fewer common words than one in `SPARSE` words, every content word with
    a next one begins a chain too, so that the spots cover all of it in any language. Texts without a spot, empty ones among them, have the hash of the whole text as
    their only one; null counts as empty.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.lower(text), _WORD_GAP), "")
    marked = F.transform(
        words, lambda w: F.when(w.isin(COMMON_WORDS), F.concat(F.lit(_MARK), w)).otherwise(w)
    )
    line = F.concat(F.lit("_^ "), F.array_join(marked, " "))
    found = F.regexp_extract_all(line, F.lit(_SPOT), F.lit(1))
    sparse = F.size(F.filter(marked, lambda w: w.startswith(_MARK))) * SPARSE < F.size(words)
    content = F.filter(words, lambda w: ~w.isin(COMMON_WORDS))
    chains = F.transform(content, lambda w: F.concat(F.lit("_* "), w))
    for k in range(1, CHAIN):  # null past the end
        chains = F.zip_with(chains, F.slice(content, k + 1, F.size(content)), lambda a, b: F.concat(a, F.lit(" "), b))
    chains = F.filter(chains, F.isnotnull)
    found = F.when(sparse, F.concat(found, chains)).otherwise(found)
    hashed = F.transform(found, lambda s: F.hash(F.regexp_replace(s, "(?<=.) _[^ ]+", "")))
    return F.array_sort(
        F.when(F.size(hashed) > 0, F.array_distinct(hashed)).otherwise(F.array(F.hash(text)))
    )


def fingerprint(spot_set: Column) -> Column:
    """The set in print: eight hexadecimal digits for each spot, in order."""
    return F.array_join(
        F.transform(spot_set, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")), ""
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two spot sets, 0 to 1."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def edited_likeness(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has the last third (in code points, rounded down) replaced by the first as many
    (or all) of the next document in descending id order, after the last the first. Null texts count
    as empty, null ids come last, ties are ordered by the hash of their text, and repeated rows are
    one row of that order and get the same result. The least long is kept for null ids. Other
    columns are not read. No rows: no rows.
    """
    texts = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63))).alias("id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    # every text's own spots are found once; as the next one's they are read again
    third = F.floor(F.length("text") / 3).cast("int").alias("third")
    stored = written(texts.select("id", "tie", third, spots(F.col("text")).alias("own")), "own-spots")
    keys = stored.groupBy("id", "tie").agg(F.max("third").alias("third"))
    own = stored.groupBy("id", "tie").agg(F.any_value("own").alias("own"))
    order = [F.desc("id"), F.asc("tie")]
    nexts = successors(keys, ["id", "tie", "third"], order)
    wanted = nexts.select(
        F.col("next_id").alias("id"), F.col("next_tie").alias("tie"),
        F.col("id").alias("of_id"), F.col("tie").alias("of_tie"), "third",
    )
    lent = (
        texts.join(wanted, ["id", "tie"])
        .join(own, ["id", "tie"])
        .select(
            F.col("of_id").alias("id"),
            F.col("of_tie").alias("tie"),
            F.struct(F.expr("left(text, third)").alias("head"), F.col("own").alias("spots")).alias("next"),
        )
        .groupBy("id", "tie")
        .agg(F.any_value("next").alias("next"))
    )
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 3)"), F.col("next.head"))
    rows = texts.join(lent, ["id", "tie"]).join(own, ["id", "tie"]).select(
        F.nullif("id", F.lit(-(2**63))).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        edited.alias("edited"),
        "own",
        F.col("next.spots").alias("next_spots"),
    )
    described = rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "own", spots(F.col("edited")).alias("edited"), "next_spots",
    )
    return described.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_spots")).alias("near_next"),
    )


def similar_pairs(
    docs: DataFrame, threshold: float = 0.8, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Pairs a < b of different spot sets with a likeness of the threshold or more, and that likeness.

    Documents with equal sets count as one, the least id (`members` gives the sets of all). Sets are
    dealt into length partitions so wide that a match lies in the same or the next one, and listed
    there under the spots of a prefix that two matching sets must share. Null ids are left out.
    """
    sets = members(docs, id_column, text_column).where("doc_id is not null")
    sets = sets.groupBy("spots").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("spots"))
    width = -math.log(threshold)
    partition = F.floor(F.log(F.col("n").cast("double")) / width + 1e-9)
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    listed = sets.withColumn("length_partition", partition).withColumn(
        "spot", F.explode(F.slice("spots", F.lit(1), prefix.cast("int")))
    )
    left = listed.select(
        "spot", F.explode(F.array(F.col("length_partition"), F.col("length_partition") + 1)).alias("k"),
        F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("length_partition").alias("k_a"),
    )
    right = listed.select(
        "spot", F.col("length_partition").alias("k"), F.col("doc_id").alias("b"), F.col("n").alias("n_b")
    )
    pairs = left.join(right, ["spot", "k"]).where("a <> b and (k_a < k or a < b)")
    pairs = pairs.where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = lambda p: sets.select(F.col("doc_id").alias(p), F.col("spots").alias(f"spots_{p}"))
    near = likeness(F.col("spots_a"), F.col("spots_b"))
    return (
        pairs.join(one("a"), "a")
        .join(one("b"), "b")
        .select("a", "b", near.alias("likeness"))
        .where(F.col("likeness") >= threshold - 1e-9)
    )


def members(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and spot set of every document."""
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), spots(F.col(text_column).cast("string")).alias("spots")
    )
