"""Training labels from parsed form fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill import constants as K
from casemill.functions import bio, fuzzy, measures
from casemill.functions import text as T
from casemill.operators import counts, joins


def intervention(manual: Column) -> Column:
    """Manual labels; a list that only says invalid is no label."""
    return F.when(manual != F.array(F.lit("invalid")), manual)


def multiple(raw: Column) -> Column:
    """1 when the cleaned text starts with "si", 0 with "no" (prefix match)."""
    clean = T.clean_hard(raw)
    return F.when(clean.startswith("si"), 1.0).when(clean.startswith("no"), 0.0)


def infiltrating(raw: Column) -> Column:
    clean = T.clean_hard(raw)
    return F.when(clean.startswith("infiltrant"), 1.0).when(clean.startswith("microinvasor"), 0.0)


def degree(raw: Column) -> Column:
    """Number of i in the first "grado i..iii"; 0 without one, also for null."""
    level = F.regexp_extract(T.clean_hard(raw), r"grado\s?(i{1,3})", 1)
    return F.coalesce(F.length(level), F.lit(0)).cast("long")


def histology_text(raw: Column) -> Column:
    return F.regexp_replace(T.clean_hard(raw), r"^ca\s", "carcinoma ")


def histology_class(clean: Column, no_match: str | None = None) -> Column:
    """Class of the best matching spelling; `no_match` below the cutoff, null for null."""
    spellings = [s for group in K.HISTOLOGICAL_TYPES.values() for s in group]
    classes = F.create_map(
        *[F.lit(v) for c, group in K.HISTOLOGICAL_TYPES.items() for s in group for v in (s, c)]
    )
    best = fuzzy.best_choice(clean, spellings)

    def name(b: Column) -> Column:
        hit = b["score"] >= K.HISTOLOGY_CUTOFF
        return F.when(hit, F.element_at(classes, b["match"])).otherwise(F.lit(no_match))

    return F.when(clean.isNotNull(), T.bind(best, name))


def with_histology(
    df: DataFrame, raw: str, out: str = "y_histological_type", no_match: str | None = None
) -> DataFrame:
    """Add the histological class; every distinct cleaned text is matched once."""
    df = df.withColumn("_histology", histology_text(F.col(f"`{raw}`")))
    df = joins.on_distinct(df, "_histology", {out: lambda c: histology_class(c, no_match)})
    return df.drop("_histology")


def is_cdi(histology: Column) -> Column:
    return histology == K.CDI


def degree_cdi(cdi: Column, raw_degree: Column) -> Column:
    """Degree of ductal infiltrating cases with a degree text; null otherwise."""
    return F.when(cdi & raw_degree.isNotNull(), degree(raw_degree))


def with_size_labels(df: DataFrame, text: str, form_size: str) -> DataFrame:
    """Add y_size_text_tokenized and y_size_representation.

    The first measure in the text with the same numbers as the form size is labelled. Both stay
    null without text or form size, the labels also without a match (an empty size never matches).
    """
    source, size = F.col(f"`{text}`"), F.col(f"`{form_size}`")
    df = df.withColumns(
        {
            "_spans": F.when(size.isNotNull(), measures.measure_spans(source)),
            "_size": measures.measure_value(size),
            "_tokens": F.when(source.isNotNull() & size.isNotNull(), T.tokens(source)),
        }
    )
    df = df.withColumn(
        "_hit",
        F.get(
            F.filter(
                F.col("_spans"),
                lambda s: (measures.measure_value(s["text"]) == F.col("_size"))
                & (F.size(F.col("_size")) > 0),
            ),
            0,
        ),
    )
    labels = bio.span_labels(
        F.col("_tokens"), F.col("_hit.token_start"), F.col("_hit.token_end"), K.SIZE_LABEL
    )
    return df.withColumns(
        {
            "y_size_text_tokenized": F.col("_tokens"),
            "y_size_representation": F.when(F.col("_hit").isNotNull(), labels),
        }
    ).drop("_spans", "_size", "_tokens", "_hit")


def form_labels(flat_forms: DataFrame, study: str = K.STUDY) -> DataFrame:
    """All labels that need the form alone, in one pass over the flat forms."""

    def field(name: str) -> Column:
        return F.col(f"`{name}`")

    raw_degree = field("tumor_features.histological_degree")
    df = with_histology(flat_forms, "tumor_features.histological_type")
    return df.select(
        study,
        intervention(field("intervention_manual")).alias("y_intervention"),
        multiple(field("tumor_features.is_multiple")).alias("y_is_multiple"),
        infiltrating(field("tumor_features.caracter")).alias("y_is_caracter_infiltrante"),
        degree(raw_degree).alias("y_histological_degree"),
        F.col("y_histological_type"),
        is_cdi(F.col("y_histological_type")).alias("y_is_cdi"),
        degree_cdi(is_cdi(F.col("y_histological_type")), raw_degree).alias(
            "y_histological_degree_cdi"
        ),
        field("tumor_features.size").alias("_form_size"),
    )


def histology_with_annotations(
    annotations: DataFrame, dataset: DataFrame, top_k: int, other: str = K.OTHER
) -> DataFrame:
    """Annotated and automatic (x, y) together, markers and numbers removed, rare types collapsed."""
    name = F.split_part(F.col("histological_type_classification"), F.lit("."), F.lit(2))
    annotated = annotations.filter(F.col("histological_type_classification").isNotNull()).select(
        F.col("text").alias("x"), T.strip(F.lower(name)).alias("y")
    )
    automatic = dataset.select(
        F.col("x_diagnostico").alias("x"), F.col("y_histological_type").alias("y")
    ).dropna(subset=["y"])
    both = annotated.unionByName(automatic).withColumn("x", T.strip_markers(F.col("x")))
    return counts.topk_other(both, "y", top_k, other)


def annotations_to_labels(annotations: DataFrame, section: str | None = None) -> DataFrame:
    """x_text, y_tokens, y_labels from token-span annotations.

    A section runs from the token after its heading to the next heading; the last section loses
    its final token, and a missing heading drops the row.
    """
    df = annotations.withColumn("_tokens", F.transform("tokens", lambda t: t["text"]))
    labels = bio.annotation_labels(F.col("_tokens"), F.col("spans"), K.SIZE_LABEL)
    df = df.withColumn("_labels", labels)
    rest = [c for c in annotations.columns if c not in ("text", "tokens", "spans")]
    if section is None:
        return df.select(
            *rest,
            F.col("text").alias("x_text"),
            F.col("_tokens").alias("y_tokens"),
            F.col("_labels").alias("y_labels"),
        )
    at = K.SECTION_HEADINGS.index(section)
    start = F.array_position("_tokens", section)
    if at + 1 < len(K.SECTION_HEADINGS):
        end = F.array_position("_tokens", K.SECTION_HEADINGS[at + 1])
    else:
        end = F.size("_tokens").cast("long")
    df = df.withColumns({"_start": start, "_end": end}).filter("_start > 0 and _end > 0")
    length = F.greatest(F.col("_end") - F.col("_start") - 1, F.lit(0)).cast("int")
    begin = (F.col("_start") + 1).cast("int")
    cropped = df.withColumns(
        {c: F.slice(c, begin, length) for c in ("_tokens", "_labels")}
    )
    return cropped.select(
        *rest,
        F.array_join("_tokens", " ").alias("x_text"),
        F.col("_tokens").alias("y_tokens"),
        F.col("_labels").alias("y_labels"),
    )


def label_columns() -> Sequence[str]:
    return (
        "y_intervention", "y_is_multiple", "y_is_caracter_infiltrante", "y_histological_degree",
        "y_histological_type", "y_is_cdi", "y_histological_degree_cdi",
        "y_size_text_tokenized", "y_size_representation",
    )
