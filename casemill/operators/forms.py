"""Whole form layouts over a table of form texts.

Each step adds plain columns, so that a section text is computed once and then read by all of the
fields in it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from casemill import constants as K
from casemill.functions import forms, fuzzy
from casemill.functions import text as T
from casemill.operators import filters, joins


def interventions(df: DataFrame, form_text: str, manual: DataFrame | None = None) -> DataFrame:
    """Add intervention_raw, intervention_automatic and intervention_manual."""
    prepared = forms.prepare(F.col(f"`{form_text}`"))
    raw = T.blank_to_null(forms.intervention_raw(prepared))
    return _labelled(df.withColumn("intervention_raw", raw), manual)


def _labelled(df: DataFrame, manual: DataFrame | None, prefix: str = "") -> DataFrame:
    """Automatic labels, computed once per distinct intervention text, and manual ones."""
    raw, auto, hand = (prefix + n for n in _INTERVENTION_NAMES)
    df = joins.on_distinct(df, raw, {auto: fuzzy.fuzzy_labels})
    df = df.withColumn(auto, F.when(F.size(auto) > 0, F.col(auto)))
    if manual is None:
        return df.withColumn(hand, F.lit(None).cast("array<string>"))
    return joins.manual_labels(df, manual, raw, hand)


def layout1(
    df: DataFrame, form_text: str, manual: DataFrame | None = None, out: str = "form"
) -> DataFrame:
    """Add the parsed first layout as one struct, nulls for everything absent or empty.

    All fields are parsed before the joins by intervention text: a text that very many forms
    share then moves parsed rows only, and no parsing waits on its partition.
    """
    return _layout1(df.withColumn("_t", forms.prepare(F.col(f"`{form_text}`"))), manual, out)


def _layout1(df: DataFrame, manual: DataFrame | None, out: str) -> DataFrame:
    """`layout1` of the prepared text `_t`, which is left out of the result."""
    kept = [c for c in df.columns if c != "_t"]
    df = df.withColumns(
        {f"_s_{key}": forms.section("_t", titles) for key, titles in K.SECTIONS.items()}
    )
    leaves = layout1_leaves()
    raw = T.blank_to_null(forms.intervention_raw(F.col("_t")))
    df = df.select(
        *kept, raw.alias("_i_intervention_raw"), *[c.alias(f"_f_{n}") for n, c in leaves.items()]
    )
    df = _labelled(df, manual, "_i_")
    return df.select(
        *[F.col(f"`{c}`") for c in kept],
        F.expr(_struct([*_INTERVENTION_FIELDS, *_nested(list(leaves))])).alias(out),
    )


def layout1_leaves() -> dict[str, Column]:
    """Dotted field name -> expression over `_t` and the section columns."""
    t = F.col("_t")
    tumor, parenchyma, nodes, hormone, her2 = (F.col(f"_s_{k}") for k in K.SECTIONS)
    leaves: dict[str, Column] = {}
    for (name, *_), c in zip(K.SIMPLE_FIELDS, forms.fields(t, K.SIMPLE_FIELDS), strict=True):
        leaves[name] = c
    size, place = forms.tumor_size_location(tumor)
    leaves["tumor_features.size"], leaves["tumor_features.location"] = size, place
    names = ("n_tumors", "location", "biggest_size")
    for name, c in zip(names, forms.tumor_multiple(tumor), strict=True):
        leaves[f"tumor_features.multiple.{name}"] = c
    for (name, *_), c in zip(K.TUMOR_FIELDS, forms.fields(tumor, K.TUMOR_FIELDS), strict=True):
        leaves[f"tumor_features.{name}"] = c
    leaves["parenquima_features.type"] = forms.parenchyma_type(parenchyma)
    found = forms.fields(parenchyma, K.PARENCHYMA_FIELDS)
    for (name, *_), c in zip(K.PARENCHYMA_FIELDS, found, strict=True):
        leaves[f"parenquima_features.{name}"] = c
    for (name, *_), c in zip(K.NODE_FIELDS, forms.fields(nodes, K.NODE_FIELDS), strict=True):
        leaves[f"ganglion_features.{name}"] = c
    leaves["ganglion_features.n_ganglions_lvl"] = forms.node_levels(nodes)
    for name, c in zip(("re", "rp"), forms.hormone(hormone), strict=True):
        leaves[f"hormone_receptors.{name}"] = c
    for name, c in zip(("result", "score"), forms.her2(her2), strict=True):
        leaves[f"inmunohistochemical_study.{name}"] = c
    leaves["pt"], leaves["pn"] = forms.stage(t)
    return leaves


# The structs are written as SQL text: one short call instead of one per field.
_INTERVENTION_NAMES = ("intervention_raw", "intervention_automatic", "intervention_manual")
_INTERVENTION_FIELDS = [(n, f"`_i_{n}`") for n in _INTERVENTION_NAMES]


def _struct(fields: Sequence[tuple[str, str]]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {x}" for n, x in fields) + ")"


def _any_set(columns: Sequence[str]) -> str:
    return " OR ".join(f"{c} IS NOT NULL" for c in columns)


def _nested(names: Sequence[str], prefix: str = "") -> list[tuple[str, str]]:
    """Structs out of the materialised `_f_<dotted name>` columns; null when all parts are null."""
    fields: dict[str, str] = {}
    for name in names:
        if not name.startswith(prefix):
            continue
        head, dot, _ = name[len(prefix) :].partition(".")
        if head in fields:
            continue
        if not dot:
            fields[head] = f"`_f_{name}`"
            continue
        inner = prefix + head + "."
        parts = [f"`_f_{leaf}`" for leaf in names if leaf.startswith(inner)]
        fields[head] = f"CASE WHEN {_any_set(parts)} THEN {_struct(_nested(names, inner))} END"
    return list(fields.items())


def layout2(
    df: DataFrame,
    form_text: str,
    manual: DataFrame | None = None,
    out: str = "form",
    single_pattern: bool = False,
) -> DataFrame:
    """Add the parsed second layout; empty captures stay empty strings."""
    kept = df.columns
    df = df.withColumn("_t", forms.prepare(F.col(f"`{form_text}`")))
    parse = forms.layout2_single_fields if single_pattern else forms.layout2_fields
    found = parse(F.col("_t"))
    raw = T.blank_to_null(forms.intervention_raw(F.col("_t")))
    columns = {"_i_intervention_raw": raw}
    columns |= {f"_f_tumor_features.{n}": c for n, c in found.items()}
    df = _labelled(df.withColumns(columns), manual, "_i_")
    nested = _nested([f"tumor_features.{n}" for n in found])
    return df.select(
        *[F.col(f"`{c}`") for c in kept],
        F.expr(_struct([*_INTERVENTION_FIELDS, *nested])).alias(out),
    )


def both_layouts(df: DataFrame, form_text: str, manual: DataFrame | None = None) -> DataFrame:
    """One row per form and layout in a shared schema: kept columns, `layout` (1 or 2), `form`.

    The interventions, which both layouts read the same way, are computed once.
    """
    second = forms.layout2_fields(F.col("_t"))
    both = df.withColumn("_t", forms.prepare(F.col(f"`{form_text}`"))).withColumns(
        {f"_g_{n}": c for n, c in second.items()}
    )
    wide = _layout1(both, manual, "_first")
    whole = wide.schema["_first"].dataType
    tumor = whole["tumor_features"].dataType.fields
    extra = [n for n in second if n not in {f.name for f in tumor}]

    def null_of(kind: ST.DataType) -> str:
        return f"CAST(NULL AS {kind.simpleString()})"

    tumor1 = [(f.name, f"_first.tumor_features.`{f.name}`") for f in tumor]
    tumor1 += [(n, null_of(ST.StringType())) for n in extra]
    tumor2 = [(f.name, f"`_g_{f.name}`" if f.name in second else null_of(f.dataType)) for f in tumor]
    tumor2 += [(n, f"`_g_{n}`") for n in extra]
    present2 = _any_set([f"`_g_{n}`" for n in second])

    def form(layout: int) -> str:
        parts = []
        for f in whole.fields:
            if f.name == "tumor_features" and layout == 1:
                value = f"CASE WHEN _first.tumor_features IS NOT NULL THEN {_struct(tumor1)} END"
            elif f.name == "tumor_features":
                value = f"CASE WHEN {present2} THEN {_struct(tumor2)} END"
            elif layout == 1 or f.name in _INTERVENTION_NAMES:
                value = f"_first.`{f.name}`"
            else:
                value = null_of(f.dataType)
            parts.append((f.name, value))
        return _struct([("layout", str(layout)), ("form", _struct(parts))])

    kept = [f"`{c}`" for c in df.columns]
    return wide.selectExpr(*kept, f"inline(array({form(1)}, {form(2)}))")


def leaf_paths(
    kind: ST.DataType, at: str, path: str = ""
) -> Iterator[tuple[str, str, ST.DataType]]:
    """(dotted path, SQL text, type) of every leaf of a nested column; lists and maps are leaves."""
    if isinstance(kind, ST.StructType):
        for f in kind.fields:
            inner = f"{path}.{f.name}" if path else f.name
            yield from leaf_paths(f.dataType, f"{at}.`{f.name}`", inner)
    else:
        yield path, at, kind


def flatten(df: DataFrame, form: str = "form", keep: Sequence[str] = (K.STUDY,)) -> DataFrame:
    """Nested form to dotted columns: plain fields first, then nested ones, each sorted."""
    paths = {p: x for p, x, _ in leaf_paths(df.schema[form].dataType, f"`{form}`")}
    ordered = sorted(sorted(paths), key=lambda p: "." in p)
    return df.select(*keep, *[F.expr(paths[p]).alias(p) for p in ordered])


def pruned(df: DataFrame, form: str = "form") -> DataFrame:
    return filters.prune_nulls(df, [form])
