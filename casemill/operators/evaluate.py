"""Evaluation tables. Matrices are long: one row per (true, predicted) cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import bio
from casemill.operators import ranking

GRID = 512


def _ratio(numerator: Column, denominator: Column) -> Column:
    """Zero instead of a division by zero."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def confusion(
    df: DataFrame,
    true: str,
    pred: str,
    weight: str | None = None,
    labels: Sequence | None = None,
    normalize: str | None = None,
) -> DataFrame:
    """true, pred, value. With `labels` every cell of that subset, zeros included; else the
    cells that occur. `normalize` divides by the true row, the predicted column or everything."""
    if normalize not in (None, "true", "pred", "all"):
        raise ValueError(f"normalize must be 'true', 'pred', 'all' or None, not {normalize!r}")
    value = F.sum(F.col(weight)) if weight else F.count("*")
    pairs = df.select(F.col(true).alias("true"), F.col(pred).alias("pred"), *([weight] if weight else []))
    cells = pairs.groupBy("true", "pred").agg(value.alias("value"))
    if labels is not None:
        kind, zero = cells.schema["true"].dataType, F.lit(0).cast(cells.schema["value"].dataType)
        options = F.array(*[F.lit(x).cast(kind) for x in labels])
        grid = (
            df.sparkSession.range(1)
            .select(F.explode(options).alias("true"))
            .select("true", F.explode(options).alias("pred"), zero.alias("value"))
        )
        inside = cells.filter(F.col("true").isin(list(labels)) & F.col("pred").isin(list(labels)))
        cells = grid.unionByName(inside).groupBy("true", "pred").agg(F.sum("value").alias("value"))
    if normalize is None:
        return cells
    over = {"true": ["true"], "pred": ["pred"], "all": []}[normalize]
    if not over:
        total = cells.agg(F.sum("value")).scalar()
        return cells.withColumn("value", _ratio(F.col("value"), total))
    sums = cells.groupBy(*over).agg(F.sum("value").alias("_total"))
    joined = cells.join(sums, over)
    return joined.select("true", "pred", _ratio(F.col("value"), F.col("_total")).alias("value"))


def confusion_per_label(
    df: DataFrame, true: str, pred: str, labels: Sequence[str], normalize: str | None = None
) -> DataFrame:
    """One 2x2 matrix per label from 0/1 vectors: label, true, pred, value."""
    names = F.array(*[F.lit(x) for x in labels])
    rows = df.select(F.explode(F.arrays_zip(names.alias("label"), F.col(true).alias("t"),
                                            F.col(pred).alias("p"))).alias("_r"))
    rows = rows.select(
        F.col("_r")["label"].alias("label"),
        F.col("_r")["t"].cast("int").alias("true"),
        F.col("_r")["p"].cast("int").alias("pred"),
    )
    counted = rows.groupBy("label").agg(
        *[
            F.count_if((F.col("true") == t) & (F.col("pred") == p)).alias(f"c{t}{p}")
            for t in (0, 1)
            for p in (0, 1)
        ]
    )
    n = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")

    def value(t: int, p: int) -> Column:
        cell = F.col(f"c{t}{p}")
        if normalize is None:
            return cell
        base = {
            "all": n,
            "true": F.col(f"c{t}0") + F.col(f"c{t}1"),
            "pred": F.col(f"c0{p}") + F.col(f"c1{p}"),
        }[normalize]
        return _ratio(cell, base)

    cells = F.array(
        *[
            F.struct(F.lit(t).alias("true"), F.lit(p).alias("pred"), value(t, p).alias("value"))
            for t in (0, 1)
            for p in (0, 1)
        ]
    )
    return counted.select("label", F.inline(cells))


def confusion_exclusive(
    df: DataFrame, true: str, pred: str, labels: Sequence[str], classes: Sequence[str] | None = None
) -> DataFrame:
    """Matrix of labels that exclude each other: one true label required, first best prediction."""
    chosen = [i for i, x in enumerate(labels) if classes is None or x in set(classes)]
    names = F.array(*[F.lit(labels[i]) for i in chosen])

    def sub(c: str) -> Column:
        return F.array(*[F.get(F.col(c), i).cast("int") for i in chosen])

    picked = df.select(sub(true).alias("_t"), sub(pred).alias("_p"))
    total = F.aggregate("_t", F.lit(0), lambda a, x: a + x)
    problem = F.raise_error(F.lit("exactly one class must be true in every row")).cast("int")
    first_true = F.when(total == 1, F.array_position("_t", 1)).otherwise(problem).cast("int")
    first_pred = F.array_position("_p", F.array_max("_p")).cast("int")
    named = picked.select(
        F.element_at(names, first_true).alias("t"), F.element_at(names, first_pred).alias("p")
    )
    return confusion(named, "t", "p", labels=[labels[i] for i in chosen])


def _class_counts(cells: DataFrame) -> DataFrame:
    """label, tp, support, predicted from confusion cells."""
    sides = F.array(
        F.struct(F.col("true").alias("label"), F.col("value").alias("support"),
                 F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("true") == F.col("pred"), F.col("value")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("value").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )
    return (
        cells.select(F.inline(sides))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    )


def report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """label, precision, recall, f1, support per class, then accuracy, macro and weighted rows."""
    classes = _class_counts(confusion(df, true, pred))
    precision = _ratio(F.col("tp"), F.col("predicted"))
    recall = _ratio(F.col("tp"), F.col("support"))
    f1 = _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    scored = classes.select(
        F.col("label").cast("string").alias("label"), precision.alias("precision"),
        recall.alias("recall"), f1.alias("f1"), "support", "tp",
    )
    n = F.sum("support")

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / n

    accuracy = F.sum("tp") / n
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("label"), *[v.alias(k) for k, v in zip(
                ("precision", "recall", "f1"), values, strict=True)], F.col("_n").alias("support"))
            for name, values in (
                ("accuracy", [F.col("_acc")] * 3),
                ("macro avg", [F.col(f"_m_{c}") for c in ("precision", "recall", "f1")]),
                ("weighted avg", [F.col(f"_w_{c}") for c in ("precision", "recall", "f1")]),
            )
        ]
    )
    totals = scored.agg(
        n.alias("_n"),
        accuracy.alias("_acc"),
        *[F.avg(c).alias(f"_m_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"_w_{c}") for c in ("precision", "recall", "f1")],
    ).select(F.inline(rows))
    return scored.drop("tp").unionByName(totals)


def averaged_metrics(df: DataFrame, true: str, pred: str, n_labels: int, positive=1) -> DataFrame:
    """precision, recall, f1, accuracy: of the positive class for two labels, else macro."""
    classes = _class_counts(confusion(df, true, pred))
    chosen = classes if n_labels > 2 else classes.filter(F.col("label") == F.lit(positive))
    accuracy = classes.agg(F.sum("tp") / F.sum("support")).scalar()
    return chosen.agg(
        F.avg(_ratio(F.col("tp"), F.col("predicted"))).alias("precision"),
        F.avg(_ratio(F.col("tp"), F.col("support"))).alias("recall"),
        F.avg(_ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))).alias("f1"),
    ).withColumn("accuracy", accuracy)


def class_accuracy(df: DataFrame, true: str, pred: str) -> DataFrame:
    """label, support, accuracy of every true class (the table behind support against accuracy)."""
    return df.groupBy(F.col(true).alias("label")).agg(
        F.count("*").alias("support"),
        F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"),
    )


def top_classes(accuracies: DataFrame, n: int = 5) -> DataFrame:
    return accuracies.orderBy(F.desc("accuracy"), F.desc("support"), "label").limit(n)


def confused_pairs(df: DataFrame, true: str, pred: str) -> DataFrame:
    """label1 > label2 with half of the mistakes between them in both directions."""
    wrong = df.filter(F.col(true) != F.col(pred))
    return wrong.groupBy(
        F.greatest(true, pred).alias("label1"), F.least(true, pred).alias("label2")
    ).agg((F.count("*") / 2).alias("corr"))


def top_pairs(pairs: DataFrame, n: int = 5) -> DataFrame:
    return pairs.orderBy(F.desc("corr"), "label1", "label2").limit(n)


def set_correct(df: DataFrame, true: str, pred: str, out: str = "correct") -> DataFrame:
    """Whether two label lists are the same multiset."""
    return df.withColumn(out, F.array_sort(true) == F.array_sort(pred))


def set_accuracy(df: DataFrame, true: str, pred: str) -> DataFrame:
    checked = set_correct(df, true, pred)
    return checked.agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))


def set_errors(df: DataFrame, x: str, true: str, pred: str) -> DataFrame:
    wrong = set_correct(df, true, pred).filter(~F.col("correct"))
    return wrong.select(F.col(x).alias("x"), F.col(true).alias("y"), F.col(pred).alias("y_pred"))


# --- ROC --------------------------------------------------------------------------------------


def roc_thresholds(scores: DataFrame) -> DataFrame:
    """(label, score, truth) to label, score, tp, fp per distinct score with running sums.

    Input is first counted per distinct score; running sums go through score buckets. Rows without
    a score are left out. A label of one class has null rates and a null area.
    """
    scores = scores.filter(F.col("score").isNotNull())
    counted = scores.groupBy("label", "score").agg(
        F.sum("truth").alias("tp"), F.sum(1 - F.col("truth")).alias("fp")
    )
    counted = counted.withColumn("score", F.col("score").cast("double"))
    bucketed = ranking.value_bucket(counted, "score")
    return ranking.running_sums(bucketed, ["label"], "score", ["tp", "fp"])


def auc(scores: DataFrame) -> DataFrame:
    """label, auc: trapezoids under the curve."""
    steps = roc_thresholds(scores)
    # a threshold adds fp wide and between cum_tp - tp and cum_tp high
    area = F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2))
    return steps.groupBy("label").agg(
        F.try_divide(area, (F.sum("tp") * F.sum("fp")).cast("double")).alias("auc")
    )


def micro(scores: DataFrame) -> DataFrame:
    """All labels as one."""
    return scores.withColumn("label", F.lit("micro"))


def roc_points(scores: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """label, score, fpr, tpr; the origin has a null score.

    A point is intermediate when its threshold and the next one add the same numbers; the first
    and the last threshold always stay.
    """
    steps = roc_thresholds(scores)
    if drop_intermediate:
        inside = Window.partitionBy("label", "_bucket").orderBy(F.desc("score"))
        heads = steps.groupBy("label", "_bucket").agg(
            F.max_by(F.struct("tp", "fp"), "score").alias("_head")
        )
        buckets = Window.partitionBy("label").orderBy(F.desc("_bucket"))
        neighbours = heads.select(
            "label",
            "_bucket",
            F.lead("_head").over(buckets).alias("_next_head"),
            (F.row_number().over(buckets) == 1).alias("_first_bucket"),
        )
        steps = steps.withColumns(
            {
                "_next": F.lead(F.struct("tp", "fp")).over(inside),
                "_nth": F.row_number().over(inside),
            }
        ).join(neighbours, ["label", "_bucket"])
        following = F.coalesce(F.col("_next"), F.col("_next_head"))
        first = F.col("_first_bucket") & (F.col("_nth") == 1)
        turns = following.isNull() | (following != F.struct("tp", "fp"))
        steps = steps.filter(first | turns)
    totals = scores.filter(F.col("score").isNotNull()).groupBy("label").agg(
        F.sum("truth").alias("_p"), F.sum(1 - F.col("truth")).alias("_n")
    )
    points = steps.join(totals, "label").select(
        "label",
        "score",
        F.try_divide(F.col("cum_fp").cast("double"), F.col("_n").cast("double")).alias("fpr"),
        F.try_divide(F.col("cum_tp").cast("double"), F.col("_p").cast("double")).alias("tpr"),
    )
    origin = totals.select(
        "label", F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(origin)


def roc_macro(scores: DataFrame, labels: Sequence[str]) -> DataFrame:
    """fpr, tpr: mean of the label curves, each interpolated on the union of their fpr values."""
    points = roc_points(scores).filter("fpr IS NOT NULL AND tpr IS NOT NULL")
    # vertical pieces: the curve leaves a position at its highest and is entered at its lowest tpr
    edges = points.groupBy("label", "fpr").agg(F.min("tpr").alias("_in"), F.max("tpr").alias("_out"))
    grid = points.select("fpr").distinct()
    wanted = grid.select("fpr", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    at = wanted.join(edges, ["label", "fpr"], "left").withColumn(
        "_bucket", F.floor(F.col("fpr") * GRID)
    )
    known = F.col("_out").isNotNull()
    left = F.when(known, F.struct(F.col("fpr").alias("x"), F.col("_out").alias("y")))
    right = F.when(known, F.struct(F.col("fpr").alias("x"), F.col("_in").alias("y")))
    ends = at.groupBy("label", "_bucket").agg(
        F.max_by(left, F.when(known, F.col("fpr"))).alias("_l"),
        F.min_by(right, F.when(known, F.col("fpr"))).alias("_r"),
    )
    buckets = Window.partitionBy("label").orderBy("_bucket")
    carried = ends.select(
        "label",
        "_bucket",
        F.last("_l", True).over(buckets.rowsBetween(Window.unboundedPreceding, -1)).alias("_l0"),
        F.first("_r", True).over(buckets.rowsBetween(1, Window.unboundedFollowing)).alias("_r0"),
    )
    inside = Window.partitionBy("label", "_bucket").orderBy("fpr")
    filled = at.select(
        "label", "fpr", "_bucket", "_out",
        F.last(left, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_l1"),
        F.first(right, True).over(inside.rowsBetween(0, Window.unboundedFollowing)).alias("_r1"),
    ).join(carried, ["label", "_bucket"])
    a, b = F.coalesce("_l1", "_l0"), F.coalesce("_r1", "_r0")
    slope = (b["y"] - a["y"]) / (b["x"] - a["x"])
    y = F.coalesce(F.col("_out"), a["y"] + slope * (F.col("fpr") - a["x"]))
    return filled.groupBy("fpr").agg((F.sum(y) / len(labels)).alias("tpr"))


def curve_area(points: DataFrame, out: str = "auc") -> DataFrame:
    """Trapezoids under one (fpr, tpr) curve with distinct fpr values in [0, 1]."""
    bucketed = points.withColumn("_bucket", F.floor(F.col("fpr") * GRID))
    inside = Window.partitionBy("_bucket").orderBy("fpr")
    point = F.struct("fpr", "tpr")
    tails = bucketed.groupBy("_bucket").agg(F.max(point).alias("_tail"))
    before = tails.select(
        "_bucket", F.lag("_tail").over(Window.orderBy("_bucket")).alias("_before")
    )
    joined = bucketed.withColumn("_prev", F.lag(point).over(inside)).join(before, "_bucket")
    p = F.coalesce("_prev", "_before")
    return joined.agg(
        F.sum((F.col("fpr") - p["fpr"]) * (F.col("tpr") + p["tpr"]) / 2).alias(out)
    )


# --- entities ---------------------------------------------------------------------------------


def entity_rows(df: DataFrame, labels: str, key: str) -> DataFrame:
    """Entities of label sequences: a B, or an I after O or after another type, starts one."""
    rows = df.select(key, F.inline_outer(bio.chunks(F.col(labels))))
    return rows.filter(F.col("start").isNotNull())


def entity_scores(df: DataFrame, true: str, pred: str, key: str) -> DataFrame:
    """Entity precision, recall, f1 (exact span and type) and token accuracy."""
    same = F.size(F.filter(F.arrays_zip(F.col(true).alias("t"), F.col(pred).alias("p")),
                           lambda x: x["t"] == x["p"]))
    tokens = df.agg(F.try_divide(F.sum(same), F.sum(F.size(true)))).scalar()
    both = (
        entity_rows(df, true, key)
        .withColumn("_t", F.lit(1))
        .join(
            entity_rows(df, pred, key).withColumn("_p", F.lit(1)),
            [key, "start", "end", "label"],
            "full_outer",
        )
    )
    hit = F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull())
    counted = both.agg(
        hit.alias("_hit"), F.count("_t").alias("_true"), F.count("_p").alias("_pred")
    )
    return counted.select(
        _ratio(F.col("_hit"), F.col("_pred")).alias("precision"),
        _ratio(F.col("_hit"), F.col("_true")).alias("recall"),
        _ratio(2 * F.col("_hit"), F.col("_true") + F.col("_pred")).alias("f1"),
        tokens.alias("accuracy"),
    )
