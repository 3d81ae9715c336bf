"""Scores of predictions: (label, prediction) rows, or counts of them.

Every score starts from the counts per (label, prediction), the only shuffle of
row data. ``keys`` scores several sets (folds, candidates) at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonelake.operators.ordering import running_sum


def count_pairs(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return pred.groupBy(*keys, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """Counts for every (label, prediction) of the labels seen on either side."""
    pairs = count_pairs(pred)
    seen = pairs.select(F.explode(F.array("label", "prediction")).alias("x")).agg(
        F.array_sort(F.collect_set("x")).alias("xs")
    )
    grid = seen.select(F.explode("xs").alias("label"), "xs").select("label", F.explode("xs").alias("prediction"))
    return grid.join(pairs, ["label", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _per_class(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per (keys, class): actual, predicted and correct rows, and the set's total."""
    hit = F.col("label") == F.col("prediction")
    sides = F.array(
        F.struct(
            F.col("label").alias("class"), F.col("n").alias("act"), F.lit(0).cast("long").alias("prd"),
            F.when(hit, F.col("n")).otherwise(F.lit(0)).alias("tp"),
        ),
        F.struct(
            F.col("prediction").alias("class"), F.lit(0).cast("long").alias("act"), F.col("n").alias("prd"),
            F.lit(0).cast("long").alias("tp"),
        ),
    )
    sums = (
        pairs.select(*keys, F.inline(sides))
        .groupBy(*keys, "class")
        .agg(F.sum("act").alias("act"), F.sum("prd").alias("prd"), F.sum("tp").alias("tp"))
    )
    # One row per class here, so the window is as small as the label set.
    return sums.withColumn("total", F.sum("act").over(Window.partitionBy(*keys)))


def _ratio(a, b):
    return F.try_divide(a, b)


def class_metrics_11(pred: DataFrame, keys: Sequence[str] = (), pairs: bool = False) -> DataFrame:
    """Eleven per-class metrics; undefined ratios are NULL."""
    c = _per_class(pred if pairs else count_pairs(pred, keys), keys)
    act, prd, tp, total = F.col("act"), F.col("prd"), F.col("tp"), F.col("total")
    tn = total - act - prd + tp
    sens, spec, ppv = _ratio(tp, act), _ratio(tn, total - act), _ratio(tp, prd)
    return c.select(
        *keys,
        "class",
        sens.alias("sensitivity"),
        spec.alias("specificity"),
        ppv.alias("pos_pred_value"),
        _ratio(tn, total - prd).alias("neg_pred_value"),
        ppv.alias("precision"),
        sens.alias("recall"),
        _ratio(2 * tp, act + prd).alias("f1"),
        _ratio(act, total).alias("prevalence"),
        _ratio(tp, total).alias("detection_rate"),
        _ratio(prd, total).alias("detection_prevalence"),
        ((sens + spec) / 2).alias("balanced_accuracy"),
    )


def classification_report(pred: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 and support; accuracy, macro and weighted rows."""
    c = _per_class(count_pairs(pred))
    zero = F.lit(0.0)
    per = c.select(
        F.col("class").alias("row"),
        F.coalesce(_ratio(F.col("tp"), F.col("prd")), zero).alias("precision"),
        F.coalesce(_ratio(F.col("tp"), F.col("act")), zero).alias("recall"),
        F.coalesce(_ratio(2 * F.col("tp"), F.col("act") + F.col("prd")), zero).alias("f1"),
        F.col("act").alias("support"),
        "tp",
    )
    names = ["precision", "recall", "f1"]
    total = F.sum("support")

    def row(name, values):
        return F.struct(F.lit(name).alias("row"), *[v.alias(n) for n, v in zip(names, values)], total.alias("support"))

    correct = F.sum("tp") / total
    summary = per.agg(
        F.array(
            row("accuracy", [correct] * 3),
            row("macro avg", [F.avg(n) for n in names]),
            row("weighted avg", [F.sum(F.col(n) * F.col("support")) / total for n in names]),
        ).alias("r")
    )
    return per.drop("tp").unionByName(summary.select(F.inline("r")))


def overall_scores(pred: DataFrame, keys: Sequence[str] = (), pairs: bool = False) -> DataFrame:
    """accuracy, balanced accuracy, weighted and macro F1 per set."""
    c = _per_class(pred if pairs else count_pairs(pred, keys), keys)
    recall = F.try_divide(F.col("tp"), F.col("act"))  # classes without rows do not count
    f1 = F.try_divide(2 * F.col("tp"), F.col("act") + F.col("prd"))
    return c.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("act")).alias("accuracy"),
        F.avg(recall).alias("balanced_accuracy"),
        (F.sum(f1 * F.col("act")) / F.sum("act")).alias("f1_weighted"),
        F.avg(f1).alias("f1_macro"),
    )


def balanced_accuracy(pred: DataFrame) -> DataFrame:
    return overall_scores(pred)


def f1_binary(pred: DataFrame, positive: str, keys: Sequence[str] = ()) -> DataFrame:
    c = _per_class(count_pairs(pred, keys), keys).filter(F.col("class") == positive)
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("act") + F.col("prd")), F.lit(0.0))
    return c.select(*keys, f1.alias("f1"))


def roc_points(scores: DataFrame, label: str = "label", score: str = "score", slots: int = 256) -> DataFrame:
    """One point per distinct score, highest first: rows at or above it, and TPR/FPR.

    ``label`` is 1 or 0. Rows are counted per score before any ordering; score
    slots from a sketch spread the running sums over tasks. Rows without a score are left out.
    """
    scores = scores.where(F.col(score).isNotNull())
    counts = scores.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")
    )
    cuts = sorted(set(scores.approxQuantile(score, [i / slots for i in range(1, slots)], 0.001)))
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col("threshold")))
    cum = running_sum(counts, [], [F.col("threshold").desc()], ["pos", "neg"], above)
    totals = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t")).scalar()
    return cum.select(
        "threshold",
        "pos",
        "neg",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        F.try_divide(F.col("cum_pos"), totals["p"]).alias("tpr"),
        F.try_divide(F.col("cum_neg"), totals["n"]).alias("fpr"),
    )


def roc_auc(points: DataFrame) -> DataFrame:
    """Area under the ROC points by trapezoids."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return points.agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"))


def gini_impurity(df: DataFrame, label: str, group: str | None = None) -> DataFrame:
    keys = [group] if group else []
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = F.sum("n")
    return counts.groupBy(*keys).agg((1 - F.sum(F.col("n") * F.col("n")) / (total * total)).alias("gini"))
