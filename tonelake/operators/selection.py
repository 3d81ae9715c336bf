"""Feature ranking, subset search, projection axes and per-subset scores."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonelake.operators.classify import lda_model, lda_weights, predict_by_fold, training_parts
from tonelake.operators.evaluate import class_metrics_11, overall_scores
from tonelake.operators.frames import standardize, unpivot_features
from tonelake.operators.moments import Moments, grouped_moments, total
from tonelake.operators.subsets import best_subsets
from tonelake.session import checkpoint


def anova_f(df: DataFrame, label: str, feats: Sequence[str]) -> DataFrame:
    """One-way F of every feature against the label.

    Rows are reduced to count, mean and variance per (feature, class) before the
    single small shuffle.
    """
    long = unpivot_features(df, [label], feats).filter("value IS NOT NULL")
    per = long.groupBy("feature", label).agg(
        F.count("value").cast("double").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    n, m = F.col("n"), F.col("m")
    mean = F.sum(n * m).over(Window.partitionBy("feature")) / F.sum("n").over(Window.partitionBy("feature"))
    k = F.count(F.lit(1))
    sums = per.withColumn("_g", mean).groupBy("feature").agg(
        (F.sum(n * (m - F.col("_g")) * (m - F.col("_g"))) / (k - 1)).alias("between"),
        (F.sum(n * F.col("v")) / (F.sum("n") - k)).alias("within"),
    )
    return sums.select("feature", F.try_divide("between", "within").alias("f"))


def select_k_best(df: DataFrame, label: str, feats: Sequence[str], k: int, target: str | None = None) -> DataFrame:
    """The ``k`` features of highest F (of one class against the rest with ``target``)."""
    src = df if target is None else df.withColumn(label, F.when(F.col(label) == target, target).otherwise("OTHER"))
    order = F.array_position(F.array(*[F.lit(f) for f in feats]), F.col("feature"))
    ranked = anova_f(src, label, feats).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.round("f", 6).desc_nulls_last(), order))
    )
    return ranked.filter(F.col("rank") <= k)


# ---- sweeps over the number of features ---------------------------------------------


def f_from_moments(parts: dict[str, Moments]) -> np.ndarray:
    """F of every feature from class moments."""
    every = total(parts.values())
    within = sum(np.diag(m.scatter) for m in parts.values())
    between = np.diag(every.scatter) - within
    dof = every.n - len(parts)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num((between / (len(parts) - 1)) / (within / dof), nan=-1.0, posinf=np.inf)


def _ranking(parts: dict[str, Moments]) -> list[int]:
    f = np.round(f_from_moments(parts), 6)
    return sorted(range(len(f)), key=lambda i: (-f[i], i))


def k_sweep(
    df: DataFrame, label: str, feats: Sequence[str], ks: Sequence[int], fold: str = "fold",
    leak_free: bool = False, target: str | None = None,
) -> DataFrame:
    """Cross-validated scores of a discriminant on the best k features, for every k.

    One pass collects the moments of all features per (fold, class). Every k is
    a sub-block of them, so rows are read once more in all, to score all k. By
    default features are ranked on all rows (as a plain selection before
    cross-validation does); ``leak_free`` ranks them on each fold's training
    rows. ``target`` scores one class against the rest by its binary F1.
    """
    feats = list(feats)
    src = df.withColumn("_y", F.col(label).cast("string"))
    if target is not None:
        src = src.withColumn("_y", F.when(F.col("_y") == target, target).otherwise("OTHER"))
    parts = grouped_moments(src, [fold, "_y"], feats)
    labels = sorted({c for _, c in parts})
    whole = {c: total(m for (_, l), m in parts.items() if l == c) for c in labels}
    train = training_parts(parts)
    fixed = _ranking(whole)
    ranks = {f: (_ranking(t) if leak_free else fixed) for f, t in train.items()}
    out = src.select(fold, "_y", *feats)
    for k in ks:
        models = {}
        for f, t in train.items():
            cols = ranks[f][:k]
            wide = lda_model({c: m.take(cols) for c, m in t.items()})
            models[f] = [_widen(m, cols, len(feats)) for m in wide]
        out = predict_by_fold(out, models, feats, fold).withColumnRenamed("prediction", f"_p{k}")
    long = out.select(
        F.col("_y").alias("label"),
        F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_p{k}").alias("prediction")) for k in ks])),
    )
    pairs = long.groupBy("k", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    scores = overall_scores(pairs, ["k"], pairs=True).select("k", "accuracy", "f1_weighted")
    if target is not None:
        one = class_metrics_11(pairs, ["k"], pairs=True).filter(F.col("class") == target)
        scores = scores.join(one.select("k", F.coalesce("f1", F.lit(0.0)).alias("f1_binary")), "k", "left")
    names = [feats[i] for i in fixed]
    chosen = F.slice(F.array(*[F.lit(x) for x in names]), F.lit(1), F.col("k"))
    score = F.round("f1_weighted" if target is None else "f1_binary", 9)
    first = Window.orderBy(score.desc_nulls_last(), "k")  # one row per k
    return scores.withColumn("features", F.concat_ws(",", chosen)).withColumn("best", F.row_number().over(first) == 1)


def _widen(model: dict, cols: Sequence[int], d: int) -> dict:
    """The same model over all features, with zero weights outside ``cols``."""
    at = [0.0] * d
    rows = [[0.0] * d for _ in model["rows"]]
    for j, col in enumerate(cols):
        at[col] = model["at"][j]
        for wide, row in zip(rows, model["rows"]):
            wide[col] = row[j]
    return {**model, "at": at, "rows": rows}


def rfe(df: DataFrame, label: str, feats: Sequence[str], keep: int = 8) -> DataFrame:
    """Drops the feature of least squared discriminant weight until ``keep`` are left.

    One data pass; every refit is a sub-block of the same moments.
    """
    feats = list(feats)
    parts = {k[0]: m for k, m in grouped_moments(df, [label], feats).items()}
    left, dropped = list(range(len(feats))), []
    while len(left) > keep:
        sub = {c: m.take(left) for c, m in parts.items()}
        n = sum(m.n for m in sub.values())
        _, weights = lda_weights(sub)
        mean = sum(w * sub[c].n / n for c, (w, _) in weights.items())
        power = np.round(sum((w - mean) ** 2 for w, _ in weights.values()), 12)
        dropped.append(left.pop(int(np.argmin(power))))
    ranks = {i: 1 for i in left} | {i: len(dropped) + 1 - r for r, i in enumerate(dropped)}
    rows = [(feats[i], int(ranks[i]), ranks[i] == 1) for i in range(len(feats))]
    return df.sparkSession.createDataFrame(rows, "feature string, ranking int, selected boolean")


# ---- subsets -------------------------------------------------------------------------


def subset_table(spark: SparkSession, every: Moments, ones: Moments, feats: list[str], nbest: int, nvmax: int):
    """Best subsets per size for a 0/1 target; ``ones`` are the moments of its rows of value 1."""
    yy = ones.n - ones.n * ones.n / every.n
    xy = ones.n * (ones.mean - every.mean)
    return _search(spark, every.scatter, xy, yy, every.n, feats, nbest, nvmax)


EVERY = 14  # features of which all subsets are listed


def _search(spark, xx, xy, yy, n, feats, nbest, nvmax) -> DataFrame:
    """The best subsets of the features, searched by all tasks from the same small moments.

    Up to ``EVERY`` features all subsets are listed; beyond, branch and bound finds those that can be among the ``nbest``
    of their size. A task keeps its ``nbest`` per size, which hold the overall best.
    """
    d = len(feats)
    # Unit-variance features keep the solves well conditioned; RSS does not depend on it.
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    xx, xy = xx / np.outer(scale, scale), xy / scale
    full = _rss(xx[None], xy[None], yy)[0]
    noise = full / (n - d - 1)

    def scan(batches):
        best: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            masks = b["id"].to_numpy()
            bits = (masks[:, None] >> np.arange(d)) & 1
            sizes = bits.sum(axis=1)
            for s in np.unique(sizes):
                if s == 0 or s > nvmax:
                    continue
                pick = sizes == s
                cols = np.nonzero(bits[pick])[1].reshape(-1, s)
                rss = _rss(xx[cols[:, :, None], cols[:, None, :]], xy[cols], yy)
                rows = best.get(int(s), []) + list(zip(np.round(rss, 9), masks[pick]))
                best[int(s)] = sorted(rows)[:nbest]
        rows = [(int(m), s, float(r)) for s, found in best.items() for r, m in found]
        yield pd.DataFrame(rows, columns=["cand_id", "size", "rss"])

    if d <= EVERY:
        masks = spark.range(1, 2**d)
    else:
        masks = best_subsets(spark, xx, xy, yy, nbest, nvmax).select(F.col("mask").alias("id"))
    found = masks.mapInPandas(scan, "cand_id long, size int, rss double")
    w = Window.partitionBy("size").orderBy("rss", "cand_id")
    names = F.array(*[F.lit(f) for f in feats])
    inside = F.filter(names, lambda x, i: F.expr("cand_id").bitwiseAND(F.pow(F.lit(2.0), i).cast("long")) != 0)
    return (
        found.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= nbest)
        .select(
            "cand_id",
            "size",
            inside.alias("features"),
            "rss",
            (F.col("rss") / F.lit(float(noise)) - F.lit(float(n)) + 2 * (F.col("size") + 1)).alias("cp"),
        )
    )


def _rss(xx: np.ndarray, xy: np.ndarray, yy: float) -> np.ndarray:
    """Residual sums of squares of a stack of regressions, from their moments."""
    try:
        b = np.linalg.solve(xx, xy[..., None])[..., 0]
    except np.linalg.LinAlgError:
        b = np.einsum("bij,bj->bi", np.linalg.pinv(xx), xy)
    return yy - np.einsum("bi,bi->b", b, xy)


def subset_cp(df: DataFrame, label: str, feats: Sequence[str], nbest: int = 60, nvmax: int = 30) -> DataFrame:
    """Mallows' Cp of the ``nbest`` feature subsets of every size, over all subsets.

    The label enters as its code 1..K. The rows are read once, for their
    moments; the search is shared out over the tasks (see ``subsets``).
    """
    feats = list(feats)
    parts = {k[0]: m for k, m in grouped_moments(df, [label], feats).items()}
    every = total(parts.values())
    codes = {c: i + 1.0 for i, c in enumerate(sorted(parts))}
    y = sum(codes[c] * m.n for c, m in parts.items())
    yy = sum((codes[c] - y / every.n) ** 2 * m.n for c, m in parts.items())
    xy = sum(codes[c] * m.n * (m.mean - every.mean) for c, m in parts.items())
    return _search(df.sparkSession, every.scatter, xy, yy, every.n, feats, nbest, nvmax)


def selection_frequency(cands: DataFrame) -> DataFrame:
    """Share of candidate subsets that hold each feature, highest first."""
    n = cands.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        cands.select(F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("feature", "n", (F.col("n") * 100 / n).alias("percent"))
        .orderBy(F.col("percent").desc(), "feature")
    )


CANDIDATES = 5_000  # candidate subsets that one pass scores


def _subset_pairs(rows: DataFrame, picked, parts, labels, feats, middle) -> DataFrame:
    """How often each label got each prediction, for every subset of one block of candidates."""
    ids = np.array([r["cand_id"] for r in picked])
    weights = np.zeros((len(picked), len(labels), len(feats)))
    consts = np.zeros((len(picked), len(labels)))
    for i, r in enumerate(picked):
        cols = [feats.index(f) for f in r["features"]]
        _, fits = lda_weights({c: m.take(cols) for c, m in parts.items()})
        for j, c in enumerate(labels):
            weights[i, j, cols], consts[i, j] = fits[c]
    model = rows.sparkSession.sparkContext.broadcast((ids, weights, consts))

    def count(batches):
        ids, weights, consts = model.value
        acc = np.zeros((len(ids), len(labels), len(labels)), dtype=np.int64)
        for b in batches:
            b = b.dropna()
            if not len(b):
                continue
            x = b[feats].to_numpy(dtype=float) - middle
            y = np.searchsorted(labels, b["label"].to_numpy())
            for i in range(len(ids)):
                p = np.argmax(x @ weights[i].T + consts[i], axis=1)
                acc[i] += np.bincount(y * len(labels) + p, minlength=len(labels) ** 2).reshape(len(labels), -1)
        i, a, p = np.nonzero(acc)
        names = np.array(labels, dtype=object)
        yield pd.DataFrame({"cand_id": ids[i], "label": names[a], "prediction": names[p], "n": acc[i, a, p]})

    return (
        rows.mapInPandas(count, "cand_id long, label string, prediction string, n long")
        .groupBy("cand_id", "label", "prediction")
        .agg(F.sum("n").alias("n"))
    )


def subset_lda_scores(
    df: DataFrame, label: str, cands: DataFrame, feats: Sequence[str], metric: str = "accuracy",
    target: str | None = None,
) -> DataFrame:
    """Discriminant fitted and scored on all rows, for every candidate subset.

    (cand_id, size, features, score, class, the eleven metrics). One pass for
    the moments and one that scores every candidate; only counts are shuffled.
    ``metric`` is accuracy, or f1 of ``target``.
    """
    feats = list(feats)
    cands = checkpoint(cands.select("cand_id", "size", "features"))
    parts = {k[0]: m for k, m in grouped_moments(df, [label], feats).items()}
    labels = sorted(parts)
    middle = total(parts.values()).mean
    rows = df.select(F.col(label).cast("string").alias("label"), *[F.col(c).cast("double").alias(c) for c in feats])
    pairs, waiting = None, cands.toLocalIterator()
    while picked := list(islice(waiting, CANDIDATES)):
        one = _subset_pairs(rows, picked, parts, labels, feats, middle)
        pairs = one if pairs is None else pairs.unionByName(one)
    if pairs is None:
        pairs = _subset_pairs(rows, [], parts, labels, feats, middle)
    metrics = class_metrics_11(pairs, ["cand_id"], pairs=True)
    if metric == "accuracy":
        score = overall_scores(pairs, ["cand_id"], pairs=True).select("cand_id", F.col("accuracy").alias("score"))
    else:
        score = metrics.filter(F.col("class") == target).select("cand_id", F.coalesce("f1", F.lit(0.0)).alias("score"))
    return cands.select("cand_id", "size", "features").join(score, "cand_id").join(metrics, "cand_id")


def best_by_size(scores: DataFrame) -> DataFrame:
    """Highest score per subset size, overall and per class (balanced accuracy)."""
    overall = scores.groupBy("size").agg(F.max("score").alias("best")).withColumn("class", F.lit("(all)"))
    per = scores.groupBy("size", "class").agg(F.max("balanced_accuracy").alias("best"))
    return per.unionByName(overall.select("size", "class", "best"))


def best_k_model(scores: DataFrame, k: int) -> DataFrame:
    """Candidates of size ``k`` with the highest score, ties included."""
    of_k = scores.filter(F.col("size") == k).select("cand_id", "size", "features", "score").distinct()
    top = of_k.agg(F.max(F.round("score", 9)).alias("m")).scalar()
    return of_k.filter(F.round("score", 9) == top)


# ---- axes ----------------------------------------------------------------------------


def _signed(axis: np.ndarray) -> np.ndarray:
    """The axis turned so that its largest loading is positive."""
    return axis if axis[int(np.argmax(np.round(np.abs(axis), 9)))] > 0 else -axis


def pca_axes(df: DataFrame, feats: Sequence[str], k: int):
    """Mean, the first ``k`` axes, their variances and shares, from one pass of moments."""
    m = grouped_moments(df, [], feats)[()]
    values, vectors = np.linalg.eigh(m.scatter / (m.n - 1))
    order = np.argsort(values)[::-1][:k]
    axes = np.array([_signed(vectors[:, i]) for i in order])
    return m.mean, axes, values[order], values[order] / values.sum()


def pca(df: DataFrame, feats: Sequence[str], k: int) -> DataFrame:
    """(component, variance, explained_ratio, loadings)."""
    _, axes, var, share = pca_axes(df, feats, k)
    rows = [(i + 1, float(var[i]), float(share[i]), [float(x) for x in axes[i]]) for i in range(len(axes))]
    return df.sparkSession.createDataFrame(
        rows, "component int, variance double, explained_ratio double, loadings array<double>"
    )


def pca_project(df: DataFrame, feats: Sequence[str], k: int) -> DataFrame:
    """Adds pc1..pck."""
    mean, axes, _, _ = pca_axes(df, feats, k)
    cols = {}
    for i, axis in enumerate(axes):
        terms = [(F.col(f) - F.lit(float(m))) * F.lit(float(a)) for f, m, a in zip(feats, mean, axis)]
        cols[f"pc{i + 1}"] = sum(terms[1:], terms[0])
    return df.withColumns(cols)


def lda_coefficients(df: DataFrame, label: str, feats: Sequence[str], scaled: bool = False) -> DataFrame:
    """Discriminant axes per feature, ordered by the first axis; each axis's share of trace.

    Axes have unit pooled within-class variance; ``scaled`` standardizes the
    features first (sample SD).
    """
    feats = list(feats)
    src = standardize(df, feats, ddof=1) if scaled else df
    parts = {k[0]: m for k, m in grouped_moments(src, [label], feats).items()}
    every = total(parts.values())
    within = sum(m.scatter for m in parts.values()) / (every.n - len(parts))
    between = sum(m.n * np.outer(m.mean - every.mean, m.mean - every.mean) for m in parts.values()) / (len(parts) - 1)
    values, vectors = np.linalg.eigh(within)
    half = vectors / np.sqrt(np.maximum(values, 1e-300))  # whitens the within-class spread
    spread, turned = np.linalg.eigh(half.T @ between @ half)
    order = np.argsort(spread)[::-1][: min(len(parts) - 1, len(feats))]
    axes = [_signed(half @ turned[:, i]) for i in order]
    share = spread[order] / spread[order].sum()
    rows = [
        (f, a + 1, float(axis[i]), float(share[a])) for a, axis in enumerate(axes) for i, f in enumerate(feats)
    ]
    out = df.sparkSession.createDataFrame(rows, "feature string, axis int, coefficient double, trace_share double")
    first = F.max(F.when(F.col("axis") == 1, F.col("coefficient"))).over(Window.partitionBy("feature"))
    return out.withColumn("first_axis", first).orderBy(F.col("first_axis").desc(), "axis").drop("first_axis")
