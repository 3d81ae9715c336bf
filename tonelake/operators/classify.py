"""Discriminants and Bayes from moments, nearest rows, votes and cascades.

A fit is one pass over the rows (``grouped_moments``) and a small solve; a
prediction is a column expression over constants.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.operators.moments import Moments, grouped_moments, total
from tonelake.operators.neighbours import nearest_rows

# Fixed value: share of the largest feature variance added to every variance in naive Bayes.
NB_SMOOTHING = 1e-9

# A class's score is b plus its one linear term (linear) or minus half the squares of
# its terms; each term is a row of weights times the features less ``at``.
MODEL_TYPE = "array<struct<label:string,b:double,at:array<double>,rows:array<array<double>>,linear:boolean>>"


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        out = np.linalg.solve(a, b)
        if np.all(np.isfinite(out)):
            return out
    except np.linalg.LinAlgError:
        pass
    return np.linalg.pinv(a) @ b


def lda_weights(parts: dict[str, Moments]) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, float]]]:
    """Overall mean, and per class the weights and constant for features around it."""
    every = total(parts.values())
    pooled = sum(m.scatter for m in parts.values()) / (every.n - len(parts))
    out = {}
    for label, m in sorted(parts.items()):
        gap = m.mean - every.mean
        w = _solve(pooled, gap)
        out[label] = (w, float(-0.5 * w @ gap + np.log(m.n / every.n)))
    return every.mean, out


def _class(label: str, b: float, at: np.ndarray, rows: np.ndarray, linear: bool) -> dict:
    return {"label": label, "b": float(b), "at": at.tolist(), "rows": rows.tolist(), "linear": linear}


def lda_model(parts: dict[str, Moments]) -> list[dict]:
    centre, fits = lda_weights(parts)
    return [_class(k, b, centre, w[None, :], True) for k, (w, b) in fits.items()]


def qda_model(parts: dict[str, Moments]) -> list[dict]:
    n = sum(m.n for m in parts.values())
    out = []
    for label, m in sorted(parts.items()):
        values, vectors = np.linalg.eigh(m.scatter / (m.n - 1))
        values = np.maximum(values, 1e-300)
        axes = vectors / np.sqrt(values)  # squared lengths along these give the Mahalanobis distance
        out.append(_class(label, np.log(m.n / n) - 0.5 * np.log(values).sum(), m.mean, axes.T, False))
    return out


def nb_model(parts: dict[str, Moments]) -> list[dict]:
    every = total(parts.values())
    floor = NB_SMOOTHING * float(np.max(np.diag(every.scatter) / every.n))
    out = []
    for label, m in sorted(parts.items()):
        var = np.maximum(np.diag(m.scatter), 0.0) / m.n + floor
        b = np.log(m.n / every.n) - 0.5 * np.log(2 * np.pi * var).sum()
        out.append(_class(label, b, m.mean, np.diag(1 / np.sqrt(var)), False))
    return out


MODELS = {"lda": lda_model, "qda": qda_model, "nb": nb_model}


def _best_label(models: Column, feats: Sequence[str]) -> Column:
    """Label of the highest score; equal scores go to the smallest label."""
    x = F.array(*[F.col(c).cast("double") for c in feats])

    def along(gap, row):
        return F.aggregate(F.zip_with(row, gap, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def score(m):
        gap = F.zip_with(x, m["at"], lambda a, b: a - b)
        linear = along(gap, F.get(m["rows"], F.lit(0)))
        square = F.aggregate(
            F.transform(m["rows"], lambda row: along(gap, row)), F.lit(0.0), lambda s, v: s - F.lit(0.5) * v * v
        )
        return m["b"] + F.when(m["linear"], linear).otherwise(square)

    scored = F.transform(models, lambda m, i: F.struct(score(m).alias("s"), (-i).alias("i"), m["label"].alias("label")))
    return F.array_max(scored)["label"]


def predict_label(df: DataFrame, model: list[dict], feats: Sequence[str], name: str = "prediction") -> DataFrame:
    models = F.from_json(F.lit(json.dumps(model)), MODEL_TYPE)
    return df.withColumn(name, _best_label(models, feats))


def predict_by_fold(
    df: DataFrame, models: dict[str, list[dict]], feats: Sequence[str], fold: str = "fold"
) -> DataFrame:
    """Each row scored by its fold's model."""
    every = F.from_json(F.lit(json.dumps(models)), f"map<string,{MODEL_TYPE}>")
    mine = F.try_element_at(every, F.col(fold).cast("string"))
    return df.withColumn("prediction", _best_label(mine, feats))


def _fit_predict(kind: str, train: DataFrame, test: DataFrame, label: str, feats: Sequence[str], id: str):
    parts = {k[0]: m for k, m in grouped_moments(train, [label], feats).items()}
    out = predict_label(test, MODELS[kind](parts), feats)
    return out.select(id, F.col(label).alias("label"), "prediction")


def lda_classify(train: DataFrame, test: DataFrame, label: str, feats: Sequence[str], id: str = "id") -> DataFrame:
    return _fit_predict("lda", train, test, label, feats, id)


def qda_classify(train: DataFrame, test: DataFrame, label: str, feats: Sequence[str], id: str = "id") -> DataFrame:
    return _fit_predict("qda", train, test, label, feats, id)


def gaussian_nb(train: DataFrame, test: DataFrame, label: str, feats: Sequence[str], id: str = "id") -> DataFrame:
    return _fit_predict("nb", train, test, label, feats, id)


def knn_classify(
    train: DataFrame, test: DataFrame, label: str, feats: Sequence[str], id: str = "id", k: int = 6, p: int = 2,
    **limits,
) -> DataFrame:
    """Majority of the ``k`` nearest training rows; equal votes go to the smallest label."""
    points = train.withColumn("_label", F.col(label).cast("string"))
    near = nearest_rows(test, points, id, feats, k, power=p, extra=["_label"], values=False, **limits)
    votes = near.groupBy("query_id", "p__label").agg(F.count(F.lit(1)).alias("n"))
    won = votes.groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("p__label").alias("l"))).alias("w"))
    return test.select(F.col(id).cast("string").alias(id), F.col(label).alias("label")).join(
        won.select(F.col("query_id").alias(id), F.col("w.l").alias("prediction")), id
    )


def vote_hard(predictions: DataFrame) -> DataFrame:
    """Majority of the models' predictions per id; equal votes go to the smallest label."""
    votes = predictions.groupBy("id", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("prediction").alias("p"))).alias("w")
    return votes.groupBy("id", "label").agg(best).select("id", "label", F.col("w.p").alias("prediction"))


def cross_val_predict(
    df: DataFrame, model: str, label: str, feats: Sequence[str], fold: str = "fold", id: str = "id"
) -> DataFrame:
    """Every row predicted by a fit on the other folds.

    One pass gives the moments of every (fold, class); a fold's training
    moments are those of all other folds together.
    """
    parts = grouped_moments(df, [fold, label], feats)
    models = {f: MODELS[model](train) for f, train in training_parts(parts).items()}
    return predict_by_fold(df, models, feats, fold).select(id, F.col(label).alias("label"), fold, "prediction")


def training_parts(parts: dict[tuple, Moments]) -> dict[str, dict[str, Moments]]:
    """Per fold the class moments of all other folds."""
    folds = sorted({k[0] for k in parts})
    labels = sorted({k[1] for k in parts})
    out: dict[str, dict[str, Moments]] = {}
    for f in folds:
        out[f] = {}
        for c in labels:
            rest = [m for (g, l), m in parts.items() if l == c and g != f]
            if rest:
                out[f][c] = total(rest)
    return out


def sequential_one_vs_rest(
    df: DataFrame, label: str, feats: Sequence[str], id: str = "id", nbest: int = 60
) -> DataFrame:
    """Cascade of one-vs-rest discriminants; the class that needs fewest features goes first.

    Each class takes its features from the subset of least Cp; a row keeps the
    first class that claims it, and stays NULL if none does.
    """
    from tonelake.operators.selection import subset_table

    parts = {k[0]: m for k, m in grouped_moments(df, [label], feats).items()}
    every = total(parts.values())
    jobs = []
    for c, own in sorted(parts.items()):
        rest = total(m for k, m in parts.items() if k != c)
        best = (
            subset_table(df.sparkSession, every, own, list(feats), nbest, len(feats))
            .orderBy(F.round("cp", 6), "size", "cand_id")
            .first()
        )
        cols = [list(feats).index(f) for f in best["features"]]
        jobs.append((len(cols), c, cols, {c: own.take(cols), "OTHERS": rest.take(cols)}))
    out = df
    claims = []
    for i, (_, c, cols, pair) in enumerate(sorted(jobs, key=lambda j: (j[0], j[1]))):
        names = [feats[j] for j in cols]
        out = predict_label(out, lda_model(pair), names, f"_c{i}")
        claims.append(F.when(F.col(f"_c{i}") == c, F.lit(c)))
    return out.select(id, F.col(label).alias("label"), F.coalesce(*claims).alias("prediction"))
