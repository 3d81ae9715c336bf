"""Selection, neighbours, balance and classifiers against direct numpy computation."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonelake.operators import classify, learners, sampling, selection
from tonelake.operators.evaluate import count_pairs, overall_scores
from tonelake.operators.neighbours import nearest_rows

D = 5
XS = [f"x{i}" for i in range(D)]


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(8)
    n = 240
    y = rng.choice(["a", "b", "c"], n, p=[0.6, 0.25, 0.15])
    x = rng.normal(0, 1, (n, D)) + np.array([{"a": 0, "b": 1.5, "c": -1.5}[k] for k in y])[:, None] * np.array([1, 0.5, 0, 0, 0.2])
    x[:60] = x[0]  # copies of one row
    out = pd.DataFrame(x, columns=XS)
    out.insert(0, "id", [f"r{i}" for i in range(n)])
    out.insert(1, "label", y)
    return out


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("power", [1, 2])
@pytest.mark.parametrize("exclude", [False, True])
def test_neighbours_by_cells(df, pdf, power, exclude):
    x = pdf[XS].to_numpy()
    d = np.abs(x[:, None] - x[None])
    d = np.round(d.sum(2) if power == 1 else np.sqrt((d**2).sum(2)), 9)
    ids = pdf["id"].to_numpy()
    for limits in ({}, {"broadcast_values": 0, "block_rows": 17, "pivots": 6}):
        got = nearest_rows(df, df, "id", XS, 4, power, exclude, **limits).toPandas()
        assert len(got) == 4 * len(pdf)
        got = got.sort_values(["query_id", "rank"]).groupby("query_id")["point_id"].apply(list)
        for i in range(len(pdf)):
            order = sorted((j for j in range(len(pdf)) if not (exclude and i == j)), key=lambda j: (d[i, j], ids[j]))
            assert got[ids[i]] == [ids[j] for j in order[:4]]


def test_smote_balances_inside_classes(df, pdf):
    out = sampling.smote(df, "id", "label", XS).toPandas()
    sizes = out.groupby("label").size()
    assert set(sizes) == {pdf.groupby("label").size().max()}
    assert out["id"].is_unique and (~out["synthetic"]).sum() == len(pdf)
    for c, part in out[out.synthetic].groupby("label"):
        own = pdf[pdf.label == c][XS]
        assert (part[XS] >= own.min() - 1e-9).all().all() and (part[XS] <= own.max() + 1e-9).all().all()


def test_folds_and_splits_are_balanced(df):
    f = sampling.stratified_folds(df, "id", "label", 7).toPandas()
    n = f.groupby(["label", "fold"]).size().unstack()
    assert (n.max(axis=1) - n.min(axis=1) <= 1).all()
    s = sampling.stratified_split(df, "id", "label", 0.75).toPandas()
    assert (s[s.part == "train"].groupby("label").size() == (s.groupby("label").size() * 0.75).astype(int)).all()
    g = sampling.group_folds(df, "label", 2).toPandas()
    assert (g.groupby("label")["fold"].nunique() == 1).all()


def lda_labels(train, test, cols):
    labels = sorted(train["label"].unique())
    x = [train[train.label == c][cols].to_numpy() for c in labels]
    pooled = sum((p - p.mean(0)).T @ (p - p.mean(0)) for p in x) / (len(train) - len(labels))
    s = []
    for p in x:
        w = np.linalg.solve(pooled, p.mean(0))
        s.append(test[cols].to_numpy() @ w - 0.5 * w @ p.mean(0) + np.log(len(p) / len(train)))
    return [labels[i] for i in np.argmax(np.array(s), axis=0)]


def test_cross_validation_from_moments(df):
    rows = sampling.stratified_folds(df, "id", "label", 4)
    got = classify.cross_val_predict(rows, "lda", "label", XS).toPandas().set_index("id")
    p = rows.toPandas()
    for f in range(4):
        test = p[p.fold == f]
        assert got.loc[test["id"], "prediction"].tolist() == lda_labels(p[p.fold != f], test, XS)


def test_qda_and_bayes(df, pdf):
    for kind, fn in (("qda", classify.qda_classify), ("nb", classify.gaussian_nb)):
        got = fn(df, df, "label", XS).toPandas().set_index("id").loc[pdf["id"], "prediction"].tolist()
        s, labels = [], sorted(pdf["label"].unique())
        x = pdf[XS].to_numpy()
        for c in labels:
            own = pdf[pdf.label == c][XS].to_numpy()
            cov = np.cov(own.T) if kind == "qda" else np.diag(own.var(0) + 1e-9 * x.var(0).max())
            d = x - own.mean(0)
            s.append(np.log(len(own) / len(pdf)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d @ np.linalg.inv(cov) * d).sum(1))
        assert got == [labels[i] for i in np.argmax(np.array(s), axis=0)]


def test_k_sweep_equals_refitting(df):
    rows = sampling.stratified_folds(df, "id", "label", 4)
    order = [r["feature"] for r in selection.select_k_best(df, "label", XS, D).orderBy("rank").collect()]
    got = selection.k_sweep(rows, "label", XS, range(1, D + 1)).orderBy("k").toPandas()
    for k in range(1, D + 1):
        pred = classify.cross_val_predict(rows, "lda", "label", order[:k])
        want = overall_scores(count_pairs(pred), pairs=True).first()
        row = got[got.k == k].iloc[0]
        assert row["features"] == ",".join(order[:k])
        assert np.isclose(row["accuracy"], want["accuracy"]) and np.isclose(row["f1_weighted"], want["f1_weighted"])
    assert got["best"].sum() == 1


def test_subset_search_is_exhaustive(df, pdf):
    y = pdf["label"].map({"a": 1.0, "b": 2.0, "c": 3.0}).to_numpy()

    def rss(cols):
        x = np.column_stack([np.ones(len(pdf)), pdf[list(cols)]])
        return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()

    noise = rss(XS) / (len(pdf) - D - 1)
    got = selection.subset_cp(df, "label", XS, nbest=3).toPandas()
    for s in range(1, D + 1):
        every = sorted((rss(c), c) for c in itertools.combinations(XS, s))[:3]
        part = got[got["size"] == s].sort_values("rss")
        assert [tuple(f) for f in part["features"]] == [c for _, c in every]
        assert np.allclose(part["cp"], [r / noise - len(pdf) + 2 * (s + 1) for r, _ in every])


def test_subset_scores(df, pdf):
    cands = selection.subset_cp(df, "label", XS, nbest=2)
    out = selection.subset_lda_scores(df, "label", cands, XS).toPandas()
    for cand, part in out.groupby("cand_id"):
        cols = list(part["features"].iloc[0])
        acc = np.mean(np.array(lda_labels(pdf, pdf, cols)) == pdf["label"])
        assert np.isclose(part["score"].iloc[0], acc) and len(part) == 3


def test_pca_and_axes(df, pdf):
    x = pdf[XS].to_numpy()
    values, vectors = np.linalg.eigh(np.cov(x.T))
    got = selection.pca(df, XS, 3).toPandas()
    assert np.allclose(got["variance"], values[::-1][:3])
    for i, loads in enumerate(got["loadings"]):
        v = vectors[:, -1 - i]
        assert np.allclose(np.abs(loads), np.abs(v), atol=1e-8) and max(loads, key=abs) > 0
    axes = selection.lda_coefficients(df, "label", XS).toPandas()
    assert np.isclose(axes.groupby("axis")["trace_share"].first().sum(), 1)
    first = axes[axes.axis == 1].set_index("feature")["coefficient"]
    assert list(first.index) == list(first.sort_values(ascending=False).index)


def test_rfe_ranks(df):
    out = selection.rfe(df, "label", XS, keep=2).toPandas()
    assert sorted(out["ranking"]) == [1, 1, 2, 3, 4] and out["selected"].sum() == 2


def test_cascade_and_learners(df):
    out = classify.sequential_one_vs_rest(df, "label", XS)
    assert out.count() == 240
    train = df.filter(F.col("id") != "r7")
    for fn, params in (
        (learners.adaboost, {"rounds": 12, "depth": 2}), (learners.bagging, {"bags": 9, "base": "lda"}),
        (learners.bagging, {"bags": 3, "base": "knn"}), (learners.bagging, {"bags": 2, "base": "logistic"}),
    ):
        acc = overall_scores(fn(train, df, "label", XS, **params)).first()["accuracy"]
        assert acc > 0.6


def test_halving_keeps_the_best(df):
    cands = [{"maxDepth": d} for d in (1, 2, 3, 4)]
    t = learners.successive_halving(df, "tree", cands, "label", XS).toPandas()
    assert t.groupby("iter").size().tolist() == [4, 2, 1] and t.groupby("iter")["n_rows"].first().tolist() == [60, 120, 240]
    for i in (1, 2):
        prev = t[t["iter"] == i - 1].sort_values("rank")["params"].tolist()
        assert set(t[t["iter"] == i]["params"]) == set(prev[: len(t[t["iter"] == i])])


def test_long_and_short_units_fit_tied_times_alike(spark):
    from tonelake.operators import lines

    rng = np.random.default_rng(4)
    rows = [(1, float(k // 2), float(rng.normal(k, 3)), float(rng.normal(-k, 9)), 0) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, t double, a double, b double, z int")
    short, long = (
        lines._robust(df, ["g"], "t", ["a", "b"], "z", None, 100, limit).select(*[F.round(f"{c}.slope", 6).alias(c) for c in "ab"]).first()
        for limit in (1000, 0)
    )
    assert short == long


def test_roc_leaves_out_rows_without_a_score(spark):
    from tonelake.operators.evaluate import roc_points

    rows = [(1, 0.9), (0, 0.2), (1, None), (0, None)]
    got = roc_points(spark.createDataFrame(rows, "label int, score double")).collect()
    assert sorted((r.threshold, r.tpr, r.fpr) for r in got) == [(0.2, 1.0, 1.0), (0.9, 1.0, 0.0)]


def test_numbers_are_encoded_in_their_own_order(spark):
    from tonelake.operators.frames import label_encode

    labels = [-5, 1, 2, 3, 9, 10, 11, 20, 100]
    coded, _ = label_encode(spark.createDataFrame([(x,) for x in labels], "l int"), "l")
    assert sorted((r.l, r.l_code) for r in coded.collect()) == [(x, i) for i, x in enumerate(labels)]


def test_a_row_drawn_twice_votes_twice(df, pdf):
    train = df.filter(F.col("id") < "r2")
    drawn = train.select("id", learners._bag_weight("id", F.lit(0), 42).alias("n")).toPandas().set_index("id")["n"]
    assert drawn.max() >= 2
    rows = pdf[pdf.id.isin(drawn.index)]
    rows = rows.loc[rows.index.repeat(drawn[rows.id].astype(int).to_numpy())]
    x, ids, labels = rows[XS].to_numpy(), rows["id"].to_numpy(), rows["label"].to_numpy()
    got = learners.bagging(train, df, "label", XS, bags=1, base="knn").toPandas().set_index("id")["prediction"]
    for _, r in pdf.iterrows():
        d = np.round(np.sqrt(((x - r[XS].to_numpy(float)) ** 2).sum(1)), 9)
        near = sorted(range(len(d)), key=lambda j: (d[j], ids[j]))[:6]
        votes = pd.Series(labels[near]).value_counts()
        assert got[r.id] == min(votes[votes == votes.max()].index)


def test_search_by_balanced_accuracy(spark, df):
    pairs = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)], "_y double, prediction double")
    assert learners.BalancedAccuracy().evaluate(pairs) == pytest.approx((0.75 + 0.5) / 2)
    out = learners.grid_search(df, "tree", {"maxDepth": [1, 4]}, "label", XS, folds=3, metric="balanced_accuracy").toPandas()
    assert out["best"].sum() == 1 and out["mean_test_score"].between(1 / 3, 1).all()
    with pytest.raises(ValueError):
        learners.grid_search(df, "nb", {"c": [1, 2]}, "label", XS, folds=3)


def test_long_ids_count_in_what_is_sent(df, monkeypatch):
    from tonelake.operators import neighbours

    def cells(*_):
        raise LookupError("by cells")

    wide = df.withColumn("note", F.repeat(F.lit("x"), 8000))
    short = nearest_rows(df, df, "id", XS, 1, broadcast_values=100_000).count()
    monkeypatch.setattr(neighbours, "_by_cells", cells)
    assert short == 240
    with pytest.raises(LookupError):
        nearest_rows(df, wide, "id", XS, 1, extra=["note"], broadcast_values=100_000)
