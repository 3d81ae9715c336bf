"""Work of a query against the size of its tables: what is moved, and what a task may hold."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tonelake.operators import forest, learners, neighbours, sampling
from tonelake.operators.quantiles import exact_quantiles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_split_moves_and_sorts_no_rows(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 9 != 0, F.col("id") % 3).alias("label"))
    got = sampling.stratified_split(df, "id", "label", 0.75)
    assert "Sort" not in plan(got) and "hashpartitioning" not in plan(got)
    want = df.toPandas()
    want["h"] = [hashlib.md5(f"42|{i}".encode()).hexdigest() for i in want["id"]]
    label = want["label"].fillna(-1)
    rank = want.groupby(label)["h"].rank(method="first")
    train = set(want["id"][rank <= np.floor(want.groupby(label)["h"].transform("size") * 0.75)])
    assert set(got.where("part = 'train'").toPandas()["id"]) == train


@pytest.mark.parametrize("n", [0, 1, 3, 7, 40])
def test_first_rows_of_repeated_ids(spark, n):
    df = spark.createDataFrame([(k % 3, "a" if k % 2 else "b") for k in range(20)], "id int, label string")
    assert sampling.sample_frames(df, "id", n).count() == min(n, 20)
    parts = sampling.stratified_split(df, "id", "label", 0.33).groupBy("label", "part").count().collect()
    assert {(r["label"], r["part"]): r["count"] for r in parts} == {(x, p): c for x in "ab" for p, c in (("train", math.floor(3.3)), ("test", 7))}


def test_quantiles_of_a_few_groups_move_no_rows(spark):
    df = spark.range(50_000).select((F.col("id") % 2).alias("k"), F.xxhash64("id").cast("double").alias("v"))
    got = exact_quantiles(df, ["k"], "v", [0.5], ["m"], accuracy=1000)
    assert "SortMergeJoin" not in plan(got) and plan(got).count("hashpartitioning(k") <= 2
    p = df.toPandas()
    assert {r["k"]: r["m"] for r in got.collect()} == p.groupby("k")["v"].median().to_dict()


@pytest.mark.parametrize("power", [1, 2])
def test_near_ties_copies_and_odd_values_are_found_exactly(power):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 6)) + 1000
    x[100:200] = x[0]  # copies
    x[200:300] = x[1] + rng.normal(0, 1e-7, (100, 6))  # apart by less than single precision tells
    names = [f"x{i}" for i in range(6)]
    ids = np.array([f"r{i:03d}" for i in range(400)])
    for odd in (None, np.nan, 1e30):
        if odd is not None:
            x[7, 3] = odd
        points = neighbours._Points(pd.DataFrame(x, columns=names).assign(id=ids), "id", names, power)
        assert points.small == (odd is None)
        for skip in (False, True):
            qi, pi, d = neighbours._top(ids, x, points, 5, skip)
            every = neighbours._distances(x, x, power)
            if skip:
                np.fill_diagonal(every, np.inf)
            for i in range(400):
                order = [j for j in np.lexsort((np.arange(400), every[i])) if np.isfinite(every[i, j])][:5]
                assert pi[qi == i].tolist() == order and (d[qi == i] == every[i][order]).all()


def test_queries_go_once_to_each_block_and_no_features_come_back(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("id"), F.rand(5).alias("x"), F.rand(6).alias("y"))
    got = neighbours.nearest_rows(df, df, "id", ["x", "y"], 3, values=False, broadcast_values=0, block_rows=150, pivots=40)
    assert set(got.columns) == {"query_id", "point_id", "distance", "rank"}
    whole = neighbours.nearest_rows(df, df, "id", ["x", "y"], 3)
    assert {(r.query_id, r.rank, r.point_id) for r in got.collect()} == {(r.query_id, r.rank, r.point_id) for r in whole.collect()}


def test_forests_grow_alike_whatever_a_task_may_hold(spark):
    rng = np.random.default_rng(11)
    n, names = 600, [f"x{i}" for i in range(6)]
    x = rng.normal(0, 1, (n, 6)).round(2)
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0.2, "a", np.where(x[:, 2] > 0, "b", "c"))
    p = pd.DataFrame(x, columns=names).assign(id=[f"r{i}" for i in range(n)], label=y)
    df = spark.createDataFrame(p).cache()
    train, test = df.where(F.xxhash64("id") % 4 != 0), df.where(F.xxhash64("id") % 4 == 0)
    draws = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda b: learners._bag_weight("id", b, 42))
    for per_node in (6, 3):
        whole, cut = (
            {r.id: r.prediction for r in forest.forest(train, test, "label", names, "id", ["a", "b", "c"], draws, 30, per_node, 42, rows).collect()}
            for rows in (20_000, 40)
        )
        assert whole == cut
        truth = test.toPandas().set_index("id")["label"]
        assert set(whole) == set(truth.index) and np.mean([whole[i] == truth[i] for i in whole]) > 0.85


def test_a_forest_split_is_the_best_of_all():
    rng = np.random.default_rng(2)
    for n in (2, 9, 30, 47, 48, 200):
        x, y, w = rng.integers(0, 7, (n, 4)).astype(np.uint8), rng.integers(0, 3, n), rng.integers(1, 4, n).astype(float)

        def gini(rows):
            c = np.bincount(y[rows], w[rows], 3)
            return c.sum() - (c * c).sum() / c.sum()

        gains = {
            (f, b): gini(x[:, f] >= 0) - gini(x[:, f] <= b) - gini(x[:, f] > b)
            for f in range(4) for b in range(7) if 0 < (x[:, f] <= b).sum() < n
        }
        got = forest._split(x, y, w)
        assert (got is None and max(gains.values(), default=0) < 1e-9) or gains[got] > max(gains.values()) - 1e-9


def test_learners_read_their_rows_without_moving_them(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).cast("string").alias("label"), F.rand(1).alias("x"))
    parts = sampling.stratified_split(df, "id", "label", 0.75)
    train = parts.where("part = 'train'").drop("part")
    rows = learners._prepared(train, "label", ["x"]).transform(train)
    assert "Sort" not in plan(rows) and "hashpartitioning" not in plan(rows)
    assert rows.count() == sum(int(0.75 * n) for n in (1334, 1333, 1333))


@pytest.mark.parametrize("copies", [5, 40])
def test_a_split_of_repeated_ids_moves_only_the_rows_of_the_last_id(spark, copies):
    ids = F.when(F.col("id") % 50 != 0, (F.col("id") % 70).cast("string")).alias("id")  # some are missing
    df = spark.range(70 * copies).select(ids, (F.col("id") % 3).alias("label"), F.floor(F.col("id") / 9).alias("x"))
    got = sampling.stratified_split(df, "id", "label", 0.75)
    assert "Sort" not in plan(got) and "hashpartitioning" not in plan(got)
    p = got.toPandas()
    assert sorted(map(str, p[["id", "label", "x"]].to_numpy().tolist())) == sorted(map(str, df.toPandas().to_numpy().tolist()))
    sizes = p.groupby("label").size()
    assert (p[p.part == "train"].groupby("label").size() == (sizes * 0.75).astype(int)).all()
    p["h"] = [hashlib.md5(f"42|{i}".encode()).hexdigest() if isinstance(i, str) else "" for i in p["id"]]
    for _, rows in p.groupby("label"):
        assert rows[rows.part == "train"]["h"].max() <= rows[rows.part == "test"]["h"].min()
        assert (rows.groupby("h")["part"].nunique() > 1).sum() <= 1


def test_a_learners_task_reads_no_more_rows_of_a_larger_file(spark, monkeypatch):
    monkeypatch.setattr(learners, "TASK_VALUES", 22 * 500)
    seen = []

    class Learner(learners.DecisionTreeClassifier):
        def _fit(self, dataset):
            seen.append((dataset.storageLevel.useMemory, learners._row_counts(dataset), sorted(r["_x"][0] for r in dataset.select("_x").collect())))
            return super()._fit(dataset)

    monkeypatch.setattr(learners, "DecisionTreeClassifier", Learner)
    for n in (4000, 16_000):
        df = spark.range(n, numPartitions=8).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).cast("string").alias("label"), F.col("id").cast("double").alias("x"))
        odd = df.withColumn("y", F.when(F.col("id") != "7", F.lit(0.0)))
        got = learners.decision_tree(odd, df.withColumn("y", F.lit(0.0)), "label", ["x", "y"], depth=3)
        assert got.count() == n
        cached, counts, xs = seen.pop()
        assert cached and xs == [float(i) for i in range(n) if i != 7]
        assert len(counts) >= 8 and max(counts) <= 600


@pytest.mark.parametrize("name, params", [("linear_svm", {"rounds": 2}), ("gradient_boosting", {"rounds": 1})])
def test_classes_of_many_rows_are_fitted_one_after_the_other(spark, monkeypatch, name, params):
    seen = []

    class Rest(learners.OneVsRest):
        def _fit(self, dataset):
            seen.append((self.getParallelism(), dataset.storageLevel.useMemory))
            return super()._fit(dataset)

    monkeypatch.setattr(learners, "OneVsRest", Rest)
    df = spark.range(900).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).cast("string").alias("label"), (F.col("id") % 3 + F.rand(2)).alias("x"))
    few = getattr(learners, name)(df, df, "label", ["x"], **params).collect()
    monkeypatch.setattr(learners, "TASK_VALUES", 1000)
    many = getattr(learners, name)(df, df, "label", ["x"], **params).collect()
    assert seen == [(4, True), (1, True)]
    assert len(few) == len(many) == 900


@pytest.mark.parametrize("per_task", [20_000_000, 21 * 300])
def test_boosting_fits_its_classes_on_kept_rows_that_were_moved_once_at_most(spark, monkeypatch, per_task):
    monkeypatch.setattr(learners, "TASK_VALUES", per_task)
    seen = []

    class Boosted(learners.GBTClassifier):
        def _fit(self, dataset):
            seen.append(plan(dataset))
            return super()._fit(dataset)

    monkeypatch.setattr(learners, "GBTClassifier", Boosted)
    copies = 6  # of every id, so that the split cuts through the rows of one
    df = spark.range(600 * copies, numPartitions=8).select(
        (F.col("id") % 600).cast("string").alias("id"), (F.col("id") % 3).cast("string").alias("label"), (F.col("id") % 3 + F.rand(2)).alias("x")
    )
    parts = sampling.stratified_split(df, "id", "label", 0.7512)  # 901 of 1200 rows
    train, test = (parts.where(F.col("part") == p).drop("part") for p in ("train", "test"))
    got = learners.gradient_boosting(train, test, "label", ["x"], rounds=2)
    assert got.count() == 3 * 299 and len(seen) == 3
    for p in seen:
        kept = p.split("InMemoryRelation")
        assert len(kept) == 2 and "Exchange" not in kept[0]  # every pass reads what is kept
        moved = kept[1].split("Initial Plan")[0].count("Exchange hashpartitioning")
        assert "Window" not in kept[1] and moved == (per_task < 20_000_000)


def test_a_search_keeps_its_rows_once_and_fits_many_rows_one_candidate_after_the_other(spark, monkeypatch):
    seen, open_fits = [], []

    class Learner(learners.LogisticRegression):
        def _fit(self, dataset):
            open_fits.append(1)
            kept = plan(dataset).split("InMemoryRelation")
            seen.append((len(open_fits), dataset.storageLevel.useMemory, len(kept), "vector" in kept[1] or "struct<type" in kept[1], kept[1].split("StorageLevel(")[1][:12], max(learners._row_counts(dataset))))
            try:
                return super()._fit(dataset)
            finally:
                open_fits.pop()

    monkeypatch.setitem(learners.ESTIMATORS, "logistic", lambda: Learner(maxIter=3))
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).cast("string").alias("label"), (F.col("id") % 3 + F.rand(2)).alias("x"))
    grid = {"regParam": [0.01, 0.1]}
    few = learners.grid_search(df, "logistic", grid, "label", ["x"], folds=3).collect()
    assert {s[4] for s in seen} == {"disk, memory"} and len(seen) == 6
    seen.clear()
    monkeypatch.setattr(learners, "TASK_VALUES", 21 * 200)
    many = learners.grid_search(df, "logistic", grid, "label", ["x"], folds=3).collect()
    assert [r.params for r in few] == [r.params for r in many] and np.allclose([r.mean_test_score for r in few], [r.mean_test_score for r in many], atol=0.01)
    # One fit at a time, of rows kept once, as plain numbers on disk alone, none of them in a large partition.
    assert len(seen) == 6
    for at_once, again, relations, vectors, level, most in seen:
        assert at_once == 1 and not again and relations == 2 and not vectors and level == "disk, 1 repl" and most < 250


def test_a_search_needs_rows_in_every_fold(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("c", "y", 3.0)], "id string, label string, v double")
    for folds in (1, 5):
        with pytest.raises(ValueError):
            learners.grid_search(df, "logistic", {"regParam": [0.1]}, "label", ["v"], folds=folds)


def test_the_forest_query_grows_all_its_trees_on_all_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(learners, "forest", lambda train, test, label, feats, id, names, draws, *_: seen.append((train, test, feats, draws)) or test)
    sf = "/root/testdata/sf0.001"
    entry.queries()["random_forest"](spark, sf)
    [(train, test, feats, draws)] = seen
    sizes = train.select(F.size(draws).alias("trees")).distinct().collect()
    assert [r.trees for r in sizes] == [1000]  # as the reference's forest of this table
    assert len(feats) == 64 and train.count() + test.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_a_forests_draws_are_kept_as_bytes(spark, monkeypatch):
    seen, coded = [], forest._coded

    def watched(rows, feats, cuts, keep):
        seen.extend(t for c, t in rows.dtypes if c == "ws")
        return coded(rows, feats, cuts, keep)

    monkeypatch.setattr(forest, "_coded", watched)
    df = spark.range(90).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).cast("string").alias("label"), (F.col("id") % 3).cast("double").alias("x"))
    got = learners.random_forest(df, df, "label", ["x"], trees=3)
    assert all(r.label == r.prediction for r in got.collect()) and seen == ["array<tinyint>"]


def test_large_nodes_count_only_the_features_they_are_offered(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).cast("string").alias("label"), *[F.rand(i).alias(f"x{i}") for i in range(9)])
    names, passes, counted = [f"x{i}" for i in range(9)], [], forest._counted

    def watched(drawn, now, *args):
        passes.append(len(now))
        return counted(drawn, now, *args)

    monkeypatch.setattr(forest, "_counted", watched)
    draws = F.array(F.lit(1), F.lit(1))
    got = [forest.forest(df, df, "label", names, "id", ["0", "1", "2"], draws, 30, 3, 42, 200).collect()]
    monkeypatch.setattr(forest, "OPEN_VALUES", 2 * 3 * forest.BINS * 4)  # counts of two nodes of three features
    passes.clear()
    got.append(forest.forest(df, df, "label", names, "id", ["0", "1", "2"], draws, 30, 3, 42, 200).collect())
    assert passes[0] == 2 and sorted(got[0]) == sorted(got[1])
