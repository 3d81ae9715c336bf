"""Spark ML learners behind one signature, ensembles, and model search."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.operators.classify import cross_val_predict, knn_classify, lda_weights
from tonelake.operators.evaluate import overall_scores
from tonelake.operators.forest import forest
from tonelake.operators.frames import complete_rows
from tonelake.operators.moments import Moments, moment_rows, total
from tonelake.operators.neighbours import nearest_rows
from tonelake.operators.sampling import sample_frames, stratified_folds
from tonelake.session import checkpoint


class _Prepared:
    """Rows with all features as ``_y`` (codes of the sorted labels) and ``_x``."""

    def __init__(self, train: DataFrame, label: str, feats: Sequence[str], scale: bool):
        self.feats = list(feats)
        index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
        self.labels = list(index.labels)
        self.stages = [index, VectorAssembler(inputCols=self.feats, outputCol="_x0" if scale else "_x")]
        if scale:
            self.stages.append(StandardScaler(inputCol="_x0", outputCol="_x", withMean=True).fit(self.transform(train)))

    def transform(self, df: DataFrame) -> DataFrame:
        rows = complete_rows(df, self.feats)
        for stage in self.stages:
            rows = stage.transform(rows)
        return rows


def _prepared(train: DataFrame, label: str, feats: Sequence[str], scale: bool = False) -> _Prepared:
    return _Prepared(train, label, feats, scale)


def _labels(prep: _Prepared) -> list[str]:
    return prep.labels


TASK_VALUES = 20_000_000  # numbers, with some twenty more a row, of one partition's rows: a learner keeps several forms of them


def _row_counts(rows: DataFrame) -> list[int]:
    """Rows per partition, without the empty ones."""
    per = rows.groupBy(F.spark_partition_id().alias("_i")).agg(F.count(F.lit(1)).alias("n"))
    return [r["n"] for r in per.collect()]  # one row per partition


def _spread(rows: DataFrame, counts: list[int], feats: Sequence[str], id: str, cols: Sequence[str] = ("_x", "_y")) -> DataFrame:
    """``cols`` of the rows in partitions that a task can hold, at least one per core; ``counts`` are the partitions' rows at most.

    Files may be cut into a few large pieces, and a learner's task reads all of its piece in each of many passes. Then the rows are
    dealt out once by a hash and put in its order, so that neither the cut of the files nor the order of arrival matters."""
    if len(counts) >= rows.sparkSession.sparkContext.defaultParallelism and max(counts) <= _task_rows(feats):
        return rows.select(*cols)
    return _dealt(rows.withColumn("_p", _place(id, feats)), sum(counts), feats, cols)


def _task_rows(feats: Sequence[str]) -> int:
    return max(1, TASK_VALUES // (len(feats) + 20))


def _place(id: str, feats: Sequence[str]) -> Column:
    return F.xxhash64(id, *feats)


def _dealt(rows: DataFrame, n: int, feats: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``cols`` of at most ``n`` rows, dealt out by their ``_p`` to partitions that a task can hold and put in its order."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    dealt = rows.select(*cols, "_p").repartition(max(cores, math.ceil(n / _task_rows(feats))), "_p")
    return dealt.sortWithinPartitions("_p", "_y").select(*cols)


def _few(df: DataFrame, n: int, feats: Sequence[str]) -> bool:
    """Whether ``n`` rows are few enough for several learners side by side, each of which keeps its own forms of all of them."""
    return n * (len(feats) + 20) <= TASK_VALUES * df.sparkSession.sparkContext.defaultParallelism


def _against_rest(classifier: Estimator, train: DataFrame, n: int, feats: Sequence[str]) -> OneVsRest:
    """One class against the rest at a time; side by side only where few rows are kept."""
    return OneVsRest(classifier=classifier, parallelism=4 if _few(train, n, feats) else 1)


def _named(scored: DataFrame, labels: list[str], label: str, id: str) -> DataFrame:
    back = IndexToString(inputCol="prediction", outputCol="_name", labels=[*labels, "?"])
    return back.transform(scored).select(id, F.col(label).alias("label"), F.col("_name").alias("prediction"))


def _learn(train, test, label, feats, id, learner: Callable[[int], Estimator], scale=False) -> DataFrame:
    """Predictions of what ``learner`` gives for the number of rows to learn from."""
    prep = _prepared(train, label, feats, scale)
    counts = _row_counts(train)
    estimator = learner(sum(counts)).setFeaturesCol("_x").setLabelCol("_y")
    rows = _spread(prep.transform(train), counts, feats, id).persist()  # else read, split and dealt out anew for each of a learner's first passes
    try:
        model = estimator.fit(rows)
    finally:
        rows.unpersist()
    return _named(model.transform(prep.transform(test)), _labels(prep), label, id)


def decision_tree(train, test, label, feats, id="id", depth: int = 30, seed: int = 42) -> DataFrame:
    return _learn(train, test, label, feats, id, lambda n: DecisionTreeClassifier(maxDepth=depth, seed=seed))


def random_forest(train, test, label, feats, id="id", trees: int = 100, depth: int = 30, seed: int = 42) -> DataFrame:
    """Trees on weighted redraws of the rows, every node offered the square root of the features, by the sum of their leaves' shares."""
    return _forest(train, test, label, feats, id, trees, depth, math.ceil(math.sqrt(len(feats))), seed)


def _forest(train, test, label, feats, id, trees: int, depth: int, per_node: int, seed: int) -> DataFrame:
    names = [r["l"] for r in train.select(F.col(label).cast("string").alias("l")).distinct().dropna().orderBy("l").collect()]  # one row per class
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda b: _bag_weight("id", b, seed))
    return forest(train, test, label, feats, id, names, draws, depth, per_node, seed)


def gradient_boosting(train, test, label, feats, id="id", rounds: int = 1000, depth: int = 3, seed: int = 42):
    """Boosted trees, one class against the rest at a time (the learner itself is binary)."""
    base = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, checkpointInterval=10)
    return _learn(train, test, label, feats, id, lambda n: _against_rest(base, train, n, feats))


def logistic_regression(train, test, label, feats, id="id", c: float = 1.0, rounds: int = 100) -> DataFrame:
    """L2 penalty 1/(c * rows), the per-row form of an inverse-strength ``c``, on the weights of standardized features."""
    return _learn(train, test, label, feats, id, lambda n: LogisticRegression(maxIter=rounds, regParam=1.0 / (c * max(n, 1))))


def linear_svm(train, test, label, feats, id="id", c: float = 1.0, rounds: int = 100) -> DataFrame:
    def learner(n):
        return _against_rest(LinearSVC(maxIter=rounds, regParam=1.0 / (c * max(n, 1))), train, n, feats)

    return _learn(train, test, label, feats, id, learner)


def mlp_classify(train, test, label, feats, id="id", hidden: Sequence[int] = (100,), rounds: int = 100, seed: int = 42):
    prep = _prepared(train, label, feats, scale=True)
    layers = [len(feats), *hidden, len(_labels(prep))]
    net = MultilayerPerceptronClassifier(
        layers=layers, maxIter=rounds, seed=seed, featuresCol="_x", labelCol="_y"
    )
    rows = _spread(prep.transform(train), _row_counts(train), feats, id)
    return _named(net.fit(rows).transform(prep.transform(test)), _labels(prep), label, id)


# ---- ensembles -----------------------------------------------------------------------

# Cumulative Poisson(1) probabilities of 0..13 draws: more are rarer than the step of the draw below.
POISSON_ONE = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(i + 1)) for i in range(14)]


def _bag_weight(id: str, bag: Column, seed: int) -> Column:
    """How often a row is drawn into a bag: Poisson(1) from the md5 of seed, row and bag."""
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id).cast("string"), F.lit("|"), bag.cast("string")))
    u = F.conv(F.substring(draw, 1, 8), 16, 10).cast("long").cast("double") / float(2**32)
    return F.size(F.filter(F.array(*[F.lit(p) for p in POISSON_ONE]), lambda p: p <= u)).cast("double")


def _vote(preds: Column, labels: list[str]) -> Column:
    """Most frequent label of an array; ties go to the smallest."""
    names = F.array(*[F.lit(x) for x in sorted(labels)])
    votes = F.transform(names, lambda l, i: F.struct(F.size(F.filter(preds, lambda p: p == l)).alias("n"), (-i).alias("i"), l.alias("l")))
    return F.array_max(votes)["l"]


def bagging(train, test, label, feats, id="id", bags: int = 1000, base: str = "tree", seed: int = 42, depth: int = 30):
    """Models on weighted redraws of the rows, by majority vote.

    Trees bag in one forest with every feature offered to every node. Discriminants
    take all bags' moments in one pass and are solved by the tasks. Other bases fit bag by bag.
    """
    if base == "tree":
        return _forest(train, test, label, feats, id, bags, depth, len(feats), seed)
    if base == "lda":
        return _bagged_discriminants(train, test, label, list(feats), id, bags, seed)
    if base in ("logistic", "knn"):
        prep = _prepared(train, label, feats)
        labels, counts = _labels(prep), _row_counts(train)
        votes = None
        for b in range(bags):
            bag = train.withColumn("_w", _bag_weight(id, F.lit(b), seed)).filter("_w > 0")
            if base == "knn":  # a row drawn twice is there twice, so it votes twice
                bag = bag.withColumn("_w", F.explode(F.array_repeat("_w", F.col("_w").cast("int"))))
                one = knn_classify(bag, test, label, feats, id).withColumn("_b", F.lit(b))
            else:
                fit = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w").fit(_spread(prep.transform(bag), counts, feats, id, ["_x", "_y", "_w"]))
                one = _named(fit.transform(prep.transform(test)), labels, label, id).withColumn("_b", F.lit(b))
            votes = one if votes is None else votes.unionByName(one)
        per = votes.groupBy(id, "label").agg(F.collect_list("prediction").alias("_ps"))  # one entry per bag
        return per.select(id, "label", _vote(F.col("_ps"), labels).alias("prediction"))
    raise ValueError(f"unknown base {base!r}")


MODEL_VALUES = 4_000_000  # weights of bagged discriminants sent to every task at once (32 MB)


def _bagged_discriminants(train, test, label, feats: list[str], id, bags: int, seed: int) -> DataFrame:
    """All bags' moments in one pass, each bag solved in a task of its own, and every row's votes counted where it stands.

    Models go to the tasks in blocks of at most ``MODEL_VALUES`` numbers. Classes of one row or none in a bag are not in its model."""
    d = len(feats)
    weights = F.transform(F.sequence(F.lit(0), F.lit(bags - 1)), lambda b: _bag_weight(id, b, seed))
    rows = moment_rows(train.withColumn("_w", weights), [label], feats, weights="_w")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {c: total(Moments.unpacked(v, d) for v in g["v"]) for c, g in pdf.groupby("k0")}
        parts = {c: m for c, m in parts.items() if m.n > 1}
        if not parts:
            return pd.DataFrame({"s": [], "label": [], "w": []})
        centre, fits = lda_weights(parts)
        # Around zero instead of the bag's mean: the constant takes up the difference.
        return pd.DataFrame({"s": int(pdf["s"].iloc[0]), "label": list(fits), "w": [[b - w @ centre, *w] for w, b in fits.values()]})

    models = checkpoint(rows.groupBy("s").applyInPandas(solve, "s int, label string, w array<double>"))
    names = sorted(r["label"] for r in models.select("label").distinct().collect())  # one row per class
    block = max(1, MODEL_VALUES // max(1, len(names) * (d + 1)))
    votes = None
    for lo in range(0, bags, block):
        part = models.where((F.col("s") >= lo) & (F.col("s") < lo + block)).toPandas()
        one = _votes(test, part, names, label, feats, id)
        votes = one if votes is None else votes.unionByName(one)
    if bags > block:
        votes = votes.groupBy(id, "label").agg(F.array(*[F.sum(F.col("votes")[i]) for i in range(len(names))]).alias("votes"))
    best = F.array_max(F.transform("votes", lambda n, i: F.struct(n.alias("n"), (-i).alias("i"))))
    return votes.select(id, "label", F.get(F.array(*[F.lit(x) for x in names]), -best["i"]).alias("prediction"))


def _votes(test: DataFrame, models: pd.DataFrame, names: list[str], label, feats: list[str], id) -> DataFrame:
    """How many of the models name each class, for every row; a model's equal scores go to the smallest name."""
    sets = sorted(set(models["s"]))
    at = {s: i for i, s in enumerate(sets)}
    table = np.zeros((len(sets), len(names), len(feats) + 1))
    table[:, :, 0] = -np.inf
    for s, c, w in zip(models["s"], models["label"], models["w"]):
        table[at[s], names.index(c)] = w
    sent = test.sparkSession.sparkContext.broadcast(table)

    def count(batches):
        table = sent.value
        for b in batches:
            x = b[feats].to_numpy(dtype=float)
            found = np.zeros((len(b), len(names)), np.int64)
            for lo in range(0, len(b), 64):
                p = x[lo : lo + 64] @ table[:, :, 1:].reshape(-1, len(feats)).T + table[:, :, 0].ravel()
                pick = p.reshape(-1, len(sets), len(names)).argmax(axis=2)
                for c in range(len(names)):
                    found[lo : lo + 64, c] = (pick == c).sum(axis=1)
            yield pd.DataFrame({id: b[id], "label": b["label"], "votes": list(found)})

    rows = complete_rows(test.select(id, F.col(label).cast("string").alias("label"), *[F.col(c).cast("double").alias(c) for c in feats]), feats)
    kind = dict(rows.dtypes)[id]
    return rows.mapInPandas(count, f"{id} {kind}, label string, votes array<long>")


def adaboost(
    train, test, label, feats, id="id", rounds: int = 1000, depth: int = 1, rate: float = 1.0, seed: int = 42
) -> DataFrame:
    """Multi-class boosting: each round's tree sees the rows the others got wrong.

    Row weights are updated in the table; lineage is cut every ten rounds.
    """
    prep = _prepared(train, label, feats)
    labels = _labels(prep)
    k = len(labels)
    rows = _spread(prep.transform(train), _row_counts(train), feats, id).withColumn("_w", F.lit(1.0)).persist()
    fitted = []
    for m in range(rounds):
        tree = DecisionTreeClassifier(
            featuresCol="_x", labelCol="_y", weightCol="_w", maxDepth=depth, seed=seed, predictionCol="_p",
            rawPredictionCol="_r", probabilityCol="_q",
        ).fit(rows)
        scored = tree.transform(rows).withColumn("_miss", (F.col("_p") != F.col("_y")).cast("double"))
        s = scored.agg(F.sum(F.col("_w") * F.col("_miss")).alias("e"), F.sum("_w").alias("w")).first()
        err = s["e"] / s["w"]
        if err <= 0:
            fitted.append((tree, 1.0))
            break
        if err >= 1 - 1 / k:
            if not fitted:
                fitted.append((tree, 1.0))
            break
        alpha = rate * (math.log((1 - err) / err) + math.log(k - 1))
        fitted.append((tree, alpha))
        grown = F.col("_w") * F.exp(F.lit(alpha) * F.col("_miss")) / F.lit(s["w"] * (1 - err + err * math.exp(alpha)))
        # Weights sum to the same total for every round, so none can overflow.
        n = F.lit(float(s["w"]))
        before, rows = rows, scored.withColumn("_w", grown * n).select("_x", "_y", "_w")
        rows = checkpoint(rows) if (m + 1) % 10 == 0 else rows.persist()
        before.unpersist()
    out = prep.transform(test)
    power = [F.lit(0.0)] * k
    for i, (tree, alpha) in enumerate(fitted):
        out = tree.copy({tree.predictionCol: f"_p{i}"}).transform(out).drop("_r", "_q")
        power = [p + F.when(F.col(f"_p{i}") == c, alpha).otherwise(0.0) for c, p in enumerate(power)]
    best = F.array_max(F.array(*[F.struct(F.round(p, 9).alias("s"), F.lit(-c).alias("i")) for c, p in enumerate(power)]))
    names = F.array(*[F.lit(x) for x in labels])
    return out.select(id, F.col(label).alias("label"), F.get(names, -best["i"]).alias("prediction"))


# ---- model search --------------------------------------------------------------------

class BalancedAccuracy(Evaluator):
    """Mean over the labels of the share of their rows that are predicted right."""

    def _evaluate(self, dataset: DataFrame) -> float:
        hit = F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("recall")
        return dataset.groupBy("_y").agg(hit).agg(F.avg("recall")).first()[0]


METRICS = {
    "accuracy": lambda: MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy"),
    "f1_weighted": lambda: MulticlassClassificationEvaluator(labelCol="_y", metricName="f1"),
    "balanced_accuracy": BalancedAccuracy,
}

ESTIMATORS = {
    "logistic": lambda: LogisticRegression(maxIter=50, maxBlockSizeInMB=0.25),
    "tree": lambda: DecisionTreeClassifier(seed=42),
    "forest": lambda: RandomForestClassifier(seed=42),
}


def _combinations(grid: dict[str, Sequence]) -> list[dict]:
    names = sorted(grid)
    return [dict(zip(names, values)) for values in itertools.product(*[grid[n] for n in names])]


def _fold_scores(df, model: str, cands: list[dict], label, feats, folds: int, metric, id, parallelism) -> list[float]:
    """Mean validation score of every candidate over the same folds.

    Discriminants and Bayes have no parameters: a candidate that names one is an error.
    """
    if model not in ESTIMATORS and model != "knn" and any(cands):
        raise ValueError(f"{model} has no parameters to search")
    if model in ESTIMATORS:
        return _learner_scores(df, ESTIMATORS[model](), cands, label, feats, folds, METRICS[metric](), id, parallelism)
    rows = stratified_folds(df, id, label, folds)
    if model == "knn":
        return _knn_scores(rows, cands, label, feats, folds, metric, id)
    out = []
    for _ in cands:
        per = overall_scores(cross_val_predict(rows, model, label, feats, "fold", id), ["fold"])
        out.append(per.agg(F.avg(metric)).first()[0])
    return out


def _learner_scores(df: DataFrame, est: Estimator, cands: list[dict], label, feats, folds: int, evaluator: Evaluator, id, parallelism) -> list[float]:
    """Mean score of every candidate of a Spark ML learner over the same folds.

    The rows are kept once, as plain numbers in partitions that a task can hold; every fold and candidate reads them from there and makes
    its vectors in passing. Where they are many they are kept on disk and candidates are fitted one after the other, so that
    only the forms that one learner keeps of its rows take up memory."""
    index, assemble = _prepared(df, label, feats).stages
    est = est.setFeaturesCol("_x").setLabelCol("_y")
    rows = stratified_folds(df.withColumn("_p", _place(id, feats)), id, label, folds)  # the place is taken before: no id is moved after the ranks
    coded = index.transform(complete_rows(rows, feats))
    # Codes as integers take two bytes each where they are kept; learners read the number of classes from the column's metadata.
    coded = coded.withColumn("_y", F.col("_y").cast("int").alias("_y", metadata=coded.schema["_y"].metadata))
    n = df.count()
    few = _few(df, n, feats)
    kept = _dealt(coded, n, feats, [*feats, "_y", "fold"]).persist(StorageLevel.MEMORY_AND_DISK_DESER if few else StorageLevel.DISK_ONLY)
    try:
        filled = {r["fold"] for r in kept.select("fold").distinct().collect()}  # one row per fold
        if folds < 2 or len(filled) < folds:
            raise ValueError(f"{folds} folds need rows in each of them and in the others")

        def score(i: int, f: int) -> float:
            part = assemble.transform(kept.where(F.col("fold") != f)).select("_x", "_y")
            fitted = est.fit(part, {est.getParam(p): v for p, v in cands[i].items()})
            return evaluator.evaluate(fitted.transform(assemble.transform(kept.where(F.col("fold") == f)).select("_x", "_y")))

        per, inherit = [], inheritable_thread_target(df.sparkSession)
        with ThreadPool(min(parallelism, len(cands)) if few else 1) as pool:
            for f in range(folds):
                per.append(pool.map(inherit(lambda i, f=f: score(i, f)), range(len(cands)), chunksize=1))
        return np.mean(per, axis=0).tolist()
    finally:
        kept.unpersist()


def _knn_scores(rows: DataFrame, cands: list[dict], label, feats, folds: int, metric, id) -> list[float]:
    """Mean score of every (k, p): one search per fold and p, at the largest k; a smaller k is a prefix of its ranks."""
    wanted = [(int(c.get("k", 6)), int(c.get("p", 2))) for c in cands]
    rows = checkpoint(rows)  # every search reads the same folds
    points = rows.withColumn("_label", F.col(label).cast("string"))
    found = None
    for p in sorted({p for _, p in wanted}):
        ks = sorted({k for k, q in wanted if q == p})
        every = F.array(*[F.lit(k) for k in ks])
        for f in range(folds):
            test, train = rows.where(F.col("fold") == f), points.where(F.col("fold") != f)
            near = nearest_rows(test, train, id, feats, ks[-1], power=p, extra=["_label"], values=False)
            near = near.select("query_id", "p__label", F.explode(F.filter(every, lambda k: k >= F.col("rank"))).alias("k"))
            near = near.withColumn("p", F.lit(p)).withColumn("fold", F.lit(f))
            found = near if found is None else found.unionByName(near)
    votes = found.groupBy("p", "k", "fold", "query_id", "p__label").agg(F.count(F.lit(1)).alias("n"))
    won = votes.groupBy("p", "k", "fold", "query_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("p__label").alias("l")))["l"].alias("prediction"))
    truth = rows.select(F.col(id).cast("string").alias("query_id"), F.col(label).alias("label"))
    per = overall_scores(won.join(truth, "query_id"), ["p", "k", "fold"])
    mean = {(r["k"], r["p"]): r["m"] for r in per.groupBy("p", "k").agg(F.avg(metric).alias("m")).collect()}  # one row per candidate
    return [mean[w] for w in wanted]


def grid_search(
    df, model: str, grid: dict[str, Sequence], label, feats, folds: int = 5, metric: str = "accuracy", id="id",
    parallelism: int = 4,
) -> DataFrame:
    """Mean score of every parameter combination; ``best`` marks the first highest."""
    cands = _combinations(grid)
    scores = _fold_scores(df, model, cands, label, feats, folds, metric, id, parallelism)
    top = max(range(len(cands)), key=lambda i: (round(scores[i], 9), -i))
    rows = [(str(c), float(s), i == top) for i, (c, s) in enumerate(zip(cands, scores))]
    return df.sparkSession.createDataFrame(rows, "params string, mean_test_score double, best boolean")


def successive_halving(
    df, model: str, cands: list[dict], label, feats, factor: int = 2, folds: int = 3, metric: str = "accuracy",
    id="id", seed: int = 42, parallelism: int = 4,
) -> DataFrame:
    """Rounds on growing samples; each keeps the best 1/factor of the candidates.

    The first sample is as large as lets the last round use all rows.
    (iter, n_rows, params, mean_test_score, rank).
    """
    n = df.count()
    rounds = 1 + int(math.floor(math.log(len(cands), factor)))
    left = list(cands)
    table = []
    for r in range(rounds):
        size = n // factor ** (rounds - 1 - r)
        part = df if size == n else sample_frames(df, id, size, seed)
        scores = _fold_scores(part, model, left, label, feats, folds, metric, id, parallelism)
        order = sorted(range(len(left)), key=lambda i: (-round(scores[i], 9), i))
        for rank, i in enumerate(order):
            table.append((r, size, str(left[i]), float(scores[i]), rank + 1))
        left = [left[i] for i in order[: max(1, math.ceil(len(left) / factor))]]
    return df.sparkSession.createDataFrame(
        table, "iter int, n_rows long, params string, mean_test_score double, rank int"
    )
