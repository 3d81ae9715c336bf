"""Classification and evaluation as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.operators import classify as ops
from tonelake.operators import evaluate as ev
from tonelake.operators import learners as ml
from tonelake.operators.sampling import stratified_folds, stratified_split
from tonelake.plans import tables as tb
from tonelake.plans.registry import query
from tonelake.plans.sampling_queries import folds_sql, split_sql
from tonelake.plans.stats_queries import _rounded

D3 = ["price", "discount", "tax"]


def _split(df):
    parts = stratified_split(df, "id", "label", 0.75)
    return parts.filter("part = 'train'").drop("part"), parts.filter("part = 'test'").drop("part")


def _vectors(spark, sf, d):
    return _split(tb.vectors(spark, sf, d))


def _split_cte(source_sql, source):
    return f"with {source_sql}, {split_sql(source, '0.75')}, tr as (select * from sp where part = 'train'), te as (select * from sp where part = 'test')"


# ---- closed forms --------------------------------------------------------------------

PICK = "select id, label, prediction from (select *, row_number() over (partition by id order by s desc, prediction) as rn from sc) where rn = 1"


@query(
    "lda_classify",
    _split_cte(tb.vectors_sql(2), "vectors")
    + ", c as (select label, count(*) as n, avg(x0) as m0, avg(x1) as m1 from tr group by label), "
    "p as (select sum((x0 - m0) * (x0 - m0)) / (count(*) - max(k)) as a, sum((x0 - m0) * (x1 - m1)) / (count(*) - max(k)) as b, "
    "sum((x1 - m1) * (x1 - m1)) / (count(*) - max(k)) as d, count(*) as total from tr join c on tr.label = c.label, (select count(*) as k from c)), "
    "w as (select label, (d * m0 - b * m1) / (a * d - b * b) as w0, (a * m1 - b * m0) / (a * d - b * b) as w1, m0, m1, n, total from c, p), "
    "sc as (select id, te.label, w.label as prediction, w0 * x0 + w1 * x1 - 5e-1 * (w0 * m0 + w1 * m1) + ln(n / total) as s from te, w) "
    + PICK,
)
def _(spark, sf):
    return ops.lda_classify(*_vectors(spark, sf, 2), "label", tb.xs(2))


@query(
    "qda_classify",
    _split_cte(tb.vectors_sql(1), "vectors")
    + ", c as (select label, count(*) as n, avg(x0) as m, var_samp(x0) as v from tr group by label), "
    "sc as (select id, te.label, c.label as prediction, ln(n / (select count(*) from tr)) - 5e-1 * ln(v) - 5e-1 * (x0 - m) * (x0 - m) / v as s from te, c) "
    + PICK,
)
def _(spark, sf):
    return ops.qda_classify(*_vectors(spark, sf, 1), "label", tb.xs(1))


def _nb_sql(train, test, extra=""):
    """CTE ``sc`` of naive Bayes scores; ``extra`` is a leading fold column, if any."""
    sel = f"{extra}, " if extra else ""
    on = f" and t.{extra} = c.{extra}" if extra else ""
    over = f"over (partition by {extra})" if extra else "over ()"
    stats = ", ".join(f"avg({x}) as m_{x}, var_pop({x}) as v_{x}" for x in D3)
    by = f"group by {extra}" if extra else ""
    glob = f"(select {sel}1e-9 * greatest({', '.join(f'var_pop({x})' for x in D3)}) as eps from {train} {by})"
    join = f"using ({extra})" if extra else "on true"
    ll = " + ".join(
        f"-5e-1 * ln(2 * pi() * (v_{x} + eps)) - 5e-1 * ({x} - m_{x}) * ({x} - m_{x}) / (v_{x} + eps)" for x in D3
    )
    return (
        f"c0 as (select {sel}label, count(*) as n, {stats} from {train} group by {sel}label), "
        f"c as (select c0.*, eps, sum(n) {over.replace('partition by ', 'partition by c0.')} as total from c0 join {glob} g {join}), "
        f"sc as (select t.id, t.label, {'t.' + extra + ', ' if extra else ''}c.label as prediction, ln(n / total) + {ll} as s from {test} t join c on true{on}) "
    )


@query("gaussian_nb", _split_cte(tb.FEATURES_SQL, "features") + ", " + _nb_sql("tr", "te") + PICK)
def _(spark, sf):
    return ops.gaussian_nb(*_split(tb.features(spark, sf).select("id", "label", *D3)), "label", D3)


def _knn_sql(d, k, power):
    terms = " + ".join(
        f"(te.x{i} - tr.x{i}) * (te.x{i} - tr.x{i})" if power == 2 else f"abs(te.x{i} - tr.x{i})" for i in range(d)
    )
    dist = f"round({'sqrt' if power == 2 else ''}({terms}), 9)"
    return (
        _split_cte(tb.vectors_sql(d), "vectors")
        + f", nn as (select te.id, te.label, tr.label as vote, row_number() over (partition by te.id order by {dist}, tr.id) as rn from te, tr), "
        f"v as (select id, label, vote, count(*) as n from nn where rn <= {k} group by all) "
        "select id, label, vote as prediction from (select *, row_number() over (partition by id order by n desc, vote) as r from v) where r = 1"
    )


@query("knn_classify", _knn_sql(64, 6, 2))
def _(spark, sf):
    return ops.knn_classify(*_vectors(spark, sf, 64), "label", tb.xs(64))


@query("knn_classify_manhattan", _knn_sql(64, 5, 1))
def _(spark, sf):
    return ops.knn_classify(*_vectors(spark, sf, 64), "label", tb.xs(64), k=5, p=1)


# ---- Spark ML learners: rows only ---------------------------------------------------


def _learner(name, fn, d=64, **params):
    @query(name)
    def _(spark, sf):
        return fn(*_vectors(spark, sf, d), "label", tb.xs(d), **params)


def _row_learner(name, fn, **params):
    """A learner over the order lines' three classes."""

    @query(name)
    def _(spark, sf):
        return fn(*_split(tb.features(spark, sf).select("id", "label", *D3)), "label", D3, **params)


_row_learner("decision_tree", ml.decision_tree)
_learner("decision_tree_depth3", ml.decision_tree, depth=3)
_learner("random_forest", ml.random_forest, trees=1000)
_row_learner("gradient_boosting", ml.gradient_boosting, rounds=2)
_learner("bagging", ml.bagging, bags=20)
_learner("bagging_lda", ml.bagging, bags=100, base="lda")


@query(
    "bagging_lda_2d",
    _split_cte(tb.vectors_sql(2), "vectors")
    + ", b as (select *, cast(concat('0x', substr(md5(concat('42|', id, '|', b)), 1, 8)) as ubigint) / 4294967296e0 as u from tr, range(50) t(b)), "
    f"wt as (select *, cast(len(list_filter([{', '.join(f'{p!r}::double' for p in ml.POISSON_ONE)}], lambda p: p <= u)) as double) as w from b), "
    "c as (select b, label, sum(w) as n, sum(w * x0) / sum(w) as m0, sum(w * x1) / sum(w) as m1 from wt group by all having sum(w) > 1), "
    "p as (select t.b, sum(w * (x0 - m0) * (x0 - m0)) / (sum(w) - count(distinct t.label)) as a, "
    "sum(w * (x0 - m0) * (x1 - m1)) / (sum(w) - count(distinct t.label)) as bb, "
    "sum(w * (x1 - m1) * (x1 - m1)) / (sum(w) - count(distinct t.label)) as d, sum(w) as total from wt t join c on t.b = c.b and t.label = c.label group by t.b), "
    "w as (select c.*, total, (d * m0 - bb * m1) / (a * d - bb * bb) as w0, (a * m1 - bb * m0) / (a * d - bb * bb) as w1 from c join p on c.b = p.b), "
    "sc as (select te.id, te.label, b, w.label as prediction, w0 * x0 + w1 * x1 - 5e-1 * (w0 * m0 + w1 * m1) + ln(n / total) as s from te, w), "
    "pr as (select id, label, prediction from (select *, row_number() over (partition by id, b order by s desc, prediction) as rn from sc) where rn = 1), "
    "v as (select id, label, prediction, count(*) as n from pr group by all) "
    "select id, label, prediction from (select *, row_number() over (partition by id order by n desc, prediction) as rn from v) where rn = 1",
)
def _(spark, sf):
    return ml.bagging(*_vectors(spark, sf, 2), "label", tb.xs(2), bags=50, base="lda")
_learner("adaboost", ml.adaboost, rounds=5)
_row_learner("logistic_regression", ml.logistic_regression, rounds=20)
_row_learner("linear_svm", ml.linear_svm, rounds=5)
_learner("mlp_classify", ml.mlp_classify, hidden=(16,), rounds=20)

# ---- votes, cascades, validation ----------------------------------------------------

RULES = {
    "m1": "case when l_extendedprice > 5e4 then 'A' else 'N' end",
    "m2": "case when l_discount > 5e-2 then 'R' else 'A' end",
    "m3": "case when l_tax > 4e-2 then 'N' else 'R' end",
}


@query(
    "vote_hard",
    "with p as (" + " union all ".join(
        f"select {tb.FEATURE_EXPRS['id']} as id, l_returnflag as label, {e} as prediction from lineitem" for e in RULES.values()
    ) + "), v as (select id, label, prediction, count(*) as n from p group by all) select id, label, prediction from "
    "(select *, row_number() over (partition by id order by n desc, prediction) as rn from v) where rn = 1",
)
def _(spark, sf):
    li = tb.table(spark, sf, "lineitem")
    models = F.array(*[F.expr(e) for e in RULES.values()])
    rows = li.select(F.expr(tb.FEATURE_EXPRS["id"]).alias("id"), F.col("l_returnflag").alias("label"), F.explode(models).alias("prediction"))
    return ops.vote_hard(rows)


@query("sequential_one_vs_rest")
def _(spark, sf):
    # Every class searches the best subsets of 30 features.
    return ops.sequential_one_vs_rest(tb.vectors(spark, sf, 30), "label", tb.xs(30))


FOLDED = (
    f"with {tb.FEATURES_SQL}, {folds_sql('features', 5)}, trn as (select f.fold, r.id, r.label, r.price, r.discount, r.tax "
    "from (select distinct fold from fd) f join fd r on r.fold <> f.fold), "
    + _nb_sql("trn", "fd", "fold")
    + ", pr as (select id, label, fold, prediction from (select *, row_number() over (partition by id order by s desc, prediction) as rn from sc) where rn = 1) "
)


def _cv(spark, sf):
    rows = stratified_folds(tb.features(spark, sf).select("id", "label", *D3), "id", "label", 5)
    return ops.cross_val_predict(rows, "nb", "label", D3)


@query("cross_val_predict", FOLDED + "select id, label, fold, prediction from pr")
def _(spark, sf):
    return _cv(spark, sf)


@query(
    "cross_val_score",
    FOLDED[:-1] + ", a as (select fold, label, count(*) as n, count(*) filter (where label = prediction) as tp from pr group by all) "
    "select fold, round(sum(tp) / sum(n), 6) as accuracy, round(avg(tp / n), 6) as balanced_accuracy from a group by fold",
)
def _(spark, sf):
    out = ev.overall_scores(_cv(spark, sf), ["fold"]).select("fold", "accuracy", "balanced_accuracy")
    return _rounded(out, ["accuracy", "balanced_accuracy"])


@query(
    "cross_val_predict_lda",
    f"with {tb.vectors_sql(2)}, {folds_sql('vectors', 5)}, trn as (select f.fold, r.label, r.x0, r.x1 "
    "from (select distinct fold from fd) f join fd r on r.fold <> f.fold), "
    "c as (select fold, label, count(*) as n, avg(x0) as m0, avg(x1) as m1 from trn group by all), "
    "p as (select t.fold, sum((x0 - m0) * (x0 - m0)) / (count(*) - count(distinct t.label)) as a, "
    "sum((x0 - m0) * (x1 - m1)) / (count(*) - count(distinct t.label)) as b, "
    "sum((x1 - m1) * (x1 - m1)) / (count(*) - count(distinct t.label)) as d, count(*) as total "
    "from trn t join c on t.fold = c.fold and t.label = c.label group by t.fold), "
    "w as (select c.fold, label, (d * m0 - b * m1) / (a * d - b * b) as w0, (a * m1 - b * m0) / (a * d - b * b) as w1, m0, m1, n, total "
    "from c join p on c.fold = p.fold), "
    "sc as (select id, fd.label, fd.fold, w.label as prediction, w0 * x0 + w1 * x1 - 5e-1 * (w0 * m0 + w1 * m1) + ln(n / total) as s "
    "from fd join w on fd.fold = w.fold) "
    "select id, label, fold, prediction from (select *, row_number() over (partition by id order by s desc, prediction) as rn from sc) where rn = 1",
)
def _(spark, sf):
    rows = stratified_folds(tb.vectors(spark, sf, 2), "id", "label", 5)
    return ops.cross_val_predict(rows, "lda", "label", tb.xs(2))


@query("grid_search")
def _(spark, sf):
    rows = tb.features(spark, sf).select("id", "label", *D3)
    return ml.grid_search(rows, "logistic", {"regParam": [0.01, 0.1], "maxIter": [10]}, "label", D3, folds=3)


@query(
    "grid_search_knn",
    f"with {tb.vectors_sql(64)}, {folds_sql('vectors', 3)}, "
    "pairs as (select te.id, te.label, te.fold, tr.id as tid, tr.label as vote, "
    f"round(sqrt({' + '.join(f'(te.x{i} - tr.x{i}) * (te.x{i} - tr.x{i})' for i in range(64))}), 9) as d2, "
    f"round({' + '.join(f'abs(te.x{i} - tr.x{i})' for i in range(64))}, 9) as d1 from fd te join fd tr on te.fold <> tr.fold), "
    "r as (select *, row_number() over (partition by id order by d2, tid) as r2, row_number() over (partition by id order by d1, tid) as r1 from pairs), "
    "c(k, p) as (values (3, 1), (3, 2), (5, 1), (5, 2)), "
    "v as (select k, p, fold, id, label, vote, count(*) as n from r join c on (p = 2 and r2 <= k) or (p = 1 and r1 <= k) group by all), "
    "w as (select *, row_number() over (partition by k, p, id order by n desc, vote) as rn from v), "
    "a as (select k, p, fold, avg(case when label = vote then 1e0 else 0e0 end) as acc from w where rn = 1 group by all), "
    "m as (select k, p, round(avg(acc), 9) as s from a group by k, p) "
    "select concat('{''k'': ', k, ', ''p'': ', p, '}') as params, s as mean_test_score, row_number() over (order by s desc, k, p) = 1 as best from m",
)
def _(spark, sf):
    out = ml.grid_search(tb.vectors(spark, sf, 64), "knn", {"k": [3, 5], "p": [1, 2]}, "label", tb.xs(64), folds=3)
    return _rounded(out, ["mean_test_score"], 9)


@query("successive_halving")
def _(spark, sf):
    cands = [{"maxDepth": d} for d in (2, 3, 4, 5)]
    return ml.successive_halving(tb.vectors(spark, sf, 64), "tree", cands, "label", tb.xs(64))


# ---- evaluation ----------------------------------------------------------------------

RULE = "case when l_extendedprice > 6e4 then 'A' when l_discount > 5e-2 then 'N' else 'R' end"
PRED = f"with pr as (select l_returnflag as label, {RULE} as prediction from lineitem) "
CLS = (
    PRED[:-1] + ", k as (select distinct label as cls from pr), c as (select cls, count(*) filter (where label = cls) as act, "
    "count(*) filter (where prediction = cls) as prd, count(*) filter (where label = cls and prediction = cls) as tp, count(*) as total "
    "from pr, k group by cls), m as (select *, tp / act as sens, (total - act - prd + tp) / (total - act) as spec, tp / prd as ppv, "
    "(total - act - prd + tp) / (total - prd) as npv, 2e0 * tp / (act + prd) as f1 from c) "
)


def _pred(spark, sf):
    li = tb.table(spark, sf, "lineitem")
    return li.select(F.col("l_returnflag").alias("label"), F.expr(RULE).alias("prediction"))


@query("confusion_matrix", PRED + "select label, prediction, count(*) as n from pr group by all")
def _(spark, sf):
    return ev.confusion_matrix(_pred(spark, sf))


@query(
    "classification_report",
    CLS + ", r as (select cls as row, ppv as precision, sens as recall, f1, act as support from m union all "
    "select 'accuracy', sum(tp) / sum(act), sum(tp) / sum(act), sum(tp) / sum(act), sum(act) from m union all "
    "select 'macro avg', avg(ppv), avg(sens), avg(f1), sum(act) from m union all "
    "select 'weighted avg', sum(ppv * act) / sum(act), sum(sens * act) / sum(act), sum(f1 * act) / sum(act), sum(act) from m) "
    "select row, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from r",
)
def _(spark, sf):
    return _rounded(ev.classification_report(_pred(spark, sf)), ["precision", "recall", "f1"])


@query(
    "balanced_accuracy",
    CLS + "select round(sum(tp) / sum(act), 6) as accuracy, round(avg(sens), 6) as balanced_accuracy, "
    "round(sum(f1 * act) / sum(act), 6) as f1_weighted, round(avg(f1), 6) as f1_macro from m",
)
def _(spark, sf):
    out = ev.balanced_accuracy(_pred(spark, sf))
    return _rounded(out, out.columns)


@query("f1_binary", CLS + "select round(f1, 6) as f1 from m where cls = 'A'")
def _(spark, sf):
    return _rounded(ev.f1_binary(_pred(spark, sf), "A"), ["f1"])


@query(
    "class_metrics_11",
    CLS + "select cls as class, round(sens, 6) as sensitivity, round(spec, 6) as specificity, round(ppv, 6) as pos_pred_value, "
    "round(npv, 6) as neg_pred_value, round(ppv, 6) as precision, round(sens, 6) as recall, round(f1, 6) as f1, "
    "round(act / total, 6) as prevalence, round(tp / total, 6) as detection_rate, round(prd / total, 6) as detection_prevalence, "
    "round((sens + spec) / 2, 6) as balanced_accuracy from m",
)
def _(spark, sf):
    out = ev.class_metrics_11(_pred(spark, sf))
    return _rounded(out, out.columns[1:])


ROC = (
    f"with {tb.IMBALANCED_SQL}, s as (select n_chars as threshold, count(*) filter (where label = 'toxic') as pos, "
    "count(*) filter (where label <> 'toxic') as neg from imbalanced group by n_chars), "
    "c as (select *, cast(sum(pos) over w as bigint) as tp, cast(sum(neg) over w as bigint) as fp, sum(pos) over () as p, sum(neg) over () as n "
    "from s window w as (order by threshold desc)) "
)


def _roc(spark, sf):
    s = tb.imbalanced(spark, sf).select((F.col("label") == "toxic").cast("int").alias("label"), F.col("n_chars").alias("score"))
    return ev.roc_points(s)


@query("roc_points", ROC + "select threshold, pos, neg, tp, fp, round(tp / p, 6) as tpr, round(fp / n, 6) as fpr from c")
def _(spark, sf):
    return _rounded(_roc(spark, sf), ["tpr", "fpr"])


@query("roc_auc", ROC + "select round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) as auc from c")
def _(spark, sf):
    return _rounded(ev.roc_auc(_roc(spark, sf)), ["auc"])


@query(
    "gini_impurity",
    "with c as (select c_nationkey, c_mktsegment, count(*) as n from customer group by all) "
    "select c_nationkey, round(1 - sum(n * n) / (sum(n) * sum(n)), 6) as gini from c group by c_nationkey",
)
def _(spark, sf):
    return _rounded(ev.gini_impurity(tb.table(spark, sf, "customer"), "c_mktsegment", "c_nationkey"), ["gini"])
