"""Feature ranking, subset search and axes as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.operators import selection as ops
from tonelake.operators.frames import impute_mean
from tonelake.operators.sampling import stratified_folds
from tonelake.operators.windows import cumulative_variance
from tonelake.plans import tables as tb
from tonelake.plans.registry import query
from tonelake.plans.sampling_queries import folds_sql
from tonelake.plans.stats_queries import LONG, _rounded

VEC = 30  # leading dimensions used as features of an embedding
SWEEP = 8  # and those of the sweeps
D3 = ["price", "discount", "tax"]


def _f_sql(source, label, name):
    """CTE (feature, f) of the one-way F of long rows."""
    return (
        f"{name}_c as (select feature, {label} as cls, count(*) as n, avg(value) as m, var_pop(value) as v from {source} "
        f"where value is not null group by all), {name}_g as (select *, sum(n * m) over (partition by feature) / "
        f"sum(n) over (partition by feature) as g from {name}_c), {name} as (select feature, "
        f"(sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) as f from {name}_g group by feature)"
    )


ORDER = "case feature " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(tb.FEATS)) + " end"


@query("anova_f", LONG[:-1] + f", {_f_sql('long', 'label', 'a')} select feature, round(f, 6) as f from a")
def _(spark, sf):
    return _rounded(ops.anova_f(tb.features(spark, sf), "label", tb.FEATS), ["f"])


def _top(source):
    return f"select feature, round(f, 6) as f, cast(row_number() over (order by round(f, 6) desc, {ORDER}) as integer) as rank from {source} qualify rank <= 2"


@query("select_k_best", LONG[:-1] + f", {_f_sql('long', 'label', 'a')} " + _top("a"))
def _(spark, sf):
    return _rounded(ops.select_k_best(tb.features(spark, sf), "label", tb.FEATS, 2), ["f"])


_ONE = "case when label = 'A' then 'A' else 'OTHER' end"


@query("select_k_best_one_vs_rest", LONG[:-1] + f", {_f_sql('long', _ONE, 'a')} " + _top("a"))
def _(spark, sf):
    return _rounded(ops.select_k_best(tb.features(spark, sf), "label", tb.FEATS, 2, target="A"), ["f"])


def _folded(spark, sf, k=10):
    return stratified_folds(tb.vectors(spark, sf, SWEEP), "id", "label", k)


@query("k_sweep")
def _(spark, sf):
    out = ops.k_sweep(_folded(spark, sf), "label", tb.xs(SWEEP), list(range(1, SWEEP + 1)))
    return _rounded(out, ["accuracy", "f1_weighted"])


# The sweep over two features: the discriminant on the better one by F, then on both, over ten folds.
SWEEP2 = (
    f"with {tb.vectors_sql(2)}, {folds_sql('vectors', 10)}, long as (select label, 'x0' as feature, x0 as value from fd union all "
    f"select label, 'x1', x1 from fd), {_f_sql('long', 'label', 'a')}, "
    "t as (select case when max(round(f, 6)) filter (where feature = 'x0') >= max(round(f, 6)) filter (where feature = 'x1') then 'x0' else 'x1' end as top from a), "
    "z as (select id, label, fold, x0, x1, case when top = 'x0' then x0 else x1 end as z from fd, t), "
    "trn as (select f.fold, r.label, r.x0, r.x1, r.z from (select distinct fold from z) f join z r on r.fold <> f.fold), "
    "c as (select fold, label, count(*) as n, avg(x0) as m0, avg(x1) as m1, avg(z) as mz from trn group by all), "
    "p as (select t.fold, sum((x0 - m0) * (x0 - m0)) / (count(*) - count(distinct t.label)) as a, "
    "sum((x0 - m0) * (x1 - m1)) / (count(*) - count(distinct t.label)) as b, "
    "sum((x1 - m1) * (x1 - m1)) / (count(*) - count(distinct t.label)) as d, "
    "sum((z - mz) * (z - mz)) / (count(*) - count(distinct t.label)) as s, count(*) as total "
    "from trn t join c on t.fold = c.fold and t.label = c.label group by t.fold), "
    "w as (select c.*, p.* exclude (fold), (d * m0 - b * m1) / (a * d - b * b) as w0, (a * m1 - b * m0) / (a * d - b * b) as w1 from c join p on c.fold = p.fold), "
    "sc as (select 1 as k, id, z.label, w.label as prediction, mz / s * z - 5e-1 * mz / s * mz + ln(n / total) as s from z join w on z.fold = w.fold "
    "union all select 2, id, z.label, w.label, w0 * x0 + w1 * x1 - 5e-1 * (w0 * m0 + w1 * m1) + ln(n / total) from z join w on z.fold = w.fold), "
    "pr as (select k, label, prediction from (select *, row_number() over (partition by k, id order by s desc, prediction) as rn from sc) where rn = 1), "
    "cl as (select k, l.label, count(*) filter (where pr.label = l.label) as act, count(*) filter (where prediction = l.label) as prd, "
    "count(*) filter (where pr.label = l.label and prediction = l.label) as tp from pr, (select distinct label from vectors) l group by all), "
    "o as (select k, sum(tp) / sum(act) as accuracy, sum(2e0 * tp / (act + prd) * act) / sum(act) as f1 from cl group by k) "
    "select k, round(accuracy, 6) as accuracy, round(f1, 6) as f1_weighted, case when k = 1 then top when top = 'x0' then 'x0,x1' else 'x1,x0' end as features, "
    "row_number() over (order by round(f1, 9) desc, k) = 1 as best from o, t"
)


@query("k_sweep_2d", SWEEP2)
def _(spark, sf):
    rows = stratified_folds(tb.vectors(spark, sf, 2), "id", "label", 10)
    return _rounded(ops.k_sweep(rows, "label", tb.xs(2), [1, 2]), ["accuracy", "f1_weighted"])


@query("k_sweep_leak_free")
def _(spark, sf):
    out = ops.k_sweep(_folded(spark, sf), "label", tb.xs(SWEEP), list(range(1, SWEEP + 1)), leak_free=True)
    return _rounded(out, ["accuracy", "f1_weighted"])


@query("k_sweep_one_vs_rest")
def _(spark, sf):
    out = ops.k_sweep(_folded(spark, sf), "label", tb.xs(SWEEP), list(range(1, SWEEP + 1)), target="3")
    return _rounded(out, ["accuracy", "f1_weighted", "f1_binary"])


@query("rfe")
def _(spark, sf):
    return ops.rfe(tb.vectors(spark, sf, 64), "label", tb.xs(64), keep=8)


# Cp of all subsets of three features, from correlations in closed form.
CP = (
    f"with {tb.FEATURES_SQL}, y as (select price as a, discount as b, tax as c, "
    "case label when 'A' then 1e0 when 'N' then 2e0 else 3e0 end as y from features), "
    "r as (select corr(a, y) as ay, corr(b, y) as byy, corr(c, y) as cy, corr(a, b) as ab, corr(a, c) as ac, corr(b, c) as bc, "
    "var_pop(y) * count(*) as yy, count(*) as n from y), "
    "q as (select *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc as det from r), "
    "s as (select n, yy, unnest([1, 2, 3, 4, 5, 6, 7]) as cand_id, unnest([1, 1, 2, 1, 2, 2, 3]) as size, "
    "unnest(['price', 'discount', 'price,discount', 'tax', 'price,tax', 'discount,tax', 'price,discount,tax']) as features, "
    "unnest([ay * ay, byy * byy, (ay * ay + byy * byy - 2 * ay * byy * ab) / (1 - ab * ab), cy * cy, "
    "(ay * ay + cy * cy - 2 * ay * cy * ac) / (1 - ac * ac), (byy * byy + cy * cy - 2 * byy * cy * bc) / (1 - bc * bc), "
    "(ay * ay * (1 - bc * bc) + byy * byy * (1 - ac * ac) + cy * cy * (1 - ab * ab) + 2 * ay * byy * (ac * bc - ab) "
    "+ 2 * ay * cy * (ab * bc - ac) + 2 * byy * cy * (ab * ac - bc)) / det]) as r2 from q), "
    "f as (select yy * (1 - r2) / (n - 4) as noise from s where cand_id = 7), "
    "cp as (select cand_id, size, features, yy * (1 - r2) as rss, yy * (1 - r2) / noise - n + 2 * (size + 1) as cp from s, f) "
)


@query("subset_cp", CP + "select cand_id, size, features, round(rss, 4) as rss, round(cp, 4) as cp from cp")
def _(spark, sf):
    out = ops.subset_cp(tb.features(spark, sf), "label", D3).withColumn("features", F.concat_ws(",", "features"))
    return _rounded(out, ["rss", "cp"], 4)


@query(
    "selection_frequency",
    CP[:-1] + ", b as (select *, row_number() over (partition by size order by rss) as rn from cp), "
    "t as (select * from b where rn <= 2), e as (select unnest(string_split(features, ',')) as feature from t) "
    "select feature, count(*) as n, round(count(*) * 100e0 / (select count(*) from t), 6) as percent from e group by feature",
)
def _(spark, sf):
    cands = ops.subset_cp(tb.features(spark, sf), "label", D3, nbest=2)
    return _rounded(ops.selection_frequency(cands), ["percent"])


@query("subset_cp_wide")
def _(spark, sf):
    """The 60 best subsets of every size of 30 features, by branch and bound."""
    out = ops.subset_cp(tb.vectors(spark, sf, VEC), "label", tb.xs(VEC)).withColumn("features", F.concat_ws(",", "features"))
    return _rounded(out, ["rss", "cp"], 4)


def _cands(spark, sf):
    v = tb.vectors(spark, sf, VEC)
    return v, ops.subset_cp(v, "label", tb.xs(VEC), nbest=10)


@query("subset_lda_scores")
def _(spark, sf):
    v, c = _cands(spark, sf)
    out = ops.subset_lda_scores(v, "label", c, tb.xs(VEC)).withColumn("features", F.concat_ws(",", "features"))
    numeric = [f.name for f in out.schema if f.dataType.typeName() == "double"]
    return _rounded(out, numeric)


@query("subset_lda_f1")
def _(spark, sf):
    v, c = _cands(spark, sf)
    out = ops.subset_lda_scores(v, "label", c, tb.xs(VEC), "f1", "3")
    return out.select("cand_id", "size", F.concat_ws(",", "features").alias("features"), F.round("score", 6).alias("score")).distinct()


# Candidate scores for the summaries: one candidate per order.
RATED = (
    "with s as (select o_orderkey as cand_id, cast(month(o_orderdate) as integer) as size, o_orderpriority as class, "
    "o_orderstatus as features, round(o_totalprice / 1e6, 3) as score, o_totalprice / 2e6 as balanced_accuracy from orders) "
)


def _rated(spark, sf):
    return tb.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("cand_id"),
        F.month("o_orderdate").alias("size"),
        F.col("o_orderpriority").alias("class"),
        F.col("o_orderstatus").alias("features"),
        F.round(F.col("o_totalprice") / 1e6, 3).alias("score"),
        (F.col("o_totalprice") / 2e6).alias("balanced_accuracy"),
    )


@query(
    "best_by_size",
    RATED + "select size, class, max(balanced_accuracy) as best from s group by 1, 2 union all "
    "select size, '(all)', max(score) from s group by 1",
)
def _(spark, sf):
    return ops.best_by_size(_rated(spark, sf))


@query(
    "best_k_model",
    RATED + "select cand_id, size, features, score from s where size = 10 and score = (select max(score) from s where size = 10)",
)
def _(spark, sf):
    return ops.best_k_model(_rated(spark, sf), 10)


PCA2 = (
    f"with {tb.vectors_sql(2)}, c as (select var_samp(x0) as a, var_samp(x1) as d, covar_samp(x0, x1) as b from vectors), "
    "e as (select (a + d) / 2 as m, sqrt((a - d) * (a - d) / 4 + b * b) as h, a + d as t from c), "
    "p as (select 1 as component, m + h as v, t from e union all select 2, m - h, t from e) "
)


@query("pca", PCA2 + "select component, round(v, 9) as variance, round(v / t, 9) as explained_ratio from p")
def _(spark, sf):
    return _rounded(ops.pca(tb.vectors(spark, sf, 2), tb.xs(2), 2).drop("loadings"), ["variance", "explained_ratio"], 9)


# Unit axes of two features; an axis points where its larger loading is positive.
AXES2 = (
    PCA2[:-1] + ", l as (select component, v, b / sqrt(b * b + (v - a) * (v - a)) as u0, (v - a) / sqrt(b * b + (v - a) * (v - a)) as u1 from p, c), "
    "ax as (select component, v, u0 * s as u0, u1 * s as u1 from (select *, case when round(abs(u0), 9) >= round(abs(u1), 9) then sign(u0) else sign(u1) end as s from l)) "
)


@query(
    "pca_loadings_2d",
    AXES2 + "select component, 0 as dim, round(u0, 9) as loading from ax union all select component, 1, round(u1, 9) from ax",
)
def _(spark, sf):
    out = ops.pca(tb.vectors(spark, sf, 2), tb.xs(2), 2).select("component", F.posexplode("loadings").alias("dim", "loading"))
    return _rounded(out, ["loading"], 9)


@query(
    "pca_project_2d",
    AXES2 + ", g as (select avg(x0) as g0, avg(x1) as g1 from vectors) "
    "select id, label, round((x0 - g0) * max(u0) filter (where component = 1) + (x1 - g1) * max(u1) filter (where component = 1), 6) as pc1, "
    "round((x0 - g0) * max(u0) filter (where component = 2) + (x1 - g1) * max(u1) filter (where component = 2), 6) as pc2 "
    "from vectors, g, ax group by id, label, x0, x1, g0, g1",
)
def _(spark, sf):
    out = ops.pca_project(tb.vectors(spark, sf, 2), tb.xs(2), 2)
    return out.select("id", "label", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("pca_loadings")
def _(spark, sf):
    out = ops.pca(tb.vectors(spark, sf, 64), tb.xs(64), 8)
    return out.select("component", F.posexplode("loadings").alias("dim", "loading"))


@query("pca_project")
def _(spark, sf):
    out = ops.pca_project(tb.vectors(spark, sf, 64), tb.xs(64), 2)
    return out.select("id", "label", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("cumulative_variance", PCA2 + "select component, round(sum(v / t) over (order by component), 9) as cumulative from p")
def _(spark, sf):
    out = cumulative_variance(ops.pca(tb.vectors(spark, sf, 2), tb.xs(2), 2))
    return out.select("component", F.round("cumulative", 9).alias("cumulative"))


@query("lda_coefficients")
def _(spark, sf):
    return ops.lda_coefficients(tb.vectors(spark, sf, 64), "label", tb.xs(64))


@query(
    "lda_coefficients_2d",
    f"with {tb.vectors_sql(2)}, c as (select label, count(*) as n, avg(x0) as m0, avg(x1) as m1 from vectors group by label), "
    "g as (select avg(x0) as g0, avg(x1) as g1 from vectors), k as (select count(*) as k from c), "
    "w as (select sum((x0 - m0) * (x0 - m0)) / (count(*) - max(k)) as a, sum((x0 - m0) * (x1 - m1)) / (count(*) - max(k)) as b, "
    "sum((x1 - m1) * (x1 - m1)) / (count(*) - max(k)) as d from vectors v join c on v.label = c.label, k), "
    "s as (select sum(n * (m0 - g0) * (m0 - g0)) / (max(k) - 1) as p, sum(n * (m0 - g0) * (m1 - g1)) / (max(k) - 1) as q, "
    "sum(n * (m1 - g1) * (m1 - g1)) / (max(k) - 1) as r from c, g, k), "
    "m as (select *, (d * p - b * q) / (a * d - b * b) as m00, (d * q - b * r) / (a * d - b * b) as m01, (a * r - b * q) / (a * d - b * b) as m11, "
    "(p * r - q * q) / (a * d - b * b) as det from w, s), "
    "e as (select *, (m00 + m11) / 2 as h, sqrt((m00 + m11) * (m00 + m11) / 4 - det) as z from m), "
    "v as (select unnest([1, 2]) as axis, unnest([h + z, h - z]) as l, * from e), "
    "u as (select axis, l / (2 * h) as share, m01 / sqrt(a * m01 * m01 + 2 * b * m01 * (l - m00) + d * (l - m00) * (l - m00)) as u0, "
    "(l - m00) / sqrt(a * m01 * m01 + 2 * b * m01 * (l - m00) + d * (l - m00) * (l - m00)) as u1 from v), "
    "t as (select *, case when round(abs(u0), 9) >= round(abs(u1), 9) then sign(u0) else sign(u1) end as sg from u) "
    "select 'x0' as feature, axis, round(u0 * sg, 6) as coefficient, round(share, 6) as trace_share from t "
    "union all select 'x1', axis, round(u1 * sg, 6), round(share, 6) from t",
)
def _(spark, sf):
    return _rounded(ops.lda_coefficients(tb.vectors(spark, sf, 2), "label", tb.xs(2)), ["coefficient", "trace_share"])


@query("lda_coefficients_scaled")
def _(spark, sf):
    return ops.lda_coefficients(impute_mean(tb.features(spark, sf), ["quantity"]), "label", tb.FEATS, scaled=True)
