"""Grouped statistics as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.operators import aggregates as ops
from tonelake.operators.joins import unit_frames
from tonelake.plans import tables as tb
from tonelake.plans.registry import query

FRAMES = f"with {tb.FRAMES_SQL} "
FEATURES = f"with {tb.FEATURES_SQL} "
LONG = FEATURES[:-1] + ", long as (" + " union all ".join(
    f"select label, pattern, '{c}' as feature, {c} as value from features" for c in tb.FEATS
) + ") "


def _rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _describe(set_no, keys):
    shown = ", ".join(k if k in keys else f"null as {k}" for k in ("label", "pattern"))
    stats = (
        "count(value) as \"count\", round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std, min(value) as \"min\", "
        "max(value) as \"max\", round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50, "
        "round(quantile_cont(value, 0.75), 6) as p75"
    )
    return f"select {set_no} as set_no, {shown}, feature, {stats} from long where value is not null group by {', '.join(keys)}, feature"


@query(
    "describe_by",
    LONG + " union all ".join([_describe(0, ["label", "pattern"]), _describe(1, ["label"]), _describe(2, ["pattern"])]),
)
def _(spark, sf):
    out = ops.describe_by(tb.features(spark, sf), tb.FEATS, [["label", "pattern"], ["label"], ["pattern"]])
    return _rounded(_rounded(out, ["mean", "std"], 4), ["p25", "p50", "p75"])


@query(
    "box_stats",
    LONG[:-1] + ", q as (select label, feature, count(value) as n, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as med, "
    "quantile_cont(value, 0.75) as q3 from long where value is not null group by 1, 2), "
    "e as (select l.label, l.feature, min(value) filter (where value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as lo, "
    "max(value) filter (where value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as hi, "
    "count(*) filter (where value not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as n_out "
    "from long l join q on l.label = q.label and l.feature = q.feature where value is not null group by 1, 2) "
    "select q.label, q.feature, n, round(q1, 6) as q1, round(med, 6) as med, round(q3, 6) as q3, lo, hi, n_out, "
    "round(med - 1.57e0 * (q3 - q1) / sqrt(n), 6) as notch_lo, round(med + 1.57e0 * (q3 - q1) / sqrt(n), 6) as notch_hi "
    "from q join e on q.label = e.label and q.feature = e.feature",
)
def _(spark, sf):
    out = ops.box_stats(tb.features(spark, sf), ["label"], tb.FEATS)
    return _rounded(out, ["q1", "med", "q3", "notch_lo", "notch_hi"])


@query(
    "null_counts",
    FEATURES + " union all ".join(
        f"select '{c}' as column_name, count(*) filter (where {c} is null) as n_null from features" for c in tb.FEATURE_EXPRS
    ),
)
def _(spark, sf):
    return ops.null_counts(tb.features(spark, sf))


@query("value_counts", FRAMES + "select pred_all, creaky, count(*) as n from frames group by 1, 2")
def _(spark, sf):
    return ops.value_counts(tb.frames(spark, sf, ["pred_all", "creaky"]), ["pred_all", "creaky"])


@query("distinct_values", "select distinct o_orderpriority from orders")
def _(spark, sf):
    return ops.distinct_values(tb.table(spark, sf, "orders"), "o_orderpriority")


@query(
    "count_distinct",
    "select count(distinct user_id) as n_user_id, count(distinct event_type) as n_event_type from events",
)
def _(spark, sf):
    return ops.count_distinct(tb.table(spark, sf, "events"), ["user_id", "event_type"])


def cut(spark, sf, cols):
    fr = tb.frames(spark, sf)
    un = tb.units(spark, sf)
    return unit_frames(tb.asked_units(un), tb.bounds(un), fr.select("file", *cols))


@query("unit_intensity", f"with {tb.CUT_SQL} select file, n_ut, round(avg(intensity), 6) as mean_se from cut group by 1, 2")
def _(spark, sf):
    return _rounded(ops.unit_intensity(cut(spark, sf, ["t", "intensity"])), ["mean_se"])


F0_COLS = ["f0_mean", "f0_sd", "f0_min", "f0_max", "f0_first", "f0_last", "f0_exc", "f0_align_max", "f0_align_min", "int_mean", "int_sd"]


@query(
    "contour_features",
    f"with {tb.CUT_SQL}, a as (select file, n_ut, count(c3) as n_voiced, avg(c3) as f0_mean, stddev_samp(c3) as f0_sd, "
    "min(c3) as f0_min, max(c3) as f0_max, arg_min(c3, t) filter (where c3 is not null) as f0_first, "
    "arg_max(c3, t) filter (where c3 is not null) as f0_last, max(c3) - min(c3) as f0_exc, "
    "arg_max(t, struct_pack(v := c3, t := -t)) filter (where c3 is not null) as tmax, "
    "arg_min(t, struct_pack(v := c3, t := t)) filter (where c3 is not null) as tmin, avg(intensity) as int_mean, "
    "stddev_samp(intensity) as int_sd, min(intensity) as int_min, max(intensity) as int_max, min(iu_start) as s, max(iu_end) as e "
    "from cut group by 1, 2), b as (select *, (tmax - s) / nullif(e - s, 0) as f0_align_max, (tmin - s) / nullif(e - s, 0) as f0_align_min from a) "
    "select file, n_ut, n_voiced, " + ", ".join(f"round({c}, 6) as {c}" for c in F0_COLS) + ", int_min, int_max from b",
)
def _(spark, sf):
    return _rounded(ops.contour_features(cut(spark, sf, ["t", "c3", "intensity"]), "c3"), F0_COLS)


SILENT = "case when user_id % 10 = 0 then null else c3 end"  # some files have no pitch at all


@query(
    "pitch_floor_ceiling",
    FRAMES[:-1] + f", p as (select file, {SILENT} as f0 from frames), q as (select file, quantile_cont(f0, 0.25) * 0.75e0 as a, "
    "quantile_cont(f0, 0.75) * 1.5e0 as b from p group by file) select file, "
    "round(case when coalesce(a, 0) = 0 then 40e0 else a end, 6) as f0_floor, "
    "round(case when coalesce(b, 0) = 0 then 800e0 else b end, 6) as f0_ceiling from q",
)
def _(spark, sf):
    fr = tb.frames(spark, sf).select("file", F.expr(SILENT).alias("f0"))
    return _rounded(ops.pitch_floor_ceiling(fr, "f0"), ["f0_floor", "f0_ceiling"])


@query(
    "max_agreement",
    FRAMES[:-1] + ", m as (select file, frame_idx, c0, c1, c2, c3, (c0 + c1 + c2 + c3) / 4e0 as mu from frames), "
    "s as (select file, frame_idx, round(sqrt(((c0-mu)*(c0-mu) + (c1-mu)*(c1-mu) + (c2-mu)*(c2-mu) + (c3-mu)*(c3-mu)) / 4e0), 9) as sd from m) "
    "select file, min(sd) as sd_min, arg_min(frame_idx, struct_pack(a := sd, b := frame_idx)) as frame_idx from s where sd is not null group by file",
)
def _(spark, sf):
    return ops.max_agreement(tb.frames(spark, sf, ["file", "frame_idx", *tb.CANDS]), tb.CANDS)


ALGOS = ["click", "view", "error", "pyin"]


@query(
    "audit_extraction",
    "with w as (select file, algo from (select distinct user_id as file from events), (select unnest(['click', 'view', 'error', 'pyin']) as algo)), "
    "c as (select user_id as file, event_type as algo, count(*) as n from events group by 1, 2) "
    "select w.file, w.algo, coalesce(n, 0) as n_frames, coalesce(n, 0) > 5 as processed from w left join c on w.file = c.file and w.algo = c.algo",
)
def _(spark, sf):
    e = tb.table(spark, sf, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("algo"))
    return ops.audit_extraction(e, e.select("file").distinct(), ALGOS)


@query(
    "fold_summary",
    "with h as (select month(o_orderdate) - 1 as epoch, avg(o_totalprice / 1e6) as m, stddev_samp(o_totalprice / 1e6) as s from orders group by 1) "
    "select epoch, round(m, 6) as mean_acc, round(s, 6) as sd_acc, "
    "(select arg_min(epoch, struct_pack(a := -round(m, 9), b := epoch)) from h) + 1 as best_epoch from h",
)
def _(spark, sf):
    h = tb.table(spark, sf, "orders").select(
        (F.month("o_orderdate").cast("long") - 1).alias("epoch"),
        F.col("o_orderpriority").alias("fold"),
        (F.col("o_totalprice") / 1e6).alias("accuracy"),
    )
    return _rounded(ops.fold_summary(h), ["mean_acc", "sd_acc"])


@query(
    "robust_scale_stats",
    LONG + "select feature, count(value) as n, round(quantile_cont(value, 0.5), 6) as median, "
    "round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) as iqr from long group by feature",
)
def _(spark, sf):
    return _rounded(ops.robust_scale_stats(tb.features(spark, sf), tb.FEATS), ["median", "iqr"])
