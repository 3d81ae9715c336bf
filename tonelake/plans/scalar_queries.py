"""Projections, filters and scalar functions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake import functions as fn
from tonelake.functions.scalar import MARKER_TAGS, UNIT_LABELS
from tonelake.operators import frames as ops
from tonelake.plans import tables as tb
from tonelake.plans.registry import query

FRAMES = f"with {tb.FRAMES_SQL} "
FEATURES = f"with {tb.FEATURES_SQL} "


def r6(col):
    return F.round(col, 6)


@query("nan_to_null", FRAMES + "select file, frame_idx, round(c3, 6) as c3 from frames")
def _(spark, sf):
    fr = tb.frames(spark, sf, ["file", "frame_idx", "c3"])
    gaps = fr.withColumn("c3", F.coalesce("c3", F.lit(float("nan"))))
    return ops.nan_to_null(gaps).withColumn("c3", r6("c3"))


@query("file_key", "select c_custkey, c_name[1:13] as key from customer")
def _(spark, sf):
    return tb.table(spark, sf, "customer").select("c_custkey", fn.file_key("c_name").alias("key"))


@query(
    "zero_pad_id",
    "select event_id, concat('u', user_id, '__', case when length(cast(event_id as varchar)) < 3 "
    "then lpad(cast(event_id as varchar), 3, '0') else cast(event_id as varchar) end) as id from events",
)
def _(spark, sf):
    e = tb.table(spark, sf, "events")
    return e.select("event_id", fn.zero_pad_id(F.concat(F.lit("u"), "user_id"), "event_id").alias("id"))


SPLIT_FILE = "concat(c_mktsegment, '__', lpad(cast(c_custkey as {s}), 9, '0'), '__', c_name)"


@query(
    "split_key",
    "select file, split_part(file, '__', 1) as \"Audio\", cast(split_part(file, '__', 2) as integer) as \"Enu\", "
    "split_part(file, '__', 3) as \"Spk\", "
    "concat(split_part(file, '__', 1), '__', cast(split_part(file, '__', 2) as integer)) as id "
    f"from (select {SPLIT_FILE.format(s='varchar')} as file from customer)",
)
def _(spark, sf):
    c = tb.table(spark, sf, "customer").select(F.expr(SPLIT_FILE.format(s="string")).alias("file"))
    return ops.split_key(c)


@query("slice_chars", "select c_custkey, c_name[11:13] as utt from customer")
def _(spark, sf):
    return tb.table(spark, sf, "customer").select("c_custkey", fn.slice_chars("c_name", 10, 13).alias("utt"))


TYPE_NAMES = {"ECONOMY": "eco", "STANDARD": "std", "PROMO": "pro"}
RAW_TAG = (
    "case p_size % 6 when 0 then 'ALL_r' when 1 then 'TPL(1)_r' when 2 then 'i COM' when 3 then 'CMB' "
    "when 4 then '??CNT' else 'FLAT' end"
)


@query(
    "remap_replace",
    "select p_partkey, case p_type when 'ECONOMY' then 'eco' when 'STANDARD' then 'std' when 'PROMO' then 'pro' "
    "else p_type end as type_name, case p_size % 6 when 0 then 'ALL' when 1 then 'TOP' when 2 then 'COB' "
    "when 3 then 'COB' when 4 then '??CNT' else 'FLAT' end as iu_remapped from part",
)
def _(spark, sf):
    p = tb.table(spark, sf, "part").withColumn("tag", F.expr(RAW_TAG))
    return p.select(
        "p_partkey",
        fn.remap_replace("p_type", TYPE_NAMES).alias("type_name"),
        fn.remap_replace("tag", UNIT_LABELS).alias("iu_remapped"),
    )


@query(
    "remap_map",
    "select p_partkey, case p_type when 'ECONOMY' then 'eco' when 'STANDARD' then 'std' when 'PROMO' then 'pro' "
    "end as type_name, case p_size % 6 when 0 then 'ALL' when 4 then 'CNT' when 5 then 'FLAT' end as tag from part",
)
def _(spark, sf):
    p = tb.table(spark, sf, "part").withColumn("raw", F.expr(RAW_TAG))
    return p.select(
        "p_partkey",
        fn.remap_map("p_type", TYPE_NAMES).alias("type_name"),
        fn.remap_map("raw", MARKER_TAGS).alias("tag"),
    )


@query("filter_in", "select event_id, event_type, value from events where event_type in ('click', 'view')")
def _(spark, sf):
    e = tb.table(spark, sf, "events").select("event_id", "event_type", "value")
    return ops.filter_in(e, "event_type", ["click", "view"])


@query("filter_eq", "select event_id, event_type from events where event_type = 'click' or event_type = 'error'")
def _(spark, sf):
    return ops.filter_eq(tb.table(spark, sf, "events").select("event_id", "event_type"), "event_type", ["click", "error"])


@query(
    "filter_outliers",
    FEATURES + "select id, label, price, quantity from features where label = 'A' and (price > 90000 or quantity < 3)",
)
def _(spark, sf):
    f = tb.features(spark, sf).select("id", "label", "price", "quantity")
    return ops.filter_outliers(f, "A", "price", 90000.0, "quantity", 3.0, tag_col="label")


FILE_NAME = "concat('u', user_id, case event_type when 'click' then '' when 'error' then '_egg' else '_a' end)"


@query(
    "file_name_filter",
    f"select event_id, name from (select event_id, {FILE_NAME} as name from events) "
    "where contains(name, '_') and not contains(name, '_egg')",
)
def _(spark, sf):
    e = tb.table(spark, sf, "events").select("event_id", F.expr(FILE_NAME).alias("name"))
    return ops.file_name_filter(e, "name")


FAMILIES = {
    "f0": ["c0", "c1", "c2", "c3", "hnr", "intensity"],
    "mfcc": [("embedding", 0, 20, "mfcc_")],
    "mel": [("embedding", 0, 32, "mel_")],
}


@query(
    "project_features",
    FRAMES + "select file, frame_idx, round(c0, 6) as c0, round(c1, 6) as c1, round(c2, 6) as c2, "
    "round(c3, 6) as c3, hnr, intensity from frames",
)
def _(spark, sf):
    f = ops.project_features(tb.frames(spark, sf), "f0", FAMILIES)
    return f.withColumns({c: r6(c) for c in tb.CANDS})


@query(
    "project_array_features",
    "select vec_id, " + ", ".join(f"embedding[{i}] as mfcc_{i:02d}" for i in range(1, 21)) + " from embeddings",
)
def _(spark, sf):
    return ops.project_features(tb.table(spark, sf, "embeddings"), "mfcc", FAMILIES, ids=["vec_id"])


@query(
    "unpivot_features",
    FEATURES + " ".join(
        f"{'union all ' if i else ''}select id, label, '{c}' as feature, {c} as value from features"
        for i, c in enumerate(tb.FEATS)
    ),
)
def _(spark, sf):
    return ops.unpivot_features(tb.features(spark, sf), ["id", "label"], tb.FEATS)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "pivot_scores",
    f"with {tb.SCORES_SQL}, uniq as (select params, iter, arg_min(mean_test_score, o_orderkey) as s from scores group by all) "
    "select iter, " + ", ".join(f"max(s) filter (where params = '{p}') as \"{p}\"" for p in PRIORITIES)
    + " from uniq group by iter",
)
def _(spark, sf):
    return ops.pivot_scores(tb.scores(spark, sf), "iter", "params", "mean_test_score", PRIORITIES, "o_orderkey")


@query(
    "impute_mean",
    FEATURES + "select id, label, round(coalesce(quantity, (select avg(quantity) from features)), 6) as quantity, price from features",
)
def _(spark, sf):
    f = ops.impute_mean(tb.features(spark, sf), ["quantity", "price"])
    return f.select("id", "label", r6("quantity").alias("quantity"), "price")


def _standardized(sd):
    return (
        FEATURES + ", s as (select avg(price) as pm, " + sd + "(price) as ps, avg(tax) as tm, " + sd
        + "(tax) as ts from features) select id, round((price - pm) / ps, 6) as price, "
        "round((tax - tm) / ts, 6) as tax from features, s"
    )


@query("standardize", _standardized("stddev_pop"))
def _(spark, sf):
    f = ops.standardize(tb.features(spark, sf).select("id", "price", "tax"), ["price", "tax"])
    return f.select("id", r6("price").alias("price"), r6("tax").alias("tax"))


@query("standardize_sample", _standardized("stddev_samp"))
def _(spark, sf):
    f = ops.standardize(tb.features(spark, sf).select("id", "price", "tax"), ["price", "tax"], ddof=1)
    return f.select("id", r6("price").alias("price"), r6("tax").alias("tax"))


@query(
    "label_encode",
    "with l as (select p_partkey, case p_type when 'PROMO' then null else p_type end as p_type from part), "
    "d as (select p_type, row_number() over (order by p_type) - 1 as code from (select distinct p_type from l where p_type is not null)) "
    "select p_partkey, l.p_type, cast(coalesce(code, -1) as integer) as p_type_code from l left join d on l.p_type = d.p_type",
)
def _(spark, sf):
    p = tb.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("p_type"))
    return ops.label_encode(p, "p_type")[0].select("p_partkey", "p_type", "p_type_code")


@query(
    "label_encode_numbers",
    "with l as (select c_custkey, c_nationkey - 7 as nation, round(c_acctbal) as balance from customer), "
    "n as (select nation, row_number() over (order by nation) - 1 as code from (select distinct nation from l)), "
    "b as (select balance, row_number() over (order by balance) - 1 as code from (select distinct balance from l)) "
    "select c_custkey, cast(n.code as integer) as nation_code, cast(b.code as integer) as balance_code "
    "from l join n on l.nation = n.nation join b on l.balance = b.balance",
)
def _(spark, sf):
    c = tb.table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") - 7).alias("nation"), F.round("c_acctbal").alias("balance"))
    return ops.label_encode(ops.label_encode(c, "nation")[0], "balance")[0].select("c_custkey", "nation_code", "balance_code")


@query(
    "binarize_label",
    "select c_custkey, case when c_mktsegment = 'BUILDING' then 'BUILDING' else 'OTHER' end as label from customer",
)
def _(spark, sf):
    return tb.table(spark, sf, "customer").select("c_custkey", fn.binarize_label("c_mktsegment", "BUILDING").alias("label"))


def similarity_sql(a, b, vup, rate="1.44e0"):
    """SQL of the similarity of two pitches (NULL: unvoiced)."""
    return (
        f"case when {a} is null and {b} is null then 1e0 when {a} is null or {b} is null then {vup} "
        f"when {a} = 0 and {b} = 0 then 1e0 when {a} = 0 or {b} = 0 then 0e0 "
        f"else exp(-{rate} * abs(log2({a} / {b}))) end"
    )


# Silence and missing values on both sides exercise every branch.
PAIR = {
    "a": "case when event_id % 13 = 0 then 0e0 else c0 end",
    "b": "case when event_id % 7 = 0 then 0e0 else c3 end",
}
PAIRS = FRAMES[:-1] + f", pairs as (select file, frame_idx, t, {PAIR['a']} as a, {PAIR['b']} as b from frames) "


def _pairs(spark, sf):
    named = [F.expr(e).alias(c) for c, e in PAIR.items()]
    return tb.frames(spark, sf).select("file", "frame_idx", "t", *named)


@query("cents_similarity", PAIRS + f"select file, frame_idx, round({similarity_sql('a', 'b', '5e-1')}, 9) as p from pairs")
def _(spark, sf):
    return _pairs(spark, sf).select("file", "frame_idx", F.round(fn.cents_similarity("a", "b"), 9).alias("p"))


@query("octave_similarity", PAIRS + f"select file, frame_idx, round({similarity_sql('a', 'b', '5e-1', '1e0')}, 9) as p from pairs")
def _(spark, sf):
    return _pairs(spark, sf).select("file", "frame_idx", F.round(fn.octave_similarity("a", "b"), 9).alias("p"))


@query(
    "forgetting_similarity",
    PAIRS + f"select file, frame_idx, round(s + (1 - s) * t / 5e-1, 9) as p from (select *, {similarity_sql('a', 'b', '5e-1')} as s from pairs)",
)
def _(spark, sf):
    return _pairs(spark, sf).select("file", "frame_idx", F.round(fn.forgetting_similarity("a", "b", "t", 0.5), 9).alias("p"))


@query("octave_to_hz", "select event_id, round(440 * pow(2, value / 1e2 - 2), 6) as hz from events")
def _(spark, sf):
    return tb.table(spark, sf, "events").select("event_id", r6(fn.octave_to_hz(F.col("value") / 100 - 2)).alias("hz"))


@query("is_in_interval", "select event_id, value >= 1e2 and value <= 2e2 as inside from events")
def _(spark, sf):
    return tb.table(spark, sf, "events").select(
        "event_id", fn.is_in_interval("value", F.lit(100.0), F.lit(200.0)).alias("inside")
    )


@query("time_grid_hop", FRAMES + "select file, frame_idx, round(frame_idx * 8e1 / 1.6e4, 9) as timeframe from frames")
def _(spark, sf):
    f = ops.time_grid(tb.frames(spark, sf, ["file", "frame_idx"]), "hop", hop=80, sr=16000)
    return f.withColumn("timeframe", F.round("timeframe", 9))


@query(
    "time_grid_even",
    FRAMES + "select file, frame_idx, round(2.5e0 * frame_idx / (count(*) over (partition by file) - 1), 9) as timeframe from frames",
)
def _(spark, sf):
    f = ops.time_grid(tb.frames(spark, sf, ["file", "frame_idx"]), "even", duration=2.5)
    return f.select("file", "frame_idx", F.round("timeframe", 9).alias("timeframe"))


@query("time_grid_mid", f"with {tb.UNITS_SQL} select file, n_ut, round((start_t + end_t) / 2, 9) as timeframe from units")
def _(spark, sf):
    f = ops.time_grid(tb.units(spark, sf), "mid")
    return f.select("file", "n_ut", F.round("timeframe", 9).alias("timeframe"))


@query("decimate", FRAMES + "select file, frame_idx // 2 as frame_idx, c0 from frames where frame_idx % 2 = 0")
def _(spark, sf):
    return ops.decimate(tb.frames(spark, sf, ["file", "frame_idx", "c0"]))


@query("round_half_even", "select l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2, 0) as half from lineitem")
def _(spark, sf):
    li = tb.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", fn.round_half_even(F.col("l_quantity") / 2).alias("half"))


@query(
    "unvoice",
    FRAMES + "select file, frame_idx, case when coalesce(pred_all, 0) = 0 then 0e0 else c0 end as f0 from frames",
)
def _(spark, sf):
    f = tb.frames(spark, sf, ["file", "frame_idx", "c0", "pred_all"])
    return f.select("file", "frame_idx", fn.unvoice("c0", "pred_all").alias("f0"))


LAGGED = (
    FRAMES[:-1] + ", l as (select *, lag(c3) over w as prev_c3, lag(t) over w as prev_t from frames "
    "window w as (partition by file order by frame_idx)) "
)


@query(
    "pair_midpoint_band",
    LAGGED + "select file, frame_idx, round((t + prev_t) / 2, 9) as mid_t, round((c3 + prev_c3) / 2, 6) as mean_f0, "
    "round(coalesce((c3 + prev_c3) / 2 * 1.43e0, 4e2), 6) as low_band from l where prev_t is not null",
)
def _(spark, sf):
    f = tb.frames(spark, sf, ["file", "frame_idx", "t", "c3"])
    out = ops.pair_midpoint_band(f, pitch="c3")
    return out.select("file", "frame_idx", F.round("mid_t", 9).alias("mid_t"), r6("mean_f0").alias("mean_f0"), r6("low_band").alias("low_band"))


@query("adjacent_frames", LAGGED + "select file, frame_idx, round(prev_c3, 6) as prev_c3, round(prev_t, 9) as prev_t from l")
def _(spark, sf):
    f = ops.adjacent_frames(tb.frames(spark, sf, ["file", "frame_idx", "t", "c3"]), ["c3", "t"])
    return f.select("file", "frame_idx", r6("prev_c3").alias("prev_c3"), F.round("prev_t", 9).alias("prev_t"))


@query(
    "concat_features",
    "with a as (select doc_id, n_chars from documents), j as (select doc_id, list_concat([cast(n_chars as double), "
    "n_chars / 2e0], list_transform(embedding, lambda x: cast(x as double))) as f from a join embeddings on doc_id = vec_id) "
    "select doc_id, unnest(generate_series(0, len(f) - 1)) as pos, unnest(f) as value from j",
)
def _(spark, sf):
    a = tb.table(spark, sf, "documents").select("doc_id", "n_chars", (F.col("n_chars") / 2).alias("half"))
    b = tb.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    f = ops.concat_features(a, b, "doc_id", ["n_chars", "half"], "embedding")
    return f.select("doc_id", F.posexplode("features").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@query(
    "mean_pool",
    "select vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x as double))) / len(embedding), 9) as pooled from embeddings",
)
def _(spark, sf):
    return tb.table(spark, sf, "embeddings").select("vec_id", F.round(fn.mean_pool("embedding"), 9).alias("pooled"))


@query("drop_columns", "select * exclude (c_name, c_acctbal), c_mktsegment = 'BUILDING' as target from customer")
def _(spark, sf):
    c = ops.drop_columns(tb.table(spark, sf, "customer"), ["c_name", "c_acctbal"])
    return c.withColumns({"target": F.col("c_mktsegment") == "BUILDING"})


@query("sort_desc", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def _(spark, sf):
    return ops.sort_desc(tb.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 100, ["o_orderkey"])


@query(
    "first_argmax",
    "select o_orderpriority, arg_min(o_orderkey, struct_pack(a := -o_totalprice, b := o_orderkey)) as best from orders group by 1",
)
def _(spark, sf):
    o = tb.table(spark, sf, "orders")
    return o.groupBy("o_orderpriority").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best")
    )


@query(
    "stack_files",
    "select event_id, value from events where event_type = 'click' union all "
    "select event_id, value from events where event_type = 'error' union all "
    "select event_id, value from events where event_type not in ('click', 'error')",
)
def _(spark, sf):
    e = tb.table(spark, sf, "events")
    cols = ["event_id", "value"]
    return ops.stack_files(
        [
            e.filter("event_type = 'click'").select(*cols),
            e.filter("event_type = 'error'").select(*cols),
            e.filter("event_type not in ('click', 'error')").select(*cols),
        ]
    )


@query("key_intersect", "select user_id from events where event_type = 'click' intersect select user_id from events where value > 480")
def _(spark, sf):
    e = tb.table(spark, sf, "events")
    return ops.key_intersect(e.filter("event_type = 'click'").select("user_id"), e.filter("value > 480").select("user_id"))


@query(
    "key_difference",
    "select user_id, event_type from events where value > 40 except all select user_id, event_type from events where value <= 40",
)
def _(spark, sf):
    e = tb.table(spark, sf, "events")
    cols = ["user_id", "event_type"]
    return ops.key_difference(e.filter("value > 40").select(*cols), e.filter("value <= 40").select(*cols))
