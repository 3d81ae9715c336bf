"""Splits, folds and balance as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.operators import sampling as ops
from tonelake.plans import tables as tb
from tonelake.plans.registry import query

FEATURES = f"with {tb.FEATURES_SQL}"
MANIFEST = f"with {tb.MANIFEST_SQL}"


def rank_sql(by, id="id", seed=42):
    part = f"partition by {by} " if by else ""
    return f"row_number() over ({part}order by md5(concat('{seed}|', {id})), {id})"


def split_sql(source, frac, name="sp"):
    """CTE with ``part`` train or test."""
    return (
        f"{name} as (select * exclude (rn, n), case when rn <= floor(n * {frac}) then 'train' else 'test' end as part "
        f"from (select *, {rank_sql('label')} as rn, count(*) over (partition by label) as n from {source}))"
    )


def folds_sql(source, k, name="fd"):
    return f"{name} as (select * exclude (rn), cast((rn - 1) % {k} as integer) as fold from (select *, {rank_sql('label')} as rn from {source}))"


@query("stratified_split", FEATURES + f", {split_sql('features', '0.75')} select id, label, part from sp")
def _(spark, sf):
    return ops.stratified_split(tb.features(spark, sf).select("id", "label"), "id", "label", 0.75)


@query(
    "row_split",
    FEATURES + f" select id, label, case when {rank_sql('')} <= floor(count(*) over () * 0.8) then 'train' else 'test' end as part from features",
)
def _(spark, sf):
    return ops.row_split(tb.features(spark, sf).select("id", "label"), "id", 0.8)


@query("stratified_folds", FEATURES + f", {folds_sql('features', 10)} select id, label, fold from fd")
def _(spark, sf):
    return ops.stratified_folds(tb.features(spark, sf).select("id", "label"), "id", "label", 10)


def _group_folds(k, extra=""):
    return (
        MANIFEST + f", g as (select speaker, cast(({rank_sql('', 'speaker')} - 1) % {k} as integer) as fold "
        f"from (select distinct speaker from manifest)) select fname, m.speaker, fold from manifest m join g on m.speaker = g.speaker {extra}"
    )


@query("group_folds", _group_folds(7))
def _(spark, sf):
    return ops.group_folds(tb.manifest(spark, sf).select("fname", "speaker"), "speaker", 7).select("fname", "speaker", "fold")


@query("group_folds_first", _group_folds(5, "where fold < 2"))
def _(spark, sf):
    m = tb.manifest(spark, sf).select("fname", "speaker")
    return ops.group_folds(m, "speaker", 5, fold_max=2).select("fname", "speaker", "fold")


@query(
    "group_split",
    f"with {tb.FRAMES_SQL}, g as (select file, {rank_sql('', 'file')} as rn, count(*) over () as n from (select distinct file from frames)) "
    "select f.file, frame_idx, case when rn <= cast(floor(n * 0.75) as bigint) then 'train' else 'valid' end as part "
    "from frames f join g on f.file = g.file",
)
def _(spark, sf):
    return ops.group_split(tb.frames(spark, sf, ["file", "frame_idx"]), "file").select("file", "frame_idx", "part")


@query(
    "subset_split",
    MANIFEST + " select o_orderkey, c_name as fname, subset from orders join customer on o_custkey = c_custkey join manifest on fname = c_name",
)
def _(spark, sf):
    c = tb.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("fname"))
    rows = tb.table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey").drop("o_custkey")
    return ops.subset_split(rows, tb.manifest(spark, sf)).select("o_orderkey", "fname", "subset")


@query(
    "undersample_other",
    f"with {tb.IMBALANCED_SQL}, r as (select *, {rank_sql('label')} as rn from imbalanced) select id, label, n_chars from r "
    "where label = 'toxic' or rn <= (select count(*) from imbalanced where label = 'toxic')",
)
def _(spark, sf):
    return ops.undersample_other(tb.imbalanced(spark, sf), "id", "label", "toxic").select("id", "label", "n_chars")


@query(
    "smote",
    f"with {tb.IMBALANCED_SQL}, r as (select *, {rank_sql('label')} as rn, count(*) over (partition by label) as n from imbalanced), "
    "p as (select r.*, top - n as need, least(5, n - 1) as reach from r, (select max(n) as top from r) where top > n and n >= 2), "
    "j as (select *, unnest(generate_series(1, need // n + case when rn <= need % n then 1 else 0 end)) as j from p), "
    "d as (select *, md5(concat('42|', id, '|', j)) as h from j), "
    "nn as (select p.id, q.n_chars as nc, q.quality as ql, row_number() over (partition by p.id order by "
    "round(sqrt((p.n_chars - q.n_chars) * (p.n_chars - q.n_chars) + (p.quality - q.quality) * (p.quality - q.quality)), 9), q.id) as rank "
    "from p join imbalanced q on p.label = q.label and p.id <> q.id), "
    "u as (select *, cast(concat('0x', substr(h, 1, 8)) as ubigint) % reach + 1 as pick, "
    "cast(concat('0x', substr(h, 9, 8)) as ubigint) / 4294967296e0 as gap from d) "
    "select id, label, round(n_chars, 6) as n_chars, round(quality, 6) as quality, false as synthetic from imbalanced union all "
    "select concat(u.id, '_s', j), label, round(n_chars + gap * (nc - n_chars), 6), round(quality + gap * (ql - quality), 6), true "
    "from u join nn on u.id = nn.id and u.pick = nn.rank",
)
def _(spark, sf):
    rows = tb.imbalanced(spark, sf)
    out = ops.smote(rows, "id", "label", ["n_chars", "quality"])
    return out.withColumns({c: F.round(c, 6) for c in ("n_chars", "quality")})


@query(
    "sample_frames",
    f"with {tb.FRAMES_SQL} select event_id, file, c0 from (select *, {rank_sql('', 'event_id')} as rn from frames) where rn <= 5000",
)
def _(spark, sf):
    return ops.sample_frames(tb.frames(spark, sf, ["event_id", "file", "c0"]), "event_id", 5000)
