"""Joins as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.operators import joins as ops
from tonelake.plans import tables as tb
from tonelake.plans.registry import query

UNITS = f"with {tb.UNITS_SQL} "


@query(
    "merge_inner",
    "select d.doc_id, lang, source, n_chars, quality, toxic from documents d join labels l on d.doc_id = l.doc_id",
)
def _(spark, sf):
    d = tb.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return ops.merge_inner(d, tb.table(spark, sf, "labels"), "doc_id")


@query(
    "unit_frames",
    f"with {tb.CUT_SQL} select file, n_ut, round(iu_start, 9) as iu_start, frame_idx, round(t, 9) as t, c0 from cut",
)
def _(spark, sf):
    fr = tb.frames(spark, sf)
    un = tb.units(spark, sf)
    cut = ops.unit_frames(tb.asked_units(un), tb.bounds(un), fr.select("file", "frame_idx", "t", "c0"))
    return cut.select("file", "n_ut", F.round("iu_start", 9).alias("iu_start"), "frame_idx", F.round("t", 9).alias("t"), "c0")


@query(
    "tag_frames",
    UNITS + ", m as (select f.file, f.frame_idx, f.c0, arg_max(struct_pack(iu := u.iu, n_ut := u.n_ut, text := u.text), u.n_ut) as u "
    "from frames f left join units u on f.file = u.file and f.t between u.start_t and u.end_t group by all) "
    "select file, frame_idx, c0, u.iu as iu, u.n_ut as n_ut, u.text as text from m",
)
def _(spark, sf):
    fr = tb.frames(spark, sf)
    return ops.tag_frames(fr.select("file", "frame_idx", "t", "c0"), tb.units(spark, sf), "n_ut", ["iu", "n_ut", "text"]).drop("t")


def _changes(un):
    """Two changes for every COM unit; the second counts."""
    return un.filter("iu = 'COM'").select(
        "file",
        "n_ut",
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("change_order"), F.lit("CMM").alias("Tag2"), F.lit("first").alias("Text")),
                F.struct(F.lit(2).alias("change_order"), F.lit("COB").alias("Tag2"), F.concat(F.lit("x"), "n_ut").alias("Text")),
            )
        ),
    )


@query(
    "relabel_update",
    UNITS + "select file, n_ut, case when iu = 'COM' then 'COB' else iu end as iu, "
    "case when iu = 'COM' then concat('x', n_ut) else '' end as text from units",
)
def _(spark, sf):
    un = tb.units(spark, sf)
    return ops.relabel_update(un.drop("text"), _changes(un), ["file", "n_ut"], "change_order").select("file", "n_ut", "iu", "text")


@query(
    "semi_filter",
    "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')",
)
def _(spark, sf):
    c = tb.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return ops.semi_filter(tb.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey")


@query(
    "nearest_unit",
    UNITS + ", u as (select *, (start_t + end_t) / 2 as centre from units), m as (select a.file, a.n_ut, a.iu, a.centre, "
    "b.n_ut as near_n_ut, b.iu as near_iu, abs(b.centre - a.centre) as distance, row_number() over "
    "(partition by a.file, a.n_ut order by abs(b.centre - a.centre), b.start_t) as rn from u a left join u b on a.file = b.file "
    "and b.iu in ('COM', 'COB', 'CMM') where a.iu in ('ALL', 'CNT', 'INP')) "
    "select file, n_ut, iu, round(centre, 9) as centre, near_n_ut, near_iu, round(distance, 9) as distance from m where rn = 1",
)
def _(spark, sf):
    un = tb.units(spark, sf)
    out = ops.nearest_unit(un, F.col("iu").isin("ALL", "CNT", "INP"))
    return out.withColumn("centre", F.round("centre", 9)).withColumn("distance", F.round("distance", 9))


TRACK_T = "greatest(frame_idx * 5e-3 + (event_id % 7 - 3) * 1.1e-3, 0e0)"


def tracks(spark, sf):
    """Samples of one tracker per event type, off the grid by up to 3.3 ms."""
    n = tb.numbered_events(spark, sf)
    return n.select(
        F.expr("concat('u', user_id) as file"), F.col("event_type").alias("algo"), F.expr(f"{TRACK_T} as t"), "value"
    )


TRACKS_SQL = (
    f"tracks as (select concat('u', user_id) as file, event_type as algo, {TRACK_T} as t, value from "
    "(select *, row_number() over (partition by user_id order by ts) - 1 as frame_idx from events))"
)


@query(
    "align_tracks",
    f"with {TRACKS_SQL}, span as (select file, cast(min(round(t / 5e-3)) as bigint) as lo, cast(max(round(t / 5e-3)) as bigint) as hi "
    "from tracks group by file), grid as (select a.file, algo, unnest(generate_series(lo, hi)) as grid_idx "
    "from (select distinct file, algo from tracks) a join span s on a.file = s.file), "
    "m as (select g.file, g.algo, g.grid_idx, s.value, row_number() over (partition by g.file, g.algo, g.grid_idx "
    "order by abs(round(s.t - g.grid_idx * 5e-3, 9)) nulls last, s.t) as rn from grid g left join tracks s on g.file = s.file and g.algo = s.algo "
    "and abs(round(s.t - g.grid_idx * 5e-3, 9)) <= 2.5e-3) "
    "select file, algo, grid_idx, round(grid_idx * 5e-3, 9) as t, value from m where rn = 1",
)
def _(spark, sf):
    return ops.align_tracks(tracks(spark, sf)).withColumn("t", F.round("t", 9))


@query(
    "key_overlap",
    "with a as (select distinct user_id from events where event_type = 'click'), b as (select distinct user_id from events "
    "where value > 480) select (select count(*) from a) as n_left, (select count(*) from b) as n_right, "
    "(select count(*) from a where user_id in (select user_id from b)) as n_both",
)
def _(spark, sf):
    e = tb.table(spark, sf, "events")
    return ops.key_overlap(e.filter("event_type = 'click'"), e.filter("value > 480"), "user_id")


@query(
    "lookup_name",
    "select c_custkey, c_nationkey, n_name from customer left join nation on c_nationkey = n_nationkey",
)
def _(spark, sf):
    dim = tb.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return ops.lookup_name(tb.table(spark, sf, "customer").select("c_custkey", "c_nationkey"), dim, "c_nationkey")


@query(
    "pending_files",
    "select distinct user_id as file, event_type as algo from events where (user_id, event_type) not in "
    "(select user_id, event_type from events where value > 400)",
)
def _(spark, sf):
    e = tb.table(spark, sf, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("algo"), "value")
    return ops.pending_files(e.select("file", "algo").distinct(), e.filter("value > 400").select("file", "algo"))
