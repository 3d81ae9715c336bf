"""Annotation tiers as queries. Times are character offsets, so a slot is 200."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.operators import tiers as ops
from tonelake.plans import tables as tb
from tonelake.plans.registry import query

WIDTH = 200.0

NUMBERED = (
    f"with {tb.TIERS_SQL}, utt as materialized (select file, start_t as utt_start, end_t as utt_end, text as utt_text, idx as utt_idx "
    "from tiers where tier = 'Trans' and length(text) > 0), "
    "unit0 as materialized (select file, idx as iu_idx, start_t as iu_start, end_t as iu_end, text as iu_text from tiers "
    "where tier = 'UTtag' and text <> 'pp'), "
    "unit as materialized (select u.*, utt_idx, utt_start, utt_end, utt_text, cast(row_number() over "
    "(partition by u.file order by iu_start, iu_idx) as integer) as n_ut "
    "from unit0 u join utt on u.file = utt.file and iu_start >= utt_start and iu_end <= utt_end) "
)
NEST = (
    NUMBERED[:-1] + ", syl as (select s.file, s.idx as syl_idx, s.start_t as syl_start, s.end_t as syl_end, s.text as syl_text, "
    "iu_idx, iu_start, iu_end, iu_text, utt_idx, utt_start, utt_end, utt_text, n_ut from tiers s join unit u on s.file = u.file "
    "and s.tier = 'Sil' and s.start_t >= iu_start and s.end_t <= iu_end) "
)


@query("number_units", NUMBERED + "select file, iu_idx, iu_start, iu_end, utt_idx, n_ut from unit")
def _(spark, sf):
    out = ops.number_units(tb.tiers(spark, sf), width=WIDTH)
    return out.select("file", "iu_idx", "iu_start", "iu_end", "utt_idx", "n_ut")


@query(
    "number_units_all",
    f"with {tb.TIERS_SQL} select file, idx as iu_idx, cast(row_number() over (partition by file order by start_t, idx) as integer) as n_ut "
    "from tiers where tier = 'UTtag' and text <> 'pp'",
)
def _(spark, sf):
    out = ops.number_units(tb.tiers(spark, sf), inside_utterance=False, width=WIDTH)
    return out.select("file", "iu_idx", "n_ut")


@query("interval_nest", NEST + "select file, syl_idx, syl_start, syl_end, syl_text, iu_start, iu_end, utt_start, n_ut from syl")
def _(spark, sf):
    out = ops.interval_nest(tb.tiers(spark, sf), width=WIDTH)
    return out.select("file", "syl_idx", "syl_start", "syl_end", "syl_text", "iu_start", "iu_end", "utt_start", "n_ut")


@query(
    "boundary_class",
    NEST + "select file, syl_idx, case when syl_start = iu_start and iu_start <> utt_start then 'begin_iu' "
    "when syl_start = utt_start then 'begin_utt' else 'none' end as start_boundary, "
    "case when syl_end = utt_end then 'tb' when syl_end = iu_end then 'ntb' else 'none' end as end_boundary from syl",
)
def _(spark, sf):
    out = ops.boundary_class(ops.interval_nest(tb.tiers(spark, sf), width=WIDTH))
    return out.select("file", "syl_idx", "start_boundary", "end_boundary")


@query(
    "mark_stress",
    NEST[:-1] + ", last as (select u.file, u.n_ut, arg_max(struct_pack(s := t.start_t, e := t.end_t, x := t.text), "
    "struct_pack(a := t.start_t, b := t.idx)) as l from (select distinct file, n_ut, iu_start, iu_end from syl) u join tiers t on t.file = u.file and t.tier = 'duv' and length(t.text) > 0 "
    "and t.start_t >= iu_start and t.end_t <= iu_end group by 1, 2), "
    "m as (select s.*, l, coalesce(l.s >= syl_start - 1e-2 and l.e <= syl_end + 1e-2, false) as stressed "
    "from syl s left join last l on s.file = l.file and s.n_ut = l.n_ut) "
    "select file, syl_idx, stressed, case when stressed then l.s end as vowel_start, "
    "case when stressed then l.e end as vowel_end, case when stressed then l.x end as vowel from m",
)
def _(spark, sf):
    iv = tb.tiers(spark, sf)
    out = ops.mark_stress(ops.interval_nest(iv, width=WIDTH), iv, width=WIDTH)
    return out.select("file", "syl_idx", "stressed", "vowel_start", "vowel_end", "vowel")


def _last(tier):
    return (
        f"try_cast(arg_max(t.text, struct_pack(a := t.start_t, b := t.idx)) filter (where t.tier = '{tier}') as double) as \"{tier}\""
    )


@query(
    "syllable_measures",
    NEST + f"select s.file, s.syl_idx, {_last('Zsil')}, {_last('Msil')}, {_last('Vsil')} from syl s left join tiers t "
    "on t.file = s.file and t.tier in ('Zsil', 'Msil', 'Vsil') and t.start_t >= syl_start and t.end_t <= syl_end group by 1, 2",
)
def _(spark, sf):
    iv = tb.tiers(spark, sf)
    out = ops.syllable_measures(ops.interval_nest(iv, width=WIDTH), iv, width=WIDTH)
    return out.select("file", "syl_idx", "Zsil", "Msil", "Vsil")
