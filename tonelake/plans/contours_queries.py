"""Windows, pitch paths and lines as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions.scalar import octave_similarity
from tonelake.operators import lines
from tonelake.operators import viterbi as vt
from tonelake.operators import windows as ops
from tonelake.plans import tables as tb
from tonelake.plans.registry import query
from tonelake.plans.scalar_queries import similarity_sql
from tonelake.plans.stats_queries import _rounded, cut

FRAMES = f"with {tb.FRAMES_SQL} "
N = len(tb.CANDS)

# ---- windows -----------------------------------------------------------------------

OFFSETS = range(-3, 4)


def _at(col, o):
    if o == 0:
        return col
    f = "lag" if o < 0 else "lead"
    return f"coalesce({f}({col}, {abs(o)}) over w, 0e0)"


@query(
    "sliding_windows",
    FRAMES + "select file, frame_idx, creaky as label, "
    + ", ".join(f"{_at(c, o)} as w{o + 3}_{c}" for o in OFFSETS for c in ("c0", "hnr"))
    + " from frames window w as (partition by file order by frame_idx)",
)
def _(spark, sf):
    fr = tb.frames(spark, sf, ["file", "frame_idx", "c0", "hnr", "creaky"])
    out = ops.sliding_windows(fr, ["c0", "hnr"], 7, "creaky")
    flat = [
        F.get(F.get("win", F.lit(i)), F.lit(j)).alias(f"w{i}_{c}") for i in range(7) for j, c in enumerate(("c0", "hnr"))
    ]
    return out.select("file", "frame_idx", "label", *flat)


CONTOUR = "1.5e2 + frame_idx * 3e-1 + (event_id % 7) * 9e-1"


def _dot_sql(first, weights):
    return "(" + " + ".join(f"({w}) * ys[{first} + {k}]" for k, w in enumerate(weights)) + ") / 42e0"


@query(
    "smooth_contour",
    FRAMES[:-1] + f", y0 as (select file, frame_idx, {CONTOUR} as y from frames), "
    "l as (select file, list(y order by frame_idx) as ys, count(*) as n from y0 group by file), "
    "f as (select y0.file, y0.frame_idx, y, case when n < 7 then y "
    + " ".join(f"when frame_idx = {i} then {_dot_sql(1, ops.SMOOTH_EDGE[i])}" for i in range(3))
    + " "
    + " ".join(f"when frame_idx = n - {i + 1} then {_dot_sql('n - 6', ops.SMOOTH_EDGE[i][::-1])}" for i in range(3))
    + f" else {_dot_sql('frame_idx - 2', ops.SMOOTH_MIDDLE)} end as fit from y0 join l on y0.file = l.file) "
    "select file, frame_idx, round(case when abs(round(y - fit, 9)) > 2.0 then 0 else fit end, 6) as smoothed from f",
)
def _(spark, sf):
    fr = tb.frames(spark, sf, ["file", "frame_idx", "event_id"]).withColumn("y", F.expr(CONTOUR))
    return ops.smooth_contour(fr, "y").select("file", "frame_idx", F.round("smoothed", 6).alias("smoothed"))


VOICED = (
    FRAMES[:-1] + ", gaps as (select file, bool_or(pred_all is null) as g0, bool_or(pred_f0 is null) as g1, "
    "bool_or(pred_mfcc is null) as g2 from frames group by file), voiced as (select f.*, case when not g0 then pred_all "
    "when not g1 then pred_f0 when not g2 then pred_mfcc else 0 end as voice from frames f join gaps on f.file = gaps.file) "
)


@query("voice_fallback", VOICED + "select file, frame_idx, voice from voiced")
def _(spark, sf):
    return ops.voice_fallback(tb.frames(spark, sf), tb.PREDS).select("file", "frame_idx", "voice")


# ---- emission, transition, path ----------------------------------------------------


def emission_sql(source, rate, bonuses, vup="5e-1"):
    """CTEs ``med`` and ``em`` (candidates c0.., emissions e0..)."""
    present = f"list_sort(list_filter([{', '.join(tb.CANDS)}], lambda x: x is not null))"
    es = []
    for i, c in enumerate(tb.CANDS):
        e = similarity_sql("m", c, vup, rate)
        es.append(" * ".join([f"({e})"] + [f"(case when {cond} then {k[i]} else 1e0 end)" for cond, k in bonuses if i in k]) + f" as e{i}")
    return (
        f", med0 as (select *, {present} as ps from {source}), med as (select *, case when len(ps) * 2 >= {N} then "
        "(ps[(len(ps) - 1) // 2 + 1] + ps[len(ps) // 2 + 1]) / 2 end as m from med0), "
        f"em as (select *, {', '.join(es)} from med)"
    )


PLAIN = [("hnr < 0", {0: "2.5e0", 2: "2.5e0"}), ("creaky = 1", {0: "2.5e0", 2: "2.5e0"})]
OCTAVE = [("creaky = 1", {0: "2.5e0", 2: "2.5e0", 4: "1.05e0"})]


def _emission_query(name, rate, bonuses, build):
    @query(
        name,
        FRAMES[:-1] + emission_sql("frames", rate, bonuses) + " select file, frame_idx, "
        + ", ".join(f"round(e{i}, 9) as e{i}" for i in range(N)) + " from em",
    )
    def _(spark, sf):
        out = build(tb.frames(spark, sf))
        return out.select("file", "frame_idx", *[F.round(F.get("emis", F.lit(i)), 9).alias(f"e{i}") for i in range(N)])


_emission_query("emission", "1.44e0", PLAIN, lambda f: vt.emission(f, tb.CANDS))
_emission_query("emission_octave", "1e0", OCTAVE, lambda f: vt.emission_octave(f, tb.CANDS, octave_similarity))


def _trans(vup):
    """Columns t<k><l> of a source that has p0.. (previous candidates) and c0.."""
    return ", ".join(
        f"{similarity_sql(f'p{k}', c, vup)} as t{k}{l}" for k in range(N) for l, c in enumerate(tb.CANDS)
    )


LAGS = ", ".join(f"lag({c}) over w as p{i}" for i, c in enumerate(tb.CANDS))


@query(
    "transitions",
    FRAMES[:-1] + f", pr as (select *, {LAGS} from frames window w as (partition by file order by frame_idx)), "
    f"tr as (select *, {_trans('3.5e-1')} from pr) select file, frame_idx, "
    + ", ".join(f"case when frame_idx > 0 then round(t{k}{l}, 9) end as t{k}{l}" for k in range(N) for l in range(N))
    + " from tr",
)
def _(spark, sf):
    out = vt.transitions(tb.frames(spark, sf, ["file", "frame_idx", *tb.CANDS]), tb.CANDS)
    flat = [
        F.round(F.get(F.get("trans", F.lit(k)), F.lit(l)), 9).alias(f"t{k}{l}") for k in range(N) for l in range(N)
    ]
    return out.select("file", "frame_idx", *flat)


def path_sql(head, source, reinforcement, vup):
    """CTEs up to ``path`` (file, frame_idx, state, log_prob): the recurrence, one frame per round."""
    keep = ", ".join(["file", "frame_idx", "log", *[f"e{i}" for i in range(N)]])
    # Scan predecessors in order; the bonus applies where the state is kept.
    inner = (
        "select s.file, s.frame_idx, f.log, " + ", ".join(f"s.e{i}" for i in range(N)) + ", "
        + ", ".join(f"f.v{k} * s.t{k}{l} as p{k}{l}" for k in range(N) for l in range(N))
        + " from fwd f join steps s on s.file = f.file and s.frame_idx = f.frame_idx + 1"
    )
    ps = ", ".join(f"p{k}{l}" for k in range(N) for l in range(N))
    level = "select *, " + ", ".join(
        f"p0{l}{f' * {reinforcement}' if l == 0 else ''} as b{l}, 0 as q{l}" for l in range(N)
    ) + f" from ({inner})"
    for k in range(1, N):
        level = f"select {keep}, {ps}, " + ", ".join(
            f"case when p{k}{l} >= b{l} * (1 - 1e-9) then p{k}{l}{f' * {reinforcement}' if l == k else ''} else b{l} end as b{l}, "
            f"case when p{k}{l} >= b{l} * (1 - 1e-9) then {k} else q{l} end as q{l}"
            for l in range(N)
        ) + f" from ({level})"
    raw = f"select file, frame_idx, log, {', '.join(f'b{l} * e{l} as r{l}, q{l}' for l in range(N))} from ({level})"
    top = "greatest(" + ", ".join(f"r{l}" for l in range(N)) + ")"
    scaled = f"select file, frame_idx, {', '.join(f'r{l} / {top} as v{l}' for l in range(N))}, {', '.join(f'q{l}' for l in range(N))}, log + ln({top}) as log"
    first = f"greatest({', '.join(f'e{l}' for l in range(N))})"
    best = "case " + " ".join(
        f"when v{l} >= 1 - 1e-9 then {l}" for l in range(N)
    ) + " end"
    pick = "case state " + " ".join(f"when {l} then q{l}" for l in range(N)) + " end"
    return (
        head.replace("with ", "with recursive ", 1)
        + f", pr as (select *, {LAGS} from {source} window w as (partition by file order by frame_idx)), "
        f"steps as materialized (select *, {_trans(vup)} from pr), "
        f"fwd as (select file, frame_idx, {', '.join(f'e{l} / {first} as v{l}' for l in range(N))}, "
        f"{', '.join(f'0 as q{l}' for l in range(N))}, ln({first}) as log from steps where frame_idx = 0 "
        f"union all {scaled} from ({raw})), "
        "ends as (select file, max(frame_idx) as n from fwd group by file), "
        f"back as (select f.file, f.frame_idx, {best} as state, log from fwd f join ends e on f.file = e.file and f.frame_idx = e.n "
        f"union all select f.file, f.frame_idx - 1, {pick}, b.log from back b join fwd f on f.file = b.file and f.frame_idx = b.frame_idx "
        "where b.frame_idx > 0), path as (select file, frame_idx, state, log as log_prob from back)"
    )


CHOSEN = "case state " + " ".join(f"when {i} then {c}" for i, c in enumerate(tb.CANDS)) + " end"


@query(
    "viterbi_path",
    path_sql(FRAMES[:-1] + emission_sql("frames", "1.44e0", PLAIN), "em", "1.2e0", "3.5e-1")
    + f" select p.file, p.frame_idx, state, round({CHOSEN}, 6) as candidate, round(log_prob, 6) as log_prob "
    "from path p join em on p.file = em.file and p.frame_idx = em.frame_idx",
)
def _(spark, sf):
    return _rounded(vt.viterbi_path(vt.emission(tb.frames(spark, sf), tb.CANDS), n_cand=N), ["candidate", "log_prob"])


@query(
    "viterbi_track",
    path_sql(VOICED[:-1] + emission_sql("voiced", "1.44e0", PLAIN), "em", "1e0", "5e-1")
    + f" select p.file, p.frame_idx, state as winning_path, round({CHOSEN}, 6) as winning_candidate, "
    f"round(case when coalesce(voice, 0) = 0 then 0 else {CHOSEN} end, 6) as unvoiced_path, concat('c', state) as tracker "
    "from path p join em on p.file = em.file and p.frame_idx = em.frame_idx",
)
def _(spark, sf):
    out = vt.viterbi_track(tb.frames(spark, sf), tb.CANDS, tb.PREDS)
    return _rounded(out, ["winning_candidate", "unvoiced_path"])


# ---- lines -------------------------------------------------------------------------


def _long_cut(spark, sf):
    c = cut(spark, sf, ["t", "creaky", "intensity", *tb.CANDS])
    return c.unpivot(["file", "n_ut", "t", "creaky", "intensity"], tb.CANDS, "algo", "f0")


LONG_CUT = (
    f"with {tb.CUT_SQL}, pts as ("
    + " union all ".join(
        f"select file, n_ut, '{c}' as algo, t as x, {c} as y, intensity as w from cut where creaky = 0 and t is not null and {c} is not null"
        for c in tb.CANDS
    )
    + ") "
)
LINE = ["file", "n_ut", "algo"]


def _fitted(df):
    return _rounded(df, ["slope", "intercept"], 4)


@query(
    "fit_line",
    LONG_CUT + "select file, n_ut, algo, round(case when max(x) > min(x) then regr_slope(y, x) end, 4) as slope, "
    "round(case when max(x) > min(x) then regr_intercept(y, x) end, 4) as intercept from pts group by all",
)
def _(spark, sf):
    return _fitted(lines.fit_line(_long_cut(spark, sf), LINE, "t", "f0", "creaky"))


def _weighted_sql(source, weight):
    return (
        f", wm as (select file, n_ut, algo, sum({weight} * x) / sum({weight}) as xm, sum({weight} * y) / sum({weight}) as ym, "
        f"max(x) > min(x) as ok from {source} group by all), "
        f"ws as (select p.file, p.n_ut, p.algo, any_value(xm) as xm, any_value(ym) as ym, any_value(ok) as ok, "
        f"sum({weight} * (x - xm) * (y - ym)) / nullif(sum({weight} * (x - xm) * (x - xm)), 0) as sl from {source} p join wm "
        "on p.file = wm.file and p.n_ut = wm.n_ut and p.algo = wm.algo group by all), "
        "fit as (select file, n_ut, algo, case when ok then sl end as slope, case when ok then ym - sl * xm end as intercept from ws)"
    )


@query(
    "fit_line_weighted",
    LONG_CUT[:-1] + _weighted_sql("pts", "(1 / w)")
    + " select file, n_ut, algo, round(slope, 4) as slope, round(intercept, 4) as intercept from fit",
)
def _(spark, sf):
    return _fitted(lines.fit_line_weighted(_long_cut(spark, sf), LINE, "t", "f0", "creaky", "intensity"))


ON = "{a}.file = {b}.file and {a}.n_ut = {b}.n_ut and {a}.algo = {b}.algo"
ROBUST = (
    LONG_CUT[:-1] + ", np as (select *, row_number() over g - 1 as i, count(*) over (partition by file, n_ut, algo) as n, "
    "median(y) over (partition by file, n_ut, algo) as med from pts window g as (partition by file, n_ut, algo order by x, w, y)), "
    "lim as (select *, round(median(abs(y - med)) over (partition by file, n_ut, algo), 9) as mad from np), "
    "d0 as (select distinct file, n_ut, algo, n, t from lim, (select unnest(generate_series(0, 99)) as t) where n >= 2), "
    "d1 as (select *, (7919 * t + 13) % n as i0 from d0), "
    "d2 as (select *, (i0 + 1 + (104729 * t + 7) % (n - 1)) % n as j0 from d1), "
    "tl as (select d.file, d.n_ut, d.algo, d.t, (q.y - p.y) / (q.x - p.x) as a, p.x as px, p.y as py from d2 d join lim p on "
    + ON.format(a="d", b="p") + " and p.i = least(i0, j0) join lim q on " + ON.format(a="d", b="q")
    + " and q.i = greatest(i0, j0) where p.x <> q.x), "
    "l2 as (select *, py - a * px as b from tl), "
    "inl as (select l.file, l.n_ut, l.algo, t, x, y, w, y - (a * x + b) as r from l2 l join lim p on "
    + ON.format(a="l", b="p") + " where round(abs(y - (a * x + b)), 9) <= mad), "
    "sc0 as (select *, avg(y) over (partition by file, n_ut, algo, t) as my from inl), "
    "sc as (select file, n_ut, algo, t, count(*) as c, sum(r * r) as lft, sum((y - my) * (y - my)) as tot from sc0 group by all), "
    "rk as (select *, row_number() over (partition by file, n_ut, algo order by c desc, round(case when round(tot, 9) = 0 then "
    "(case when round(lft, 9) = 0 then 1e0 else 0e0 end) else 1 - lft / tot end, 6) desc, t) as rn from sc), "
    "win as (select i.* from inl i join rk on " + ON.format(a="i", b="rk") + " and i.t = rk.t where rn = 1), "
    "grp as (select distinct file, n_ut, algo from cut, (select unnest(['c0', 'c1', 'c2', 'c3']) as algo))"
)


def _robust_sql(weight):
    return (
        ROBUST + _weighted_sql("win", weight)
        + " select g.file, g.n_ut, g.algo, round(slope, 4) as slope, round(intercept, 4) as intercept from grp g left join fit on "
        + ON.format(a="g", b="fit")
    )


@query("fit_line_ransac", _robust_sql("1e0"))
def _(spark, sf):
    return _fitted(lines.fit_line_ransac(_long_cut(spark, sf), LINE, "t", "f0", "creaky"))


@query("fit_line_ransac_weighted", _robust_sql("w"))
def _(spark, sf):
    return _fitted(lines.fit_line_ransac_weighted(_long_cut(spark, sf), LINE, "t", "f0", "creaky", "intensity"))


@query(
    "unit_slopes",
    ROBUST + _weighted_sql("win", "w") + ", se as (select file, n_ut, avg(intensity) as mean_se from cut group by all) "
    "select se.file, se.n_ut, round(mean_se, 6) as mean_se, "
    + ", ".join(
        f"round(max(slope) filter (where algo = '{c}'), 4) as {c}_slope, round(max(intercept) filter (where algo = '{c}'), 4) as {c}_intercept"
        for c in tb.CANDS
    )
    + " from se left join fit on se.file = fit.file and se.n_ut = fit.n_ut group by se.file, se.n_ut, mean_se",
)
def _(spark, sf):
    fr = tb.frames(spark, sf)
    un = tb.units(spark, sf)
    out = lines.unit_slopes(tb.asked_units(un), tb.bounds(un), fr, tb.CANDS)
    return _rounded(_rounded(out, ["mean_se"]), [f"{c}_{p}" for c in tb.CANDS for p in ("slope", "intercept")], 4)


@query(
    "predict_line",
    f"with {tb.CUT_SQL}, k as (select file, n_ut, case when max(t) > min(t) then regr_slope(c0, t) end as slope, "
    "case when max(t) > min(t) then regr_intercept(c0, t) end as intercept from cut where creaky = 0 and t is not null group by all) "
    "select c.file, c.n_ut, frame_idx, round(slope * t + intercept, 6) as fitted from cut c join k on c.file = k.file and c.n_ut = k.n_ut",
)
def _(spark, sf):
    c = cut(spark, sf, ["frame_idx", "t", "c0", "creaky"])
    coefs = lines.fit_line(c, ["file", "n_ut"], "t", "c0", "creaky")
    return _rounded(lines.predict_line(c, coefs, ["file", "n_ut"]).select("file", "n_ut", "frame_idx", "fitted"), ["fitted"])
