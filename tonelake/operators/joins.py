"""Equi-joins, interval joins and nearest-unit joins.

Interval joins always carry a time bin beside the file, so one long file is spread over many tasks. Bins are dyadic: those
of level L are 2**L slots long. An interval of a few slots stands in each of them (level 0); a longer one stands at the
level whose bins are as long as it, so in two bins at most. A point asks one bin of every level that some interval has: with
short intervals alone that is its slot, and a long interval costs its two rows and one more question per point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.operators.ordering import neighbours_in_order

SLOT = 10.0  # seconds of recording per join slot


def _slot(t: Column | str, width: float) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(t / F.lit(float(width))).cast("long")


NARROW = 4  # slots that an interval may touch at level 0


def _level(lo: str, hi: str, width: float) -> Column:
    """The level of an interval: 0, or that of the shortest bins that are as long as it."""
    touched = _slot(hi, width) - _slot(lo, width) + 1
    return F.when(touched <= NARROW, F.lit(0)).otherwise(F.length(F.bin(touched - 1))).cast("int")


def _bins(lo: str, hi: str, width: float) -> Column:
    """Level and number of every bin an interval stands in; none for one that ends before it starts."""
    level = _level(lo, hi, width)
    size = F.pow(F.lit(2.0), level).cast("long")
    numbers = F.sequence(F.floor(_slot(lo, width) / size), F.floor(_slot(hi, width) / size))
    places = F.transform(numbers, lambda n: F.struct(level.alias("_level"), n.cast("long").alias("_bin")))
    return F.inline(F.when(F.col(hi) >= F.col(lo), places))


def interval_levels(intervals: DataFrame, lo: str, hi: str, width: float) -> list[int]:
    """The levels that some interval has (64 at most)."""
    used = intervals.where(F.col(hi) >= F.col(lo)).select(_level(lo, hi, width).alias("l")).distinct()
    return sorted(r["l"] for r in used.collect()) or [0]


def _asked(points: DataFrame, t: str, width: float, levels: Sequence[int]) -> DataFrame:
    """Every point with the bins it asks."""
    if list(levels) == [0]:
        return points.withColumn("_level", F.lit(0)).withColumn("_bin", _slot(t, width))
    asks = [F.struct(F.lit(n).alias("_level"), F.floor(_slot(t, width) / F.lit(1 << n)).cast("long").alias("_bin")) for n in levels]
    return points.select("*", F.inline(F.array(*asks)))


def merge_inner(a: DataFrame, b: DataFrame, on="id") -> DataFrame:
    return a.join(b, on, "inner")


def semi_filter(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return a.join(b, on, "left_semi")


def pending_files(inputs: DataFrame, done: DataFrame, keys: Sequence[str] = ("file", "algo")) -> DataFrame:
    """Inputs with no finished output yet."""
    return inputs.join(done, list(keys), "left_anti")


def lookup_name(df: DataFrame, dim: DataFrame, on) -> DataFrame:
    return df.join(dim, on, "left")


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys on each side and on both."""
    sides = (
        a.select(key).distinct().withColumn("_a", F.lit(1)).withColumn("_z", F.lit(0))
        .unionByName(b.select(key).distinct().withColumn("_a", F.lit(0)).withColumn("_z", F.lit(1)))
        .groupBy(key)
        .agg(F.max("_a").alias("_a"), F.max("_z").alias("_z"))
    )
    return sides.agg(
        F.sum("_a").alias("n_left"),
        F.sum("_z").alias("n_right"),
        F.sum(F.col("_a") * F.col("_z")).alias("n_both"),
    )


def relabel_update(units: DataFrame, changes: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """Units whose key has a change take its tag and text; the last change wins."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("Tag2", "Text"), order_col).alias("_r"))
    return (
        units.join(last, list(keys), "left")
        .withColumn("iu", F.coalesce(F.col("_r.Tag2"), F.col("iu")))
        .withColumn("text", F.when(F.col("_r").isNull(), F.lit("")).otherwise(F.col("_r.Text")))
        .drop("_r")
    )


def unit_frames(
    units: DataFrame, bounds: DataFrame, frames: DataFrame, order_col: str = "bound_order", width: float = SLOT
) -> DataFrame:
    """Each unit's frames (closed interval of its first boundary row).

    A unit without boundary or without frames stays, with NULL frame columns.
    Frames are shuffled once, by file and bin; the units with none are added
    from the keys alone, so a unit with very many frames never fills one task.
    """
    keys = ["file", "n_ut"]
    first = bounds.groupBy(*keys).agg(F.min_by(F.struct("iu_start", "iu_end"), order_col).alias("_w"))
    placed = units.join(first, keys, "left").select(*units.columns, "_w.iu_start", "_w.iu_end")
    levels = interval_levels(first.select("_w.*"), "iu_start", "iu_end", width)
    spans = placed.select("*", _bins("iu_start", "iu_end", width))
    extra = [c for c in frames.columns if c != "file"]

    def inside(fr: DataFrame) -> DataFrame:
        return spans.join(_asked(fr, "t", width, levels), ["file", "_level", "_bin"]).filter(
            F.col("t").between(F.col("iu_start"), F.col("iu_end"))
        )

    hits = inside(frames).select(*placed.columns, *extra)
    seen = inside(frames.select("file", "t")).select(*keys).distinct()
    bare = placed.join(seen, keys, "left_anti")
    return hits.unionByName(bare, allowMissingColumns=True)


def tag_frames(
    frames: DataFrame, units: DataFrame, order_col: str, cols: Sequence[str] = ("unit", "n_ut", "text"),
    width: float = SLOT,
) -> DataFrame:
    """Every frame with the unit around it; on overlap the last unit in table order wins.

    With units of one level the grouping extends the join key, so it needs no further shuffle.
    """
    levels = interval_levels(units, "start_t", "end_t", width)
    spans = units.select(
        "file", _bins("start_t", "end_t", width),
        F.col("start_t").alias("_s"), F.col("end_t").alias("_e"), F.col(order_col).alias("_o"),
        F.struct(*cols).alias("_u"),
    )
    left = _asked(frames, "t", width, levels)
    cond = (
        (F.col("f.file") == F.col("s.file"))
        & (F.col("f._level") == F.col("s._level"))
        & (F.col("f._bin") == F.col("s._bin"))
        & F.col("f.t").between(F.col("s._s"), F.col("s._e"))
    )
    rest = [c for c in frames.columns if c not in ("file", "frame_idx")]
    together = ["f._level", "f._bin"] if len(levels) == 1 else []
    tagged = (
        left.alias("f").join(spans.alias("s"), cond, "left")
        .groupBy("f.file", *together, "f.frame_idx")
        .agg(
            F.any_value(F.struct(*[F.col(f"f.{c}") for c in rest])).alias("_f"),
            F.max_by(F.col("s._u"), F.col("s._o")).alias("_u"),
        )
    )
    return tagged.select(
        "file", "frame_idx", *[F.col(f"_f.{c}") for c in rest], *[F.col(f"_u.{c}") for c in cols]
    )


def contained_in(
    children: DataFrame, parents: DataFrame, start: str, end: str, p_start: str, p_end: str,
    width: float = SLOT,
) -> DataFrame:
    """Join children to the parents of the same file that fully contain them."""
    levels = interval_levels(parents, p_start, p_end, width)
    p = parents.select("file", _bins(p_start, p_end, width), *[c for c in parents.columns if c != "file"]).alias("p")
    c = _asked(children, start, width, levels).alias("c")
    cond = (
        (F.col("c.file") == F.col("p.file"))
        & (F.col("c._level") == F.col("p._level"))
        & (F.col("c._bin") == F.col("p._bin"))
        & (F.col(f"c.{start}") >= F.col(f"p.{p_start}"))
        & (F.col(f"c.{end}") <= F.col(f"p.{p_end}"))
    )
    joined = c.join(p, cond)
    return joined.select(
        *[F.col(f"c.{x}") for x in children.columns], *[F.col(f"p.{x}") for x in parents.columns if x != "file"]
    )


def nearest_unit(
    units: DataFrame, target_pred: Column, candidate_tags: Sequence[str] = ("COM", "COB", "CMM"),
    width: float = 600.0,
) -> DataFrame:
    """Each target unit's nearest candidate in the same file by centre time.

    Works on the time order with one carry per slot: no pairs are formed.
    Ties go to the earlier start.
    """
    u = units.withColumn("centre", (F.col("start_t") + F.col("end_t")) / 2)
    is_cand = F.col("iu").isin(list(candidate_tags)) & ~target_pred
    prev_item = F.when(
        is_cand, F.struct(F.col("centre").alias("c"), (-F.col("start_t")).alias("s"), F.col("n_ut"), F.col("iu"))
    )
    next_item = F.when(
        is_cand, F.struct(F.col("centre").alias("c"), F.col("start_t").alias("s"), F.col("n_ut"), F.col("iu"))
    )
    seen = neighbours_in_order(
        u.withColumn("_t", target_pred), ["file"], "centre", _slot("centre", width), prev_item, next_item
    ).filter("_t")
    dp = F.col("centre") - F.col("_prev.c")
    dn = F.col("_next.c") - F.col("centre")
    use_prev = dn.isNull() | (dp < dn) | ((dp == dn) & (-F.col("_prev.s") <= F.col("_next.s")))
    pick = F.when(dp.isNotNull() & use_prev, F.col("_prev")).otherwise(F.col("_next"))
    return seen.select(
        "file", "n_ut", "iu", "centre",
        pick["n_ut"].alias("near_n_ut"), pick["iu"].alias("near_iu"),
        F.abs(pick["c"] - F.col("centre")).alias("distance"),
    )


def align_tracks(tracks: DataFrame, step: float = 0.005, tol: float = 0.0025) -> DataFrame:
    """Every tracker on one grid: the nearest sample within ``tol``, else NULL.

    The grid of a file runs over the grid points between its first and last
    sample. A sample goes to the grid points within ``tol`` of it; one partial
    aggregation per (file, algo, grid point) keeps the nearest.
    """
    near = F.round(F.col("t") / F.lit(step)).cast("long")
    reach = int(-(-tol // step)) if tol > step / 2 else 1
    points = F.explode(F.sequence(near - reach, near + reach))
    gap = F.abs(F.round(F.col("t") - F.col("grid_idx") * F.lit(step), 9))
    nearest = (
        tracks.select("file", "algo", "t", "value", points.alias("grid_idx"))
        .filter((gap <= F.lit(tol)) & (F.col("grid_idx") >= 0))
        .groupBy("file", "algo", "grid_idx")
        .agg(F.min_by("value", F.struct(gap.alias("g"), F.col("t"))).alias("value"))
    )
    spans = tracks.groupBy("file").agg(F.min(near).alias("_lo"), F.max(near).alias("_hi"))
    algos = tracks.select("file", "algo").distinct()
    # The grid is built in two steps so that a long file's grid is made by many tasks.
    blocks = F.explode(F.sequence(F.floor(F.col("_lo") / 4096), F.floor(F.col("_hi") / 4096)))
    cells = F.explode(
        F.sequence(
            F.greatest(F.col("_lo"), F.col("_blk") * 4096), F.least(F.col("_hi"), F.col("_blk") * 4096 + 4095)
        )
    )
    grid = (
        algos.join(spans, "file")
        .select("file", "algo", "_lo", "_hi", blocks.alias("_blk"))
        .repartition("file", "algo", "_blk")
        .select("file", "algo", cells.alias("grid_idx"))
    )
    return grid.join(nearest, ["file", "algo", "grid_idx"], "left").select(
        "file", "algo", "grid_idx", (F.col("grid_idx") * F.lit(step)).alias("t"), "value"
    )
