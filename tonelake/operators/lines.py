"""Lines per unit: least squares, weighted, and robust by random sample consensus."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.operators.joins import SLOT, unit_frames
from tonelake.operators.ordering import _join_summary, number_rows
from tonelake.operators.quantiles import exact_quantiles

GROUP_LIMIT = 20_000  # frames per unit handled as one array (100 s at 5 ms)


def _usable(df: DataFrame, group: Sequence[str], x, y, z, w=None) -> DataFrame:
    """Rows with every value present and not creaky, as columns _x, _y, _w."""
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    return df.filter(F.col(z) == 0).select(
        *group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), weight.alias("_w")
    ).filter("_x IS NOT NULL AND _y IS NOT NULL AND _w IS NOT NULL")


def fit_line(df: DataFrame, group: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """Least-squares slope and intercept per group; NULL where all x are equal."""
    rows = _usable(df, group, x, y, z)
    spread = F.max("_x") > F.min("_x")
    return rows.groupBy(*group).agg(
        F.when(spread, F.regr_slope("_y", "_x")).alias("slope"),
        F.when(spread, F.regr_intercept("_y", "_x")).alias("intercept"),
    )


def _weighted(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Weighted line from sums centred on the weighted means."""
    means = rows.groupBy(*group).agg(
        (F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_xm"),
        (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("_ym"),
    )
    dx, dy = F.col("_x") - F.col("_xm"), F.col("_y") - F.col("_ym")
    sums = _join_summary(rows, means, group).groupBy(*group).agg(
        F.sum(F.col("_w") * dx * dy).alias("_sxy"),
        F.sum(F.col("_w") * dx * dx).alias("_sxx"),
        F.any_value("_xm").alias("_xm"),
        F.any_value("_ym").alias("_ym"),
        (F.max("_x") > F.min("_x")).alias("_spread"),
    )
    slope = F.when(F.col("_spread"), F.try_divide("_sxy", "_sxx"))
    return sums.select(*group, slope.alias("slope"), (F.col("_ym") - slope * F.col("_xm")).alias("intercept"))


def fit_line_weighted(df: DataFrame, group: Sequence[str], x: str, y: str, z: str, w: str) -> DataFrame:
    """Weighted least squares with weight 1/w."""
    rows = _usable(df, group, x, y, z, w).filter("_w <> 0").withColumn("_w", 1 / F.col("_w"))
    return _weighted(rows, group)


# ---- robust lines ------------------------------------------------------------------


def _picks(n: int, t: np.ndarray):
    """The two points of each trial among ``n`` ordered points (a fixed draw)."""
    i = (7919 * t + 13) % n
    j = (i + 1 + (104729 * t + 7) % (n - 1)) % n
    return np.minimum(i, j), np.maximum(i, j)


def _robust_lines(x: np.ndarray, y: np.ndarray, w: np.ndarray, trials: int) -> np.ndarray:
    """(slope, intercept) of units that all have n points ordered by x; nan where none fits."""
    units, n = x.shape
    out = np.full((units, 2), np.nan)
    if n < 2:
        return out
    dev = np.abs(y - np.median(y, axis=1, keepdims=True))
    limit = np.round(np.median(dev, axis=1), 9)
    i, j = _picks(n, np.arange(trials))
    run = x[:, j] - x[:, i]
    valid = run != 0
    a = (y[:, j] - y[:, i]) / np.where(valid, run, 1.0)
    b = y[:, i] - a * x[:, i]
    resid = y[:, None, :] - (a[:, :, None] * x[:, None, :] + b[:, :, None])
    inlier = (np.round(np.abs(resid), 9) <= limit[:, None, None]) & valid[:, :, None]
    count = inlier.sum(axis=2)
    mean = (inlier * y[:, None, :]).sum(axis=2) / np.maximum(count, 1)
    total = (inlier * (y[:, None, :] - mean[:, :, None]) ** 2).sum(axis=2)
    left = (inlier * resid**2).sum(axis=2)
    # Most inliers, then highest R squared, then the earliest trial.
    top = count == count.max(axis=1, keepdims=True)
    r2 = np.where(top, _r2(left, total), -np.inf)
    best = np.argmax(r2 == r2.max(axis=1, keepdims=True), axis=1)
    keep = inlier[np.arange(units), best]
    w = w * keep
    weight = w.sum(axis=1)
    lo = np.where(keep, x, np.inf).min(axis=1)
    hi = np.where(keep, x, -np.inf).max(axis=1)
    ok = (hi > lo) & (weight != 0)
    safe = np.where(ok, weight, 1.0)
    xm, ym = (w * x).sum(axis=1) / safe, (w * y).sum(axis=1) / safe
    dx = x - xm[:, None]
    sxx = np.where(ok, (w * dx * dx).sum(axis=1), 1.0)
    slope = (w * dx * (y - ym[:, None])).sum(axis=1) / sxx
    out[ok] = np.column_stack([slope, ym - slope * xm])[ok]
    return out


def _r2(left, total):
    """R squared to 6 digits; without spread, 1 for an exact fit and else 0."""
    flat = np.round(total, 9) == 0
    exact = np.where(np.round(left, 9) == 0, 1.0, 0.0)
    return np.round(np.where(flat, exact, 1 - left / np.where(flat, 1.0, total)), 6)


def _fit_all(x: pd.Series, y: pd.Series, w: pd.Series, trials: int) -> np.ndarray:
    """Fits of every unit of a batch; units with equally many points go together."""
    points, by_size = [], {}
    for pos, (xi, yi, wi) in enumerate(zip(x, y, w)):
        p = np.array([xi, yi, wi], dtype=float)
        p = p[:, ~np.isnan(p).any(axis=0)]
        p = p[:, np.lexsort((p[1], p[2], p[0]))]  # by x, weight, y: each tracker's own order
        points.append(p)
        by_size.setdefault(p.shape[1], []).append(pos)
    out = np.full((len(points), 2), np.nan)
    for n, members in by_size.items():
        step = max(1, 2_000_000 // (trials * max(n, 1)))
        for lo in range(0, len(members), step):
            part = members[lo : lo + step]
            block = np.stack([points[m] for m in part])
            out[part] = _robust_lines(block[:, 0], block[:, 1], block[:, 2], trials)
    return out


def _robust_small(
    rows: DataFrame, group: Sequence[str], ys: Sequence[str], trials: int, extra: dict[str, Column]
) -> DataFrame:
    """One array of points per group, fitted in Arrow batches."""
    points = rows.groupBy(*group).agg(
        F.collect_list(F.when(F.col("_x").isNotNull(), F.struct("_x", "_w", *ys))).alias("_p"),
        *[agg.alias(name) for name, agg in extra.items()],
    )
    # A field of an array of structs is the array of that field.
    arrays = points.select(
        *group, F.col("_p._x").alias("x"), F.col("_p._w").alias("w"), *[F.col(f"_p.{c}").alias(c) for c in ys],
        *extra,
    )

    @F.pandas_udf("slope double, intercept double")
    def fit(x: pd.Series, y: pd.Series, w: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_fit_all(x, y, w, trials), columns=["slope", "intercept"])

    return arrays.select(*group, *[fit("x", c, "w").alias(c) for c in ys], *extra)


def _robust_large(rows: DataFrame, group: Sequence[str], trials: int) -> DataFrame:
    """The same fit for units of any length, by joins and partial sums.

    ``rows`` has _x, _y, _w without gaps. Every trial's sums come from one
    aggregation whose state per task is ``trials`` rows per group.
    """
    group = list(group)
    med = exact_quantiles(rows, group, "_y", [0.5], ["_med"])
    dev = _join_summary(rows, med, group).withColumn("_d", F.abs(F.col("_y") - F.col("_med")))
    mad = exact_quantiles(dev.select(*group, "_d"), group, "_d", [0.5], ["_mad"])
    numbered = number_rows(rows, group, ["_x", "_w", "_y"], F.floor(F.col("_x") / F.lit(SLOT)), "_rn")
    numbered = numbered.withColumn("_rn", F.col("_rn") - 1)
    draws = mad.filter("n >= 2").select(*group, "n", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("_t"))
    i = (F.lit(7919) * F.col("_t") + 13) % F.col("n")
    j = (i + 1 + (F.lit(104729) * F.col("_t") + 7) % (F.col("n") - 1)) % F.col("n")
    ends = draws.select(*group, "_t", F.explode(F.array(i, j)).alias("_rn"))
    pts = _join_summary(ends, numbered.select(*group, "_rn", "_x", "_y"), [*group, "_rn"])
    # Two points per trial: order them by row so slope and intercept match either way.
    lines = pts.groupBy(*group, "_t").agg(
        F.min_by(F.struct("_x", "_y"), "_rn").alias("p"), F.max_by(F.struct("_x", "_y"), "_rn").alias("q")
    ).filter("p._x <> q._x")
    slope = (F.col("q._y") - F.col("p._y")) / (F.col("q._x") - F.col("p._x"))
    lines = lines.select(*group, F.struct(F.col("_t").alias("t"), slope.alias("a"), (F.col("p._y") - slope * F.col("p._x")).alias("b")).alias("_l"))
    trial_list = lines.groupBy(*group).agg(F.array_sort(F.collect_list("_l")).alias("_ls"))
    info = _join_summary(
        _join_summary(trial_list, mad.select(*group, "_mad"), group), med.select(*group, "_med"), group
    )
    resid = F.col("_y") - (F.col("_l.a") * F.col("_x") + F.col("_l.b"))
    hit = F.round(F.abs(resid), 9) <= F.round(F.col("_mad"), 9)
    yc = F.col("_y") - F.col("_med")
    scored = (
        _join_summary(rows, info, group)
        .select(*group, "_x", "_y", "_mad", "_med", F.explode("_ls").alias("_l"))
        .filter(hit)
        .groupBy(*group, "_l")
        .agg(
            F.count(F.lit(1)).alias("_c"), F.sum(yc).alias("_sy"), F.sum(yc * yc).alias("_syy"),
            F.sum(resid * resid).alias("_left"),
        )
    )
    total = F.col("_syy") - F.col("_sy") * F.col("_sy") / F.col("_c")
    flat = F.round(total, 9) == 0
    r2 = F.round(
        F.when(flat, F.when(F.round("_left", 9) == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide("_left", total)), 6
    )
    best = scored.groupBy(*group).agg(
        F.max_by("_l", F.struct("_c", r2.alias("r2"), (-F.col("_l.t")).alias("nt"))).alias("_l")
    )
    chosen = _join_summary(
        _join_summary(rows, mad.select(*group, "_mad"), group), best, group
    ).filter(hit)
    fitted = _weighted(chosen.select(*group, "_x", "_y", "_w"), group)
    every = rows.select(*group).distinct()
    return _join_summary(every, fitted, group, "left")


def _robust(df: DataFrame, group, x, ys, z, w, trials, limit, extra: dict[str, Column] | None = None) -> DataFrame:
    """One struct (slope, intercept) per y; groups beyond ``limit`` rows go the distributed way.

    ``extra`` names further aggregates, over the points' columns.
    """
    group, extra = list(group), extra or {}
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    rows = df.select(
        *group,
        # A dropped frame keeps its group: its point is empty.
        F.when(F.col(z) == 0, F.col(x)).cast("double").alias("_x"),
        weight.alias("_w"),
        *[F.col(c).cast("double").alias(c) for c in ys],
    )
    sizes = rows.groupBy(*group).agg(F.count("_x").alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= limit:
        return _robust_small(rows, group, ys, trials, extra)
    sized = _join_summary(rows, sizes, group)
    out = _robust_small(sized.filter(F.col("_n") <= limit).drop("_n"), group, ys, trials, extra)
    big = sized.filter(F.col("_n") > limit).drop("_n")
    fits = big.groupBy(*group).agg(F.lit(1).alias("_one"), *[a.alias(k) for k, a in extra.items()]).drop("_one")
    for c in ys:
        clean = big.select(*group, "_x", "_w", F.col(c).alias("_y")).filter(
            "_x IS NOT NULL AND _y IS NOT NULL AND _w IS NOT NULL"
        )
        fit = _robust_large(clean, group, trials).select(*group, F.struct("slope", "intercept").alias(c))
        fits = _join_summary(fits, fit, group, "left")
    return out.unionByName(fits)


def fit_line_ransac(
    df: DataFrame, group: Sequence[str], x: str, y: str, z: str, trials: int = 100, limit: int = GROUP_LIMIT
) -> DataFrame:
    return _robust(df, group, x, [y], z, None, trials, limit).select(
        *group, F.col(f"{y}.slope").alias("slope"), F.col(f"{y}.intercept").alias("intercept")
    )


def fit_line_ransac_weighted(
    df: DataFrame, group: Sequence[str], x: str, y: str, z: str, w: str, trials: int = 100,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Robust line whose last fit weighs the inliers by ``w`` itself."""
    return _robust(df, group, x, [y], z, w, trials, limit).select(
        *group, F.col(f"{y}.slope").alias("slope"), F.col(f"{y}.intercept").alias("intercept")
    )


def unit_slopes(
    units: DataFrame, bounds: DataFrame, frames: DataFrame, trackers: Sequence[str], trials: int = 100,
    limit: int = GROUP_LIMIT, order_col: str = "bound_order", width: float = SLOT,
) -> DataFrame:
    """Robust weighted line of every tracker and mean intensity, per unit.

    A tracker that gives no line is a NULL pair.
    """
    keys = ["file", "n_ut"]
    need = frames.select("file", "t", "creaky", "intensity", *trackers)
    cut = unit_frames(units.select(*keys), bounds, need, order_col, width)
    # Mean intensity is over all frames of the unit, so it shares the fits' grouping.
    fits = _robust(
        cut, keys, "t", list(trackers), "creaky", "intensity", trials, limit, {"mean_se": F.avg("_w")}
    )
    wide: list[Column] = []
    for c in trackers:
        wide += [F.col(f"{c}.slope").alias(f"{c}_slope"), F.col(f"{c}.intercept").alias(f"{c}_intercept")]
    return fits.select(*keys, *wide, "mean_se")


def predict_line(frames: DataFrame, coefs: DataFrame, on: Sequence[str], x: str = "t") -> DataFrame:
    return frames.join(coefs, list(on)).withColumn("fitted", F.col("slope") * F.col(x) + F.col("intercept"))
