"""Frame windows: sliding feature windows, smoothing, voicing choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonelake.operators.ordering import with_halo

CHUNK = 4096  # frames per window task unit (about 20 s at 5 ms)

# Savitzky-Golay smoothing, 7 points, cubic, each over 42.
# Interior weights, then the weights for the first three points of a file;
# the last three use the same rows mirrored.
SMOOTH_MIDDLE = [-4, 6, 12, 14, 12, 6, -4]
SMOOTH_EDGE = [
    [39, 8, -4, -4, 1, 4, -2],
    [8, 19, 16, 6, -4, -7, 4],
    [-4, 16, 19, 12, 2, -4, 1],
]


def sliding_windows(
    frames: DataFrame, feats: Sequence[str], size: int = 7, label: str | None = None, chunk: int = CHUNK
) -> DataFrame:
    """One window per frame, centred on it, zero-padded at the file's ends."""
    reach = size // 2
    w = Window.partitionBy("file", "_chunk").orderBy("frame_idx")
    row = F.array(*[F.col(c).cast("double") for c in feats])
    zero = F.array(*[F.lit(0.0) for _ in feats])
    cols = ["file", "frame_idx", row.alias("_x")] + ([F.col(label).alias("label")] if label else [])
    halo = with_halo(frames.select(*cols), "frame_idx", chunk, reach)
    steps = [F.lag("_x", reach - i) if i < reach else F.lead("_x", i - reach) for i in range(size)]
    win = F.array(*[F.coalesce(s.over(w), zero) if i != reach else F.col("_x") for i, s in enumerate(steps)])
    out = halo.select("*", win.alias("win")).filter("_own")
    return out.select("file", "frame_idx", "win", *(["label"] if label else []))


def _dot(values: Column, weights: list[int]) -> Column:
    lits = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(values, lits, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / F.lit(42.0)


def smooth_contour(frames: DataFrame, col: str, max_dev: float = 2.0, chunk: int = CHUNK) -> DataFrame:
    """Adds ``smoothed``: the filtered contour, 0 where it departs more than ``max_dev``.

    Files shorter than the filter stay as they are.
    """
    w = Window.partitionBy("file", "_chunk").orderBy("frame_idx")
    near = with_halo(frames, "frame_idx", chunk, 6).select(
        "*",
        F.collect_list(F.coalesce(F.col(col), F.lit(0.0))).over(w.rowsBetween(-6, 6)).alias("_w"),
        F.count(F.lit(1)).over(w.rowsBetween(-6, -1)).cast("int").alias("_back"),
        F.count(F.lit(1)).over(w.rowsBetween(1, 6)).cast("int").alias("_fwd"),
    )
    near = near.filter("_own")
    y = F.coalesce(F.col(col), F.lit(0.0))
    fit = F.when(F.size("_w") < 7, y)
    for i in range(3):
        fit = fit.when(F.col("_back") == i, _dot(F.slice("_w", 1, 7), SMOOTH_EDGE[i]))
    for i in range(3):
        fit = fit.when(F.col("_fwd") == i, _dot(F.slice("_w", -7, 7), SMOOTH_EDGE[i][::-1]))
    fit = fit.otherwise(_dot(F.slice("_w", F.col("_back") - 2, F.lit(7)), SMOOTH_MIDDLE))
    off = F.abs(F.round(y - F.col("_fit"), 9)) > F.lit(max_dev)
    return (
        near.withColumn("_fit", fit)
        .withColumn("smoothed", F.when(off, F.lit(0.0)).otherwise(F.col("_fit")))
        .drop("_own", "_chunk", "_w", "_back", "_fwd", "_fit")
    )


def cumulative_variance(df: DataFrame, ratio="explained_ratio", order="component") -> DataFrame:
    """Running total of explained variance; one row per component, so one small window."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum(ratio).over(w))


def voice_fallback(frames: DataFrame, preds: Sequence[str] = ("pred_all", "pred_f0", "pred_mfcc")) -> DataFrame:
    """Adds ``voice``: per file the first prediction with no missing value, else 0."""
    gaps = frames.groupBy("file").agg(*[F.max(F.col(p).isNull()).alias(f"_gap{i}") for i, p in enumerate(preds)])
    voice = None
    for i, p in enumerate(preds):
        ok = ~F.col(f"_gap{i}")
        voice = F.when(ok, F.col(p)) if voice is None else voice.when(ok, F.col(p))
    return (
        frames.join(gaps, "file")
        .withColumn("voice", voice.otherwise(F.lit(0)))
        .drop(*[f"_gap{i}" for i in range(len(preds))])
    )
