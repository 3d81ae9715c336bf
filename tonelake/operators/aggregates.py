"""Grouped statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.operators.frames import unpivot_features
from tonelake.operators.ordering import _join_summary
from tonelake.operators.quantiles import exact_quantiles


def describe_by(df: DataFrame, cols: Sequence[str], grouping_sets: Sequence[Sequence[str]]) -> DataFrame:
    """count, mean, sd, min, quartiles and max of each feature per grouping set.

    Columns outside a row's grouping set are NULL; ``set_no`` tells the sets apart.
    """
    every = sorted({k for s in grouping_sets for k in s})
    long = unpivot_features(df, every, cols).filter("value IS NOT NULL")
    sets = F.array(
        *[
            F.struct(
                F.lit(i).alias("set_no"),
                *[(F.col(k) if k in s else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in every],
            )
            for i, s in enumerate(grouping_sets)
        ]
    )
    rows = long.select("feature", "value", F.inline(sets))
    keys = ["set_no", *every, "feature"]
    names = ["p25", "p50", "p75"]
    q = exact_quantiles(rows, keys, "value", [0.25, 0.5, 0.75], names, moments=True)
    return q.withColumnRenamed("n", "count")


def box_stats(df: DataFrame, group: Sequence[str], cols: Sequence[str], whis: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends, notch and outlier count per (group, feature)."""
    long = unpivot_features(df, group, cols).filter("value IS NOT NULL")
    keys = [*group, "feature"]
    q = exact_quantiles(long, keys, "value", [0.25, 0.5, 0.75], ["q1", "med", "q3"])
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumn("_lo", F.col("q1") - F.lit(whis) * iqr).withColumn("_hi", F.col("q3") + F.lit(whis) * iqr)
    inside = F.col("value").between(F.col("_lo"), F.col("_hi"))
    ends = (
        _join_summary(long, q.select(*keys, "_lo", "_hi"), keys)
        .groupBy(*keys)
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("lo"),
            F.max(F.when(inside, F.col("value"))).alias("hi"),
            F.sum(F.when(inside, 0).otherwise(1)).alias("n_out"),
        )
    )
    half = F.lit(1.57) * iqr / F.sqrt(F.col("n").cast("double"))
    out = _join_summary(q.drop("_lo", "_hi"), ends, keys)
    return out.withColumn("notch_lo", F.col("med") - half).withColumn("notch_hi", F.col("med") + half)


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column_name", "n_null")


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def count_distinct(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct values per column; ``approx`` uses a fixed-size sketch per column."""
    f = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[f(c).alias(f"n_{c}") for c in cols])


def unit_intensity(unit_frames: DataFrame, keys: Sequence[str] = ("file", "n_ut")) -> DataFrame:
    return unit_frames.groupBy(*keys).agg(F.avg("intensity").alias("mean_se"))


def contour_features(
    unit_frames: DataFrame, pitch: str, keys: Sequence[str] = ("file", "n_ut"), time="t",
    start="iu_start", end="iu_end",
) -> DataFrame:
    """Pitch and intensity features of each unit.

    Excursion is max - min; alignment is the relative time of an extreme in the
    unit. Missing pitch frames are skipped.
    """
    v, t = F.col(pitch), F.col(time)
    at = F.when(v.isNotNull(), t)

    def relative(col):
        return F.try_divide(col - F.col("_s"), F.col("_e") - F.col("_s"))

    agg = unit_frames.groupBy(*keys).agg(
        F.count(v).alias("n_voiced"),
        F.avg(v).alias("f0_mean"),
        F.stddev_samp(v).alias("f0_sd"),
        F.min(v).alias("f0_min"),
        F.max(v).alias("f0_max"),
        F.min_by(v, at).alias("f0_first"),
        F.max_by(v, at).alias("f0_last"),
        F.max_by(t, F.when(v.isNotNull(), F.struct(v, -t))).alias("_tmax"),
        F.min_by(t, F.when(v.isNotNull(), F.struct(v, t))).alias("_tmin"),
        F.avg("intensity").alias("int_mean"),
        F.stddev_samp("intensity").alias("int_sd"),
        F.min("intensity").alias("int_min"),
        F.max("intensity").alias("int_max"),
        F.min(start).alias("_s"),
        F.max(end).alias("_e"),
    )
    return (
        agg.withColumn("f0_exc", F.col("f0_max") - F.col("f0_min"))
        .withColumn("f0_align_max", relative(F.col("_tmax")))
        .withColumn("f0_align_min", relative(F.col("_tmin")))
        .drop("_tmax", "_tmin", "_s", "_e")
    )


def pitch_floor_ceiling(frames: DataFrame, col: str, lo: float = 40.0, hi: float = 800.0) -> DataFrame:
    """Per file the search range: 0.75 * q25 to 1.5 * q75, or the defaults."""
    q = exact_quantiles(frames, ["file"], col, [0.25, 0.75], ["_q25", "_q75"])
    files = frames.select("file").distinct().join(q, "file", "left")
    floor, ceiling = F.col("_q25") * 0.75, F.col("_q75") * 1.5
    return files.select(
        "file",
        F.when(F.coalesce(floor, F.lit(0.0)) == 0, F.lit(float(lo))).otherwise(floor).alias("f0_floor"),
        F.when(F.coalesce(ceiling, F.lit(0.0)) == 0, F.lit(float(hi))).otherwise(ceiling).alias("f0_ceiling"),
    )


def max_agreement(frames: DataFrame, cands: Sequence[str]) -> DataFrame:
    """Per file the first frame whose candidates, all present, differ least (population SD)."""
    n = F.lit(float(len(cands)))
    values = [F.col(c) for c in cands]
    mean = sum(values[1:], values[0]) / n
    var = sum([(v - mean) * (v - mean) for v in values[1:]], (values[0] - mean) * (values[0] - mean)) / n
    sd = F.round(F.sqrt(var), 9)
    full = frames.withColumn("_sd", sd).filter(F.col("_sd").isNotNull())
    best = full.groupBy("file").agg(F.min(F.struct("_sd", "frame_idx")).alias("_m"))
    return best.select("file", F.col("_m._sd").alias("sd_min"), F.col("_m.frame_idx").alias("frame_idx"))


def audit_extraction(tracks: DataFrame, files: DataFrame, algos: Sequence[str], min_len: int = 5) -> DataFrame:
    """Per (file, algo): frames found and whether extraction counts as done."""
    found = tracks.groupBy("file", "algo").agg(F.count(F.lit(1)).alias("n_frames"))
    wanted = files.select("file", F.explode(F.array(*[F.lit(a) for a in algos])).alias("algo"))
    n = F.coalesce(F.col("n_frames"), F.lit(0))
    return wanted.join(found, ["file", "algo"], "left").select(
        "file", "algo", n.alias("n_frames"), (n > min_len).alias("processed")
    )


def fold_summary(history: DataFrame) -> DataFrame:
    """Per epoch (0-based): mean and SD over folds, and whether it is the best (1-based ``best_epoch``)."""
    per = history.groupBy("epoch").agg(
        F.avg("accuracy").alias("mean_acc"), F.stddev_samp("accuracy").alias("sd_acc")
    )
    best = per.agg(F.min_by("epoch", F.struct((-F.round("mean_acc", 9)).alias("a"), F.col("epoch"))).alias("b"))
    return per.withColumn("best_epoch", best.scalar() + 1)


def robust_scale_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Median and interquartile range per feature, the terms of a robust scaling."""
    long = unpivot_features(df, [], cols)
    q = exact_quantiles(long, ["feature"], "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    return q.select("feature", "n", "median", (F.col("q3") - F.col("q1")).alias("iqr"))
