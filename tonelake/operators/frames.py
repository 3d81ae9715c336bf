"""Row-wise frame operators, column selection, imputation and encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tonelake.operators.ordering import number_rows, with_halo
from tonelake.session import checkpoint

# Named feature families of a frame: scalar columns, and the mfcc array.
PITCH_FAMILY = ("creaky", "hnr", "cpps", "intensity", "se")


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN becomes NULL; run once on ingestion so no NaN travels further."""
    if cols is None:
        cols = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def split_key(df: DataFrame, col: str = "file") -> DataFrame:
    """``corpus__utt__speaker`` into Audio, Enu (int), Spk and an unpadded id."""
    parts = F.split(F.col(col), "__")
    return (
        df.withColumn("Audio", F.get(parts, F.lit(0)))
        .withColumn("Enu", F.get(parts, F.lit(1)).try_cast("int"))
        .withColumn("Spk", F.get(parts, F.lit(2)))
        .withColumn("id", F.concat(F.col("Audio"), F.lit("__"), F.col("Enu").cast("string")))
    )


def filter_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(col).isin(list(values)))


def filter_eq(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Rows equal to any of ``values``, as an OR of equalities."""
    cond = F.lit(False)
    for v in values:
        cond = cond | (F.col(col) == F.lit(v))
    return df.filter(cond)


def filter_outliers(df: DataFrame, tag: str, hi_col: str, hi: float, lo_col: str, lo: float, tag_col="tag"):
    """Rows of one tag whose ``hi_col`` exceeds ``hi`` or ``lo_col`` is under ``lo``."""
    return df.filter((F.col(tag_col) == tag) & ((F.col(hi_col) > hi) | (F.col(lo_col) < lo)))


def file_name_filter(df: DataFrame, col: str, has: str = "_", lacks: str = "_egg") -> DataFrame:
    return df.filter(F.col(col).contains(has) & ~F.col(col).contains(lacks))


def project_features(df: DataFrame, family: str, families: dict, ids: Sequence[str] = ("file", "frame_idx")):
    """Select a named family: plain columns, or (array, first, length, name) slices."""
    cols: list[Column] = [F.col(c) for c in ids]
    for item in families[family]:
        if isinstance(item, str):
            cols.append(F.col(item))
        else:
            array, first, length, name = item
            cols += [F.get(F.col(array), F.lit(first + i)).alias(f"{name}{i + 1:02d}") for i in range(length)]
    return df.select(*cols)


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that have a number in every column.

    One condition per column: a single one over all of them, as ``dropna`` gives, takes the optimizer a time that doubles with
    every column that is derived below it."""
    typed = dict(df.dtypes)
    for c in cols:
        have = F.col(c).isNotNull()
        df = df.where(have & ~F.isnan(c) if typed[c] in ("double", "float") else have)
    return df


def unpivot_features(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot(list(ids), list(cols), "feature", "value")


def pivot_scores(df: DataFrame, row: str, col: str, value: str, col_values: Sequence, order: str | None = None):
    """One row per ``row``, one column per ``col``; duplicates keep the first by ``order``."""
    first = F.min_by(value, F.struct(order, value)) if order else F.max(value)
    unique = df.groupBy(row, col).agg(first.alias(value))
    return unique.groupBy(row).pivot(col, list(col_values)).agg(F.max(value))


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(means[c])) for c in cols})


def standardize(df: DataFrame, cols: Sequence[str], ddof: int = 0) -> DataFrame:
    """z-scores with population (``ddof=0``) or sample SD; constant columns become 0."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[sd(c).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    return df.withColumns(
        {c: (F.col(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}
    )


def label_encode(df: DataFrame, col: str, code: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Codes 0..K-1 of the sorted labels (missing: -1), and the dictionary."""
    code = code or f"{col}_code"
    labels = df.select(col).where(F.col(col).isNotNull()).distinct()
    # Ranges of the column's own order, kept as they fell: the next reading must see the same ones.
    labels = checkpoint(labels.repartitionByRange(F.col(col)).withColumn("_range", F.spark_partition_id()))
    dictionary = number_rows(labels, [], [col], F.col("_range"), "_rn").select(
        col, (F.col("_rn") - 1).cast("int").alias(code)
    )
    coded = df.join(dictionary, col, "left").withColumn(code, F.coalesce(F.col(code), F.lit(-1)))
    return coded, dictionary


def time_grid(df: DataFrame, mode: str, hop=None, sr=None, duration=None, key="file", index="frame_idx"):
    """Frame times: ``hop`` (index*hop/sr), ``even`` (0..duration) or ``mid`` of start/end."""
    if mode == "hop":
        return df.withColumn("timeframe", F.col(index) * F.lit(float(hop)) / F.lit(float(sr)))
    if mode == "mid":
        return df.withColumn("timeframe", (F.col("start_t") + F.col("end_t")) / 2)
    if mode != "even":
        raise ValueError(f"unknown mode {mode!r}")
    total = duration if isinstance(duration, Column) else F.lit(float(duration))
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    step = F.try_divide(total * F.col(index), F.col("_n") - 1)
    return df.join(sizes, key).withColumn("timeframe", F.coalesce(step, F.lit(0.0))).drop("_n")


def decimate(df: DataFrame, step: int = 2, index: str = "frame_idx") -> DataFrame:
    return df.filter(F.pmod(F.col(index), F.lit(step)) == 0).withColumn(
        index, F.floor(F.col(index) / F.lit(step)).cast("long")
    )


def adjacent_frames(
    df: DataFrame, cols: Sequence[str], key="file", index="frame_idx", chunk: int = 4096
) -> DataFrame:
    """Adds ``prev_<col>`` from the frame before in the same file."""
    w = Window.partitionBy(key, "_chunk").orderBy(index)
    out = with_halo(df, index, chunk, 1)
    out = out.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in cols])
    return out.filter("_own").drop("_own", "_chunk")


def pair_midpoint_band(
    df: DataFrame, factor: float = 1.43, default: float = 400.0, pitch="f0", time="t", chunk: int = 4096
) -> DataFrame:
    """Per adjacent pair of frames: middle time, mean pitch and the low band's upper limit."""
    pairs = adjacent_frames(df, [pitch, time], chunk=chunk).filter(F.col(f"prev_{time}").isNotNull())
    mean = (F.col(pitch) + F.col(f"prev_{pitch}")) / 2
    return pairs.select(
        "file",
        "frame_idx",
        ((F.col(time) + F.col(f"prev_{time}")) / 2).alias("mid_t"),
        mean.alias("mean_f0"),
        F.coalesce(mean * F.lit(factor), F.lit(float(default))).alias("low_band"),
    )


def concat_features(a: DataFrame, b: DataFrame, on: str, cols: Sequence[str], array: str, name="features"):
    """Numeric columns of ``a`` followed by the array of ``b``, as one array."""
    numeric = F.array(*[F.col(c).cast("double") for c in cols])
    return a.join(b.select(on, array), on).select(
        on, F.concat(numeric, F.transform(array, lambda x: x.cast("double"))).alias(name)
    )


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def sort_desc(df: DataFrame, col: str, n: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Descending order; with ``n`` a top-n that Spark runs as a bounded heap per task."""
    out = df.orderBy(F.col(col).desc(), *ties)
    return out if n is None else out.limit(n)


def stack_files(dfs: Sequence[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def key_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def key_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` not in ``b``, duplicates kept (multiset difference)."""
    return a.exceptAll(b)
