"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_file(df: DataFrame, path: str, mode: str = "errorifexists", slot_frames: int = 1_000_000) -> None:
    """Parquet clustered by file and frame, so a file's rows are read from few row groups.

    A very long file is spread over tasks by frame slot instead of filling one.
    """
    slot = F.floor(F.col("frame_idx") / F.lit(slot_frames))
    df.repartition("file", slot).sortWithinPartitions("file", "frame_idx").write.mode(mode).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
