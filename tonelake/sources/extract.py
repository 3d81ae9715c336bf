"""Pluggable per-file extraction: files in, track rows and error rows out."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# An extractor takes a file's bytes and returns times, values and probabilities (or None).
Extractor = Callable[[bytes], tuple]

_REGISTRY: dict[str, Extractor] = {}
_SCHEMA = (
    "file string, algo string, frame_idx long, timeframe double, value double, prob double, "
    "error string, at timestamp"
)


def register(name: str, fn: Extractor) -> None:
    _REGISTRY[name] = fn


def extract_from(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> tuple[DataFrame, DataFrame]:
    """Tracks and errors of (path, content) rows; a failing extractor is an error row.

    Each returned table runs the extractors when used: write the first to
    storage before a second use where they are costly.
    """
    todo = dict(_REGISTRY if extractors is None else extractors)

    def run(batches):
        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                for algo, fn in todo.items():
                    try:
                        time, value, prob = fn(bytes(raw))
                        n = len(value)
                        out = pd.DataFrame(
                            {
                                "file": path, "algo": algo, "frame_idx": range(n), "timeframe": time, "value": value,
                                "prob": [None] * n if prob is None else prob,
                            }
                        )
                        out["prob"] = out["prob"].astype(float)
                        out["error"], out["at"] = None, pd.NaT
                    except Exception as e:  # one bad file must not stop the rest
                        out = pd.DataFrame({"file": [path], "algo": [algo], "frame_idx": [None]})
                        out["timeframe"] = out["value"] = out["prob"] = float("nan")
                        out["error"] = f"{type(e).__name__}: {e}"
                        out["at"] = pd.Timestamp(datetime.now(timezone.utc))
                    out["frame_idx"] = out["frame_idx"].astype("Int64")
                    out["at"] = pd.to_datetime(out["at"], utc=True)
                    yield out

    rows = files.select("path", "content").mapInPandas(run, _SCHEMA)
    tracks = rows.filter("error IS NULL").drop("error", "at")
    return tracks, error_log(rows)


def error_log(rows: DataFrame) -> DataFrame:
    return rows.filter("error IS NOT NULL").select(
        F.col("file").alias("path"), "algo", "at", F.col("error").alias("message")
    )


def extract_tracks(
    spark: SparkSession, path: str, suffix: str, extractors: dict[str, Extractor] | None = None
) -> tuple[DataFrame, DataFrame]:
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{suffix}")
        .load(path)
    )
    return extract_from(files, extractors)
