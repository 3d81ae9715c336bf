"""Readers: every schema is stated, NaN becomes NULL on the way in."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonelake.operators.frames import nan_to_null

MANIFEST_SCHEMA = "fname string, speaker string, subset string"
TRACK_SCHEMA = "algo string, frame_idx long, timeframe double, value double, prob double"
TIER_SCHEMA = "file string, tier string, idx int, start_t double, end_t double, text string"


def read_frames(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",") -> DataFrame:
    df = spark.read.schema(schema).csv(path, header=True, sep=sep, nanValue="NaN")
    return nan_to_null(df)


def read_tracks(spark: SparkSession, path: str, schema: str = TRACK_SCHEMA) -> DataFrame:
    """Per-file datasets under one folder as one table; the file's name is its key."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.parquet$", 1)
    return nan_to_null(df.select(F.url_decode(name).alias("file"), "*"))


def read_manifest(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=multi_line)


# ---- annotation files ----------------------------------------------------------------

_NAME = r'name = "(?P<name>(?:[^"]|"")*)"'
_INTERVAL = r'intervals \[\d+\]:?\s+xmin = (?P<lo>\S+)\s+xmax = (?P<hi>\S+)\s+text = "(?P<text>(?:[^"]|"")*)"'
_TIER_PART = re.compile(f"{_NAME}|{_INTERVAL}")


def decode_text(raw: bytes) -> str:
    """Text by byte-order mark, else UTF-8 if valid, else Latin-1."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _intervals(text: str):
    """(tier, idx, start, end, text) of a long-layout interval file."""
    tier, idx = None, 0
    for m in _TIER_PART.finditer(text):
        if m["name"] is not None:
            tier, idx = m["name"].replace('""', '"'), 0
        else:
            idx += 1
            yield tier, idx, float(m["lo"]), float(m["hi"]), m["text"].replace('""', '"')


def parse_tier_files(files: DataFrame, suffix: str = ".TextGrid", tiers: Sequence[str] | None = None) -> DataFrame:
    """Interval rows of annotation files given as (path, content)."""

    def parse(batches):
        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                name = path.rsplit("/", 1)[-1].removesuffix(suffix)
                rows = [(name, *r) for r in _intervals(decode_text(bytes(raw)))]
                yield pd.DataFrame(rows, columns=["file", "tier", "idx", "start_t", "end_t", "text"])

    out = files.select("path", "content").mapInPandas(parse, TIER_SCHEMA)
    return out if tiers is None else out.filter(F.col("tier").isin(list(tiers)))


def read_tier_files(
    spark: SparkSession, path: str, suffix: str = ".TextGrid", tiers: Sequence[str] | None = None
) -> DataFrame:
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{suffix}")
        .load(path)
    )
    return parse_tier_files(files, suffix, tiers)
