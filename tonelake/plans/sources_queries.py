"""Readers, writers, extraction and annotation parsing as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.plans import tables as tb
from tonelake.plans.registry import query
from tonelake.session import scratch_path
from tonelake.sources.extract import extract_from
from tonelake.sources.readers import parse_tier_files, read_frames, read_manifest, read_tracks
from tonelake.sources.writers import write_by_file, write_table

# ---- files: a table is written to the shared folder and read back --------------------

FRAMES = f"with {tb.FRAMES_SQL} "


@query("read_frames", FRAMES + "select file, frame_idx, t, c0, c3 from frames")
def _(spark, sf):
    path = scratch_path(spark, "frames-csv")
    fr = tb.frames(spark, sf, ["file", "frame_idx", "t", "c0", "c3"])
    gaps = fr.withColumn("c3", F.coalesce("c3", F.lit(float("nan"))))
    gaps.write.option("header", True).option("sep", ";").csv(path)
    return read_frames(spark, path, "file string, frame_idx long, t double, c0 double, c3 double", sep=";")


@query("read_tracks", "select 'events' as file, event_id, value from events")
def _(spark, sf):
    return read_tracks(spark, f"{sf}/events.parquet", "event_id long, value double")


@query("read_manifest", f"with {tb.MANIFEST_SQL} select fname, cast(speaker as varchar) as speaker, subset from manifest")
def _(spark, sf):
    path = scratch_path(spark, "manifest")
    write_table(tb.manifest(spark, sf).withColumn("speaker", F.col("speaker").cast("string")), path, "json")
    return read_manifest(spark, path)


@query("write_by_file", FRAMES + "select file, frame_idx, c0, hnr from frames")
def _(spark, sf):
    path = scratch_path(spark, "by-file")
    write_by_file(tb.frames(spark, sf, ["file", "frame_idx", "c0", "hnr"]), path)
    return spark.read.parquet(path)


@query("write_table", f"with {tb.SCORES_SQL} select o_orderkey, params, iter, mean_test_score from scores")
def _(spark, sf):
    path = scratch_path(spark, "scores")
    rows = tb.scores(spark, sf)
    write_table(rows, path, "csv")
    return spark.read.schema(rows.schema).csv(path, header=True)


# ---- extraction: line lengths of a page, as a stand-in for a signal ------------------


def _line_lengths(raw: bytes):
    lines = raw.decode("utf-8").split("\n")
    return [i * 0.005 for i in range(len(lines))], [float(len(x)) for x in lines], None


def _needs_lines(raw: bytes):
    if b"\n" not in raw:
        raise ValueError("one line")
    return [0.0], [float(raw.count(b"<p"))], [1.0]


def _extract(spark, sf):
    pages = tb.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return extract_from(pages, {"lines": _line_lengths, "paragraphs": _needs_lines})


@query(
    "extract_tracks",
    "select cast(page_id as varchar) as file, 'lines' as algo, i as frame_idx, round(i * 5e-3, 6) as timeframe, "
    "cast(length(line) as double) as value, cast(null as double) as prob from (select page_id, unnest(string_split(html, chr(10))) as line, "
    "unnest(generate_series(0, len(string_split(html, chr(10))) - 1)) as i from pages) union all "
    "select cast(page_id as varchar), 'paragraphs', 0, 0, cast((length(html) - length(replace(html, '<p', ''))) // 2 as double), 1 from pages where contains(html, chr(10))",
)
def _(spark, sf):
    return _extract(spark, sf)[0].withColumn("timeframe", F.round("timeframe", 6))


@query(
    "error_log",
    "select cast(page_id as varchar) as path, 'paragraphs' as algo, 'ValueError: one line' as message from pages where not contains(html, chr(10))",
)
def _(spark, sf):
    return _extract(spark, sf)[1].drop("at")


# ---- annotation files: every turn written in the long layout, one file each ----------


def _rendered(spark, sf):
    conv = tb.table(spark, sf, "conversations")

    def interval(text, i):
        return F.concat(
            F.lit("        intervals ["), (i + 1).cast("string"), F.lit("]:\n            xmin = "), i.cast("string"),
            F.lit("\n            xmax = "), (i + 0.5).cast("string"), F.lit('\n            text = "'),
            F.replace(text, F.lit('"'), F.lit('""')), F.lit('"\n'),
        )

    def tier(name, texts):
        head = F.lit(f'    item []:\n        class = "IntervalTier"\n        name = "{name}"\n')
        return F.concat(head, F.array_join(F.transform(texts, interval), ""))

    text = F.concat(tier("Trans", F.array("role")), tier("UTtag", F.split("text", "[.]")))
    path = F.concat(F.lit("/corpus/c"), "conv_id", F.lit("__"), "turn", F.lit(".TextGrid"))
    return conv.select(path.alias("path"), F.encode(text, "UTF-8").alias("content"))


@query(
    "read_tier_files",
    "with f as (select concat('c', conv_id, '__', turn) as file, role, string_split(text, '.') as parts from conversations), "
    "u as (select file, unnest(parts) as text, cast(unnest(generate_series(1, len(parts))) as integer) as idx from f) "
    "select file, 'Trans' as tier, 1 as idx, 0e0 as start_t, 5e-1 as end_t, role as text from f union all "
    "select file, 'UTtag', idx, idx - 1e0, idx - 5e-1, text from u",
)
def _(spark, sf):
    return parse_tier_files(_rendered(spark, sf))
