"""Readers, writers and extraction on small files."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tonelake.operators.tiers import boundary_class, interval_nest, mark_stress, number_units, syllable_measures
from tonelake.sources.extract import extract_tracks
from tonelake.sources.readers import read_frames, read_manifest, read_tier_files, read_tracks
from tonelake.sources.writers import write_by_file, write_table


def test_frames_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("file;t;f0\nx;0.005;NaN\nx;0.010;120.5\ny;0.005;\n")
    rows = read_frames(spark, str(tmp_path), "file string, t double, f0 double", sep=";").orderBy("file", "t").collect()
    assert [r["f0"] for r in rows] == [None, 120.5, None]


def test_manifest(spark, tmp_path):
    rows = [{"fname": "a", "speaker": "s1", "subset": "Train"}, {"fname": "b", "speaker": "s2", "subset": "Test"}]
    (tmp_path / "m.json").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "m2.json").write_text(json.dumps(rows, indent=1))
    for name, multi in (("m.json", False), ("m2.json", True)):
        got = read_manifest(spark, str(tmp_path / name), multi).orderBy("fname").collect()
        assert [r.asDict() for r in got] == rows


def grid(tiers):
    out = ['File type = "ooTextFile"', 'Object class = "TextGrid"', "", "xmin = 0", "xmax = 9", "tiers? <exists>", f"size = {len(tiers)}", "item []:"]
    for i, (name, items) in enumerate(tiers.items(), 1):
        out += [f"    item [{i}]:", '        class = "IntervalTier"', f'        name = "{name}"', "        xmin = 0", "        xmax = 9", f"        intervals: size = {len(items)}"]
        for j, (lo, hi, text) in enumerate(items, 1):
            text = text.replace('"', '""')
            out += [f"        intervals [{j}]:", f"            xmin = {lo}", f"            xmax = {hi}", f'            text = "{text}"']
    return "\n".join(out) + "\n"


TIERS = {
    "Trans": [(0, 4, "é bom"), (4, 5, "")],
    "UTtag": [(0, 2, "COM"), (2, 2.5, "pp"), (2.5, 4, "ALL"), (4, 5, "XXX")],
    "Sil": [(0, 1, 'a"b'), (1, 2, "c"), (2.5, 3, "d"), (3, 4, "e"), (4, 5, "f")],
    "duv": [(0.1, 0.4, "V"), (0.995, 1.9, "W"), (3.1, 3.2, "")],
    "Zsil": [(0, 0.5, "0.1"), (0.5, 1, "0.2"), (1.2, 1.4, "n/a")],
}


@pytest.fixture()
def corpus(tmp_path):
    sub = tmp_path / "deep" / "er"
    sub.mkdir(parents=True)
    text = grid(TIERS)
    (sub / "u8.TextGrid").write_bytes(text.encode("utf-8"))
    (tmp_path / "u16.TextGrid").write_bytes(text.encode("utf-16"))
    (tmp_path / "l1.TextGrid").write_bytes(text.encode("latin-1"))
    (tmp_path / "note.txt").write_text("no")
    return str(tmp_path)


def test_tier_files_in_three_encodings(spark, corpus):
    rows = read_tier_files(spark, corpus).orderBy("file", "tier", "idx").collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r["file"], []).append((r["tier"], r["idx"], r["start_t"], r["end_t"], r["text"]))
    assert set(by_file) == {"u8", "u16", "l1"}
    want = sorted((t, i, float(a), float(b), x) for t, items in TIERS.items() for i, (a, b, x) in enumerate(items, 1))
    assert all(v == want for v in by_file.values())
    assert {r["tier"] for r in read_tier_files(spark, corpus, tiers=["duv"]).collect()} == {"duv"}


def test_tier_goldens(spark, corpus):
    iv = read_tier_files(spark, corpus).filter("file = 'u8'")
    assert [(r["iu_text"], r["n_ut"]) for r in number_units(iv).orderBy("n_ut").collect()] == [("COM", 1), ("ALL", 2)]
    assert number_units(iv, inside_utterance=False).count() == 3
    nest = interval_nest(iv)
    rows = boundary_class(nest).orderBy("syl_start").collect()
    assert [(r["syl_text"], r["start_boundary"], r["end_boundary"]) for r in rows] == [
        ('a"b', "begin_utt", "none"), ("c", "none", "ntb"), ("d", "begin_iu", "none"), ("e", "none", "tb"),
    ]
    stress = {r["syl_text"]: (r["stressed"], r["vowel"]) for r in mark_stress(nest, iv).collect()}
    # The unit's last label counts; it starts 5 ms before its syllable, within the margin.
    assert stress == {'a"b': (False, None), "c": (True, "W"), "d": (False, None), "e": (False, None)}
    z = {r["syl_text"]: r["Zsil"] for r in syllable_measures(nest, iv).collect()}
    assert z == {'a"b': 0.2, "c": None, "d": None, "e": None}


def test_write_by_file(spark, tmp_path):
    df = spark.range(100).select(F.concat(F.lit("f"), F.col("id") % 3).alias("file"), F.col("id").alias("frame_idx"))
    path = str(tmp_path / "out")
    write_by_file(df, path, slot_frames=10)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(map(tuple, df.collect()))
    for fmt in ("csv", "json", "parquet"):
        p = str(tmp_path / fmt)
        write_table(df, p, fmt)
        back = spark.read.schema(df.schema).format(fmt).options(header=True).load(p)
        assert sorted(map(tuple, back.select("file", "frame_idx").collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        write_table(df, str(tmp_path / "x"), "xlsx")


def test_tracks_take_the_file_name(spark, tmp_path):
    for name in ("a 1", "b"):
        part = spark.createDataFrame([("yin", 0, 0.0, math.nan, 1.0)], "algo string, frame_idx long, timeframe double, value double, prob double")
        part.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    rows = read_tracks(spark, str(tmp_path)).orderBy("file").collect()
    assert [(r["file"], r["value"]) for r in rows] == [("a 1", None), ("b", None)]


def test_extraction_logs_errors(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"\x01\x02\x03")
    (tmp_path / "b.wav").write_bytes(b"\x00")

    def loud(raw):
        if raw == b"\x00":
            raise ValueError("empty")
        return [i * 0.005 for i in range(len(raw))], list(raw), None

    tracks, errors = extract_tracks(spark, str(tmp_path), ".wav", {"loud": loud, "size": lambda raw: ([0.0], [len(raw)], [1.0])})
    assert sorted((r["algo"], r["frame_idx"], r["value"]) for r in tracks.collect()) == [
        ("loud", 0, 1.0), ("loud", 1, 2.0), ("loud", 2, 3.0), ("size", 0, 1.0), ("size", 0, 3.0),
    ]
    e = errors.collect()
    assert len(e) == 1 and e[0]["message"] == "ValueError: empty" and e[0]["at"] is not None
