"""Bucketed order operators against plain pandas, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonelake.operators.joins import nearest_unit, tag_frames
from tonelake.operators import ordering
from tonelake.operators.ordering import number_rows, running_sum, with_slots
from tonelake.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    key = np.where(rng.random(3000) < 0.7, "hot", rng.choice(["a", "b", "c"], 3000))
    return pd.DataFrame({"k": key, "t": rng.permutation(3000) / 10, "v": rng.integers(0, 9, 3000)})


def test_number_rows(spark, rows):
    got = number_rows(spark.createDataFrame(rows), ["k"], ["t"], F.floor(F.col("t") / 7)).toPandas()
    want = rows.assign(rn=rows.groupby("k")["t"].rank().astype(int))
    assert got.sort_values("t")["rn"].tolist() == want.sort_values("t")["rn"].tolist()


@pytest.mark.parametrize("cuts_max", [4, 1000])
def test_slots_split_a_hot_group(spark, monkeypatch, cuts_max):
    monkeypatch.setattr(ordering, "CUTS_MAX", cuts_max)
    rng = np.random.default_rng(9)
    # Nearly all rows of the hot key lie in a short stretch of time.
    t = np.where(rng.random(4000) < 0.9, rng.random(4000), rng.random(4000) * 1e6)
    pdf = pd.DataFrame({"k": np.where(rng.random(4000) < 0.8, "hot", "cold"), "t": t})
    df = spark.createDataFrame(pdf)
    assert with_slots(df, ["k"], "t").select("_slot").distinct().count() == 1
    cut = with_slots(df, ["k"], "t", rows=200)
    assert cut.groupBy("k", "_slot").count().agg(F.max("count")).first()[0] < (1600 if cuts_max == 4 else 400)
    got = number_rows(cut, ["k"], ["t"], F.col("_slot")).toPandas().sort_values("t")["rn"]
    assert got.tolist() == pdf.assign(rn=pdf.groupby("k")["t"].rank().astype(int)).sort_values("t")["rn"].tolist()


def test_number_rows_null_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "k string, t int")
    got = {(r.k, r.t): r.rn for r in number_rows(df, ["k"], ["t"], F.col("t")).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("x", 3): 1}


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum(spark, rows, inclusive):
    df = running_sum(spark.createDataFrame(rows), ["k"], ["t"], ["v"], F.floor(F.col("t") / 7), inclusive)
    got = df.toPandas().sort_values("t")["cum_v"].tolist()
    s = rows.sort_values("t")
    want = s.groupby("k")["v"].cumsum() - (0 if inclusive else s["v"])
    assert got == want.tolist()


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(2)
    # A hot group with many equal values, a heavy tail and a single row.
    pdf = pd.concat(
        [
            pd.DataFrame({"k": "hot", "v": np.round(rng.exponential(10, 20000), 1)}),
            pd.DataFrame({"k": "tail", "v": rng.standard_cauchy(3000)}),
            pd.DataFrame({"k": "same", "v": np.full(500, 3.5)}),
            pd.DataFrame({"k": "one", "v": [7.0]}),
        ]
    )
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", probs, list("abcde"), accuracy).toPandas()
    for r in got.itertuples():
        want = np.quantile(pdf[pdf["k"] == r.k]["v"], probs)
        assert np.allclose([r.a, r.b, r.c, r.d, r.e], want, rtol=1e-12)
    assert len(got) == 4


def test_exact_quantiles_without_keys(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    for acc in (20, 10_000):
        r = exact_quantiles(df, [], "v", [0.5, 0.333], ["m", "q"], acc).first()
        assert (r["m"], round(r["q"], 9)) == (500.0, 333.0)


@pytest.mark.parametrize("moments", [False, True])
def test_quantiles_selected_in_rounds(spark, moments):
    """Groups too large to sort: hot, tied, of both signs, over many powers, with ends at infinity."""
    rng = np.random.default_rng(5)
    powers = 2.0 ** rng.integers(-1000, 1000, 3000)
    groups = {
        "normal": rng.standard_normal(5000),
        "ties": np.round(rng.exponential(3, 5000)),
        "powers": powers * np.where(rng.random(3000) < 0.5, -1, 1),
        "small": powers[:1000] * 1e-8,
        "down": -np.abs(rng.standard_cauchy(3000)),
        "same": np.full(2000, -2.5),
        "few": rng.standard_normal(30),
        None: np.concatenate([rng.standard_normal(3000), [np.inf, -np.inf]]),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v]
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    df = spark.createDataFrame(rows, "k string, v double")
    got = exact_quantiles(df, ["k"], "v", probs, list("abcde"), 20, moments=moments, row_bound=10)
    got = {r["k"]: r for r in got.collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        r = got[k]
        want = np.sort(v)
        for p, name in zip(probs, "abcde"):
            at = (len(v) - 1) * p
            lo, hi = want[int(np.floor(at))], want[int(np.ceil(at))]
            assert r[name] == lo or abs(r[name] - (lo + (hi - lo) * (at - np.floor(at)))) <= 1e-12 * abs(hi)
        assert r["n"] == len(v)
        if moments and k in ("normal", "ties", "few"):
            assert abs(r["mean"] - v.mean()) < 1e-9 and abs(r["std"] - v.std(ddof=1)) < 1e-9 and r["max"] == v.max()
    alone = exact_quantiles(df.where("k = 'normal'").select("v"), [], "v", [0.25], ["q"], 20, moments=moments, row_bound=10).first()
    assert abs(alone["q"] - np.quantile(groups["normal"], 0.25)) < 1e-12


def test_nearest_unit_matches_pairs(spark):
    rng = np.random.default_rng(3)
    n = 300
    start = np.sort(rng.integers(0, 5000, n)).astype(float)
    pdf = pd.DataFrame(
        {
            "file": rng.choice(["f", "g"], n), "n_ut": np.arange(n), "start_t": start,
            "end_t": start + rng.integers(1, 30, n) * 2.0, "iu": rng.choice(["COM", "COB", "CMM", "ALL", "INP"], n),
        }
    )
    target = F.col("iu").isin("ALL", "INP")
    got = nearest_unit(spark.createDataFrame(pdf), target, width=50.0).toPandas().set_index("n_ut")
    pdf["c"] = (pdf.start_t + pdf.end_t) / 2
    for r in pdf[pdf.iu.isin(["ALL", "INP"])].itertuples():
        c = pdf[(pdf.file == r.file) & pdf.iu.isin(["COM", "COB", "CMM"])]
        best = c.assign(d=(c.c - r.c).abs()).sort_values(["d", "start_t"]).iloc[0]
        row = got.loc[r.n_ut]
        assert row["distance"] == best.d
        assert pdf.loc[row["near_n_ut"], "start_t"] == best.start_t


def test_tag_frames_matches_loop(spark):
    rng = np.random.default_rng(4)
    frames = pd.DataFrame({"file": "f", "frame_idx": np.arange(400), "t": np.arange(400) * 0.5})
    s = rng.integers(0, 180, 40).astype(float)
    units = pd.DataFrame({"file": "f", "start_t": s, "end_t": s + rng.integers(0, 40, 40), "o": np.arange(40)})
    got = tag_frames(spark.createDataFrame(frames), spark.createDataFrame(units), "o", ["o"], width=7.0).toPandas()
    want = []
    for t in frames["t"]:
        hit = units[(units.start_t <= t) & (t <= units.end_t)]
        want.append(None if hit.empty else hit["o"].max())
    got = got.sort_values("frame_idx")["o"].tolist()
    assert [None if pd.isna(x) else x for x in got] == want
