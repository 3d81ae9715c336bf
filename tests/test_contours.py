"""Goldens and brute-force checks of windows, paths and lines."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonelake.functions import cents_similarity, is_in_interval, zero_pad_id
from tonelake.operators import lines
from tonelake.operators import viterbi as vt
from tonelake.operators.frames import adjacent_frames
from tonelake.operators.windows import sliding_windows, smooth_contour


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_similarity_golden(spark):
    f = F.lit
    assert round(one(spark, cents_similarity(f(75.0), f(800.0))), 7) == 0.0073163
    none = f(None).cast("double")
    assert one(spark, cents_similarity(none, none)) == 1.0
    assert one(spark, cents_similarity(none, f(1.0), 0.35)) == 0.35
    assert one(spark, cents_similarity(f(0.0), f(5.0))) == 0.0
    assert one(spark, cents_similarity(f(0.0), f(0.0))) == 1.0


def test_interval_ends_and_padding(spark):
    f = F.lit
    assert [one(spark, is_in_interval(f(x), f(1.0), f(2.5))) for x in (1.5, 1.0, 2.5, 2.6)] == [True, True, True, False]
    assert [one(spark, zero_pad_id(f("a"), f(n))) for n in (7, 1234)] == ["a__007", "a__1234"]


def savgol(y):
    """Cubic least squares over 7 points; the ends use the fit of the first and last 7."""
    out = np.empty(len(y))
    x = np.arange(7)
    for i in range(len(y)):
        lo = min(max(i - 3, 0), len(y) - 7)
        out[i] = np.polyval(np.polyfit(x, y[lo : lo + 7], 3), i - lo)
    return np.where(np.abs(y - out) > 2.0, 0.0, out)


@pytest.mark.parametrize("n", [3, 7, 10, 12, 13, 29])
@pytest.mark.parametrize("chunk", [6, 7, 4096])
def test_smooth_contour(spark, n, chunk):
    y = np.tile([221.0, 219.5, 224.0, 131.0, 226.5, 225.0, 229.0, 310.0, 228.0, 226.0], 3)[:n]
    if n > 10:
        y = 200 + np.cumsum(np.sin(np.arange(n)))
    df = spark.createDataFrame(pd.DataFrame({"file": "f", "frame_idx": np.arange(n), "y": y}))
    got = smooth_contour(df, "y", chunk=chunk).orderBy("frame_idx").toPandas()["smoothed"]
    assert np.allclose(got, y if n < 7 else savgol(y))


@pytest.mark.parametrize("chunk", [3, 5, 4096])
def test_windows_do_not_depend_on_chunks(spark, chunk):
    n = 17
    pdf = pd.DataFrame({"file": "f", "frame_idx": np.arange(n), "v": np.arange(1.0, n + 1)})
    df = spark.createDataFrame(pdf)
    got = sliding_windows(df, ["v"], 7, chunk=chunk).orderBy("frame_idx").collect()
    padded = np.concatenate([np.zeros(3), pdf["v"], np.zeros(3)])
    assert [[x[0] for x in r["win"]] for r in got] == [list(padded[i : i + 7]) for i in range(n)]
    prev = adjacent_frames(df, ["v"], chunk=chunk).orderBy("frame_idx").toPandas()["prev_v"]
    assert np.isnan(prev[0]) and prev[1:].tolist() == pdf["v"][:-1].tolist()


# ---- paths ---------------------------------------------------------------------------


def sim(a, b, vup):
    if a is None and b is None:
        return 1.0
    if a is None or b is None:
        return vup
    if a == 0 or b == 0:
        return 1.0 if a == b else 0.0
    return math.exp(-0.0012 * 1200 * abs(math.log2(a / b)))


def frames_of(spark, files):
    rows = [
        (f, i, [None if c is None else float(c) for c in cand], [float(e) for e in emis])
        for f, (cands, emiss) in files.items()
        for i, (cand, emis) in enumerate(zip(cands, emiss))
    ]
    return spark.createDataFrame(rows, "file string, frame_idx long, cand array<double>, emis array<double>")


def random_file(rng, n_frames, n_cand=3, zeros=False):
    cands = [[None if rng.random() < 0.2 else float(rng.integers(80, 400)) for _ in range(n_cand)] for _ in range(n_frames)]
    if zeros:
        cands = [[0.0 if c is not None and rng.random() < 0.2 else c for c in row] for row in cands]
    return cands, rng.uniform(0.05, 2.5, (n_frames, n_cand)).tolist()


def path_score(cands, emis, states, vup=0.35):
    p = emis[0][states[0]]
    for m in range(1, len(states)):
        p *= sim(cands[m - 1][states[m - 1]], cands[m][states[m]], vup) * emis[m][states[m]]
    return p


@pytest.mark.parametrize("n_cand", [1, 2, 3])
def test_path_is_the_best_of_all(spark, n_cand):
    rng = np.random.default_rng(5)
    files = {f"f{i}": random_file(rng, int(rng.integers(1, 7)), n_cand) for i in range(6)}
    out = vt.viterbi_path(frames_of(spark, files), 1.0).toPandas()
    for f, (cands, emis) in files.items():
        rows = out[out.file == f].sort_values("frame_idx")
        best = max(path_score(cands, emis, s) for s in itertools.product(range(n_cand), repeat=len(cands)))
        got = path_score(cands, emis, rows["state"].tolist())
        assert math.isclose(got, best, rel_tol=1e-9)
        assert math.isclose(math.log(best), rows["log_prob"].iloc[0], rel_tol=1e-9, abs_tol=1e-9)


def feeding(p, own, r):
    """The state that feeds ``own``: the strongest, of equals the last; once ``own`` leads those before it, those behind have to
    reach its score with the bonus. Also the score it passes on."""
    strongest = lambda ks: max(ks, key=lambda k: (p[k], k), default=None)
    before, behind = strongest(range(own)), strongest(range(own + 1, len(p)))
    lead, bar = (own, r * p[own]) if before is None or p[own] >= p[before] else (before, p[before])
    return (behind, p[behind]) if behind is not None and p[behind] >= bar else (lead, bar)


def scan(cands, emis, r, vup=0.35):
    """The path of best scores from tables: row m holds each state's score and the state before it."""
    table = [[(e, None) for e in emis[0]]]
    for here, there, weight in zip(cands, cands[1:], emis[1:]):
        fed = [feeding([v * sim(a, b, vup) for (v, _), a in zip(table[-1], here)], own, r) for own, b in enumerate(there)]
        scores = [bar * w for (_, bar), w in zip(fed, weight)]
        scale = max(scores) or 1.0
        table.append([(x / scale, k) for x, (k, _) in zip(scores, fed)])
    best = [v for v, _ in table[-1]]
    path = [best.index(max(best))]
    for row in table[:0:-1]:
        path.append(row[path[-1]][1])
    return path[::-1]


@pytest.mark.parametrize("r", [1.0, 1.1, 1.2])
def test_chunks_give_the_same_path(spark, r):
    rng = np.random.default_rng(6)
    files = {f"f{i}": random_file(rng, n) for i, n in enumerate([1, 4, 5, 8, 9, 23])}
    files["zeros"] = random_file(rng, 14, zeros=True)
    files["gone"] = ([[None] * 3 for _ in range(9)], [[1.0, 1.0, 1.0]] * 9)
    files["same"] = ([[100.0] * 3 for _ in range(9)], [[1.0, 1.0, 1.0]] * 9)
    df = frames_of(spark, files)
    want = {f: scan(c, e, r) for f, (c, e) in files.items()}
    for chunk in (4, 1000):
        out = vt.viterbi_path(df, r, chunk=chunk).toPandas().sort_values("frame_idx")
        assert {f: g["state"].tolist() for f, g in out.groupby("file")} == want
    whole = vt.viterbi_path(df, r).toPandas().sort_values(["file", "frame_idx"])
    cut = vt.viterbi_path(df, r, chunk=4).toPandas().sort_values(["file", "frame_idx"])
    assert np.allclose(whole["log_prob"], cut["log_prob"], equal_nan=True)


def test_rounds_do_not_grow_with_the_chunks(spark, monkeypatch):
    """With a reinforcement chunks run at once and again only until their exits stay: far fewer rounds than chunks."""
    rng = np.random.default_rng(9)
    cands, emis = random_file(rng, 1000)
    calls = []
    keep = vt.checkpoint
    monkeypatch.setattr(vt, "checkpoint", lambda df: calls.append(1) or keep(df))
    out = vt.viterbi_path(frames_of(spark, {"f": (cands, emis)}), 1.15, chunk=80, run_frames=1).orderBy("frame_idx").toPandas()
    assert out["state"].tolist() == scan(cands, emis, 1.15)
    assert len(calls) < 30  # two per round; 1,000 chunks of one frame each


def test_ties_go_to_the_later_predecessor(spark):
    out = vt.viterbi_path(frames_of(spark, {"f": ([[100.0] * 3] * 3, [[1.0] * 3] * 3)}), 1.0)
    assert [r["state"] for r in out.orderBy("frame_idx").collect()] == [2, 2, 0]


def test_emission_majority_and_bonus(spark):
    rows = [("f", 0, 100.0, None, None, 1.0, 0), ("f", 1, 100.0, 200.0, None, -1.0, 1)]
    df = spark.createDataFrame(rows, "file string, frame_idx int, a double, b double, c double, hnr double, creaky int")
    e = [r["emis"] for r in vt.emission(df, ["a", "b", "c"]).orderBy("frame_idx").collect()]
    assert e[0] == [0.5, 1.0, 1.0]  # two of three missing: the median is missing
    assert np.allclose(e[1], [6.25 * sim(150, 100, 0.5), sim(150, 200, 0.5), 6.25 * 0.5])


# ---- lines ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(7)
    parts = []
    for u, n in {"tiny": 1, "pair": 2, "small": 9, "long": 300, "flat": 12}.items():
        t = np.arange(n) * 0.005
        y = 200 + 30 * t + rng.normal(0, 1, n)
        y[rng.random(n) < 0.2] += 150
        parts.append(pd.DataFrame({"u": u, "t": t if u != "flat" else 0.0, "y": y, "z": (rng.random(n) < 0.1).astype(int) if n > 5 else 0, "w": rng.integers(40, 70, n).astype(float)}))
    pdf = pd.concat(parts)
    pdf.loc[pdf.sample(frac=0.1, random_state=1).index[:5], "y"] = None
    return spark.createDataFrame(pdf)


def fits(df):
    return {r["u"]: (r["slope"], r["intercept"]) for r in df.collect()}


def test_long_units_fit_the_same_by_joins(units):
    a = fits(lines.fit_line_ransac_weighted(units, ["u"], "t", "y", "z", "w"))
    b = fits(lines.fit_line_ransac_weighted(units, ["u"], "t", "y", "z", "w", limit=0))
    assert a.keys() == b.keys()
    for u in a:
        for x, y in zip(a[u], b[u]):
            assert (x is None or math.isnan(x)) == (y is None or math.isnan(y))
            if x is not None and not math.isnan(x):
                assert math.isclose(x, y, rel_tol=1e-9)


def test_robust_line_ignores_outliers(spark):
    t = np.arange(40) * 0.005
    y = 100 + 50 * t
    y[::5] += 400
    df = spark.createDataFrame(pd.DataFrame({"u": 1, "t": t, "y": y, "z": 0, "w": 1.0}))
    r = lines.fit_line_ransac(df, ["u"], "t", "y", "z").first()
    assert math.isclose(r["slope"], 50, rel_tol=1e-6) and math.isclose(r["intercept"], 100, rel_tol=1e-6)
    plain = lines.fit_line(df, ["u"], "t", "y", "z").first()
    assert math.isclose(plain["slope"], np.polyfit(t, y, 1)[0], rel_tol=1e-9)


def test_weighted_line_uses_inverse_weight(spark):
    t, y, w = np.arange(5.0) + 1e9, np.array([1.0, 2, 4, 3, 9]), np.array([1.0, 2, 4, 5, 10])
    df = spark.createDataFrame(pd.DataFrame({"u": 1, "t": t, "y": y, "z": 0, "w": w}))
    got = lines.fit_line_weighted(df, ["u"], "t", "y", "z", "w").first()["slope"]
    assert math.isclose(got, np.polyfit(t - 1e9, y, 1, w=np.sqrt(1 / w))[0], rel_tol=1e-9)
