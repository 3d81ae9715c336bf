"""Interval joins with intervals of any length against pairs."""

import numpy as np
import pandas as pd
import pytest

from tonelake.operators import joins


def intervals(rng, n, long):
    start = rng.integers(0, 3000, n) / 4
    size = rng.integers(0, 40, n) / 4
    if long:
        size[: n // 5] = rng.integers(100, 3000, n // 5) / 4
        start[0], size[0] = 0.0, 800.0
    size[-1] = -1.0  # ends before it starts
    return pd.DataFrame({"file": rng.choice(["f", "g"], n), "s": start, "e": start + size, "k": np.arange(n)})


@pytest.mark.parametrize("long", [False, True])
def test_contained_in_is_every_pair(spark, long):
    rng = np.random.default_rng(1)
    p = intervals(rng, 80, long)
    c = intervals(rng, 200, False).rename(columns={"s": "cs", "e": "ce", "k": "ck"})
    got = joins.contained_in(spark.createDataFrame(c), spark.createDataFrame(p), "cs", "ce", "s", "e", width=2.0)
    pairs = c.merge(p, on="file")
    want = pairs[(pairs.cs >= pairs.s) & (pairs.ce <= pairs.e) & (pairs.e >= pairs.s) & (pairs.cs <= pairs.e)]
    have = sorted((r.ck, r.k) for r in got.select("ck", "k").collect())
    assert have == sorted(zip(want.ck, want.k)) and have


def test_rows_and_questions_do_not_grow_with_an_interval(spark):
    df = spark.createDataFrame([("f", 0.0, 1e6), ("f", 3.0, 3.5), ("f", 10.0, 200.0), ("f", 5.0, 4.0)], "file string, s double, e double")
    rows = df.select("s", joins._bins("s", "e", 1.0)).collect()
    count = {s: sum(r.s == s for r in rows) for s in (0.0, 3.0, 10.0, 5.0)}
    assert count[0.0] <= 2 and count[3.0] == 1 and count[10.0] <= 2 and count[5.0] == 0
    levels = joins.interval_levels(df, "s", "e", 1.0)
    assert len(levels) == 3 and levels[0] == 0
    asked = joins._asked(spark.createDataFrame([(7.5,)], "t double"), "t", 1.0, levels)
    assert asked.count() == 3
    assert joins.interval_levels(df.limit(0), "s", "e", 1.0) == [0]


@pytest.mark.parametrize("long", [False, True])
def test_units_and_tags_of_frames(spark, long):
    rng = np.random.default_rng(2)
    u = intervals(rng, 30, long)
    fr = pd.DataFrame({"file": "f", "frame_idx": np.arange(1500), "t": np.arange(1500) * 0.5, "v": 1.0})
    bounds = u.rename(columns={"s": "iu_start", "e": "iu_end", "k": "n_ut"}).assign(bound_order=1)
    got = joins.unit_frames(spark.createDataFrame(u[["file", "k"]].rename(columns={"k": "n_ut"})), spark.createDataFrame(bounds), spark.createDataFrame(fr), width=2.0)
    have = sorted((r.n_ut, r.frame_idx) for r in got.select("n_ut", "frame_idx").collect() if r.frame_idx is not None)
    pairs = u.merge(fr, on="file")
    pairs = pairs[(pairs.t >= pairs.s) & (pairs.t <= pairs.e)]
    assert have == sorted(zip(pairs.k, pairs.frame_idx))
    assert {r.n_ut for r in got.where("frame_idx is null").select("n_ut").collect()} == set(u.k) - set(pairs.k)
    units = u.rename(columns={"s": "start_t", "e": "end_t"})
    tagged = joins.tag_frames(spark.createDataFrame(fr), spark.createDataFrame(units), "k", ["k"], width=2.0).toPandas()
    want = pairs.groupby("frame_idx")["k"].max()
    assert len(tagged) == len(fr)
    for r in tagged.itertuples():
        assert (pd.isna(r.k) and r.frame_idx not in want.index) or r.k == want[r.frame_idx]
