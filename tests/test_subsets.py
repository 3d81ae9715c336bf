"""Branch and bound over feature subsets against the list of all of them."""

from itertools import combinations
from math import comb

import numpy as np
import pytest

from tonelake.operators import selection, subsets


def moments(n, d, seed, tied=False):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) @ (np.eye(d) + 0.4 * rng.standard_normal((d, d)))
    if tied:
        x[:, d - 1] = x[:, 0]
    y = x[:, : d // 2] @ rng.standard_normal(d // 2) * 0.3 + rng.standard_normal(n)
    x, y = x - x.mean(axis=0), y - y.mean()
    x /= np.sqrt((x**2).sum(axis=0))
    return x.T @ x, x.T @ y, float(y @ y)


def every_subset(xx, xy, yy):
    out = {}
    for size in range(1, len(xy) + 1):
        rows = []
        for c in combinations(range(len(xy)), size):
            c = list(c)
            rows.append((yy - float(np.linalg.lstsq(xx[np.ix_(c, c)], xy[c], rcond=None)[0] @ xy[c]), sum(1 << i for i in c)))
        out[size] = sorted(rows)
    return out


@pytest.mark.parametrize("d,nbest,steps,tied", [(12, 60, 20_000, False), (12, 5, 40, False), (10, 8, 300, True)])
def test_branch_and_bound_finds_the_best_of_every_size(spark, d, nbest, steps, tied):
    xx, xy, yy = moments(80, d, d + nbest, tied)
    found = subsets.best_subsets(spark, xx, xy, yy, nbest, d, steps=steps).toPandas()
    for size, rows in every_subset(xx, xy, yy).items():
        have = set(found[found["size"] == size]["mask"])
        worst = rows[min(nbest, len(rows)) - 1][0]
        assert {m for r, m in rows if r < worst - 1e-9 * yy} <= have and len(have) >= min(nbest, len(rows))


def test_wide_search_keeps_to_the_exhaustive_table(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 8))
    rows = [(*map(float, r), "a" if r[0] + 0.5 * r[3] + rng.standard_normal() > 0 else "b") for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"x{i} double" for i in range(8)) + ", y string")
    feats = [f"x{i}" for i in range(8)]
    order = ["size", "rss", "cand_id"]
    plain = selection.subset_cp(df, "y", feats, nbest=6).orderBy(order).collect()
    monkeypatch.setattr(selection, "EVERY", 4)
    assert selection.subset_cp(df, "y", feats, nbest=6).orderBy(order).collect() == plain


def test_thirty_features_end(spark):
    xx, xy, yy = moments(400, 30, 1)
    found = subsets.best_subsets(spark, xx, xy, yy, 60, 30).groupBy("size").count().collect()
    n = {r["size"]: r["count"] for r in found}
    assert set(n) == set(range(1, 31)) and all(v >= min(60, comb(30, s)) for s, v in n.items())
    with pytest.raises(ValueError):
        subsets.best_subsets(spark, np.eye(63), np.ones(63), 99.0, 2, 3)
