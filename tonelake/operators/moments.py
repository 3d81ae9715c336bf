"""Counts, means and scatter matrices per group: one pass serves every linear fit.

A task sums up numpy blocks around its own means and sends d*d numbers per
group. The parts are merged in two steps, so neither a task nor the driver
meets the parts of all tasks; the driver sees d*d numbers per group (checked).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.operators.frames import complete_rows

MERGE_WAYS = 64


@dataclass
class Moments:
    """Weighted count, mean and scatter (cross products around the mean) of rows."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    def __add__(self, o: "Moments") -> "Moments":
        n = self.n + o.n
        if n == 0:
            return self
        gap = o.mean - self.mean
        return Moments(
            n, self.mean + gap * (o.n / n), self.scatter + o.scatter + np.outer(gap, gap) * (self.n * o.n / n)
        )

    def take(self, cols: Sequence[int]) -> "Moments":
        i = np.asarray(cols)
        return Moments(self.n, self.mean[i], self.scatter[np.ix_(i, i)])

    def packed(self) -> list[float]:
        return [self.n, *self.mean, *self.scatter.ravel()]

    @staticmethod
    def unpacked(values, d: int) -> "Moments":
        v = np.asarray(values, dtype=float)
        return Moments(float(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d))

    @staticmethod
    def of(x: np.ndarray, w: np.ndarray) -> "Moments":
        n = float(w.sum())
        if n == 0:
            return Moments(0.0, np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2))
        mean = w @ x / n
        dx = x - mean
        return Moments(n, mean, (dx * w[:, None]).T @ dx)


def total(parts) -> Moments:
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def grouped_moments(
    df: DataFrame, keys: Sequence[str], feats: Sequence[str], weights: str | None = None
) -> dict[tuple, Moments]:
    """Moments of ``feats`` per group on the driver; rows with a missing feature are left out.

    ``weights`` names an array column: entry b weighs the row in the b-th of that
    many sets, and b is appended to the group key.
    """
    names = [*[f"k{i}" for i in range(len(list(keys)))], "s"]
    found = moment_rows(df, keys, feats, weights).toPandas()  # one row per group
    out = {}
    for key, part in found.groupby(names, sort=True):
        name = tuple(key[:-1]) + ((int(key[-1]),) if weights else ())
        out[name] = total(Moments.unpacked(v, len(list(feats))) for v in part["v"])
    return out


def moment_rows(df: DataFrame, keys: Sequence[str], feats: Sequence[str], weights: str | None = None) -> DataFrame:
    """The same as rows: the group's keys as text (``k0`` ...), the set ``s`` and the packed moments ``v``."""
    keys, feats = list(keys), list(feats)
    d = len(feats)
    cols = [F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
    cols += [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(feats)]
    if weights:
        cols.append(F.col(weights).alias("w"))
    rows = complete_rows(df.select(*cols), [f"x{i}" for i in range(d)] + [f"k{i}" for i in range(len(keys))])
    key_names = [f"k{i}" for i in range(len(keys))]
    x_names = [f"x{i}" for i in range(d)]
    group = [*key_names, "s"]

    def table(acc: dict[tuple, Moments], way) -> pd.DataFrame:
        out = pd.DataFrame([[*key, way, m.packed()] for key, m in acc.items()], columns=[*group, "way", "v"])
        return out

    def add_up(batches):
        acc: dict[tuple, Moments] = {}
        for b in batches:
            if not len(b):
                continue
            groups = b.groupby(key_names, sort=False).indices if key_names else {(): np.arange(len(b))}
            x_all = b[x_names].to_numpy(dtype=float)
            w_all = np.stack(b["w"].to_numpy()) if weights else np.ones((len(b), 1))
            for key, idx in groups.items():
                key = key if isinstance(key, tuple) else (key,)
                for s in range(w_all.shape[1]):
                    m = Moments.of(x_all[idx], w_all[idx, s])
                    name = (*key, s)
                    acc[name] = acc[name] + m if name in acc else m
        if acc:
            # By partition, so a task that runs again sends its part the same way.
            yield table(acc, TaskContext.get().partitionId() % MERGE_WAYS)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        acc: dict[tuple, Moments] = {}
        for *key, v in zip(*[pdf[c] for c in group], pdf["v"]):
            m = Moments.unpacked(v, d)
            acc[tuple(key)] = acc[tuple(key)] + m if tuple(key) in acc else m
        return table(acc, int(pdf["way"].iloc[0]))

    # With many weighted sets the groups of a set are merged together: one call per set, not one per set and group.
    by = ["s"] if weights else group
    schema = "".join(f"{k} string, " for k in key_names) + "s int, way int, v array<double>"
    parts = rows.mapInPandas(add_up, schema).groupBy(*by, "way").applyInPandas(merge, schema)
    return parts.groupBy(*by).applyInPandas(merge, schema).drop("way")
