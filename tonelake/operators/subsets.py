"""Best feature subsets of every size by branch and bound.

A node is a subset and a position: its descendants are what is left when further features behind the position are taken out. Taking a
feature out never lowers the residual sum of squares, and a descendant of size s has lost at least as many of them as sizes differ:
so its sum is at least the node's own, plus the loss of the cheapest features that are enough. Where that is above
the ``nbest``-th best sum known for each size within reach, the node and all below it are left out. The sums of a node's children come from its
own inverse (one division each), the inverse of a child from one reverse sweep.

The search goes in rounds: every task takes a share of the open nodes, works for a bounded number of steps and hands back what is still
open and its best subsets; the bounds of all tasks together start the next round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonelake.session import checkpoint

BEAM = 256  # subsets per size that set the first bounds
STEPS = 20_000  # nodes that one task opens in a round
_BATCH = 128  # nodes opened at once
_RIDGE = 1e-10
_SLACK = 1e-7  # of the total sum of squares: nothing within it of a bound is left out

OPEN = "mask long, position int"
_ROWS = "kind int, mask long, position int, size int, rss double"


def _swept(xx: np.ndarray, xy: np.ndarray, yy: float, masks: np.ndarray) -> np.ndarray:
    """The moments swept on the features of each mask: inverse (negative), coefficients and residual sum of squares."""
    d = len(xy)
    a = np.empty((d + 1, d + 1))
    a[:d, :d], a[:d, d], a[d, :d], a[d, d] = xx + _RIDGE * np.eye(d), xy, xy, yy
    a = np.repeat(a[None], len(masks), axis=0)
    for j in range(d):
        on = np.flatnonzero(masks >> j & 1)
        a[on] = _sweep(a[on], np.full(len(on), j), 1.0)
    return a


def _sweep(a: np.ndarray, j: np.ndarray, sign: float) -> np.ndarray:
    """Sweeps each matrix on its own pivot (``sign`` 1), or undoes it (-1)."""
    n = np.arange(len(a))
    row = a[n, j]
    pivot = row[n, j][:, None]
    out = a - row[:, :, None] * (row / pivot)[:, None, :]
    side = sign * row / pivot
    out[n, j], out[n, :, j] = side, side
    out[n, j, j] = -1 / pivot[:, 0]
    return out


def _losses(a: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """What taking out each feature adds to a node's sum; infinite for features that are not in."""
    d = a.shape[1] - 1
    inverse = -np.diagonal(a, axis1=1, axis2=2)[:, :d]
    inside = (masks[:, None] >> np.arange(d) & 1).astype(bool)
    return np.where(inside, a[:, :d, d] ** 2 / np.where(inside, np.maximum(inverse, 1e-300), 1.0), np.inf)


class Search:
    """The moments, in an order that tries the features that matter most first, and the bounds per size."""

    def __init__(self, xx: np.ndarray, xy: np.ndarray, yy: float, nbest: int, nvmax: int):
        d = len(xy)
        full = np.array([(1 << d) - 1])
        loss = _losses(_swept(xx, xy, yy, full), full)[0]
        self.order = np.argsort(-loss, kind="stable")
        self.xx, self.xy, self.yy, self.d = xx[np.ix_(self.order, self.order)], xy[self.order], yy, d
        self.nbest, self.nvmax, self.slack = nbest, min(nvmax, d), _SLACK * yy
        self.bounds = np.full(d + 1, np.inf)
        self.first = self._beam()
        self.tighten(self.first)

    def _beam(self) -> dict[int, dict[int, float]]:
        """Good subsets of every size: the best found by taking out one feature of the best of the size above."""
        masks = np.array([(1 << self.d) - 1])
        a = _swept(self.xx, self.xy, self.yy, masks)
        found = {self.d: {int(masks[0]): float(a[0, -1, -1])}}
        for size in range(self.d - 1, 0, -1):
            rss = a[:, -1, -1][:, None] + _losses(a, masks)
            i, j = np.nonzero(np.isfinite(rss))
            child = masks[i] ^ (1 << j)
            _, one = np.unique(child, return_index=True)
            best = one[np.lexsort((child[one], rss[i[one], j[one]]))[: max(BEAM, self.nbest)]]
            a = _sweep(a[i[best]], j[best], -1.0)
            masks = child[best]
            found[size] = dict(zip(masks.tolist(), a[:, -1, -1].tolist()))
        return {s: v for s, v in found.items() if s <= self.nvmax}

    def tighten(self, found: dict[int, dict[int, float]]) -> None:
        """Lowers the bound of each size to the ``nbest``-th best of the subsets found."""
        for size, rows in found.items():
            if len(rows) >= self.nbest:
                self.bounds[size] = min(self.bounds[size], np.partition(np.fromiter(rows.values(), float), self.nbest - 1)[self.nbest - 1])

    def search(self, masks: np.ndarray, positions: np.ndarray, steps: int):
        """Opens nodes until ``steps`` of them are done: the best subsets by size, and the nodes that are still open."""
        found: dict[int, dict[int, float]] = {}
        fresh = {}
        stack = []
        for lo in range(0, len(masks), _BATCH):
            m = masks[lo : lo + _BATCH]
            stack.append((m, positions[lo : lo + _BATCH], _swept(self.xx, self.xy, self.yy, m)))
        bits = np.arange(self.d)
        while stack and steps > 0:
            m, k, a = stack.pop()
            steps -= len(m)
            loss = _losses(a, m)
            behind = bits[None, :] >= k[:, None]
            loss = np.where(behind, loss, np.inf)
            rss = a[:, -1, -1][:, None] + loss
            size = np.bitwise_count(m.astype(np.uint64)).astype(np.int64)
            i, j = np.nonzero(np.isfinite(rss))
            child, child_rss, child_size = m[i] ^ (1 << j), rss[i, j], size[i] - 1
            near = (child_size <= self.nvmax) & (child_size > 0)
            near[near] = child_rss[near] <= self.bounds[child_size[near]] + self.slack
            for s in np.unique(child_size[near]).tolist():
                on = near & (child_size == s)
                rows = found.setdefault(s, {})
                rows.update(zip(child[on].tolist(), child_rss[on].tolist()))
                if len(rows) > 8 * self.nbest:
                    self.tighten({s: rows})
                    found[s] = {x: r for x, r in rows.items() if r <= self.bounds[s] + self.slack}
            # A child is opened if some size within its reach may still get better: it loses t more of the features behind j.
            left = (np.isfinite(loss)[i] & (bits[None, :] > j[:, None])).sum(axis=1)
            cheap = np.sort(np.where(bits[None, :] > j[:, None], loss[i], np.inf), axis=1)
            open_ = np.zeros(len(i), bool)
            for t in range(1, int(left.max(initial=0)) + 1):
                s = child_size - t
                may = (left >= t) & (s >= 1) & (s <= self.nvmax)
                least = np.maximum(child_rss, a[i, -1, -1] + cheap[:, t - 1])
                open_[may] |= least[may] <= self.bounds[s[may]] + self.slack
            i, j, child = i[open_], j[open_], child[open_]
            for lo in range(0, len(i), _BATCH):
                p = slice(lo, lo + _BATCH)
                stack.append((child[p], j[p] + 1, _sweep(a[i[p]], j[p], -1.0)))
        for s, rows in found.items():
            self.tighten({s: rows})
            fresh[s] = {x: r for x, r in rows.items() if r <= self.bounds[s] + self.slack}
        return fresh, np.concatenate([x[0] for x in stack] or [np.zeros(0, np.int64)]), np.concatenate([x[1] for x in stack] or [np.zeros(0, np.int64)])

    def masks_as_given(self, masks: np.ndarray) -> np.ndarray:
        """Masks in the features' own order."""
        out = np.zeros(len(masks), np.int64)
        for at, feature in enumerate(self.order.tolist()):
            out |= (masks >> at & 1) << feature
        return out


def best_subsets(spark: SparkSession, xx: np.ndarray, xy: np.ndarray, yy: float, nbest: int, nvmax: int, steps: int = STEPS) -> DataFrame:
    """``mask`` and ``size`` of subsets among which are the ``nbest`` best of every size up to ``nvmax`` (bit i: feature i).

    ``xx`` has a unit diagonal. The driver sees one bound per size and round."""
    if len(xy) > 62:
        raise ValueError("a subset is a 64-bit mask: 62 features at most")
    state = Search(xx, xy, yy, nbest, nvmax)
    parts = max(8, spark.sparkContext.defaultParallelism)
    # A few steps on the driver give every task nodes of its own.
    full = np.array([(1 << state.d) - 1])
    found, masks, positions = state.search(full, np.zeros(1, np.int64), 4 * parts)
    for s, rows in state.first.items():
        found.setdefault(s, {}).update(rows)
    for s in found:
        found[s] = {m: r for m, r in found[s].items() if r <= state.bounds[s] + state.slack}
    rows = [(m, s, r) for s, best in found.items() for m, r in best.items()]
    best = spark.createDataFrame(rows, "mask long, size int, rss double")
    nodes = spark.createDataFrame(pd.DataFrame({"mask": masks, "position": positions.astype(np.int32)}), OPEN) if len(masks) else None

    def work(batches):
        # Several tasks' worth of nodes may come in several batches; a task opens at most ``steps``.
        left = steps
        for b in batches:
            got, m, k = state.search(b["mask"].to_numpy(), b["position"].to_numpy().astype(np.int64), left)
            left = max(0, left - len(b)) if not len(m) else 0
            out = [(0, x, 0, s, r) for s, best in got.items() for x, r in best.items()]
            out += [(1, x, int(p), 0, 0.0) for x, p in zip(m.tolist(), k.tolist())]
            yield pd.DataFrame(out, columns=["kind", "mask", "position", "size", "rss"])

    top = Window.partitionBy("size").orderBy("rss", "mask")
    while nodes is not None:
        done = checkpoint(nodes.repartition(parts, F.xxhash64("mask")).mapInPandas(work, _ROWS))
        merged = best.unionByName(done.where("kind = 0").select("mask", "size", "rss")).groupBy("mask", "size").agg(F.min("rss").alias("rss"))
        last = F.max(F.when(F.col("_n") <= nbest, F.col("rss"))).over(Window.partitionBy("size"))
        merged = merged.withColumn("_n", F.row_number().over(top)).withColumn("_last", last)
        best = checkpoint(merged.where((F.col("_n") <= nbest) | (F.col("rss") <= F.col("_last") + state.slack)).select("mask", "size", "rss"))
        counts = best.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.expr(f"get(sort_array(collect_list(rss)), {nbest - 1})").alias("bound"))
        for r in counts.where(F.col("n") >= nbest).collect():  # one row per size
            state.bounds[r["size"]] = min(state.bounds[r["size"]], r["bound"])
        nodes = done.where("kind = 1").select("mask", "position")
        if nodes.isEmpty():
            nodes = None

    def renumber(batches):
        for b in batches:
            yield pd.DataFrame({"mask": state.masks_as_given(b["mask"].to_numpy()), "size": b["size"]})

    return best.select("mask", "size").mapInPandas(renumber, "mask long, size int")
