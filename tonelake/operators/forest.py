"""Forests of deep trees.

A learner that counts every open node's rows per feature, value and class in every task sends as much for a node of
three rows as for one of a million, and deep trees are made of such nodes. Here only nodes of more than ``NODE_ROWS`` drawn
rows are counted that way. All other open nodes are groups: one task holds a node's rows, at most ``NODE_ROWS``, grows the rest of
that tree and scores the rows to predict that fall into it; branches none of them reaches are not grown, and no tree is sent anywhere.

Splits are Gini splits between at most ``BINS`` values of a feature; a row's score is the sum of its leaves' shares per class.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.operators.frames import complete_rows
from tonelake.session import checkpoint

NODE_ROWS = 20_000  # drawn rows of one node that one task may hold
BINS = 32
OPEN_VALUES = 8_000_000  # counts that one task keeps in a pass over the rows (64 MB)
SORTED_ROWS = 48  # nodes of fewer rows are split by sorting, larger ones by counting


def _cuts(rows: DataFrame, feats: list[str]) -> list[np.ndarray]:
    """Per feature the ends of its bins: half-way between values where it has few, else at quantiles."""
    grid = [i / 256 for i in range(257)]
    out = []
    for q in rows.approxQuantile(feats, grid, 1 / 2048):
        v = np.unique(np.asarray(q, dtype=float))
        out.append((v[1:] / 2 + v[:-1] / 2) if len(v) <= BINS else v[np.linspace(0, len(v) - 1, BINS + 1).round().astype(int)][1:-1])
    return out


def _coded(rows: DataFrame, feats: list[str], cuts: list[np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the bins of all features as one byte each (``x``)."""

    def code(batches):
        for b in batches:
            x = np.column_stack([np.searchsorted(c, b[f].to_numpy(dtype=float), side="left") for f, c in zip(feats, cuts)]).astype(np.uint8)
            yield b[keep].assign(x=[r.tobytes() for r in x])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.select(*keep, *feats).mapInPandas(code, schema + ", x binary")


def _bytes(x: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.uint8).reshape(-1, d)


def _best(left: np.ndarray, valid: np.ndarray, total: np.ndarray):
    """First best (feature, place) of counts (feature, place, class) up to each place, or None where no split gains."""
    right = total - left
    a, b = left.sum(axis=2), right.sum(axis=2)
    valid = valid & (a > 0) & (b > 0)
    score = (left * left).sum(axis=2) / np.where(valid, a, 1) + (right * right).sum(axis=2) / np.where(valid, b, 1)
    score = np.where(valid, score, -1.0)
    at = int(score.argmax())
    n = total.sum()
    if not valid.flat[at] or score.flat[at] - (total * total).sum() / n <= 1e-12 * n:
        return None
    return divmod(at, score.shape[1])


def _counts(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    """Weights per feature, bin and class."""
    m = x.shape[1]
    cell = (np.arange(m) * BINS + x) * classes + y[:, None]
    return np.bincount(cell.ravel(), np.repeat(w, m), m * BINS * classes).reshape(m, BINS, classes)


def _split(x: np.ndarray, y: np.ndarray, w: np.ndarray):
    """(feature, bin) of the best split of a node's rows, or None."""
    names, y = np.unique(y, return_inverse=True)
    k = len(names)
    if len(x) < 2 or k < 2:
        return None
    total = np.bincount(y, w, k)
    if len(x) >= SORTED_ROWS:
        left = _counts(x, y, w, k).cumsum(axis=1)
        return _best(left, np.ones(left.shape[:2], bool), total)
    order = x.argsort(axis=0, kind="stable").T
    level = np.take_along_axis(x.T, order, 1)
    hot = np.zeros((len(x), k))
    hot[np.arange(len(x)), y] = w
    found = _best(hot[order].cumsum(axis=1)[:, :-1], level[:, :-1] < level[:, 1:], total)
    return found and (found[0], int(level[found]))


def _offered(seed: int, tree: int, node: int, d: int, per_node: int) -> np.ndarray:
    """The features a node may split by."""
    if per_node >= d:
        return np.arange(d)
    return np.sort(np.random.default_rng((seed, tree, node)).choice(d, per_node, replace=False))


def _walk(tree: np.ndarray, x: np.ndarray, splits: dict) -> np.ndarray:
    """The open node or leaf of each row; a node's children are 2 * node and 2 * node + 1."""
    node = np.ones(len(tree), dtype=np.int64)
    for t in np.unique(tree):
        mine = np.flatnonzero(tree == t)
        at = [(1, mine)]
        while at:
            n, rows = at.pop()
            if (t, n) not in splits:
                node[rows] = n
                continue
            f, b = splits[t, n]
            right = x[rows, f] > b
            at += [(2 * n, rows[~right]), (2 * n + 1, rows[right])]
    return node


def forest(
    train: DataFrame, test: DataFrame, label: str, feats: Sequence[str], id: str, names: list[str], draws: Column, depth: int, per_node: int, seed: int,
    node_rows: int = NODE_ROWS,
) -> DataFrame:
    """(id, label, prediction) by one tree per entry of ``draws``, an array of how often the row of an ``id`` is drawn (at most 127 times).

    ``names`` are the labels in order; a missing label is a class of its own, named ?. Equal scores go to the first class."""
    feats, d, classes = list(feats), len(feats), len(names) + 1
    code = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in names]), F.col(label).cast("string")) - 1, F.lit(len(names)))
    doubles = [F.col(c).cast("double").alias(c) for c in feats]
    # Rows of a few files are dealt out first: what follows is work per row and tree.
    parts = 3 * train.sparkSession.sparkContext.defaultParallelism
    base = complete_rows(train.select(F.col(id).alias("id"), code.cast("int").alias("y"), *doubles), feats)
    base = checkpoint(base.repartition(parts))
    cuts = _cuts(base, feats)
    # A row's draws are kept and sent as one byte a tree.
    rows = checkpoint(_coded(base.withColumn("ws", draws.cast("array<tinyint>")), feats, cuts, ["y", "ws"]))
    asked = complete_rows(test.select(F.col(id).alias("id"), F.col(label).alias("label"), *doubles), feats)
    asked = checkpoint(_coded(asked.repartition(parts), feats, cuts, ["id", "label"]).withColumn("r", F.monotonically_increasing_id()))
    drawn = rows.select("y", "x", F.posexplode("ws").alias("t", "w")).where("w > 0").withColumn("w", F.col("w").cast("double"))

    splits: dict[tuple[int, int], tuple[int, int]] = {}
    leaves: dict[tuple[int, int], list[float]] = {}
    sizes = drawn.groupBy("t").agg(F.sum("w").alias("w")).collect()  # one row per tree
    wide = [(r["t"], 1) for r in sizes if r["w"] > node_rows]
    while wide:
        most = max(1, OPEN_VALUES // (min(per_node, d) * BINS * classes))
        now, wide = wide[:most], wide[most:]
        for r in _counted(drawn, set(now), dict(splits), d, classes, depth, per_node, seed).collect():  # one row per node
            key = (r["t"], r["n"])
            if r["f"] is None:
                leaves[key] = r["p"]
                continue
            splits[key] = (r["f"], r["b"])
            wide += [(r["t"], 2 * r["n"] + s) for s, w in enumerate((r["lw"], r["rw"])) if w > node_rows]

    def place(batches):
        for b in batches:
            if len(b):
                yield b.assign(n=_walk(b["t"].to_numpy(), _bytes(b["x"], d), splits))

    def settle(batches):
        for b in place(batches):
            yield b.assign(p=[leaves.get(k) for k in zip(b["t"], b["n"])])

    kinds = dict(asked.dtypes)
    head = f"r long, id {kinds['id']}, label {kinds['label']}, "
    every = asked.select("r", "id", "label", "x", F.explode(F.lit([r["t"] for r in sizes])).alias("t"))
    every = checkpoint(every.mapInPandas(settle, head + "x binary, t int, n long, p array<double>"))
    open_ = every.where("p IS NULL").drop("p")
    # A node that very many rows to predict fall into is grown in several tasks alike.
    ways = open_.groupBy("t", "n").agg(F.ceil(F.count(F.lit(1)) / (4 * node_rows)).cast("int").alias("ways"))
    ways = F.broadcast(checkpoint(ways))  # one row per open node, no more than rows / node_rows and trees
    here = drawn.mapInPandas(place, "y int, x binary, t int, w double, n long").join(ways, ["t", "n"])
    here = here.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")
    open_ = open_.join(ways, ["t", "n"]).withColumn("s", F.pmod(F.xxhash64("r"), F.col("ways")).cast("int")).drop("ways")

    def grow(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        tree, top = int(key[0]), int(key[1])
        out = np.zeros((len(b), classes))
        if len(a) and len(b):
            x, y, w, z = _bytes(a["x"], d), a["y"].to_numpy(), a["w"].to_numpy(), _bytes(b["x"], d)
            at = [(top, np.arange(len(a)), np.arange(len(b)))]
            while at:
                n, i, j = at.pop()
                some = _offered(seed, tree, n, d, per_node)
                best = _split(x[i][:, some], y[i], w[i]) if n.bit_length() - 1 < depth else None
                if best is None:
                    out[j] = np.bincount(y[i], w[i], classes) / w[i].sum()
                    continue
                f, cut = some[best[0]], best[1]
                down, right = x[i, f] > cut, z[j, f] > cut
                for child, mine, asks in ((2 * n, i[~down], j[~right]), (2 * n + 1, i[down], j[right])):
                    if len(asks):
                        at.append((child, mine, asks))
        return pd.DataFrame({"r": b["r"], "id": b["id"], "label": b["label"], "p": list(out)})

    keys = ["t", "n", "s"]
    scored = here.groupBy(*keys).cogroup(open_.groupBy(*keys)).applyInPandas(grow, head + "p array<double>")
    if leaves:
        scored = scored.unionByName(every.where("p IS NOT NULL").select("r", "id", "label", "p"))
    sums = F.array(*[F.round(F.sum(F.col("p")[c]), 9) for c in range(classes)]).alias("p")
    votes = scored.groupBy("r").agg(F.first("id").alias(id), F.first("label").alias("label"), sums)
    best = F.array_max(F.transform("p", lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
    return votes.select(id, "label", F.get(F.array(*[F.lit(x) for x in [*names, "?"]]), -best["i"]).alias("prediction"))


def _counted(drawn: DataFrame, now: set, splits: dict, d: int, classes: int, depth: int, per_node: int, seed: int) -> DataFrame:
    """Per node of ``now`` its split (``f``, ``b``) and the drawn rows on both sides, or where it has none its shares per class."""

    def add_up(batches):
        acc = {}
        for b in batches:
            if not len(b):
                continue
            t, x, y, w = b["t"].to_numpy(), _bytes(b["x"], d), b["y"].to_numpy(), b["w"].to_numpy()
            nodes = pd.DataFrame({"t": t, "n": _walk(t, x, splits)}).groupby(["t", "n"]).indices
            for key, i in nodes.items():
                if key in now:  # only the features that the node may split by
                    c = _counts(x[i][:, _offered(seed, int(key[0]), int(key[1]), d, per_node)], y[i], w[i], classes)
                    acc[key] = acc[key] + c if key in acc else c
        for (t, n), c in acc.items():
            yield pd.DataFrame({"t": [t], "n": [n], "c": [c.tobytes()]})

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        t, n = int(pdf["t"].iloc[0]), int(pdf["n"].iloc[0])
        c = sum(np.frombuffer(v).reshape(-1, BINS, classes) for v in pdf["c"])
        total = c[0].sum(axis=0)
        some = _offered(seed, t, n, d, per_node)
        left = c.cumsum(axis=1)
        best = _best(left, np.ones(left.shape[:2], bool), total) if n.bit_length() - 1 < depth else None
        row = {"t": t, "n": n, "f": None, "b": None, "lw": None, "rw": None, "p": (total / total.sum()).tolist()}
        if best is not None:
            lw = float(left[best].sum())
            row |= {"f": int(some[best[0]]), "b": int(best[1]), "lw": lw, "rw": float(total.sum() - lw)}
        return pd.DataFrame([row])

    wanted = sorted({t for t, _ in now})
    parts = drawn.where(F.col("t").isin(wanted)).mapInPandas(add_up, "t int, n long, c binary")
    return parts.groupBy("t", "n").applyInPandas(decide, "t int, n long, f int, b int, lw double, rw double, p array<double>")
