"""Exact nearest rows.

A table of points under a checked size is sent to every task. A larger one is
cut into cells around pivot points: a query visits only the cells that can hold
one of its ``k`` nearest (a bound from the cells' sizes and radii). Small cells
share a block, big ones are cut into blocks, so no task holds a whole cell and a
query is sent once per block, not per cell. Each task keeps ``k`` rows per query;
no list of all pairs exists.

Inside a task all pairs are measured in single precision (a matrix product, or one
pass of maxima), with a bound on its error; only pairs that may be among the
nearest by that bound are measured exactly, and these decide. Where no cell can be
left out the work is that of all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_VALUES = 4_000_000  # points sent to every task, in units of 8 bytes (32 MB)
BLOCK_ROWS = 20_000  # rows of one side in one block
PIVOTS = 64
TASK_PAIRS = 200_000_000  # pairs that one task measures where all points are sent to it


def _distances(q: np.ndarray, p: np.ndarray, power: int) -> np.ndarray:
    total = np.zeros((len(q), len(p)))
    for j in range(q.shape[1]):
        gap = np.abs(q[:, j : j + 1] - p[None, :, j])
        total += gap if power == 1 else gap * gap
    return np.round(total if power == 1 else np.sqrt(total), 9)


GROUP = 32  # points whose least distance stands for them where the bound is sought
LANE = 1024  # points met at once by the pass of maxima
TILE = 16  # points side by side in it
_HALF = 1e12  # larger values than this are measured in double precision only


class _Points:
    """One block of points in the order of their ids, and what the measuring in single precision needs of them."""

    def __init__(self, pdf: pd.DataFrame, id: str, feats, power: int):
        self.rows = pdf.sort_values(id, ignore_index=True)
        self.ids = self.rows[id].to_numpy()
        self.x = _values(self.rows, feats)
        self.power = power
        self.small = bool(len(self.x)) and bool((np.abs(self.x) < _HALF).all())  # false for NaN, too
        if self.small:
            self.centre = self.x.mean(axis=0)
            gap = self.x - self.centre
            self.size = np.abs(gap).sum(axis=1) if power == 1 else np.sqrt((gap * gap).sum(axis=1))
            self.narrow = np.zeros((-(-len(gap) // TILE) * TILE, gap.shape[1]), np.float32)
            self.narrow[: len(gap)] = gap
            self.own = (-gap.sum(axis=1) if power == 1 else (gap * gap).sum(axis=1)).astype(np.float32)

    def measure(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances (squared for ``power`` 2) of all pairs in single precision, and per query what they may be off by."""
        gap = q - self.centre
        near = gap.astype(np.float32)
        if self.power == 1:
            d = q.shape[1]
            out = np.empty((len(q), len(self.narrow)), np.float32)
            twos = np.full(d, 2, np.float32)
            tiled = np.tile(near, (1, TILE))  # long rows: both sides of the maximum are read in order
            for lo in range(0, len(self.narrow), LANE):
                part = self.narrow[lo : lo + LANE].reshape(-1, TILE * d)
                buffer = np.empty_like(part)
                flat = buffer.reshape(-1, d)
                for i in range(len(q)):  # |a - b| = 2 max(a, b) - a - b
                    np.maximum(part, tiled[i], out=buffer)
                    np.dot(flat, twos, out=out[i, lo : lo + LANE])
            out = out[:, : len(self.x)]
            out += self.own
            out -= gap.sum(axis=1).astype(np.float32)[:, None]
            reach = np.abs(gap).sum(axis=1) + self.size.max()
        else:
            out = near @ self.narrow[: len(self.x)].T
            out *= -2
            out += self.own
            out += (gap * gap).sum(axis=1).astype(np.float32)[:, None]
            reach = (np.sqrt((gap * gap).sum(axis=1)) + self.size.max()) ** 2
        return out, (q.shape[1] + 8) * 4e-7 * reach


def _candidates(q, p: _Points, k: int, alike):
    """Pairs that hold every query's ``k`` nearest; ``alike`` are pairs (query, point) that do not count."""
    if not p.small or not (np.abs(q) < _HALF).all():
        d = _distances(q, p.x, p.power)
        d[alike] = np.inf
        edge = np.partition(d, k - 1, axis=1)[:, k - 1]
        return np.nonzero((d <= edge[:, None]) & np.isfinite(d))
    d, off = p.measure(q)
    d[alike] = np.inf
    least, groups = d, d.shape[1] // GROUP
    if groups >= 2 * k:  # the k-th least of the groups' least: no less than the k-th least of all
        least = d[:, : groups * GROUP].reshape(len(d), groups, GROUP).min(axis=2)
    edge = np.partition(least, k - 1, axis=1)[:, k - 1].astype(float) + off
    if p.power == 2:
        edge = (np.sqrt(np.maximum(edge, 0)) + 2e-9) ** 2
    limit = (edge + off + 2e-9) * (1 + 1e-6)
    return np.nonzero((d <= limit.astype(np.float32)[:, None]) & np.isfinite(d))


def _top(q_ids, q: np.ndarray, p: _Points, k: int, exclude_self: bool):
    """The k nearest points of each query: (query position, point position, distance).

    Points are sorted by id, so among equal distances the first positions win.
    """
    found = []
    m = min(k, len(p.ids))
    step = max(1, 2_000_000 // max(1, len(p.ids)))
    same = pd.Index(p.ids) if exclude_self else None
    for lo in range(0, len(q) if m else 0, step):
        part = q[lo : lo + step]
        alike = (np.zeros(0, int), np.zeros(0, int))
        if exclude_self:
            at, miss = same.get_indexer_non_unique(q_ids[lo : lo + step])
            reps = np.repeat(np.arange(len(part)), pd.Series(p.ids).value_counts().reindex(q_ids[lo : lo + step]).fillna(1).to_numpy(int))
            alike = (reps[at >= 0], at[at >= 0])
        qi, pi = _candidates(part, p, m, alike)
        gap = np.zeros(len(qi))
        for j in range(q.shape[1]):
            g = part[qi, j] - p.x[pi, j]
            gap += np.abs(g) if p.power == 1 else g * g
        d = np.round(gap if p.power == 1 else np.sqrt(gap), 9)
        qi, pi, d = (v[np.isfinite(d)] for v in (qi, pi, d))
        order = np.lexsort((pi, d, qi))
        qi, pi, d = qi[order], pi[order], d[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < m
        found.append((lo + qi[keep], pi[keep], d[keep]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(v) for v in zip(*found))


def _values(pdf: pd.DataFrame, feats) -> np.ndarray:
    return pdf[list(feats)].to_numpy(dtype=float)


def _emit(q_pdf, p: _Points, id, feats, kept, k, exclude_self) -> pd.DataFrame:
    qi, pi, d = _top(q_pdf[id].to_numpy(), _values(q_pdf, feats), p, k, exclude_self)
    out = {"query_id": q_pdf[id].to_numpy()[qi], "point_id": p.ids[pi], "distance": d}
    for c in kept:
        out[f"p_{c}"] = p.rows[c].to_numpy()[pi]
    return pd.DataFrame(out)


def nearest_rows(
    queries: DataFrame,
    points: DataFrame,
    id: str,
    feats: Sequence[str],
    k: int,
    power: int = 2,
    exclude_self: bool = False,
    extra: Sequence[str] = (),
    values: bool = True,
    broadcast_values: int = BROADCAST_VALUES,
    block_rows: int = BLOCK_ROWS,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, point_id, distance, p_<col> ...) of each query's ``k`` nearest points.

    The columns are those of ``extra`` and, with ``values``, the features. Distances count as equal to 9 digits; equal ones go by point id (as text).
    """
    feats, extra = list(feats), list(extra)
    vals = [F.col(c).cast("double").alias(c) for c in feats]
    q = queries.select(F.col(id).cast("string").alias(id), *vals)
    p = points.select(F.col(id).cast("string").alias(id), *vals, *extra)
    kept = [*(feats if values else []), *extra]
    schema = "query_id string, point_id string, distance double" + "".join(
        f", p_{c} {p.schema[c].dataType.simpleString()}" for c in kept
    )
    # Ids and further columns travel too: their text counts as 8 bytes a value.
    text = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in [id, *extra]), F.lit(0))
    n, size = p.agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).first()
    if n * len(feats) + size / 8 <= broadcast_values:
        sent = q.sparkSession.sparkContext.broadcast(p.toPandas())

        def scan(batches):
            table = _Points(sent.value, id, feats, power)
            for batch in batches:
                if len(batch) and len(table.ids):
                    yield _emit(batch, table, id, feats, kept, k, exclude_self)

        asked = q.count()
        parts = min(-(-asked * n // TASK_PAIRS), asked)
        found = (q.repartition(parts) if parts > 1 else q).mapInPandas(scan, schema)
    else:
        found = _by_cells(q, p, id, feats, kept, k, power, exclude_self, block_rows, pivots, schema)
    w = Window.partitionBy("query_id").orderBy("distance", "point_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _by_cells(q, p, id, feats, kept, k, power, exclude_self, block_rows, pivots, schema) -> DataFrame:
    spark = q.sparkSession
    # Pivots only steer the pruning: any choice gives the same result.
    centres = _values(p.orderBy(F.xxhash64(id)).limit(pivots).select(*feats).toPandas(), feats)

    def assign(batches):
        for b in batches:
            if len(b):
                d = _distances(_values(b, feats), centres, power)
                yield b.assign(_cell=d.argmin(axis=1).astype("int64"), _d=d.min(axis=1))

    base = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema)
    placed = p.mapInPandas(assign, base + ", _cell long, _d double")
    stats = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_d").alias("hi"), F.min("_d").alias("lo"))
    rows = sorted(stats.collect(), key=lambda r: r["_cell"])  # one row per pivot
    cells = np.array([r["_cell"] for r in rows])
    size = np.array([r["n"] for r in rows])
    hi, lo = np.array([r["hi"] for r in rows]), np.array([r["lo"] for r in rows])
    want = k + (1 if exclude_self else 0)
    # Neighbouring cells share a block of ``block_rows`` points, a larger cell is cut into several.
    first, parts, blocks, room = np.zeros(len(cells), int), np.maximum(1, -(-size // block_rows)), -1, 0
    for c in _chain(centres[cells], power):
        if parts[c] > 1 or size[c] > room:
            blocks, room = blocks + 1, block_rows if parts[c] == 1 else 0
            first[c] = blocks
            blocks += parts[c] - 1
        else:
            first[c] = blocks
        room -= size[c]
    blocks += 1
    cell_blocks = np.zeros((len(cells), blocks), bool)
    for c in range(len(cells)):
        cell_blocks[c, first[c] : first[c] + parts[c]] = True

    def visit(batches):
        for b in batches:
            if not len(b):
                continue
            d = _distances(_values(b, feats), centres[cells], power)
            far = d + hi  # no point of the cell is farther
            order = np.argsort(far, axis=1)
            filled = np.cumsum(size[order], axis=1) >= want
            last = np.where(filled.any(axis=1), filled.argmax(axis=1), len(cells) - 1)
            bound = np.take_along_axis(far, np.take_along_axis(order, last[:, None], 1), 1)
            near = np.maximum(np.maximum(d - hi, lo - d), 0.0)
            goes = (near <= bound + 1e-6) @ cell_blocks
            yield b.assign(_blocks=[np.flatnonzero(g) for g in goes])

    q_base = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in q.schema)
    visits = q.mapInPandas(visit, q_base + ", _blocks array<long>").withColumn("_block", F.explode("_blocks")).drop("_blocks")
    loads = {r["_block"]: r["v"] for r in visits.groupBy("_block").agg(F.count(F.lit(1)).alias("v")).collect()}  # one row per block
    ways = [-(-loads.get(b, 0) // block_rows) for b in range(blocks)]

    def of(values, at):
        return F.get(F.array(*[F.lit(int(v)) for v in values]), at)

    # A block's points meet every part of its queries.
    where = F.col("_place")
    pp = placed.drop("_d").join(
        F.broadcast(spark.createDataFrame([(int(c), int(a), int(n)) for c, a, n in zip(cells, first, parts)], "_cell long, _at long, _parts long")), "_cell"
    ).select(*p.columns, (F.col("_at") + F.pmod(F.xxhash64(id), F.col("_parts"))).alias("_place"))
    pp = pp.withColumn("_ways", of(ways, where.cast("int"))).where("_ways > 0").select(
        *p.columns, where.alias("_block"), F.explode(F.sequence(F.lit(0), F.col("_ways") - 1)).alias("_part")
    )
    part = F.pmod(F.xxhash64(id, F.lit(7)), of(ways, F.col("_block").cast("int"))).cast("int")
    qq = visits.select(*q.columns, "_block", part.alias("_part"))
    keys = ["_block", "_part"]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            a, b = a.iloc[:0], b.iloc[:0]
        return _emit(a, _Points(b, id, feats, power), id, feats, kept, k, exclude_self)

    pairs = sum(v * min(block_rows, n) for v, n in ((loads.get(b, 0), block_rows) for b in range(blocks)))
    tasks = max(1, min(sum(ways), -(-pairs // TASK_PAIRS)))
    pp, qq = (t.repartition(int(tasks), *keys) for t in (pp, qq))
    return qq.groupBy(*keys).cogroup(pp.groupBy(*keys)).applyInPandas(meet, schema)


def _chain(centres: np.ndarray, power: int) -> list[int]:
    """The cells in an order in which each comes after the nearest one before it."""
    d = _distances(centres, centres, power)
    out, left = [0], set(range(1, len(centres)))
    while left:
        out.append(min(left, key=lambda c: (d[out[-1], c], c)))
        left.remove(out[-1])
    return out
