"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of a unit vector, make a product grid of cells. A vector stands in the cell of its
halves' nearest centroids. The search of a vector visits cells by growing lower bound of the distance to them
(the distances to the borders between centroids, squared and added over the halves) until the bound that
gives the target recall, and verifies the cosine of all it meets there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.components import components, local_stars
from tonelake.llm.store import written

COSINE = 0.95
RECALL = 0.999
SAMPLE = 20_000
PROBES = 2_000  # sampled vectors whose links to all vectors set the bound
EDGES = np.append(0.0, np.geomspace(1e-9, 8.0, 4096))  # bounds are told apart this finely
CELL_ROWS = 16  # vectors a cell should hold
CENTROIDS_MAX = 1024
CHUNK = 4096  # vectors of one cell that one task compares
_BORDERS = 3  # nearest centroids whose borders count


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1), 0)


def _means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _squared(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Grid:
    """The codebooks of both halves and the bound up to which cells are visited."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float, recall: float):
        x = unit(sample)
        self.half = x.shape[1] // 2
        self.books = [np.unique(_means(h, min(k, len(x))), axis=0) for h in (x[:, : self.half], x[:, self.half :])]
        self.shape = tuple(len(b) for b in self.books)
        self.gaps = [np.sqrt(_squared(b, b)) for b in self.books]
        # Links at the very cosine in any direction; those that the data have come with ``measured``.
        rng = np.random.default_rng(1)
        self.probes = p = x[:PROBES]
        side = rng.standard_normal(p.shape)
        side -= (side * p).sum(axis=1, keepdims=True) * p
        length = np.linalg.norm(side, axis=1, keepdims=True)
        other = unit(cosine * p + np.sqrt(1 - cosine**2) * np.divide(side, length, out=np.zeros_like(side), where=length > 1e-9))
        need = np.minimum(self.bounds_to(p, self.home(other)), self.bounds_to(other, self.home(p)))
        self.bound = float(np.quantile(need, recall)) + 1e-12

    def needs(self, x: np.ndarray, cosine: float) -> np.ndarray:
        """Of the links between the probes and the vectors ``x``, how many need a bound up to each of ``EDGES`` for one of the
        two to visit the other's cell."""
        p, s = self.probes, self.shape[1]
        (pa_, pb), (xa, xb) = self.borders(p), self.borders(x)
        hp, hx = self.home(p), self.home(x)
        i, j = np.nonzero(p @ x.T >= cosine)
        apart = (p[i] != x[j]).any(axis=1)
        i, j = i[apart], j[apart]
        need = np.minimum(pa_[i, hx[j] // s] + pb[i, hx[j] % s], xa[j, hp[i] // s] + xb[j, hp[i] % s])
        return np.bincount(np.searchsorted(EDGES, need), minlength=len(EDGES) + 1)

    def measured(self, counts: np.ndarray, recall: float) -> None:
        """Raises the bound to the one that reaches the recall on the links counted."""
        upto = np.cumsum(counts)
        if upto[-1]:
            at = int(np.searchsorted(upto, recall * upto[-1]))
            self.bound = max(self.bound, float(EDGES[at]) + 1e-12 if at < len(EDGES) else np.inf)

    def _halves(self, x):
        return x[:, : self.half], x[:, self.half :]

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = (_squared(h, book).argmin(axis=1) for h, book in zip(self._halves(x), self.books))
        return a * self.shape[1] + b

    def borders(self, x: np.ndarray) -> list[np.ndarray]:
        """For each half, the squared least distance of every vector to every centroid's region."""
        out = []
        for h, book, gap in zip(self._halves(x), self.books, self.gaps):
            d = _squared(h, book)
            near = np.argsort(d, axis=1)[:, :_BORDERS]
            low = np.zeros_like(d)
            for n in near.T:
                g = gap[n]
                over = d - d[np.arange(len(d)), n][:, None]
                np.maximum(low, np.divide(over, 2 * g, out=np.zeros_like(d), where=g > 0), out=low)
            out.append(low**2)
        return out

    def bounds_to(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        a, b = self.borders(x)
        at = np.arange(len(x))
        return a[at, cell // self.shape[1]] + b[at, cell % self.shape[1]]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and cell of all visits: the multi-sequence walks both halves' centroids by growing bound."""
        a, b = self.borders(x)
        first, second = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        a, b = np.take_along_axis(a, first, axis=1), np.take_along_axis(b, second, axis=1)
        rows, cells = [], []
        for i in range(self.shape[0]):
            open_ = np.flatnonzero(a[:, i] + b[:, 0] <= self.bound)
            if not len(open_):
                break
            r, j = np.nonzero(a[open_, i, None] + b[open_] <= self.bound)
            rows.append(open_[r])
            cells.append(first[open_[r], i] * self.shape[1] + second[open_[r], j])
        return np.concatenate(rows), np.concatenate(cells)


def _matrix(column, kind: str) -> np.ndarray:
    """Fixed-size little-endian floating-point binaries as a matrix of doubles."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1).astype(np.float64)


def _compare(table: pa.Table, grid: Grid, cosine: float, kind: str) -> pa.Table:
    """Links of one cell's vectors to the vectors that visit it. Rows: link counts (b null) and links (n 0)."""
    visits = table["visit"].to_numpy()
    x, ids, n = _matrix(table["v"], kind), table["gid"].to_numpy(), table["n"].to_numpy()
    q, d = np.flatnonzero(visits), np.flatnonzero(~visits)
    length = np.linalg.norm(x, axis=1)
    found_i, found_j = [], []
    for lo in range(0, len(q), 1024):
        part = q[lo : lo + 1024]
        cos = (x[part] @ x[d].T) / (length[part][:, None] * length[d])
        i, j = np.nonzero(cos >= cosine)
        found_i.append(part[i])
        found_j.append(d[j])
    i, j = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_i, found_j))
    keep = ids[i] != ids[j]
    i, j = i[keep], j[keep]
    if len(i):
        # If each visits the other's cell, the visit of the smaller number counts.
        later = np.flatnonzero(ids[i] > ids[j])
        u = unit(x)
        both = np.zeros(len(later), bool)
        for lo in range(0, len(later), 4096):
            at = later[lo : lo + 4096]
            both[lo : lo + 4096] = grid.bounds_to(u[j[at]], grid.home(u[i[at]])) <= grid.bound
        drop = np.zeros(len(i), bool)
        drop[later[both]] = True
        i, j = i[~drop], j[~drop]
    links = np.bincount(i, weights=n[j], minlength=len(x)) + np.bincount(j, weights=n[i], minlength=len(x))
    some = np.flatnonzero(links)
    # A vector may stand in the group twice, as visitor and as resident: one node.
    names, node = np.unique(ids, return_inverse=True)
    label = local_stars(node[i], node[j], len(names))
    star = np.flatnonzero(label != np.arange(len(names)))
    a = np.concatenate([ids[some], names[star]])
    b = pa.array(np.concatenate([ids[some], names[label[star]]]), pa.int64(), mask=np.arange(len(a)) < len(some))
    return pa.table({"a": pa.array(a, pa.int64()), "b": b, "n": pa.array(np.concatenate([links[some], np.zeros(len(star))]).astype(np.int64))})


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL, chunk: int = CHUNK
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    * Vectors that are null, empty, all zero, of another length than most, or hold null or non-finite numbers link with
      nothing; so do rows with a null number, which get a null component and are kept.
    * Equal vectors meet as one before the search and count as links of each other; repeated rows are copies.
    * Further columns are ignored; an empty table gives an empty one.

    Every vector is indexed; the codebooks come from ``SAMPLE`` vectors, first by a hash of their number. The bound comes from
    the links of ``PROBES`` of them to all vectors, found by comparing them with every one. The number of cells grows with
    the vectors, up to ``CENTROIDS_MAX`` ** 2. A cell with over ``chunk`` vectors is cut, and so are the visits to a cell beyond
    four times that, so no task compares more than about ``chunk`` vectors with four times as many; links between them
    are true pairs, which the counts need, but only counts and one link per vector leave the task.
    """
    single = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    kind = "<f4" if single == "float" else "<f8"
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast(f"array<{single}>").alias("e"))
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("e", lambda v: v != 0), F.lit(False))
    rows = written(rows.withColumn("good", good).withColumn("h", F.xxhash64("e")), "vectors")
    lengths = rows.where("good").groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if lengths is None:
        return alone(rows)
    usable = F.col("good") & (F.size("e") == lengths[0])
    groups = rows.where(usable).groupBy("h", "e").agg(F.min("vec_id").alias("gid"), F.count(F.lit(1)).alias("n"))

    def pack(batches):
        for b in batches:
            m = b["e"].values.to_numpy(zero_copy_only=False)[b["e"].offsets[0].as_py() :].astype(kind).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b["gid"], b["n"], pa.array([r.tobytes() for r in m], pa.binary())], names=["gid", "n", "v"])

    packed = written(groups.select("gid", "n", "e").mapInArrow(pack, "gid long, n long, v binary"), "groups")
    sample = packed.orderBy(F.md5(F.col("gid").cast("string")), "gid").limit(SAMPLE).select("v").toArrow()
    total = packed.count()
    k = int(min(CENTROIDS_MAX, max(2, (total / CELL_ROWS) ** 0.5)))
    grid = Grid(_matrix(sample["v"], kind), k, cosine, recall)

    def needs(batches):
        total = np.zeros(len(EDGES) + 1, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                total += grid.needs(unit(_matrix(b["v"].slice(lo, 1000), kind)), cosine)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["edge", "n"])

    seen = packed.select("v").mapInArrow(needs, "edge long, n long").groupBy("edge").agg(F.sum("n").alias("n")).toArrow()
    grid.measured(np.bincount(seen["edge"].to_numpy(), weights=seen["n"].to_numpy(), minlength=len(EDGES) + 1), recall)

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(grid.home(unit(_matrix(b["v"], kind))), pa.int64())], names=["gid", "n", "v", "cell"])

    def visit(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                b = batch.slice(lo, 1000)
                row, cell = grid.visits(unit(_matrix(b["v"], kind)))
                t = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(cell, pa.int64())], names=["gid", "n", "v", "cell"])

    homes = packed.mapInArrow(place, "gid long, n long, v binary, cell long")
    visits = written(packed.mapInArrow(visit, "gid long, n long, v binary, cell long"), "visits")
    loads = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (4 * chunk)).cast("int").alias("askers"))
    pieces = homes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("pieces"))
    pieces = written(pieces.join(loads, "cell"), "cells").withColumnRenamed("cell", "of")
    sides = []
    for df, is_visit in ((homes, False), (visits, True)):
        mine, others, here, there = ("askers", "pieces", "q", "d") if is_visit else ("pieces", "askers", "d", "q")
        df = df.join(pieces, F.col("cell") == F.col("of")).withColumn(here, F.pmod(F.xxhash64("gid"), mine).cast("int"))
        df = df.withColumn(there, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        sides.append(df.select("cell", "d", "q", "gid", "n", "v", F.lit(is_visit).alias("visit")))
    met = sides[0].unionByName(sides[1]).groupBy("cell", "d", "q")
    found = written(met.applyInArrow(lambda t: _compare(t, grid, cosine, kind), "a long, b long, n long"), "vector-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    linked = components(found.where("b is not null").select("a", "b"))
    ids = (
        groups.select("h", "e", "gid", "n")
        .join(counts, F.col("gid") == F.col("a"), "left")
        .join(linked, F.col("gid") == F.col("node"), "left")
        .select("h", "e", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "gid").alias("component_id"))
    )
    out = rows.where(usable).join(ids, ["h", "e"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone(rows.where(~usable)))


def op9_embedding_near_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
