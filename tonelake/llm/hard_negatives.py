"""Hard negatives of anchor vectors, by Four-Russians scoring.

Vectors are whole numbers (components times ``scale``, rounded down). An anchor's components stand in groups of eight; a table per
group holds the sums of all 256 subsets. A candidate is its bit planes: for every bit of its components (two's complement) and
every group one byte that says which components have the bit. So a plane's share of the inner product is one lookup per
group, and the planes from the highest (which counts negative) down are shifted and added: the scores are exact.

Anchors go through in blocks of a fixed number, each against all candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.llm.store import written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
ANCHORS = 2048  # about so many go to every task at once
CANDIDATES = 512  # scored at once
ROWS = 4096  # candidates of one task at least
_LARGEST = 1 << 26
_NONE = -(1 << 62)

PACKED = "vec_id long, label long, planes binary"


def bit_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """Bytes by (row, plane, group of eight components), the lowest plane first; the last plane is the sign's."""
    rows, width = values.shape
    values = np.pad(values, ((0, 0), (0, -width % 8)))
    out = np.empty((rows, planes, values.shape[1] // 8), np.uint8)
    for b in range(planes):
        out[:, b] = np.packbits((values >> min(b, 63)) & 1 == 1, axis=1, bitorder="little")
    return out


def unpacked(planes: np.ndarray) -> np.ndarray:
    """The whole numbers behind bit planes."""
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
    weight = 1 << np.arange(planes.shape[1], dtype=np.int64)
    weight[-1] *= -1
    return np.einsum("rpc,p->rc", bits, weight)


class SubsetSums:
    """The tables of a block of anchors: for each group and byte, the sum of the components whose bits are set, of all anchors."""

    def __init__(self, anchors: np.ndarray, planes: int):
        n, width = anchors.shape
        self.groups = width // 8
        # An inner product has no more than this many bits.
        largest = int(np.abs(anchors).sum(axis=1).max(initial=0)) << (planes - 1)
        self.kind = np.int32 if largest < 1 << 31 else np.int64
        self.table = np.zeros((self.groups, 256, n), self.kind)
        for g in range(self.groups):
            for k in range(8):  # all subsets with component k as the highest: those without it, and it
                self.table[g, 1 << k : 2 << k] = self.table[g, : 1 << k] + anchors[:, 8 * g + k].astype(self.kind)

    def scores(self, planes: np.ndarray) -> np.ndarray:
        """Inner products by (candidate, anchor)."""
        rows, count, groups = planes.shape
        total = np.zeros((rows, self.table.shape[2]), self.kind)
        found = np.empty_like(total)
        for b in range(count - 1, -1, -1):
            total <<= 1
            for g in range(groups):
                np.take(self.table[g], planes[:, b, g], axis=0, out=found)
                if b == count - 1:
                    total -= found
                else:
                    total += found
        return total


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every row's (score, id) the first ``k`` by falling score, then rising id; places without a score hold ``_NONE``."""
    by = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, by, axis=1), np.take_along_axis(ids, by, axis=1)


def _block_best(scores: np.ndarray, ids: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by (anchor, candidate) of a block whose ids ascend, among those that are ``ok``."""
    n = scores.shape[1]
    key = np.where(ok, scores.astype(np.int64) * n + np.arange(n - 1, -1, -1), _NONE)
    if n > k:
        key = np.partition(key, n - k, axis=1)[:, n - k :]
    place = n - 1 - key % n
    found = key > _NONE
    return np.where(found, key // n, _NONE), np.where(found, ids[place], np.iinfo(np.int64).max)


class _Anchors:
    """A block of anchors in a task: their tables and what has been found so far."""

    def __init__(self, rows: list[tuple[int, int, bytes]], planes: int):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.int64)
        packed = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), planes, -1)
        self.sums = SubsetSums(unpacked(packed), planes)
        self.planes = planes

    def blocks(self, batches):
        """Ids, labels and scores by (anchor, candidate) of candidates in ascending order, block by block."""
        for b in batches:
            ids, labels = b["vec_id"].to_numpy(), b["label"].to_numpy()
            planes = np.frombuffer(b"".join(b["planes"].to_pylist()), np.uint8).reshape(len(ids), self.planes, -1)
            order = np.argsort(ids)
            for lo in range(0, len(ids), CANDIDATES):
                at = order[lo : lo + CANDIDATES]
                yield ids[at], labels[at], np.ascontiguousarray(self.sums.scores(planes[at]).T)


def pack(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """The vectors that take part as bit planes, one row per number, and the number of planes."""
    number, label = vectors[id_col].cast("long"), vectors[label_col].cast("long")
    exact = F.transform(vectors[vector_col], lambda x: x.cast("double"))
    rows = vectors.select(number.alias("vec_id"), label.alias("label"), exact.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(odd, F.lit(False)))
    rows = rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")
    rows = written(rows, "whole-numbers")
    least, most, width = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v")), F.max(F.size("v"))).first()
    reach = max(-(least or 0) - 1, most or 0, 0)
    if reach >= _LARGEST:
        raise ValueError(f"components times {scale} must stay below {_LARGEST}")
    planes, width = int(reach).bit_length() + 1, max(width or 0, 1)

    def planes_of(batches):
        for b in batches:
            v = b["v"]
            size = np.diff(v.offsets.to_numpy())
            out = np.zeros((len(size), width), np.int64)
            out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = v.flatten().to_numpy()
            packed = bit_planes(out, planes)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array([x.tobytes() for x in packed], pa.binary())], names=["vec_id", "label", "planes"])

    return written(rows.mapInArrow(planes_of, PACKED), "bit-planes"), planes


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    per_round: int = ANCHORS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    ``anchors`` is a condition on ``vec_id`` and ``label``. An anchor's positives are its first ``positives`` other rows of the same
    label; for each, the first ``negatives`` rows of other labels whose score is between ``low`` and ``high`` per cent of the
    positive's. First is the higher score, of equal ones the smaller number.

    * Rows without number, label or vector, or with a component that is null or not finite, take no part. Shorter vectors count
      as if filled with zeros. A number that stands several times counts once, with its smallest label, then vector.
    * Components times ``scale`` of 2**26 or more raise ``ValueError``: scores would not be exact.
    * Further columns are ignored; an empty table, or one without anchors, gives an empty result.

    Each round sends about ``per_round`` anchors to every task; a task keeps the best it has met, so what is shuffled does not
    grow with the candidates, and every round reads the packed candidates (a byte per eight components and plane) twice.
    """
    packed, planes = pack(vectors, id_col, label_col, vector_col, scale)
    spark = packed.sparkSession
    chosen = packed.where(anchors)
    rounds = -(-chosen.count() // per_round)
    n = packed.count()
    parts = max(1, -(-n // ROWS), min(n // CANDIDATES, spark.sparkContext.defaultParallelism))
    candidates = written(packed.repartition(parts, "vec_id"), "candidates") if n else packed
    spread = candidates.repartition(parts, "vec_id")
    out = None
    for k in range(max(1, rounds)):
        block = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rounds))) == k)
        found = _round(spread, [tuple(r) for r in block.orderBy("vec_id").collect()], planes, positives, negatives, low, high)
        out = found if out is None else out.unionByName(found)
    return out


_POSITIVE = "anchor_id long, positive_id long, positive_score long"
_NEGATIVE = _POSITIVE + ", negative_id long, negative_score long"


def _round(candidates: DataFrame, rows: list, planes: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    def near(batches):
        if not rows:
            return
        a = _Anchors(rows, planes)
        score = np.full((len(a.ids), positives), _NONE)
        at = np.full((len(a.ids), positives), np.iinfo(np.int64).max)
        for ids, labels, s in a.blocks(batches):
            ok = (labels == a.labels[:, None]) & (ids != a.ids[:, None])
            more, where = _block_best(s, ids, ok, positives)
            score, at = _best(np.concatenate([score, more], axis=1), np.concatenate([at, where], axis=1), positives)
        i, j = np.nonzero(score > _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(a.ids[i]), pa.array(at[i, j]), pa.array(score[i, j])], names=["anchor_id", "positive_id", "positive_score"])

    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = candidates.mapInArrow(near, _POSITIVE).withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives).drop("n")
    pairs = pairs.orderBy("anchor_id", F.desc("positive_score"), "positive_id").toArrow()  # at most ``positives`` per anchor of the round
    of, positive, reach = (pairs[c].to_numpy() for c in ("anchor_id", "positive_id", "positive_score"))

    def far(batches):
        if not len(of):
            return
        a = _Anchors(rows, planes)
        row = np.searchsorted(a.ids, of)
        least, most = -(-low * reach // 100), high * reach // 100
        score = np.full((len(of), negatives), _NONE)
        at = np.full((len(of), negatives), np.iinfo(np.int64).max)
        for ids, labels, s in a.blocks(batches):
            for lo in range(0, len(of), 1024):
                p = slice(lo, lo + 1024)
                mine = s[row[p]]
                ok = (mine >= least[p, None]) & (mine <= most[p, None]) & (labels != a.labels[row[p]][:, None])
                some = np.flatnonzero(ok.any(axis=1))
                if len(some):
                    more, where = _block_best(mine[some], ids, ok[some], negatives)
                    q = lo + some
                    score[q], at[q] = _best(np.concatenate([score[q], more], axis=1), np.concatenate([at[q], where], axis=1), negatives)
        i, j = np.nonzero(score > _NONE)
        columns = [of[i], positive[i], reach[i], at[i, j], score[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in _NEGATIVE.split(", ")])

    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = candidates.mapInArrow(far, _NEGATIVE).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


OP12_SQL = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where label is not null and embedding is not null and list_count(embedding) = len(embedding)
        and len(list_filter(embedding, lambda x: not isfinite(cast(x as double)))) = 0
), scores as (
    select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
        cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) as bigint) as score
    from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), positives as (
    select anchor_id, other_id as positive_id, score as positive_score from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
), negatives as (
    select p.anchor_id, p.positive_id, s.other_id as negative_id, p.positive_score, s.score as negative_score,
        row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) as rank
    from positives p join scores s on s.anchor_id = p.anchor_id and not s.same
        and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from negatives where rank <= 3
"""
