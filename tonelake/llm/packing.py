"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

Only lengths decide how pieces are packed, and there are at most ``capacity``
lengths. So the plan is made from the number of pieces per length: one bin
pattern after the other, each used as often as the counts allow. The pieces
are numbered within their length by Spark and looked up in the plan.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonelake.llm.store import written
from tonelake.llm.texts import chunks
from tonelake.llm.tokens import default_vocabulary, encoder

CAPACITY = 4096
_TEXT_BYTES = 2_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _rank long"


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Every document as ids, documents over ``capacity`` cut into pieces of it.

    Null and empty texts have the end id alone; a null number stays null; rows with the same number are
    documents of their own; further columns are ignored; an empty table gives no pieces. ``_part`` and
    ``_rank`` number the pieces of one length within a task. ``with_ids`` adds the ids as bytes.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def cut(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for t in chunks(batches, _TEXT_BYTES):
            ids, lens = encoder(vocabulary).encode(t["text"])
            n = -(-lens // capacity)
            first = np.cumsum(n) - n
            doc = np.repeat(np.arange(len(lens)), n)
            piece = np.arange(len(doc)) - first[doc]
            start = piece * capacity
            length = np.minimum(lens[doc] - start, capacity)
            at = (np.cumsum(lens) - lens)[doc] + start
            order = np.argsort(length, kind="stable")
            sizes = length[order]
            run = np.concatenate([[0], np.flatnonzero(np.diff(sizes)) + 1])
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.repeat(run, np.diff(np.append(run, len(doc)))) + seen[sizes]
            seen += np.bincount(length, minlength=capacity + 1)
            view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            bits = [view[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
            out = {
                "doc_id": t["doc_id"].combine_chunks().take(pa.array(doc)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(b) for b in bits], pa.int64()),
                "_part": pa.array(np.full(len(doc), part, np.int32)),
                "_rank": pa.array(rank),
            }
            if with_ids:
                out["ids"] = pa.array([bytes(b) for b in bits], pa.binary())
            yield pa.RecordBatch.from_pydict({k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for k, v in out.items()})

    return rows.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-two-fit on counts per length.

    A bin is filled greedily with the longest piece that still fits. Then its smallest piece gives way to the two
    unpacked pieces that together fill the widened gap best (of equal pairs the most even), if better than the piece did.
    The pattern is repeated while every length in it has enough pieces: the next bin would be the same.

    Returns rows (length, first rank, end rank, first bin, pieces per bin, offset in the bin) and the number of bins.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"no bin of {capacity} holds a piece of {length}")
        left[length] = n
    used_ranks = np.zeros(capacity + 1, np.int64)
    rows, bins = [], 0
    index = np.arange(capacity + 1)
    while left.any():
        fits = np.maximum.accumulate(np.where(left > 0, index, 0))  # longest unpacked piece up to a length
        taken: dict[int, int] = {}
        room = capacity
        while room:
            size = int(fits[room])
            while size and left[size] <= taken.get(size, 0):
                size = int(fits[size - 1])
            if not size:
                break
            n = min(room // size, int(left[size]) - taken.get(size, 0))
            taken[size] = taken.get(size, 0) + n
            room -= n * size
        small = min(taken)
        if room and len(taken) + taken[small] > 2:
            free = left.copy()
            for size, n in taken.items():
                free[size] -= n
            gap = room + small
            best = np.maximum.accumulate(np.where(free > 0, index, 0))
            a = np.flatnonzero(free[: gap + 1] > 0)
            if len(a):
                b = best[np.minimum(gap - a, a)]
                twice = (b == a) & (free[a] < 2)
                b[twice] = best[a[twice] - 1]
                both = np.where(b > 0, a + b, 0)
                k = int(both.argmax())
                if both[k] > small:
                    taken[small] -= 1
                    for size in (int(a[k]), int(b[k])):
                        taken[size] = taken.get(size, 0) + 1
        taken = {size: n for size, n in taken.items() if n}
        times = min(int(left[size]) // n for size, n in taken.items())
        offset = 0
        for size, n in sorted(taken.items(), reverse=True):
            first = int(used_ranks[size])
            rows.append((size, first, first + times * n, bins, n, offset))
            used_ranks[size] += times * n
            left[size] -= times * n
            offset += size * n
        bins += times
    return rows, bins


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces of ``token_pieces`` (a written table: its ranks must stay).

    The driver sees one count per length (at most ``capacity`` rows) and sends back the plan, whose rows are bounded
    by the number of ways to put pieces of one length into a bin, a few times ``capacity``.
    No length is ordered as a whole: a piece's number is its number in its task plus the counts of the tasks before.
    """
    spark = pieces.sparkSession
    per_part = pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in per_part.groupBy("length").agg(F.sum("n")).collect()}
    rows, _ = plan_bins(counts, capacity)
    plan = spark.createDataFrame(rows, "length long, lo long, hi long, bin long, per_bin int, at int")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "_part"]).withColumn("r", F.col("base") + F.col("_rank"))
    mine = (ranked["length"] == plan["length"]) & (ranked["r"] >= plan["lo"]) & (ranked["r"] < plan["hi"])
    nth = F.col("r") - F.col("lo")
    return (
        ranked.join(F.broadcast(plan), mine)
        .drop(plan["length"])
        .withColumn("sequence_id", F.col("bin") + F.floor(nth / F.col("per_bin")))
        .withColumn("offset", F.col("at") + (nth % F.col("per_bin")) * F.col("length"))
        .drop("_part", "_rank", "base", "r", "lo", "hi", "bin", "per_bin", "at")
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs whole documents; see ``token_pieces`` and ``pack_pieces``."""
    return pack_pieces(written(token_pieces(docs, vocabulary, capacity, with_ids=with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids as bytes and where its pieces start. Needs ``ids``."""
    piece = F.struct("offset", "doc_id", "piece", "ids")
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda all_ids, x: F.concat(all_ids, x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["piece"].alias("piece"))).alias("pieces"),
    )


def op1_best_fit_packing(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack_documents(docs, default_vocabulary())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
