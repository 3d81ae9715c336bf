"""SimHash near-duplicates by pigeonring filtering.

The 64 bits of a fingerprint are cut into m = 3 * distance + 1 segments on a ring. By the pigeonring principle two
fingerprints within the distance have a segment from which every chain of l consecutive segments differs
in at most l * distance / m bits. So the first three segments of that chain are equal, and the next three differ
in one bit at most, which leaves two of them equal. Fingerprints that share such segments are the candidates;
the whole chain is checked, then the Hamming distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.components import components, local_stars
from tonelake.llm.store import written

SHINGLE = 3
DISTANCE = 2
BITS = 64
_PAIRS = 512  # fingerprints of one bucket that are compared all with all


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set where over half of the shingles' hashes (XXH64, seed 42) have it; A-Z count as a-z."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    k = min(shingle, len(ws))
    h = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :])], "<u8")
    set_bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Number, fingerprint (a signed 64-bit integer) and ``mark`` (hash of the text) of every row."""
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))

    def add(batches):
        for b in batches:
            fp = [fingerprint(t, shingle) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp, pa.int64()), b["mark"]], names=["doc_id", "fp", "mark"])

    return rows.mapInArrow(add, "doc_id long, fp long, mark long")


def _segments(distance: int) -> list[int]:
    """Bit mask of each segment on the ring."""
    m = min(3 * distance + 1, BITS)
    cuts = [BITS * i // m for i in range(m + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts[:-1], cuts[1:])]


def _tables(distance: int) -> list[tuple[int, int]]:
    """First segment of the chain and mask of the segments that must be equal, for every candidate table."""
    seg = _segments(distance)
    m = len(seg)
    out = []
    for i in range(m):
        head = 0
        for k in range(3):
            head |= seg[(i + k) % m]
        if m < 6:
            out.append((i, head))
        else:
            out += [(i, head | seg[(i + a) % m] | seg[(i + b) % m]) for a, b in combinations((3, 4, 5), 2)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chain_holds(diff: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Whether the differing bits stay within l * distance / m on the first l segments from ``start``, for every l."""
    seg = _segments(distance)
    m = len(seg)
    ok, total = np.ones(diff.shape, bool), np.zeros(diff.shape, np.int64)
    for k in range(m):
        total += np.bitwise_count(diff & np.uint64(seg[(start + k) % m]))
        ok &= total * m <= (k + 1) * distance
    return ok


def bucket_links(fps: np.ndarray, start: int, mask: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the fingerprints (distinct, equal under ``mask``) that pass the chain and the distance.

    A small bucket compares all its pairs. In a large one every fingerprint looks up the ones that differ in
    up to ``distance`` of the bits outside the mask: the work grows with the bucket, not with its square.
    """
    if len(fps) <= _PAIRS:
        i, j = np.triu_indices(len(fps), 1)
        diff = fps[i] ^ fps[j]
        ok = chain_holds(diff, start, distance)
        i, j, diff = i[ok], j[ok], diff[ok]
        ok = np.bitwise_count(diff) <= distance
        return i[ok], j[ok]
    free = [1 << b for b in range(BITS) if not mask >> b & 1]
    order = np.argsort(fps)
    ordered = fps[order]
    left, right = [], []
    for k in range(1, distance + 1):
        for bits in combinations(free, k):
            flip = np.uint64(sum(bits))
            if not chain_holds(np.array([flip]), start, distance)[0]:
                continue
            other = fps ^ flip
            at = np.minimum(np.searchsorted(ordered, other), len(fps) - 1)
            hit = np.flatnonzero((ordered[at] == other) & (other > fps))
            left.append(hit)
            right.append(order[at[hit]])
    return np.concatenate(left), np.concatenate(right)


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``) that join all that are within the distance.

    Within a bucket, linked fingerprints hang on one of theirs, so a dense group gives as many rows as it has members and
    table. A bucket holds distinct values of the bits outside its mask only: 2**19 at most for distance 2.
    """
    tables = _tables(distance)
    keys = F.array(*[F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for n, (_, mask) in enumerate(tables)])
    buckets = (
        fps.select("fp", F.explode(keys).alias("k"))
        .groupBy("k")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("k.t", "fps")
    )

    def verify(batches):
        for b in batches:
            a, c = [], []
            for t, values in zip(b["t"].to_pylist(), b["fps"]):
                start, mask = tables[t]
                f = values.values.to_numpy().view(np.uint64)
                i, j = bucket_links(f, start, mask, distance)
                if len(i):
                    label = local_stars(i, j, len(f))
                    on = np.flatnonzero(label != np.arange(len(f)))
                    a.append(f[on])
                    c.append(f[label[on]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, c)], names=["a", "b"])

    return buckets.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (the smallest number reachable by links), ``root`` (a fingerprint of the
    component, never null) and ``mark`` (hash of the text) of every row.

    Null, empty and blank texts have fingerprint zero and link like any other; a null number gets the component of its
    fingerprint but is never its smallest, unless there is none; repeated rows are repeated in the result; further columns
    are ignored; an empty table gives an empty one. Copies meet as one fingerprint before any comparison.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    if distance > 0:
        linked = components(fingerprint_links(groups.select("fp"), distance))
        of = groups.join(linked, groups["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
        of = written(of, "roots")
        least = of.groupBy("root").agg(F.min("least").alias("component_id"))
        of = of.join(least, "root").select("fp", "root", "component_id")
    else:
        of = groups.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return rows.join(of, "fp").select("doc_id", "fp", "component_id", "root", "mark")


def op4_simhash_dedup(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
