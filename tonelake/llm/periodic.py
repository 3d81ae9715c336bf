"""Periodic runs of words in each document, by descending-LCP Kruskal.

The suffixes of a document are sorted, and neighbours in that order are linked by the number of words they share (LCP). Links are
taken by decreasing LCP and unite classes of suffixes (union-find); every class is an ordered set of positions. Two positions that
become neighbours in a united set share exactly the LCP of the link. If their distance is within it they seed a run whose
period is that distance: a smaller one would have put a position between them before. The seed whose words to the left differ
gives the run its start, so each run is found once.

A suffix can only matter if its first words occur twice in its document; documents without such words are not sorted at all.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.texts import chunks, mixed, ragged, text_bytes, word_hashes, words

SHORTEST = 6  # words
POWER = 4  # a run is at least so many times its period
_TEXT_BYTES = 2_000_000
_BLOCK = 512  # positions in a part of a large ordered set
_STEP = np.uint64(0xD6E8FEB86659FD93)

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_numbers(data, starts, ends) -> np.ndarray:
    """Equal words get equal numbers: told apart by two independent hashes of their bytes."""
    one, two = (word_hashes(data, starts, ends, kind) for kind in (0, 1))
    _, first, number = np.unique(one, return_index=True, return_inverse=True)
    odd = two != two[first][number]
    if odd.any():
        _, number = np.unique(np.stack([one, two]), axis=1, return_inverse=True)
    return number


def _repeated(number: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """Rows in which some ``size`` consecutive words occur twice (or seem to: they are told by a hash)."""
    n = len(number) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = row[:n].astype(np.uint64)
    for k in range(size):
        h = mixed(h * _STEP + number[k : n + k].astype(np.uint64))
    on = np.flatnonzero(row[:n] == row[size - 1 :])
    order = on[np.argsort(h[on])]
    twin = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    return np.unique(row[order[twin]])


def suffix_order(number: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places in suffix order, row by row, and for every k the class of each place's first 2**k words (within its row)."""
    n = len(number)
    last = np.flatnonzero(np.diff(np.append(row, -1)))  # of each row
    end = np.repeat(last + 1, np.diff(np.append(-1, last)))
    key = row * (int(number.max(initial=0)) + 1) + number
    order = np.argsort(key, kind="stable")
    levels = []
    rank = np.empty(n, np.int64)

    def renumber(sorted_places, keys, base):
        """Each place's rank: where its group starts in the order."""
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[sorted_places] = base[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]

    slots = np.arange(n)
    renumber(order, key[order], slots)
    size = 1
    while True:
        levels.append(rank.astype(np.int32))
        # Only groups with several places are refined.
        r = rank[order]
        many = np.zeros(len(r), bool)
        same = r[1:] == r[:-1]
        many[1:] |= same
        many[:-1] |= same
        slots_now = np.flatnonzero(many)
        if not len(slots_now):
            return order, levels
        places = order[slots_now]
        behind = places + size
        inside = behind < end[places]
        follow = np.zeros(len(places), np.int64)
        follow[inside] = levels[-1][behind[inside]] + 1
        key = rank[places] * (n + 1) + follow
        by = np.argsort(key, kind="stable")
        order[slots_now] = places[by]
        renumber(places[by], key[by], slots_now)
        size *= 2


def common_words(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Number of words that the suffixes at ``a`` and ``b`` (of one row) share."""
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        on = np.flatnonzero((x < end[a]) & (y < end[b]))
        hit = on[levels[k][x[on]] == levels[k][y[on]]]
        lcp[hit] += 1 << k
    return lcp


class Positions:
    """An ordered set of positions; large ones are kept in parts, so that putting one in moves few."""

    __slots__ = ("parts", "size")

    def __init__(self, position: int):
        self.parts, self.size = [[position]], 1

    def __iter__(self):
        for p in self.parts:
            yield from p

    def put(self, x: int) -> tuple[int, int]:
        """Adds ``x``; the positions before and behind it, or -1."""
        parts = self.parts
        k = 0 if len(parts) == 1 else max(0, bisect_right(parts, x, key=lambda p: p[0]) - 1)
        p = parts[k]
        i = bisect_left(p, x)
        before = p[i - 1] if i else (parts[k - 1][-1] if k else -1)
        behind = p[i] if i < len(p) else (parts[k + 1][0] if k + 1 < len(parts) else -1)
        p.insert(i, x)
        self.size += 1
        if len(p) > _BLOCK:
            parts[k : k + 1] = [p[: _BLOCK // 2], p[_BLOCK // 2 :]]
        return before, behind


def seeds(places: list[int], links: list[tuple[int, int]], power: int):
    """(left, right, lcp) of positions that become neighbours at a distance of at most ``lcp / (power - 1)``.

    ``places`` are positions in suffix order; a link (k, lcp) joins the k-th with the next; links come by decreasing lcp."""
    parent = list(range(len(places)))
    sets: list[Positions | None] = [Positions(x) for x in places]
    out = []
    for k, lcp in links:
        a, b = k, k + 1
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        large, small = sets[a], sets[b]
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        parent[b], sets[b] = a, None
        reach = lcp // (power - 1)
        late = -1, -1  # the last one put in and what stands behind it
        mine = -1
        for x in small:
            before, behind = large.put(x)
            if late[1] >= 0 and late[1] < x and late[1] - late[0] <= reach:
                out.append((*late, lcp))
            if before >= 0 and before != mine and x - before <= reach:
                out.append((before, x, lcp))
            late, mine = (x, behind), x
        if late[1] >= 0 and late[1] - late[0] <= reach:
            out.append((*late, lcp))
    return out


def find_runs(number: np.ndarray, row: np.ndarray, shortest: int = SHORTEST, power: int = POWER) -> np.ndarray:
    """Row, start (in ``number``), length and period of every run, in order of row, start and period.

    Words are ``number``; equal ``row`` numbers stand side by side and ascend."""
    least = max(1, min(max(shortest, power * q) - q for q in range(1, shortest + 1)))  # words that a run's start and its first repeat share
    none = np.zeros((0, 4), np.int64)
    some = np.isin(row, _repeated(number, row, least))
    at = np.flatnonzero(some)
    if not len(at):
        return none
    number, row = number[at], row[at]
    order, levels = suffix_order(number, row)
    last = np.flatnonzero(np.diff(np.append(row, -1)))
    end = np.repeat(last + 1, np.diff(np.append(-1, last)))
    pair = np.flatnonzero(row[order[1:]] == row[order[:-1]])
    lcp = common_words(order[pair], order[pair + 1], levels, end)
    pair, lcp = pair[lcp >= least], lcp[lcp >= least]
    if not len(pair):
        return none
    nodes = np.unique(np.concatenate([pair, pair + 1]))
    by = np.argsort(-lcp, kind="stable")
    links = list(zip(np.searchsorted(nodes, pair[by]).tolist(), lcp[by].tolist()))
    found = np.array(seeds(order[nodes].tolist(), links, power), np.int64).reshape(-1, 3)
    left, right, shared = found.T
    period, length = right - left, right - left + shared
    first = left == 0
    first |= (row[left - 1] != row[left]) | (number[left - 1] != number[right - 1])
    ok = first & (length >= np.maximum(shortest, power * period))
    out = np.stack([row[left], at[left], length, period], axis=1)[ok]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, power: int = POWER, also: tuple[str, ...] = (), read=None
) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length and period, by start, then period) and ``collapsed`` (the words that no run
    repeats, joined by one space) of every row.

    A run is a stretch of words with smallest period q, at least ``power`` * q (two or more) and ``shortest`` words long, that no
    neighbouring word extends. All words of the whole text count. Null, empty and blank texts have no words and no runs; repeated
    rows are repeated; a null number stays null; further columns are ignored; an empty table gives an empty one.
    ``read(table, before)`` may say which word stands at each place (an index into the words as written, of which row k has
    ``before[k]`` to ``before[k + 1]``); ``also`` are columns it needs.
    """
    if power < 2:
        raise ValueError("a run holds its period twice at least")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *[docs[c].alias(f"_also_{c}") for c in also])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches):
        for t in chunks(batches, _TEXT_BYTES):
            data, at = text_bytes(t["text"])
            starts, ends, before = words(data, at)
            if read is not None:
                place = read(t, before)
                starts, ends = starts[place], ends[place]
            n = np.diff(before)
            row = np.repeat(np.arange(len(n)), n)
            runs = find_runs(word_numbers(data, starts, ends), row, shortest, power)
            of, start, length, period = runs.T
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            kept = np.cumsum(edge[:-1]) == 0
            per_row = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n)))]).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - before[of], length, period)], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks(), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(per_row), values), joined(data, starts[kept], ends[kept], row[kept], len(n))],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return rows.mapInArrow(find, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """The words of every row with one space between, as ``n`` strings."""
    size = ends - starts + 1
    last = np.zeros(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    last[-1:] = True
    stop = np.cumsum(size)
    out = data[np.minimum(ragged(starts, size), max(len(data) - 1, 0))]
    out[stop - 1] = 32
    keep = np.ones(len(out), bool)
    keep[(stop - 1)[last]] = False
    count = np.bincount(row, weights=size, minlength=n).astype(np.int64) - (np.bincount(row, minlength=n) > 0)
    offsets = np.concatenate([[0], np.cumsum(count)])
    if offsets[-1] >= 1 << 31:
        return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out[keep])).cast(pa.string())
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out[keep]))


def stretched(t: pa.Table, before: np.ndarray) -> np.ndarray:
    """Every tenth document (by ``_also_h``) goes on from a place of its own with what it has just said, over and over."""
    n = np.diff(before)
    place = np.arange(before[-1])
    h = t["_also_h"].to_numpy(zero_copy_only=False)
    for k in np.flatnonzero((h % 10 == 0) & (n > 0)).tolist():
        g, size = int(h[k]) // 10, int(n[k])
        a = g % size
        p = 1 + (size - a) // (3 + g % 8)
        place[before[k] + a : before[k + 1]] = before[k] + a + np.arange(size - a) % p
    return place


def op13_periodic_runs(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # A document without a number has no hash and stays as it is.
    docs = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1)).alias("h"))
    found = periodic_runs(docs, also=("h",), read=stretched)
    # Quotients of numbers below 2**26 differ as doubles if they differ at all.
    strength = F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("q"), r["length"].alias("n")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.withColumn("best", F.array_max(strength)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.q")).alias("period"),
        F.expr("1000 * best.n div -best.q").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
