"""Mixing sources to target weights: Sainte-Lague seats of equal-token blocks, per source and shard."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.store import written

BLOCK = 32  # words
SHARD_WORDS = 1_000_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LAPS = 2
SEED = 17


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, laps: float = LAPS) -> list[float]:
    """Words each source should give: ``share`` of all sizes by weight, at most ``laps`` times a source's
    own size; what is cut off goes to the others by weight until no target is above."""
    out = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > laps * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(laps * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int]) -> np.ndarray:
    """Seats by highest quotients weight / (2 * seats so far + 1), none beyond its cap; ties go to the first.

    A divisor close to the final one gives nearly all seats at once, the highest quotients give the rest.
    """
    w, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    caps = np.where(w > 0, caps, 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(w), np.int64)

    def given(divisor):
        return np.minimum(np.floor(w / divisor + 0.5), caps).astype(np.int64)

    low, high = w[w > 0].min() / (2.0 * caps.max() + 2), w.max() * 4
    for _ in range(200):
        mid = (low + high) / 2
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
    out = given(high)
    heap = [(-w[i] / (2 * out[i] + 1), i) for i in range(len(w)) if out[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-w[i] / (2 * out[i] + 1), i))
    return out


def _nth_weight(i: int) -> float:
    return WEIGHTS[i % len(WEIGHTS)]


def _take(pdf: pd.DataFrame, block: int, seed: int) -> pd.DataFrame:
    """Words taken from the documents of one shard: whole laps, then seeded blocks for the rest of its quota."""
    pdf = pdf.sort_values(["order", "doc_id", "mark", "size"]).reset_index(drop=True)
    size = pdf["size"].to_numpy(np.int64)
    end = np.cumsum(size)
    words = int(end[-1])
    quota = min(int(pdf["seats"].iloc[0]) * block, LAPS * words)
    laps, rest = divmod(quota, words)
    times = np.full(-(-words // block), laps, np.int64)
    whole = words // block
    if rest and whole:
        rng = np.random.default_rng([seed, zlib.crc32(str(pdf["source"].iloc[0]).encode()), int(pdf["shard"].iloc[0])])
        times[rng.permutation(whole)[: min(whole, round(rest / block))]] += 1
    elif 2 * rest >= words:
        times += 1
    edges = np.minimum(np.arange(len(times) + 1) * block, words)
    before = np.concatenate([[0], np.cumsum(np.diff(edges) * times)])

    def taken_up_to(x):
        b = np.minimum(x // block, len(times) - 1)
        return before[b] + (x - edges[b]) * times[b]

    start = end - size
    pdf["taken"] = taken_up_to(end) - taken_up_to(start)
    spans = []
    for a, z in zip(start.tolist(), end.tolist()):
        lo, hi = a // block, (z - 1) // block
        t = times[lo : hi + 1]
        turn = np.flatnonzero(np.diff(t)) + 1
        at = [0, *((lo + turn) * block - a).tolist(), z - a]
        n = t[[0, *turn.tolist()]].tolist()
        spans.append([x for k, v in enumerate(n) if v for x in (at[k], at[k + 1], v)])
    pdf["spans"] = spans
    pdf["nth"] = pdf.groupby(["doc_id", "mark"], dropna=False).cumcount() + 1
    return pdf[["doc_id", "mark", "source", "size", "taken", "spans", "nth"]]


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Callable[[int], float] = _nth_weight,
    share: float = SHARE,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id``, ``mark`` (hash of the text), ``source``, ``size``, ``source_size``, ``target``, ``taken``,
    ``spans`` (start word, end word, times, ...) and ``nth`` (number among the rows of equal doc_id, text and source, from 1;
    null for size 0) of every row.

    * Null, empty and blank texts have size 0 and give nothing. A null source is a source of its own and comes last;
      ``weight`` gets a source's place in code-point order. Null numbers and repeated rows are rows like any other;
      equal rows are interchangeable. Further columns are ignored; an empty table gives an empty one.
    * The seats of the sources, and in each source those of its shards, are apportioned by Sainte-Lague in blocks of
      ``block`` words. A shard's documents are laid end to end in seeded order; its quota takes whole laps over them and
      then seeded blocks. A taken total misses its target by half a block per shard or so, and by a block per source.
    * A source is split in as many shards as its size has ``shard_words``, so a hot source is many small groups. The
      driver sees one row per source: the list that the weights are given for.
    """
    spark = docs.sparkSession
    text = docs[text_col].cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), docs[source_col].cast("string").alias("source"), size.alias("size")
    )
    rows = written(rows, "sizes")
    found = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum("size")).collect()}
    names = sorted(found, key=lambda s: (s is None, s or ""))
    sizes = [found[s] for s in names]
    goal = targets(sizes, [weight(i) for i in range(len(names))], share)
    seats = sainte_lague(goal, round(sum(goal) / block), [-(-LAPS * s // block) for s in sizes])
    listed = [(s, n, g, int(q), max(1, -(-n // shard_words))) for s, n, g, q in zip(names, sizes, goal, seats)]
    sources = spark.createDataFrame(listed, "of string, source_size long, target double, source_seats long, shards long")
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["of"])).drop("of")
    order = F.xxhash64(F.lit(seed), "doc_id", "mark")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "mark"), "shards")).withColumn("order", order)
    some = rows.where("size > 0")

    def shard_seats(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard").reset_index(drop=True)
        caps = -(-LAPS * pdf["words"].to_numpy() // block)
        pdf["seats"] = sainte_lague(pdf["words"].to_numpy(), int(pdf["source_seats"].iloc[0]), caps)
        return pdf[["source", "shard", "seats"]]

    # One small row per shard: a source's shards are millions of times fewer than its words.
    shards = some.groupBy("source", "source_seats", "shard").agg(F.sum("size").alias("words"))
    quotas = shards.groupBy("source").applyInPandas(shard_seats, "source string, shard long, seats long")
    quotas = quotas.withColumnsRenamed({"source": "of", "shard": "nth"})
    some = some.join(quotas, some["source"].eqNullSafe(quotas["of"]) & (some["shard"] == quotas["nth"]))

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _take(pdf, block, seed)
        return out.assign(source_size=pdf["source_size"].iloc[0], target=pdf["target"].iloc[0])

    schema = "doc_id long, mark long, source string, size long, taken long, spans array<int>, nth long, source_size long, target double"
    columns = ["doc_id", "mark", "source", "size", "source_size", "target", "taken", "spans", "nth"]
    taken = some.select("doc_id", "mark", "source", "size", "shard", "order", "seats", "source_size", "target")
    taken = taken.groupBy("source", "shard").applyInPandas(take, schema).select(*columns)
    none = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("spans", F.array().cast("array<int>")).withColumn("nth", F.lit(None).cast("long"))
    return taken.unionByName(none.select(*columns))


def taken_text(text: str, spans: Sequence[int]) -> str:
    """The taken words of a text; a word taken twice stands in two lines."""
    ws = text.encode().split()
    laps = max(spans[2::3], default=0)
    lines = []
    for lap in range(1, laps + 1):
        line = []
        for a, b, n in zip(spans[::3], spans[1::3], spans[2::3]):
            if n >= lap:
                line += ws[a:b]
        lines.append(b" ".join(line))
    return b"\n".join(lines).decode()


def op10_source_mixing(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
