"""Order-dependent operators that put no group of unchecked size into one task.

A group (a file, a label) may hold a large share of all rows, so a window
over the group alone would run in one task. Each operator here takes a
``bucket``: a column that grows with the order (a time slot, the first digits
of a hash). Rows are ordered inside (group, bucket); one summary row per bucket
carries the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _join_summary(rows: DataFrame, summary: DataFrame, on: Sequence[str], how="inner") -> DataFrame:
    """Null-safe join on ``on``; keeps the left key columns."""
    renamed = summary.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)],
        *[c for c in summary.columns if c not in on],
    )
    cond = None
    for i, k in enumerate(on):
        c = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        cond = c if cond is None else cond & c
    return rows.join(renamed, cond, how).drop(*[f"_k{i}" for i in range(len(on))])


SENT_ROWS = 100_000  # rows of a checkpointed summary that may be sent to every task


def sent_if_small(summary: DataFrame) -> DataFrame:
    """A checkpointed summary, marked to be sent to every task where its rows, counted, are few.

    Spark's own estimate for such a table is that of its plan, mostly far too large, and a join on a few keys would
    then shuffle all rows to as many tasks as there are keys."""
    return F.broadcast(summary) if summary.count() <= SENT_ROWS else summary


SLOT_ROWS = 1_000_000  # rows of one group that one task may order
CUTS_MAX = 1_000


def with_slots(df: DataFrame, keys: Sequence[str], position: str, rows: int = SLOT_ROWS) -> DataFrame:
    """Adds ``_slot``, a bucket that grows with ``position`` (a number).

    While every group is small all rows are in slot 0. Otherwise a sketch of the
    positions gives cuts with about equally many rows between them, however
    uneven the positions are; past ``CUTS_MAX`` cuts each piece is cut evenly.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    slots = -(-largest // rows)
    if slots <= 1:
        return df.withColumn("_slot", F.lit(0).cast("long"))
    cuts = min(2 * slots, CUTS_MAX)
    pos = df.withColumn("_pos", F.col(position).cast("double"))
    inner = sorted(set(pos.approxQuantile("_pos", [i / cuts for i in range(cuts + 1)], 0.2 / cuts)))
    edges = [float("-inf"), *inner, float("inf")]
    cut = Bucketizer(splits=edges, inputCol="_pos", outputCol="_cut", handleInvalid="keep").transform(pos)
    parts = -(-2 * slots // cuts)
    at = F.col("_cut").cast("int")
    lo = F.get(F.array(*[F.lit(x) for x in [inner[0], *inner]]), at)
    hi = F.get(F.array(*[F.lit(x) for x in [*inner, inner[-1]]]), at)
    within = F.floor(F.try_divide(F.col("_pos") - lo, hi - lo) * parts)
    sub = F.least(F.greatest(F.coalesce(within, F.lit(0)), F.lit(0)), F.lit(parts - 1))
    return cut.withColumn("_slot", (at * parts + sub).cast("long")).drop("_pos", "_cut")


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, name: str = "rn"
) -> DataFrame:
    """1-based position of each row in its group under ``order``."""
    keys = list(keys)
    rows = df.withColumn("_b", bucket)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    local = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    return (
        _join_summary(local, offsets, keys + ["_b"])
        .withColumn(name, F.col("_off") + F.col("_r"))
        .drop("_b", "_off", "_r")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    values: Sequence[str],
    bucket: Column,
    inclusive: bool = True,
) -> DataFrame:
    """Running sums ``cum_<value>`` of each group under ``order``."""
    keys = list(keys)
    rows = df.withColumn("_b", bucket)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    sums = sums.select(
        *keys, "_b", *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    here = (
        Window.partitionBy(*keys, "_b")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = rows.select(
        "*", *[F.coalesce(F.sum(v).over(here), F.lit(0)).alias(f"_l_{v}") for v in values]
    )
    out = _join_summary(local, sums, keys + ["_b"])
    for v in values:
        out = out.withColumn(f"cum_{v}", F.col(f"_o_{v}") + F.col(f"_l_{v}"))
    return out.drop("_b", *[f"_o_{v}" for v in values], *[f"_l_{v}" for v in values])


def neighbours_in_order(
    df: DataFrame, keys: Sequence[str], position: str, bucket: Column, before_item: Column, after_item: Column
) -> DataFrame:
    """Largest ``before_item`` at or before, smallest ``after_item`` at or after each row.

    The items are structs led by ``position`` (NULL on rows that offer none);
    adds ``_prev`` and ``_next``.
    """
    keys = list(keys)
    rows = df.withColumn("_b", bucket).withColumn("_pi", before_item).withColumn("_ni", after_item)
    w = Window.partitionBy(*keys)
    summary = rows.groupBy(*keys, "_b").agg(F.max("_pi").alias("_mx"), F.min("_ni").alias("_mn"))
    summary = summary.select(
        *keys,
        "_b",
        F.max("_mx").over(w.orderBy(F.col("_b").asc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_pc"),
        F.min("_mn").over(w.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_nc"),
    )
    here = Window.partitionBy(*keys, "_b")
    up = here.orderBy(F.col(position).asc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = here.orderBy(F.col(position).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("_pl", F.max("_pi").over(up)).withColumn("_nl", F.min("_ni").over(down))
    return (
        _join_summary(local, summary, keys + ["_b"])
        .withColumn("_prev", F.coalesce("_pl", "_pc"))
        .withColumn("_next", F.coalesce("_nl", "_nc"))
        .drop("_b", "_pi", "_ni", "_pl", "_nl", "_pc", "_nc")
    )


def with_halo(df: DataFrame, index: str, size: int, halo: int) -> DataFrame:
    """Split dense row numbers into chunks of ``size`` rows.

    Rows within ``halo`` of a chunk's edge are also sent to the neighbour, so a
    window of that reach sees all its rows inside (key, ``_chunk``). ``_own``
    marks the original row.
    """
    if size < halo:
        raise ValueError("chunk size must be at least the halo")
    chunk = F.floor(F.col(index) / F.lit(size)).cast("long")
    pos = F.pmod(F.col(index), F.lit(size))

    def copy(c, own):
        return F.struct(c.alias("_chunk"), F.lit(own).alias("_own"))

    copies = F.array_compact(
        F.array(
            copy(chunk, True),
            F.when((pos < halo) & (chunk > 0), copy(chunk - 1, False)),
            F.when(pos >= size - halo, copy(chunk + 1, False)),
        )
    )
    return df.select("*", F.inline(copies))
