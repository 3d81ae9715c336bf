"""Exact quantiles of groups of any size.

A sketch (bounded state, partial aggregation) brackets each wanted rank; only
values inside the bracket, pre-aggregated by value, are then sorted. Groups of
up to ``2 * accuracy`` rows are bracketed by their whole range.

Where a group is so large that even its brackets would be a long sort, nothing is sorted: each wanted rank is selected by
rounds of histograms. A round cuts what is left of the range into ``DIGITS`` cells and counts them; the cell that holds the
rank, from its least to its greatest value, is the next round's range, until one value is left. The least and the greatest value
never share a cell, so every round narrows the range, and no task sees more of a group than ``DIGITS`` sums per rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonelake.operators.ordering import _join_summary, sent_if_small
from tonelake.session import checkpoint

ROW_BOUND = 200_000  # values of one bracket that may be sorted
DIGITS = 4096
_LARGEST = 1.7976931348623157e308
_FAR = 64.0  # ranges whose ends differ by more than this factor are cut by logarithm


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    accuracy: int = 10_000,
    moments: bool = False,
    row_bound: int = ROW_BOUND,
) -> DataFrame:
    """``keys``, ``n`` and one linearly interpolated quantile column per name.

    ``moments`` adds mean, std (sample), min and max from the same passes. Groups whose brackets could hold more than
    ``row_bound`` values are selected from in rounds (infinite values count as the ends of the range). NaN counts as the greatest.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    # A sketch rank is off by at most n/accuracy, so 3/accuracy on both sides
    # covers the two order statistics a quantile needs once n > 2*accuracy.
    d = 3.0 / accuracy
    grid = [x for p in probs for x in (max(p - d, 0.0), min(p + d, 1.0))]
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_v").alias("_mn"),
        F.max("_v").alias("_mx"),
        F.percentile_approx("_v", grid, accuracy).alias("_g"),
    )
    small = F.col("n") <= 2 * accuracy
    edges = []
    for i in range(len(probs)):
        lo = F.col("_mn") if grid[2 * i] == 0.0 else F.when(small, F.col("_mn")).otherwise(F.col("_g")[2 * i])
        hi = F.col("_mx") if grid[2 * i + 1] == 1.0 else F.when(small, F.col("_mx")).otherwise(F.col("_g")[2 * i + 1])
        edges += [lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}")]
    brackets = stats.select(*keys, "n", *edges)
    names_of = [f"_{e}{i}" for i in range(len(probs)) for e in ("lo", "hi")]
    most = max(2 * accuracy, int(row_bound / (2 * d)))
    selected = None
    brackets = checkpoint(brackets)
    if (brackets.agg(F.max("n")).first()[0] or 0) > most:
        large = brackets.where(F.col("n") > most)
        selected = _selected(rows, large, keys, probs, moments)
        brackets = brackets.where(F.col("n") <= most)
        if not keys:
            return _interpolated(selected, keys, probs, names, moments)
    if keys:
        joined = _join_summary(rows, sent_if_small(brackets), keys)
    else:
        only = brackets.first()
        if only["n"] == 0:
            return brackets.select("n", *[F.lit(None).cast("double").alias(x) for x in names])
        joined = rows.select("_v", *[F.lit(only[c]).alias(c) for c in ["n", *names_of]])
    # Probabilities ascend, so the first bracket whose end is not below a value is the
    # value's segment. All values of a segment before its bracket share one NULL row.
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    segment, value_in = None, None
    for rank, i in enumerate(order):
        inside = F.when(F.col("_v") >= F.col(f"_lo{i}"), F.col("_v"))
        upto = F.col("_v") <= F.col(f"_hi{i}")
        segment = F.when(upto, rank) if segment is None else segment.when(upto, rank)
        value_in = F.when(upto, inside) if value_in is None else value_in.when(upto, inside)
    sums = [F.count(F.lit(1)).alias("_c")]
    const = ["n"]
    if moments:
        # Sums around a value near the middle lose no digits.
        middle = f"_lo{order[len(order) // 2]}"
        gap = F.col("_v") - F.col(middle)
        sums += [F.sum(gap).alias("_s"), F.sum(gap * gap).alias("_ss"), F.min("_v").alias("_min"), F.max("_v").alias("_max")]
        const.append(middle)
        segment = segment.otherwise(len(probs))
    cells = joined.select(*keys, *const, segment.alias("_i"), value_in.alias("_bv"), "_v")
    if not moments:
        cells = cells.filter("_i IS NOT NULL")
    counts = cells.groupBy(*keys, *const, "_i", "_bv").agg(*sums)
    w = (
        Window.partitionBy(*keys)
        .orderBy("_i", F.col("_bv").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = counts.withColumn("_hi", F.sum("_c").over(w)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    picks = []
    for j, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(p))
        for t, k in (("a", F.floor(at)), ("b", F.ceil(at))):
            hit = (F.col("_lo") <= k) & (k < F.col("_hi"))
            picks.append(F.max(F.when(hit, F.col("_bv"))).alias(f"_{t}{j}"))
    if moments:
        picks += [F.sum("_s").alias("_s"), F.sum("_ss").alias("_ss"), F.min("_min").alias("min"), F.max("_max").alias("max"), F.first(middle).alias("_mid")]
    out = ranked.groupBy(*keys, *const).agg(*picks).drop(*const[1:])
    if selected is not None:
        out = out.unionByName(selected)
    return _interpolated(out, keys, probs, names, moments)


def _interpolated(out: DataFrame, keys, probs, names, moments: bool) -> DataFrame:
    """Quantiles from the two order statistics ``_a`` and ``_b`` of each, moments from sums around ``_mid``."""
    cols = []
    if moments:
        n, s = F.col("n"), F.col("_s")
        var = F.greatest(F.try_divide(F.col("_ss") - s * s / n, n - 1), F.lit(0.0))
        cols = [(F.col("_mid") + s / n).alias("mean"), F.when(n > 1, F.sqrt(var)).alias("std"), "min", "max"]
    for j, (p, name) in enumerate(zip(probs, names)):
        at = (F.col("n") - 1) * F.lit(float(p))
        frac = at - F.floor(at)
        a, b = F.col(f"_a{j}"), F.col(f"_b{j}")
        cols.append(F.when(a == b, a).otherwise(a + (b - a) * frac).alias(name))
    return out.select(*keys, "n", *cols)


def _digit(v, lo, hi):
    """The cell of ``v`` in the range from ``lo`` to ``hi``: 0 for the least, ``DIGITS - 1`` for the greatest, never falling in between.

    Ranges of both signs are cut at zero, those of one sign that span many powers by logarithm, others evenly."""

    def even(x, a, b):  # halves, so that no difference overflows
        return F.floor(F.try_divide(x / 2 - a / 2, b / 2 - a / 2) * (DIGITS - 1))

    a, b = F.greatest(lo, F.lit(-_LARGEST)), F.least(hi, F.lit(_LARGEST))
    up, down = (a > 0) & (b / _FAR > a), (b < 0) & (a / _FAR < b)
    cell = F.when((a <= 0) & (b >= 0), F.signum(v) + 1)
    cell = cell.when(up, even(F.log(v), F.log(a), F.log(b))).when(down, even(-F.log(-v), -F.log(-a), -F.log(-b))).otherwise(even(v, a, b))
    cell = F.least(F.greatest(F.coalesce(cell, F.lit(0)), F.lit(0)), F.lit(DIGITS - 1))
    return F.when(v <= lo, 0).when(v >= hi, DIGITS - 1).otherwise(cell).cast("int")


def _selected(rows: DataFrame, large: DataFrame, keys: list[str], probs, moments: bool) -> DataFrame:
    """Per group of ``large`` the order statistics ``_a0``, ``_b0``, ... and with ``moments`` the sums, by rounds of histograms."""
    k = len(probs)
    if keys:
        joined = _join_summary(rows, sent_if_small(large), keys)
    else:
        joined = rows.crossJoin(F.broadcast(large))  # one row
    middle = f"_lo{k // 2}"
    gap = F.col("_v") - F.col(middle)
    sums = [F.sum(F.when(F.col("_v") < F.col(f"_lo{i}"), 1).otherwise(0)).alias(f"_below{i}") for i in range(k)]
    if moments:
        sums += [F.sum(gap).alias("_s"), F.sum(gap * gap).alias("_ss"), F.min("_v").alias("min"), F.max("_v").alias("max")]
    # One pass over all rows for what lies below the brackets, one that keeps the values inside, counted.
    below = checkpoint(joined.groupBy(*keys, "n", middle).agg(*sums).withColumnRenamed(middle, "_mid"))
    result = below.drop(*[f"_below{i}" for i in range(k)], *([] if moments else ["_mid"]))
    inside = F.array(*[F.when((F.col("_v") >= F.col(f"_lo{i}")) & (F.col("_v") <= F.col(f"_hi{i}")), F.lit(i)) for i in range(k)])
    values = joined.select(*keys, "_v", F.explode(F.array_compact(inside)).alias("_i"))
    values = checkpoint(values.groupBy(*keys, "_i", "_v").agg(F.count(F.lit(1)).alias("_c")))
    wanted = []
    for j, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(p))
        wanted += [F.struct(F.lit(j).alias("_i"), F.lit(t).alias("_t"), (x - F.col(f"_below{j}")).alias("_k")) for t, x in (("a", F.floor(at)), ("b", F.ceil(at)))]
    state = below.select(*keys, F.inline(F.array(*wanted)))
    ends = values.groupBy(*keys, "_i").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = checkpoint(_join_summary(state, ends, [*keys, "_i"]))
    found = None
    while True:
        done = state.where("_lo = _hi OR isnan(_lo)").select(*keys, "_i", "_t", F.col("_lo").alias("_x"))
        found = done if found is None else found.unionByName(done)
        state = state.where("_lo < _hi")
        if state.isEmpty():
            break
        near = _join_summary(values, sent_if_small(state), [*keys, "_i"]).where("_v >= _lo AND _v <= _hi")
        cells = near.groupBy(*keys, "_i", "_t", "_k", _digit(F.col("_v"), F.col("_lo"), F.col("_hi")).alias("_d")).agg(
            F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        upto = Window.partitionBy(*keys, "_i", "_t").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)  # ``DIGITS`` rows at most
        cells = cells.withColumn("_upto", F.sum("_c").over(upto)).where((F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_c")))
        state = checkpoint(cells.select(*keys, "_i", "_t", (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_k"), "_lo", "_hi"))
    pick = [F.max(F.when((F.col("_i") == j) & (F.col("_t") == t), F.col("_x"))).alias(f"_{t}{j}") for j in range(k) for t in ("a", "b")]
    if keys:
        return _join_summary(result, found.groupBy(*keys).agg(*pick), keys)
    return result.crossJoin(F.broadcast(found.agg(*pick)))  # one row each
