"""Splits, folds and class balance. "Random" order is the md5 of seed and id.

Ranks go through ``number_rows`` with the hash's first digits as the bucket, so
a label with most of the rows is still ranked by many tasks. Where only the first
rows of each label are wanted, no row is ranked but those near the last one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonelake.operators.neighbours import nearest_rows
from tonelake.operators.ordering import _join_summary, number_rows, sent_if_small
from tonelake.session import checkpoint


def seeded_hash(col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(col).cast("string")))


def _ranked(df: DataFrame, keys: Sequence[str], id: str, seed: int, name: str = "_rn") -> DataFrame:
    hashed = df.withColumn("_h", seeded_hash(id, seed))
    return number_rows(hashed, keys, ["_h", id], F.substring("_h", 1, 3), name).drop("_h")


def _with_first(df: DataFrame, keys: Sequence[str], id: str, seed: int, quota: Column) -> DataFrame:
    """Adds ``_in``: whether the row is among the first ``quota`` (of ``_n``, the group's rows) of its group in seeded order.

    Rows are neither moved nor sorted: counts per group and hash prefix name the prefix that holds the last row to take, only the
    rows of that prefix are ranked, and every row is compared to the last one. Where some but not all rows of one id are to be
    taken, the rows of that id alone are ranked, by all their columns, and kept.
    """
    keys = list(keys)
    hashed = F.coalesce(seeded_hash(id, seed), F.lit(""))
    slim = df.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], hashed.alias("_h"), F.col(id).alias("_id"))
    slim = slim.withColumn("_b", F.substring("_h", 1, 3))
    on = [f"_g{i}" for i in range(len(keys))]
    group = Window.partitionBy(*on)
    upto = F.sum("_c").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    counts = slim.groupBy(*on, "_b").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select(*on, "_b", "_c", upto.alias("_upto"), F.sum("_c").over(group).alias("_n")).withColumn("_m", quota)
    cut = checkpoint(
        counts.where((F.col("_m") > F.col("_upto") - F.col("_c")) & (F.col("_m") <= F.col("_upto")))
        .select(*on, "_b", (F.col("_m") - F.col("_upto") + F.col("_c")).alias("_k"))
    )
    near = _join_summary(slim, sent_if_small(cut), [*on, "_b"])
    order = Window.partitionBy(*on, "_b").orderBy("_h", "_id")
    near = near.withColumn("_r", F.row_number().over(order)).withColumn("_same", F.rank().over(order))
    at, end = F.struct("_h", "_id"), F.col("_r") == F.col("_k")
    last = near.groupBy(*on).agg(
        F.max(F.when(end, at)).alias("_last"), F.max(F.when(F.col("_r") == F.col("_k") + 1, at)).alias("_next"),
        F.max(F.when(end, F.col("_k") - F.col("_same") + 1)).alias("_take"),
    )
    tied = F.coalesce(F.col("_last") == F.col("_next"), F.lit(False)).alias("_tied")
    last = checkpoint(last.select(*on, F.col("_last._h").alias("_lh"), F.col("_last._id").alias("_lid"), "_take", tied))
    some_tied = not last.where("_tied").isEmpty()
    last = sent_if_small(last.withColumnsRenamed({g: k for g, k in zip(on, keys)}))
    joined = _join_summary(df, last, keys, "left") if keys else df.join(last, F.lit(True), "left")
    upto = (F.col(id) <= F.col("_lid")) | F.col(id).eqNullSafe(F.col("_lid"))
    first = (hashed < F.col("_lh")) | ((hashed == F.col("_lh")) & upto)
    more = ["_lh", "_lid", "_take", "_tied"]
    if not some_tied:
        return joined.withColumn("_in", F.coalesce(first, F.lit(False))).drop(*more)
    cut_id = F.coalesce(F.col("_tied") & (hashed == F.col("_lh")) & F.col(id).eqNullSafe(F.col("_lid")), F.lit(False))
    whole = joined.where(~cut_id).withColumn("_in", F.coalesce(first, F.lit(False))).drop(*more)
    rows = joined.where(cut_id).withColumn("_h", F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})))
    ranked = number_rows(rows, keys, ["_h"], F.substring("_h", 1, 3), "_rn").withColumn("_in", F.col("_rn") <= F.col("_take"))
    return whole.unionByName(checkpoint(ranked.select(*df.columns, "_in")))


def stratified_split(df: DataFrame, id: str, label: str, frac: float, seed: int = 42) -> DataFrame:
    """Adds ``part``: 'train' for the first ``frac`` of each label, else 'test'."""
    marked = _with_first(df, [label], id, seed, F.floor(F.col("_n") * F.lit(float(frac))))
    return marked.withColumn("part", F.when(F.col("_in"), "train").otherwise("test")).drop("_in")


def row_split(df: DataFrame, id: str, frac: float, seed: int = 42) -> DataFrame:
    """Adds ``part``: 'train' for the first ``frac`` of all rows, whatever their label, else 'test'."""
    marked = _with_first(df, [], id, seed, F.floor(F.col("_n") * F.lit(float(frac))))
    return marked.withColumn("part", F.when(F.col("_in"), "train").otherwise("test")).drop("_in")


def stratified_folds(df: DataFrame, id: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..k-1, balanced within each label."""
    ranked = _ranked(df, [label], id, seed)
    return ranked.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")


def group_folds(df: DataFrame, group: str, k: int, seed: int = 42, fold_max: int | None = None) -> DataFrame:
    """Adds ``fold``; a group (speaker) is never split. ``fold_max`` keeps the first folds only."""
    groups = _ranked(df.select(group).distinct(), [], group, seed)
    folds = groups.select(group, ((F.col("_rn") - 1) % k).cast("int").alias("fold"))
    if fold_max is not None:
        folds = folds.filter(F.col("fold") < fold_max)
    return df.join(folds, group)


def group_split(df: DataFrame, group: str, valid: float = 0.25, seed: int = 42) -> DataFrame:
    """Adds ``part``; whole groups go to 'train' (the first 1 - valid) or 'valid'."""
    groups = df.select(group).distinct()
    total = groups.count()
    cut = int(total * (1 - valid))
    ranked = _ranked(groups, [], group, seed)
    parts = ranked.select(group, F.when(F.col("_rn") <= cut, "train").otherwise("valid").alias("part"))
    return df.join(parts, group)


def subset_split(frames: DataFrame, manifest: DataFrame, on: str = "fname") -> DataFrame:
    """Frames of files the manifest lists, with the manifest's ``subset``."""
    return frames.join(manifest.select(on, "subset"), on)


def undersample_other(
    df: DataFrame, id: str, label: str, target: str, seed: int = 42, other: str = "OTHER"
) -> DataFrame:
    """All target rows and as many rows of the other class."""
    n = df.filter(F.col(label) == target).count()
    rest = _with_first(df.filter(F.col(label) == other), [], id, seed, F.least(F.col("_n"), F.lit(n)))
    kept = rest.filter("_in").drop("_in")
    return df.filter(F.col(label) == target).unionByName(kept)


def sample_frames(df: DataFrame, id: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in seeded order."""
    return _with_first(df, [], id, seed, F.least(F.col("_n"), F.lit(n))).filter("_in").drop("_in")


def smote(
    df: DataFrame, id: str, label: str, feats: Sequence[str], k: int = 5, seed: int = 42, **limits
) -> DataFrame:
    """Adds synthetic rows until every class is as large as the largest.

    A synthetic row lies between a class row and one of its ``k`` nearest rows
    of the class. ``synthetic`` marks new rows.
    """
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    top = max(sizes.values())
    base = df.select(id, label, *[F.col(c).cast("double").alias(c) for c in feats])
    out = base.withColumn("synthetic", F.lit(False))
    for value, n in sorted(sizes.items()):
        need = top - n
        if need == 0 or n < 2:
            continue
        rows = base.filter(F.col(label) == value)
        # Every row gives need // n new rows, the first need % n in seeded order one more.
        ranked = _ranked(rows, [], id, seed)
        copies = F.lit(need // n) + F.when(F.col("_rn") <= need % n, 1).otherwise(0)
        plan = ranked.withColumn("_c", copies).filter("_c > 0").drop("_rn")
        reach = min(k, n - 1)
        near = nearest_rows(
            plan.select(id, *feats), rows.select(id, *feats), id, feats, reach, exclude_self=True, **limits
        )
        near = near.select("query_id", "rank", F.struct(*[F.col(f"p_{c}").alias(c) for c in feats]).alias("_near"))
        jobs = plan.select("*", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("_j"))
        draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id).cast("string"), F.lit("|"), F.col("_j").cast("string")))
        digits = F.conv(F.substring(draw, 1, 8), 16, 10).cast("long")
        gap = F.conv(F.substring(draw, 9, 8), 16, 10).cast("double") / F.lit(float(2**32))
        jobs = jobs.withColumn("_pick", (digits % reach + 1).cast("int")).withColumn("_u", gap)
        new = jobs.join(near, (F.col(id) == F.col("query_id")) & (F.col("_pick") == F.col("rank"))).select(
            F.concat(F.col(id).cast("string"), F.lit("_s"), F.col("_j").cast("string")).alias(id),
            label,
            *[(F.col(c) + F.col("_u") * (F.col(f"_near.{c}") - F.col(c))).alias(c) for c in feats],
            F.lit(True).alias("synthetic"),
        )
        out = out.withColumn(id, F.col(id).cast("string")).unionByName(new)
    return out
