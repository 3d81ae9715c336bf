"""Annotation tiers: numbering, nesting, boundaries, stress and syllable measures.

Input rows are intervals (file, tier, idx, start_t, end_t, text).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.operators.joins import SLOT, contained_in
from tonelake.operators.ordering import number_rows

UTTERANCE, UNIT, SYLLABLE, STRESS = "Trans", "UTtag", "Sil", "duv"


def _tier(intervals: DataFrame, tier: str, prefix: str) -> DataFrame:
    """One tier's rows as (file, <prefix>_idx, <prefix>_start, <prefix>_end, <prefix>_text)."""
    return intervals.filter(F.col("tier") == tier).select(
        "file",
        F.col("idx").alias(f"{prefix}_idx"),
        F.col("start_t").alias(f"{prefix}_start"),
        F.col("end_t").alias(f"{prefix}_end"),
        F.col("text").alias(f"{prefix}_text"),
    )


def number_units(
    intervals: DataFrame, skip: str = "pp", inside_utterance: bool = True, width: float = SLOT
) -> DataFrame:
    """N_UT = 1, 2, ... over the units that are no pause, in time order per file."""
    units = _tier(intervals, UNIT, "iu").filter(F.col("iu_text") != skip)
    if inside_utterance:
        utts = _tier(intervals, UTTERANCE, "utt").filter(F.length("utt_text") > 0)
        units = contained_in(units, utts, "iu_start", "iu_end", "utt_start", "utt_end", width)
    slot = F.floor(F.col("iu_start") / F.lit(width * 100))
    return number_rows(units, ["file"], ["iu_start", "iu_idx"], slot, "n_ut").withColumn(
        "n_ut", F.col("n_ut").cast("int")
    )


def interval_nest(intervals: DataFrame, skip: str = "pp", width: float = SLOT) -> DataFrame:
    """Syllables with the unit and the non-empty utterance that contain them."""
    units = number_units(intervals, skip, True, width)
    return contained_in(
        _tier(intervals, SYLLABLE, "syl"), units, "syl_start", "syl_end", "iu_start", "iu_end", width
    )


def boundary_class(syl: DataFrame) -> DataFrame:
    """Which boundary a syllable starts and ends at.

    Start looks at the unit first (if that is not the utterance's start); end
    looks at the utterance first.
    """
    start = (
        F.when(
            (F.col("syl_start") == F.col("iu_start")) & (F.col("iu_start") != F.col("utt_start")), "begin_iu"
        )
        .when(F.col("syl_start") == F.col("utt_start"), "begin_utt")
        .otherwise("none")
    )
    end = (
        F.when(F.col("syl_end") == F.col("utt_end"), "tb")
        .when(F.col("syl_end") == F.col("iu_end"), "ntb")
        .otherwise("none")
    )
    return syl.withColumn("start_boundary", start).withColumn("end_boundary", end)


def mark_stress(syl: DataFrame, intervals: DataFrame, margin: float = 0.010, width: float = SLOT) -> DataFrame:
    """Flags the syllable around its unit's last non-empty stress interval."""
    units = _tier(intervals, UNIT, "iu").drop("iu_text")
    stress = _tier(intervals, STRESS, "str").filter(F.length("str_text") > 0)
    last = (
        contained_in(stress, units, "str_start", "str_end", "iu_start", "iu_end", width)
        .groupBy("file", "iu_idx")
        .agg(
            F.max_by(
                F.struct("str_start", "str_end", "str_text"), F.struct("str_start", "str_idx")
            ).alias("_s")
        )
    )
    inside = (F.col("_s.str_start") >= F.col("syl_start") - F.lit(margin)) & (
        F.col("_s.str_end") <= F.col("syl_end") + F.lit(margin)
    )
    flagged = syl.join(last, ["file", "iu_idx"], "left").withColumn("stressed", F.coalesce(inside, F.lit(False)))
    return (
        flagged.withColumn("vowel_start", F.when(F.col("stressed"), F.col("_s.str_start")))
        .withColumn("vowel_end", F.when(F.col("stressed"), F.col("_s.str_end")))
        .withColumn("vowel", F.when(F.col("stressed"), F.col("_s.str_text")))
        .drop("_s")
    )


def syllable_measures(
    syl: DataFrame, intervals: DataFrame, tiers: Sequence[str] = ("Zsil", "Msil", "Vsil"), width: float = SLOT
) -> DataFrame:
    """Text of each tier's last interval inside the syllable, as a number; none is NULL."""
    keys = ["file", "syl_idx"]
    parents = _tier(intervals, SYLLABLE, "syl").drop("syl_text")
    marks = intervals.filter(F.col("tier").isin(list(tiers))).select(
        "file", "tier", "idx", "start_t", "end_t", "text"
    )
    inside = contained_in(marks, parents, "start_t", "end_t", "syl_start", "syl_end", width)
    order = F.struct("start_t", "idx")
    found = inside.groupBy(*keys).agg(
        *[
            F.max_by(F.when(F.col("tier") == t, F.col("text")), F.when(F.col("tier") == t, order))
            .try_cast("double")
            .alias(t)
            for t in tiers
        ]
    )
    return syl.join(found, keys, "left")
