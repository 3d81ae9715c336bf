"""Column expressions: every function takes and returns Columns (or names)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit labels and the label each one counts as.
UNIT_LABELS = {
    "ALL": "ALL",
    "ALL_n": "ALL",
    "ALL_r": "ALL",
    "APC": "APC",
    "APT": "APT",
    "APT(1)": "APT",
    "AUX": "AUX",
    "AUX_n": "AUX",
    "AUX_r": "AUX",
    "AUX_r_n": "AUX",
    "CMB": "COB",
    "CMM": "CMM",
    "CMM_r": "CMM",
    "CNT": "CNT",
    "CNT_n": "CNT",
    "CNT_r": "CNT",
    "COB": "COB",
    "COB_r": "COB",
    "COM": "COM",
    "COM_r": "COM",
    "DCT": "DCT",
    "DCT_r": "DCT",
    "EMP": "EMP",
    "EMP_r": "EMP",
    "EVD": "EVD",
    "EXP": "EXP",
    "FLAT": "FLAT",
    "INP": "INP",
    "INP_r": "INP",
    "INT": "INT",
    "INT_r": "INT",
    "PAR": "PAR",
    "PAR(1)": "PAR",
    "SCA": "SCA",
    "SCA_r": "SCA",
    "TMP": "TMT",
    "TMT": "TMT",
    "TOP": "TOP",
    "TOP_r": "TOP",
    "TPL": "TOP",
    "TPL(1)": "TOP",
    "TPL(1)_r": "TOP",
    "TPL(2)": "TOP",
    "TPL(2)_r": "TOP",
    "TPL(3)": "TOP",
    "UNC": "UNC",
    "i COB": "COB",
    "i COM": "COB",
    "i TOP": "TOP",
    "i TPL(3)": "TOP",
    "i-COB": "COB",
}

# Marker tags kept for the plots' data; any other tag is missing.
MARKER_TAGS = {
    "??CNT": "CNT",
    "??INP": "INP",
    "ALL": "ALL",
    "ALL_r": "ALL",
    "CNT": "CNT",
    "CNT_r": "CNT",
    "DCT": "DCT",
    "EVD": "EVD",
    "EXP": "EXP",
    "FLAT": "FLAT",
    "INP": "INP",
    "INP_r": "INP",
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_key(col, n: int = 13) -> Column:
    return F.substring(_c(col), 1, n)


def slice_chars(col, start0: int, end0: int) -> Column:
    """Characters ``start0`` (0-based) up to, not including, ``end0``."""
    return F.substring(_c(col), start0 + 1, end0 - start0)


def zero_pad_id(file, utt, width: int = 3) -> Column:
    """``file__utt`` with the utterance number padded; longer numbers stay whole."""
    s = _c(utt).cast("string")
    return F.concat_ws(
        "__", _c(file), F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)
    )


def _literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def remap_replace(col, mapping: dict[str, str]) -> Column:
    """Mapped label; a label without an entry keeps its value."""
    return F.coalesce(F.try_element_at(_literal_map(mapping), _c(col)), _c(col))


def remap_map(col, mapping: dict[str, str]) -> Column:
    """Mapped label; a label without an entry becomes NULL."""
    return F.try_element_at(_literal_map(mapping), _c(col))


def _ratio_similarity(f1, f2, vup: float, rate: float) -> Column:
    a, b = _c(f1), _c(f2)
    octaves = F.abs(F.log2(F.try_divide(a, b)))
    return (
        F.when(a.isNull() & b.isNull(), F.lit(1.0))
        .when(a.isNull() | b.isNull(), F.lit(float(vup)))
        .when((a == 0) & (b == 0), F.lit(1.0))
        .when((a == 0) | (b == 0), F.lit(0.0))
        .otherwise(F.exp(F.lit(-rate) * octaves))
    )


def cents_similarity(f1, f2, vup: float = 0.5) -> Column:
    """exp(-0.0012 * cents between two pitches); NULL means unvoiced."""
    return _ratio_similarity(f1, f2, vup, 0.0012 * 1200)


def octave_similarity(f1, f2, vup: float = 0.5) -> Column:
    """exp(-octaves between two pitches); NULL means unvoiced."""
    return _ratio_similarity(f1, f2, vup, 1.0)


def forgetting_similarity(f1, f2, time, threshold: float) -> Column:
    """Similarity that drifts to 1 as the gap approaches ``threshold`` seconds."""
    s = cents_similarity(f1, f2)
    return s + (F.lit(1.0) - s) * _c(time) / F.lit(float(threshold))


def octave_to_hz(col) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), _c(col))


def is_in_interval(value, lo, hi) -> Column:
    return _c(value).between(_c(lo), _c(hi))


def round_half_even(col) -> Column:
    return F.bround(_c(col), 0)


def unvoice(cand, voice) -> Column:
    """0 where the voice decision is 0 or missing, else the candidate."""
    return F.when(F.coalesce(_c(voice), F.lit(0)) == 0, F.lit(0.0)).otherwise(_c(cand))


def binarize_label(col, target: str, other: str = "OTHER") -> Column:
    return F.when(_c(col) == target, F.lit(target)).otherwise(F.lit(other))


def mean_pool(arr) -> Column:
    """Mean of an array's components as one double."""
    a = _c(arr)
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.try_divide(total, F.size(a).cast("double"))
