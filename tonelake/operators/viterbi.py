"""Best pitch-candidate path per file.

Emissions and voicing are column expressions. The path itself is a fold over a
file's frames; files up to ``chunk`` frames are folded side by side, many to a
group. Longer ones are cut into chunks so that no task holds a whole file:

1. each chunk's transfer (best score from every entry state to every exit
   state) is computed on its own; a short scan over chunks gives each
   chunk's entry scores. With a reinforcement other than 1 the step is not a
   max-product, so entry scores are passed on one chunk per round instead;
2. every chunk reports which entry state each exit state came from; a
   backward scan over chunks fixes each chunk's exit state;
3. every chunk traces its own frames back.

The scans see one small row per chunk of a file, never its frames.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonelake.functions.scalar import cents_similarity, remap_map, unvoice
from tonelake.operators.ordering import with_halo
from tonelake.operators.windows import CHUNK, voice_fallback
from tonelake.session import checkpoint

FOLD_CHUNK = 100_000  # frames of the longest file folded whole (500 s at 5 ms)
RUN_FRAMES = 2_000  # frames per chunk of a longer one, more where that
RUN_CHUNKS = 10_000  # would give a file more chunks than this
BIN_FRAMES = 200_000  # frames of whole files folded as one group

# Scores this close (relative) count as equal. Path scores tie by design whenever a
# pitch lies between two others, so rounding must not decide between them.
TIE = 1e-9

# Factors on candidates 0 and 2 in noisy and in creaky frames,
# and the octave variant's factors in creaky frames.
NOISE_FACTOR = 2.5
CREAKY_FACTOR = 2.5
OCTAVE_CREAKY_FACTORS = {0: 2.5, 2: 2.5, 4: 1.05}


def default_bonuses(hnr="hnr", creaky="creaky") -> list[tuple[Column, dict[int, float]]]:
    return [
        (F.col(hnr) < 0, {0: NOISE_FACTOR, 2: NOISE_FACTOR}),
        (F.col(creaky) == 1, {0: CREAKY_FACTOR, 2: CREAKY_FACTOR}),
    ]


def octave_bonuses(creaky="creaky") -> list[tuple[Column, dict[int, float]]]:
    return [(F.col(creaky) == 1, OCTAVE_CREAKY_FACTORS)]


def frame_median(cands: Sequence[str]) -> Column:
    """Median of the present candidates; NULL when more than half are missing."""
    present = F.array_sort(F.array_compact(F.array(*[F.col(c) for c in cands])))
    k = F.size(present)
    mid = (
        F.get(present, F.floor((k - 1) / 2).cast("int")) + F.get(present, F.floor(k / 2).cast("int"))
    ) / 2
    return F.when(k * 2 >= len(cands), mid)


def emission(
    frames: DataFrame,
    cands: Sequence[str],
    sim: Callable = cents_similarity,
    bonuses: Sequence[tuple[Column, dict[int, float]]] | None = None,
    vup: float = 0.5,
) -> DataFrame:
    """Adds ``cand`` and ``emis`` arrays: similarity of each candidate to the frame's median."""
    bonuses = default_bonuses() if bonuses is None else bonuses
    with_median = frames.withColumn("_med", frame_median(cands))
    scores = []
    for i, c in enumerate(cands):
        e = sim(F.col("_med"), F.col(c), vup)
        for cond, factors in bonuses:
            if i in factors:
                e = e * F.when(cond, F.lit(float(factors[i]))).otherwise(F.lit(1.0))
        scores.append(e)
    return (
        with_median.withColumn("cand", F.array(*[F.col(c) for c in cands]))
        .withColumn("emis", F.array(*scores))
        .drop("_med")
    )


def emission_octave(frames: DataFrame, cands: Sequence[str], sim: Callable, vup: float = 0.5) -> DataFrame:
    return emission(frames, cands, sim, octave_bonuses(), vup)


def transitions(frames: DataFrame, cands: Sequence[str], vup: float = 0.35, chunk: int = CHUNK) -> DataFrame:
    """Adds ``trans``: similarity of each previous candidate to each present one; NULL on the first frame."""
    w = Window.partitionBy("file", "_chunk").orderBy("frame_idx")
    halo = with_halo(frames, "frame_idx", chunk, 1)
    prev = halo.select(
        "*", *[F.lag(c).over(w).alias(f"_p{i}") for i, c in enumerate(cands)],
        F.lag(F.lit(1)).over(w).alias("_has"),
    ).filter("_own")
    matrix = F.array(
        *[F.array(*[cents_similarity(F.col(f"_p{i}"), F.col(c), vup) for c in cands]) for i in range(len(cands))]
    )
    return prev.withColumn("trans", F.when(F.col("_has").isNotNull(), matrix)).drop(
        "_own", "_chunk", "_has", *[f"_p{i}" for i in range(len(cands))]
    )


# ---- the fold: many runs of frames side by side ----------------------------------------
#
# A run is a whole file, or a chunk of a long one led by the last frame of the chunk
# before it. All runs of a group advance one frame per step, as numpy blocks.


def _similarities(a: np.ndarray, b: np.ndarray, vup: float) -> np.ndarray:
    """Similarity of every candidate to every one of the frame after, from their log2.

    Missing pitch is nan, pitch 0 is -inf: their differences are nan unless one
    is a plain number and the other 0, whose similarity is 0.
    """
    with np.errstate(invalid="ignore"):
        s = np.exp(-0.0012 * 1200 * np.abs(a[:, :, None] - b[:, None, :]))
    odd = np.isnan(s)
    if odd.any():
        one = np.isnan(a)[:, :, None] != np.isnan(b)[:, None, :]
        s = np.where(odd, np.where(one, vup, 1.0), s)
    return s


def _step(v: np.ndarray, t: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Best predecessor of each state of each run; equal scores go to the later one."""
    p = v[:, :, None] * t
    n = v.shape[1]
    if r == 1.0:
        near = p >= p.max(axis=1, keepdims=True) * (1 - TIE)
        ptr = n - 1 - np.argmax(near[:, ::-1], axis=1)
        return np.take_along_axis(p, ptr[:, None, :], 1)[:, 0], ptr
    best = np.zeros_like(v)
    ptr = np.zeros(v.shape, dtype=np.int64)
    for k in range(n):
        take = p[:, k] >= best * (1 - TIE)
        gain = p[:, k].copy()
        gain[:, k] *= r
        best, ptr = np.where(take, gain, best), np.where(take, k, ptr)
    return best, ptr


def _scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each run over their highest, and its logarithm (-inf if all are 0)."""
    top = v.max(axis=-1)
    with np.errstate(divide="ignore"):
        return v / np.where(top > 0, top, 1.0)[..., None], np.log(top)


def _best_state(v: np.ndarray) -> np.ndarray:
    """First of the best states of each run."""
    return np.argmax(v >= v.max(axis=-1, keepdims=True) * (1 - TIE), axis=-1)


class _Runs:
    """The runs of one group's rows: their frames and where each starts."""

    def __init__(self, pdf: pd.DataFrame, n: int):
        keys = [c for c in ("file", "_chunk") if c in pdf]
        self.pdf = pdf.sort_values([*keys, "frame_idx"], ignore_index=True)
        self.cand = self.pdf[[f"c{i}" for i in range(n)]].to_numpy(dtype=float)
        with np.errstate(divide="ignore"):
            self.octave = np.log2(self.cand)
        self.emis = self.pdf[[f"e{i}" for i in range(n)]].to_numpy(dtype=float)
        new = np.ones(len(pdf), dtype=bool)
        if len(pdf) > 1:
            k = self.pdf[keys]
            new[1:] = (k.iloc[1:].to_numpy() != k.iloc[:-1].to_numpy()).any(axis=1)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(pdf)))
        order = np.argsort(-size, kind="stable")  # runs still going are always the leading ones
        self.first, self.size, self.n = first[order], size[order], n
        self.keys = self.pdf.loc[self.first, keys].reset_index(drop=True)

    def going(self, m: int) -> np.ndarray:
        """Row of frame ``m`` of every run that has one."""
        return self.first[: int(np.searchsorted(-self.size, -m, side="left"))] + m

    def forward(self, v: np.ndarray, vup: float, r: float):
        """Final scores and logs of each run from its first row's scores; back pointers per row."""
        v, log = _scaled(v)
        ptrs = np.zeros(self.emis.shape, dtype=np.int64)
        for m in range(1, self.size[0]):
            at = self.going(m)
            best, ptrs[at] = _step(v[: len(at)], _similarities(self.octave[at - 1], self.octave[at], vup), r)
            v[: len(at)], s = _scaled(best * self.emis[at])
            log[: len(at)] += s
        return v, log, ptrs

    def transfer(self, vup: float):
        """Best score of each run from every first state to every last one (runs x N x N), and its log scale."""
        v = np.broadcast_to(np.eye(self.n), (len(self.first), self.n, self.n)).copy()
        log = np.zeros(len(self.first))
        for m in range(1, self.size[0]):
            at = self.going(m)
            t = _similarities(self.octave[at - 1], self.octave[at], vup)
            best = (v[: len(at), :, :, None] * t[:, None, :, :]).max(axis=2) * self.emis[at][:, None, :]
            flat, s = _scaled(best.reshape(len(at), -1))
            v[: len(at)] = flat.reshape(best.shape)
            log[: len(at)] += s
        return v, log

    def origins(self, ptrs: np.ndarray) -> np.ndarray:
        """For each last state of a run, the state of its path on the first row."""
        at_state = np.tile(np.arange(self.n), (len(self.first), 1))
        for m in range(self.size[0] - 1, 0, -1):
            at = self.going(m)
            at_state[: len(at)] = np.take_along_axis(ptrs[at], at_state[: len(at)], 1)
        return at_state

    def trace(self, ptrs: np.ndarray, last: np.ndarray) -> np.ndarray:
        """State of every row, given each run's last one."""
        states = np.zeros(len(self.pdf), dtype=np.int64)
        states[self.first + self.size - 1] = last
        for m in range(self.size[0] - 1, 0, -1):
            at = self.going(m)
            states[at - 1] = ptrs[at, states[at]]
        return states

    def per_row(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.pdf), dtype=values.dtype)
        for f, s, x in zip(self.first, self.size, values):
            out[f : f + s] = x
        return out

    def path(self, states: np.ndarray, log: np.ndarray) -> pd.DataFrame:
        log = self.per_row(log)
        out = self.pdf[["file", "frame_idx"]].assign(
            state=states.astype("int32"),
            candidate=self.cand[np.arange(len(states)), states],
            log_prob=np.where(np.isfinite(log), log, np.nan),
        )
        return out[self.pdf["_own"]] if "_own" in self.pdf else out


PATH_SCHEMA = "file string, frame_idx long, state int, candidate double, log_prob double"
STATE_SCHEMA = "file string, _chunk long, v array<double>, log double"


def _no_rows(*cols: str) -> pd.DataFrame:
    return pd.DataFrame(columns=list(cols), dtype=object)


def _whole_files(n: int, vup: float, r: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = _Runs(pdf, n)
        v, log, ptrs = runs.forward(runs.emis[runs.first], vup, r)
        return runs.path(runs.trace(ptrs, _best_state(v)), log)

    return run


def _entries(runs: _Runs, state: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Scores of every run's first row: those handed over, or a file's first emissions."""
    v, log = runs.emis[runs.first].copy(), np.zeros(len(runs.first))
    known = {(f, c): (x, s) for f, c, x, s in zip(state["file"], state["_chunk"], state["v"], state["log"])}
    for i, (f, c) in enumerate(zip(runs.keys["file"], runs.keys["_chunk"])):
        if c > 0:
            v[i], log[i] = known[(f, c)]
    return v, log


def _transfers(n: int, vup: float):
    """Chunk 0: its exit scores. Later chunks: their transfer."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = _Runs(pdf, n)
        m, log = runs.transfer(vup)
        start = runs.keys["_chunk"].to_numpy() == 0
        v, s = _scaled((runs.emis[runs.first][:, :, None] * m).max(axis=1))
        return runs.keys.assign(
            m=[x.tolist() if z else y.ravel().tolist() for x, y, z in zip(v, m, start)],
            log=np.where(start, log + s, log),
        )

    return run


def _scan_entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry scores of chunk c+1 from the transfers of chunks 0..c."""
    pdf = pdf.sort_values("_chunk")
    rows = []
    v, log = None, 0.0
    for chunk, m, s in zip(pdf["_chunk"], pdf["m"], pdf["log"]):
        m = np.asarray(m, dtype=float)
        if v is None:
            v, log = m, s
        else:
            v, top = _scaled((v[:, None] * m.reshape(len(v), len(v))).max(axis=0))
            log += s + top
        rows.append((pdf["file"].iloc[0], chunk + 1, v.tolist(), log))
    return pd.DataFrame(rows, columns=["file", "_chunk", "v", "log"])


def _exits(n: int, vup: float, r: float):
    """Exit scores of every chunk and the logarithm they gain, from the entries known or else guessed: its first row's emissions."""

    def run(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 0:
            return _no_rows("file", "_chunk", "entry", "exit", "gain")
        runs = _Runs(pdf, n)
        known = dict(zip(zip(state["file"], state["_chunk"]), state["entry"]))
        entry, first = _scaled(runs.emis[runs.first])
        for i, key in enumerate(zip(runs.keys["file"], runs.keys["_chunk"])):
            if key in known:
                entry[i] = known[key]
        v, gain, _ = runs.forward(entry.copy(), vup, r)
        gain = np.where(runs.keys["_chunk"].to_numpy() == 0, gain + first, gain)  # a file's first scores are its emissions
        return runs.keys.assign(entry=entry.tolist(), exit=v.tolist(), gain=gain)

    return run


EXIT_SCHEMA = "file string, _chunk long, entry array<double>, exit array<double>, gain double"
_SAME = 1e-12  # scores (the highest is 1) that count as unchanged


def _converged_entries(beside, cut: DataFrame, n: int, r: float, vup: float) -> DataFrame:
    """Entry scores of every chunk where steps are no products: all chunks run at once from guessed entries, then those whose
    entry turns out to be another run again, until none does.

    The best paths from different entries soon go through one state, and from there on the scores differ by a factor alone. So
    after few rounds a chunk's exit no longer depends on what came before it; at worst there are as many rounds as chunks."""
    spark = cut.sparkSession
    state = checkpoint(beside(cut, spark.createDataFrame([], "file string, _chunk long, entry array<double>"), _exits(n, vup, r), EXIT_SCHEMA))
    while True:
        before = state.select("file", (F.col("_chunk") + 1).alias("_chunk"), F.col("exit").alias("_now"))
        gap = F.array_max(F.zip_with("entry", "_now", lambda x, y: F.abs(x - y)))
        todo = checkpoint(state.join(before, ["file", "_chunk"]).where(gap > _SAME).select("file", "_chunk", F.col("_now").alias("entry")))
        if todo.isEmpty():
            break
        again = beside(cut.join(todo, ["file", "_chunk"], "left_semi"), todo, _exits(n, vup, r), EXIT_SCHEMA)
        state = checkpoint(state.join(todo, ["file", "_chunk"], "left_anti").unionByName(again))
    upto = Window.partitionBy("file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)  # one row per chunk
    return checkpoint(state.select("file", (F.col("_chunk") + 1).alias("_chunk"), F.col("exit").alias("v"), F.sum("gain").over(upto).alias("log")))


def _origins(n: int, vup: float, r: float):
    def run(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 0:
            return _no_rows("file", "_chunk", "origin", "best", "log")
        runs = _Runs(pdf, n)
        v, log = _entries(runs, state)
        v, gain, ptrs = runs.forward(v, vup, r)
        return runs.keys.assign(origin=runs.origins(ptrs).tolist(), best=_best_state(v), log=log + gain)

    return run


def _scan_exits(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_chunk", ascending=False)
    state, log = int(pdf["best"].iloc[0]), float(pdf["log"].iloc[0])
    rows = []
    for chunk, origin in zip(pdf["_chunk"], pdf["origin"]):
        rows.append((pdf["file"].iloc[0], chunk, state, log))
        state = int(origin[state])
    return pd.DataFrame(rows, columns=["file", "_chunk", "last", "total"])


def _trace_chunks(n: int, vup: float, r: float):
    def run(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 0:
            return _no_rows("file", "frame_idx", "state", "candidate", "log_prob")
        runs = _Runs(pdf, n)
        v, _ = _entries(runs, state)
        _, _, ptrs = runs.forward(v, vup, r)
        known = runs.keys.merge(state[["file", "_chunk", "last", "total"]], on=["file", "_chunk"], how="left")
        return runs.path(runs.trace(ptrs, known["last"].to_numpy()), known["total"].to_numpy(dtype=float))

    return run


def _long_paths(rows: DataFrame, n: int, r: float, vup: float, chunk: int, bins: int) -> DataFrame:
    k = F.floor(F.col("frame_idx") / F.lit(chunk)).cast("long")
    last = F.pmod(F.col("frame_idx"), F.lit(chunk)) == chunk - 1
    copies = F.array_compact(
        F.array(
            F.struct(k.alias("_chunk"), F.lit(True).alias("_own")),
            F.when(last, F.struct((k + 1).alias("_chunk"), F.lit(False).alias("_own"))),
        )
    )
    bin_of = F.pmod(F.xxhash64("file", "_chunk"), F.lit(bins)).alias("_bin")
    # A file that ends on a chunk's last frame leaves a chunk with no frame of its own.
    sizes = rows.groupBy("file").agg(F.floor((F.count(F.lit(1)) - 1) / F.lit(chunk)).alias("_lastc"))
    cut = rows.select("*", F.inline(copies)).join(sizes, "file").filter("_chunk <= _lastc").drop("_lastc")
    cut = cut.select("*", bin_of)

    def beside(chunks: DataFrame, state: DataFrame, fn, schema: str) -> DataFrame:
        side = state.select("*", bin_of)
        return chunks.groupBy("_bin").cogroup(side.groupBy("_bin")).applyInPandas(fn, schema)

    if r == 1.0:
        transfers = cut.groupBy("_bin").applyInPandas(
            _transfers(n, vup), "file string, _chunk long, m array<double>, log double"
        )
        entries = checkpoint(transfers.groupBy("file").applyInPandas(_scan_entries, STATE_SCHEMA))
    else:
        entries = _converged_entries(beside, cut, n, r, vup)
    origins = beside(
        cut, entries, _origins(n, vup, r), "file string, _chunk long, origin array<int>, best int, log double"
    )
    exits = origins.groupBy("file").applyInPandas(
        _scan_exits, "file string, _chunk long, last int, total double"
    )
    known = exits.join(entries, ["file", "_chunk"], "left")
    return beside(cut, known, _trace_chunks(n, vup, r), PATH_SCHEMA)


def viterbi_path(
    frames: DataFrame, reinforcement: float = 1.2, vup: float = 0.35, chunk: int = FOLD_CHUNK,
    n_cand: int | None = None, run_frames: int = RUN_FRAMES,
) -> DataFrame:
    """(file, frame_idx, state, candidate, log_prob) of the best path of each file.

    ``frames`` needs file, dense frame_idx, and the ``cand`` and ``emis`` arrays of
    ``n_cand`` entries (looked up if not given). Files of more than ``chunk``
    frames are cut.
    """
    n = n_cand or frames.select(F.size("cand")).first()[0]
    rows = frames.select(
        "file",
        "frame_idx",
        *[F.get("cand", F.lit(i)).alias(f"c{i}") for i in range(n)],
        *[F.get("emis", F.lit(i)).alias(f"e{i}") for i in range(n)],
    )
    r = float(reinforcement)
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    seen = sizes.agg(F.max("_n").alias("longest"), F.sum("_n").alias("frames")).first()
    # Runs share groups of about BIN_FRAMES frames, since the fold takes them side by side.
    spread = 4 * rows.sparkSession.sparkContext.defaultParallelism
    bins = max(spread, -(-(seen["frames"] or 0) // BIN_FRAMES))

    def whole(df: DataFrame) -> DataFrame:
        binned = df.withColumn("_bin", F.pmod(F.xxhash64("file"), F.lit(bins)))
        return binned.groupBy("_bin").applyInPandas(_whole_files(n, vup, r), PATH_SCHEMA)

    if (seen["longest"] or 0) <= chunk:
        return whole(rows)
    sized = rows.join(sizes, "file")
    short = sized.filter(F.col("_n") <= chunk).drop("_n")
    long = sized.filter(F.col("_n") > chunk).drop("_n")
    run = max(run_frames, -(-seen["longest"] // RUN_CHUNKS))
    return whole(short).unionByName(_long_paths(long, n, r, vup, min(chunk, run), bins))


def viterbi_track(
    frames: DataFrame, cands: Sequence[str], preds: Sequence[str], reinforcement: float = 1.0,
    vup: float = 0.5, chunk: int = FOLD_CHUNK,
) -> DataFrame:
    """Voicing choice, emission, path and unvoicing; names the winning tracker."""
    voiced = voice_fallback(frames, preds)
    path = viterbi_path(emission(voiced, cands, vup=vup), reinforcement, vup, chunk, len(cands))
    names = {str(i): c for i, c in enumerate(cands)}
    return path.join(voiced.select("file", "frame_idx", "voice"), ["file", "frame_idx"]).select(
        "file",
        "frame_idx",
        F.col("state").alias("winning_path"),
        F.col("candidate").alias("winning_candidate"),
        unvoice("candidate", "voice").alias("unvoiced_path"),
        remap_map(F.col("state").cast("string"), names).alias("tracker"),
    )
