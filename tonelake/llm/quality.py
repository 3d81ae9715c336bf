"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.store import written
from tonelake.llm.texts import chunks, lower, mixed, text_bytes, word_hashes, words

DIMENSIONS = 48
WORD_TERMS = 16_384
SHAPE_TERMS = 4096
TERMS = WORD_TERMS + SHAPE_TERMS
SAMPLE_PER_LABEL = 2500
NEIGHBOURS = 15
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
_TEXT_BYTES = 4_000_000
SAMPLE_CELLS = 10_000_000  # terms of all sampled texts together that are learned from
_BLOCK = 64  # documents whose terms stand in one dense block

#: Character classes: capitals, other letters, digits; any other byte is its own class.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[48:58] = 48
_PART = np.arange(256) >= 128  # bytes of characters beyond ASCII have no class
#: Bytes that tell words apart: letters, digits and everything beyond ASCII.
_OWN = _PART | np.isin(_SHAPE, (65, 97, 48))


def text_terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and term of every token. The first ``WORD_TERMS`` terms are the words themselves (hashed, A-Z as a-z, without
    punctuation) and the pairs of neighbours; ``SHAPE_TERMS`` further ones tell how words look: a word's shape (runs of one
    class as one), the pair of it and the next word's, and whether a word repeats the one before."""
    starts, ends, before = words(data, at)
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))
    if not len(row):
        return row, row
    inner = row[1:] == row[:-1]
    own = _OWN[data]
    left = np.concatenate([[0], np.cumsum(own)])
    name = word_hashes(lower(data)[own], left[starts], left[ends])
    name_pair = mixed(name[:-1] * np.uint64(3) + name[1:])[inner]
    whole = word_hashes(data, starts, ends)
    same = np.zeros(len(row), bool)
    same[1:] = (whole[1:] == whole[:-1]) & inner
    kind = _SHAPE[data]
    stay = ~_PART[data]
    stay[1:] &= (kind[1:] != kind[:-1]) | _PART[data[:-1]]
    stay[starts] |= ~_PART[data[starts]]
    kept = np.concatenate([[0], np.cumsum(stay)])
    shape = word_hashes(kind[stay], kept[starts], kept[ends])
    shape = mixed(shape ^ same.astype(np.uint64))
    pair = mixed(shape[:-1] * np.uint64(3) + shape[1:])[inner]
    names = np.concatenate([name, name_pair]) % np.uint64(WORD_TERMS)
    shapes = np.concatenate([shape, pair]) % np.uint64(SHAPE_TERMS) + np.uint64(WORD_TERMS)
    return np.concatenate([row, row[:-1][inner]] * 2), np.concatenate([names, shapes]).astype(np.int64)


def term_weights(column) -> np.ndarray:
    """Square roots of the term rates of every text, one row each: words and shapes have length 1 each, and so has the row;
    a text without words is all zero."""
    data, at = text_bytes(column)
    row, term = text_terms(data, at)
    n = len(at) - 1
    out = np.zeros(n * TERMS, np.float32)
    cell, count = np.unique(row * TERMS + term, return_counts=True)
    out[cell] = np.sqrt(count)
    out = out.reshape(n, TERMS)
    for part in (out[:, :WORD_TERMS], out[:, WORD_TERMS:]):
        length = np.linalg.norm(part, axis=1, keepdims=True) * np.float32(2**0.5)
        np.divide(part, length, out=part, where=length > 0)
    return out


class SparseRows:
    """Rows of weights of which only those over zero are kept; a slice is a dense block."""

    def __init__(self, at: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.at, self.term, self.weight = at, term, weight
        self.shape = (len(at) - 1, TERMS)

    def __len__(self):
        return self.shape[0]

    def __getitem__(self, rows: slice) -> np.ndarray:
        lo, hi, _ = rows.indices(len(self))
        out = np.zeros((hi - lo, TERMS), np.float32)
        cells = slice(self.at[lo], self.at[hi])
        out[np.repeat(np.arange(hi - lo), np.diff(self.at[lo : hi + 1])), self.term[cells]] = self.weight[cells]
        return out


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 1e-9)


class NeighbourVote:
    """Latent-semantic vectors of labelled texts, and the vote of the nearest."""

    def __init__(self, weights: np.ndarray | SparseRows, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS):
        n, width = weights.shape
        blocks = [slice(lo, lo + _BLOCK) for lo in range(0, n, _BLOCK)]
        seen = sum(((weights[b] > 0).sum(axis=0) for b in blocks), np.zeros(width, np.int64))
        self.idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + 1

        def times(right):
            return np.concatenate([(weights[b] * self.idf) @ right for b in blocks])

        def transposed(left):
            return sum((weights[b] * self.idf).T @ left[b] for b in blocks)

        rng = np.random.default_rng(0)
        d = min(dimensions, n, width)
        if d:
            y = times(rng.standard_normal((width, d + 8)).astype(np.float32))
            for _ in range(4):  # power rounds of the randomised decomposition
                q, _r = np.linalg.qr(y)
                y = times(transposed(q))
            q, _r = np.linalg.qr(y)
            _u, _s, vt = np.linalg.svd(transposed(q).T, full_matrices=False)
            self.project = np.ascontiguousarray(vt[:d].T)
        else:
            self.project = np.zeros((TERMS, 1), np.float32)
        self.vectors = np.ascontiguousarray(unit(times(self.project)).T) if d else np.zeros((1, 0), np.float32)
        self.labels = labels.astype(np.float32)
        self.k = min(neighbours, len(labels))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Share of label 1 among the ``k`` nearest, weighted by similarity; all that tie with the last one vote too.
        Without labels, or for a text with no known term, the share of label 1 among all labelled texts (0.5 without)."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(weights), prior)
        if not self.k:
            return out
        v = unit(weights @ (self.idf[:, None] * self.project))
        for lo in range(0, len(v), _BLOCK):
            sim = v[lo : lo + _BLOCK] @ self.vectors
            least = np.partition(sim, -self.k, axis=1)[:, -self.k, None]
            vote = np.where(sim >= least - 1e-6, np.maximum(sim, 0.0), 0.0)
            total = vote.sum(axis=1)
            known = np.flatnonzero((total > 0) & (np.abs(v[lo : lo + _BLOCK]).sum(axis=1) > 0))
            out[lo + known] = (vote[known] @ self.labels) / total[known]
        return np.clip(out, 0.0, 1.0)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_label: int = SAMPLE_PER_LABEL,
    max_cells: int = SAMPLE_CELLS,
) -> NeighbourVote:
    """Learns from a bounded sample: up to ``per_label`` documents of each label, the first by a hash of their number,
    and of these, in that order, as many as have ``max_cells`` terms (one at least).

    A number with several labels counts with the lowest, one with several texts with that of the smallest hash, then the
    smallest; rows without number or label are left out. Rows whose crc32 of the number leaves ``HELD_OUT`` modulo
    ``FOLDS`` are never learned from.
    """
    clean = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).dropna()
    clean = clean.where(F.col("label").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT))
    clean = clean.groupBy("doc_id").agg(F.min("label").alias("label"))
    rank = F.md5(F.concat(F.lit("quality-"), F.col("doc_id").cast("string")))
    picked = [clean.where(F.col("label") == v).orderBy(rank, "doc_id").limit(per_label) for v in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_label rows of two numbers
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).join(picked, "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))

    def weigh(batches):
        for c in chunks(batches, _TEXT_BYTES):
            for lo in range(0, c.num_rows, _BLOCK):
                t = c.slice(lo, _BLOCK)
                w = term_weights(t["text"])
                at, term = np.nonzero(w)
                n = np.bincount(at, minlength=len(w))
                cut = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": t["doc_id"].combine_chunks(),
                        "label": t["label"].combine_chunks(),
                        "terms": pa.ListArray.from_arrays(pa.array(cut), pa.array(term, pa.int32())),
                        "weights": pa.ListArray.from_arrays(pa.array(cut), pa.array(w[at, term], pa.float32())),
                    }
                )

    found = written(rows.mapInArrow(weigh, "doc_id long, label int, terms array<int>, weights array<float>"), "quality-terms")
    sizes = found.select("doc_id", F.size("terms").alias("n")).orderBy(rank, "doc_id").collect()  # 2 * per_label rows
    whole = np.cumsum([r["n"] for r in sizes]) <= max_cells
    if len(whole) and not whole.all():
        found = found.where(F.col("doc_id").isin([r["doc_id"] for r, ok in zip(sizes, whole) if ok] or [sizes[0]["doc_id"]]))
    found = found.toArrow().sort_by("doc_id").combine_chunks()
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(found["terms"]).to_numpy())]).astype(np.int64)
    term, weight = (pc.list_flatten(found[c]).to_numpy() for c in ("terms", "weights"))
    return NeighbourVote(SparseRows(at, term, weight), found["label"].to_numpy().astype(np.int64))


def score_documents(docs: DataFrame, model: NeighbourVote, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row, from its text alone, and its columns ``keep``.

    Null, empty and blank texts get the share of label 1 in the sample learned from. Every document's products with all
    labelled vectors are made, in blocks. The model (two labels' samples of ``DIMENSIONS`` numbers and the projection,
    about 5 MB) goes to every task. Null numbers give a null ``held_out``; repeated rows get equal scores;
    further columns are ignored, unless named in ``keep``; an empty table gives an empty one.
    """
    names = [f"_keep{i}" for i in range(len(keep))]
    sent = {n: "text" if c == text_col and dict(docs.dtypes)[c] == "string" else n for c, n in zip(keep, names)}  # the text goes once
    kept = [docs[c].alias(n) for c, n in zip(keep, names) if sent[n] == n]
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *kept)
    schema = docs.select(docs[id_col].cast("long").alias("doc_id"), *[docs[c].alias(n) for c, n in zip(keep, names)]).schema.add("score", "double")

    def score(batches):
        for t in chunks(batches, _TEXT_BYTES):
            s = np.concatenate([model.scores(term_weights(t["text"].slice(lo, _BLOCK))) for lo in range(0, t.num_rows, _BLOCK)])
            yield pa.RecordBatch.from_pydict({"doc_id": t["doc_id"].combine_chunks(), **{n: t[c].combine_chunks() for n, c in sent.items()}, "score": pa.array(s)})

    out = rows.mapInArrow(score, schema)
    return out.select(
        "doc_id",
        *[F.col(n).alias(c) for c, n in zip(keep, names) if c != "doc_id"],
        (F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op6_quality_classifier(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, fit(docs, labels))
