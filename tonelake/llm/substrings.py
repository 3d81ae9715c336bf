"""Removal of word passages that an earlier document has too.

A window is ``size`` consecutive words of one document. Every window gets a Rabin-Karp hash; Spark brings
equal hashes together; a word goes if a window over it also starts in a document with a smaller number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tonelake.llm.texts import chunks, mixed, text_bytes, window_hashes, word_hashes, words
from tonelake.llm.worker import release

WINDOW = 13
BUCKET_BYTES = 4_000_000  # text whose windows make one bucket
_TEXT_BYTES = 4_000_000
_HASH_BYTES = 7
_BOTH = np.uint64(0xFF51AFD7ED558CCD)

#: A packed row: windows of many documents in one bucket (or words to remove, in one group of documents).
_PACKED = "bucket long, docs binary, marks binary, counts binary, places binary, hashes binary"
_ARROW = pa.schema([("bucket", pa.int64())] + [(n, pa.binary()) for n in ("docs", "marks", "counts", "places", "hashes")])
_LAST = np.int64(2**63 - 1)


def _squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as compressed differences (sign in the lowest bit), one byte plane after the other."""
    d = np.diff(values.astype(np.int64), prepend=0)
    planes = ((d << 1) ^ (d >> 63)).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expand(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    d = np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum((d >> np.uint64(1)).view(np.int64) ^ -(d & np.uint64(1)).view(np.int64))


def _group(doc: np.ndarray, mark: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that a row belongs to; ``_group_column`` is the same rule in Spark."""
    return (doc ^ (doc >> 17) ^ mark) % groups


def _group_column(doc, mark, groups: int):
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 17)).bitwiseXOR(mark.cast("long")), F.lit(groups))


def _rows(bucket, doc, mark, place, hashes=None):
    """Entries sorted by (bucket, document) as packed rows, one per bucket."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if lo == hi:
            continue
        d, m = doc[lo:hi], mark[lo:hi]
        first = np.concatenate([[0], np.flatnonzero((np.diff(d) != 0) | (np.diff(m) != 0)) + 1])
        yield {
            "bucket": int(bucket[lo]),
            "docs": _squeeze(d[first]),
            "marks": m[first].astype("<i4").tobytes(),
            "counts": _squeeze(np.diff(np.append(first, hi - lo))),
            "places": _squeeze(place[lo:hi]),
            "hashes": b"" if hashes is None else hashes[lo:hi, :_HASH_BYTES].tobytes(),
        }


def _entries(table: pa.Table):
    """The entries of packed rows: document, mark, place and hash."""
    docs, marks, places, hashes = [], [], [], []
    for r in table.to_pylist():
        n = _expand(r["counts"])
        docs.append(np.repeat(_expand(r["docs"]), n))
        marks.append(np.repeat(np.frombuffer(r["marks"], "<i4").astype(np.int64), n))
        places.append(_expand(r["places"]))
        h = np.zeros((len(places[-1]), 8), np.uint8)
        if r["hashes"]:
            h[:, :_HASH_BYTES] = np.frombuffer(r["hashes"], np.uint8).reshape(-1, _HASH_BYTES)
        hashes.append(h.view("<u8").ravel())
    return tuple(np.concatenate(x) for x in (docs, marks, places, hashes))


def _covered(places: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the places."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, np.minimum(places + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = WINDOW,
    keep: tuple[str, ...] = (),
    whole: bool = False,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per document: number, the ``keep`` columns, ``n_words``, ``n_removed``, ``removed`` (the maximal
    intervals of removed words, as start, end, start, end ...) and ``kept_text`` (kept words joined by one space; with
    ``whole`` the text of a document that loses nothing stays as it is, a null one null).

    * A null text has no words; texts under ``size`` words have no windows and stay.
    * Of equal passages only those of the smallest number stay, also where that document is repeated: rows with
      the same number do not remove each other's words. A null number counts as larger than any other.
    * Further columns are ignored, unless named in ``keep``; an empty table gives an empty one.

    Each batch of documents first settles what it can by itself: of equal windows only those of its smallest document
    go on to the shuffle, so a passage in very many documents is sent once per batch. Windows travel packed by bucket,
    in as many buckets as the text has ``bucket_bytes``. A window is told by its bucket (one hash) and 56 bits of another:
    the chance of a wrong match per window does not grow with the data. The removals of a document come back to its text by a join.
    """
    spark = docs.sparkSession
    number = docs[id_col].cast("long")
    text = docs[text_col].cast("string")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(16, -(-total // bucket_bytes))
    key = F.coalesce(number, F.lit(int(_LAST)))
    mark = F.pmod(F.xxhash64(text), F.lit(2**31 - 1)).cast("int")
    rows = docs.select(key.alias("doc"), mark.alias("mark"), text.alias("text"))

    def windows(batches):
        for t in chunks(batches, _TEXT_BYTES):
            t = t.take(pc.sort_indices(t, [("doc", "ascending")])).combine_chunks()
            data, at = text_bytes(t["text"])
            starts, ends, before = words(data, at)
            hashes = tuple(word_hashes(data, starts, ends, kind) for kind in (0, 1))
            one, two, first = window_hashes(hashes, before, size)
            del data, starts, ends, hashes
            if not len(first):
                continue
            row = np.searchsorted(before, first, side="right") - 1
            doc_of, mark_of = t["doc"].to_numpy(), t["mark"].to_numpy().astype(np.int64)
            place, doc = first - before[row], doc_of[row]
            order = np.argsort(one, kind="stable")  # rows ascend, so the smallest document leads each run
            h, h2 = one[order], two[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
            one = mixed(one + two * _BOTH)  # tells a window apart even where one of the hashes is shared
            lead = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            settled = np.zeros(len(h), bool)
            settled[order] = lead != doc[order]
            del h, h2, new, lead, order
            out = []
            go = np.flatnonzero(~settled)
            bucket = (two[go] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            go = go[by]
            low = one[go].astype("<u8").view(np.uint8).reshape(-1, 8)
            out += _rows(bucket[by], doc[go], mark_of[row[go]], place[go], low)
            del one, two, first, low, go, by, bucket
            done = np.flatnonzero(settled)
            if len(done):
                m = mark_of[row[done]]
                g = _group(doc[done], m, buckets)
                by = np.argsort(g, kind="stable")
                out += _rows(g[by], doc[done][by], m[by], place[done][by])
            del row, doc, place, settled, done
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    def match(table: pa.Table) -> pa.Table:
        """A bucket's windows that have an equal one in a smaller document; settled rows go through."""
        has = pc.greater(pc.binary_length(table["hashes"]), 0)
        through = table.filter(pc.invert(has))
        table = table.filter(has)
        if not table.num_rows:
            return through
        doc, mark_, place, h = _entries(table)
        order = np.argsort(h, kind="stable")
        hs = h[order]
        run = np.concatenate([[0], np.flatnonzero(hs[1:] != hs[:-1]) + 1])
        least = np.minimum.reduceat(doc[order], run)
        gone = order[doc[order] > np.repeat(least, np.diff(np.append(run, len(hs))))]
        doc, mark_, place = doc[gone], mark_[gone], place[gone]
        g = _group(doc, mark_, buckets)
        by = np.lexsort((place, mark_, doc, g))
        found = pa.Table.from_pylist(list(_rows(g[by], doc[by], mark_[by], place[by])), schema=_ARROW)
        return pa.concat_tables([through.cast(_ARROW), found])

    removals = rows.mapInArrow(windows, _PACKED).groupBy("bucket").applyInArrow(match, _PACKED)

    kept_cols = [docs[c] for c in keep]
    names = [f"_keep{i}" for i in range(len(keep))]
    group = _group_column(key, mark, buckets).alias("bucket")
    full = docs.select(number.alias("_id"), key.alias("doc"), mark.alias("mark"), group, text.alias("text"), *[c.alias(n) for c, n in zip(kept_cols, names)])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        """The documents of one group without the words that go."""
        gone: dict[tuple[int, int], np.ndarray] = {}
        if right.num_rows:
            doc, mark_, place, _ = _entries(right)
            order = np.lexsort((mark_, doc))
            d, m, p = doc[order], mark_[order], place[order]
            cut = np.concatenate([[0], np.flatnonzero((np.diff(d) != 0) | (np.diff(m) != 0)) + 1, [len(d)]])
            gone = {(int(d[a]), int(m[a])): p[a:b] for a, b in zip(cut[:-1], cut[1:])}
        n_words, n_removed, removed, kept = [], [], [], []
        for doc, mark_, text_ in zip(left["doc"].to_pylist(), left["mark"].to_pylist(), left["text"].to_pylist()):
            ws = (text_ or "").encode().split()
            places = gone.get((doc, mark_))
            spans = []
            if places is not None:
                mask = _covered(places, len(ws), size)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                spans = edges.tolist()
                ws_kept = []
                for a, b in zip([0, *spans[1::2]], [*spans[::2], len(ws)]):
                    ws_kept += ws[a:b]
            else:
                ws_kept = ws
            n_words.append(len(ws))
            n_removed.append(len(ws) - len(ws_kept))
            removed.append(spans)
            kept.append(text_ if whole and not spans else b" ".join(ws_kept).decode())
        del gone
        release()
        out = {"_id": left["_id"], **{n: left[n] for n in names}}
        out["n_words"] = pa.array(n_words, pa.int64())
        out["n_removed"] = pa.array(n_removed, pa.int64())
        out["removed"] = pa.array(removed, pa.list_(pa.int32()))
        out["kept_text"] = pa.array(kept, pa.string())
        return pa.table(out)

    schema = full.select("_id", *names).schema.add("n_words", "long").add("n_removed", "long").add("removed", ArrayType(IntegerType())).add("kept_text", "string")
    result = full.groupBy("bucket").cogroup(removals.groupBy("bucket")).applyInArrow(remove, schema)
    return result.withColumnsRenamed({"_id": id_col, **dict(zip(names, keep))})


def op2_substring_dedup(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
