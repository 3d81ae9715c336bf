"""Language-model scores by Brown class-based bigrams.

The corpus is encoded once, in batches: a batch's distinct words (as 64-bit hashes) and its texts as indices into them.
Counts are made per word over all batches and come back to every batch, so no vocabulary is ever in one place.

Classes: exchange clustering puts the ``frequent`` most frequent words into ``classes`` classes. Every other training word is then
exchanged in Spark, per bucket of words: from the classes it stands behind and in front of over the whole corpus it goes into the
class that most raises the likelihood. The end of a text is a class of its own.
A word's probability is P(class | class before) * P(word | class); each class keeps the share of its words seen once for
unknown ones, and an unknown word counts as one of these.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.store import written
from tonelake.llm.texts import chunks, lower, text_bytes, word_hashes, words

FOLDS, HELD_OUT = 5, 1
FREQUENT = 1000
CLASSES = 48
ROUNDS = 4
TOPS = 64  # buckets whose most frequent words are merged at once
BUCKET_BYTES = 32_000_000
_TEXT_BYTES = 4_000_000
END_HASH = np.uint64(0)  # no word has it: see _hashes

_BATCH = "batch long, docs binary, lens binary, train binary, seq binary, dict binary, times binary"


def _zip(a: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype(kind)).tobytes())


def _unzip(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _hashes(data, starts, ends) -> np.ndarray:
    return np.maximum(word_hashes(data, starts, ends), np.uint64(1))


def encode(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The corpus in batches. ``dict`` is sorted; ``seq`` counts its entries from 1, and 0 is the end of a text;
    ``times`` is how often each entry stands in the batch's training texts."""
    number = docs[id_col].cast("long")
    train = F.coalesce(F.crc32(number.cast("string")) % FOLDS != HELD_OUT, F.lit(True))
    rows = docs.select(number.alias("doc_id"), docs[text_col].cast("string").alias("text"), train.alias("train"))

    def pack(batches):
        batch = TaskContext.get().partitionId() << 32
        for t in chunks(batches, _TEXT_BYTES):
            data, at = text_bytes(t["text"])
            data = lower(data)
            starts, ends, before = words(data, at)
            known, index = np.unique(_hashes(data, starts, ends), return_inverse=True)
            learn = t["train"].to_numpy(zero_copy_only=False)
            lens = np.diff(before)
            times = np.bincount(index[np.repeat(learn, lens)], minlength=len(known))
            seq = np.insert(index + 1, before[1:], 0)
            numbers = t["doc_id"].combine_chunks()
            row = {"docs": _zip(numbers.fill_null(0).to_numpy(), "<i8") + bytes(), "lens": _zip(lens, "<i8")}
            row["train"] = _zip(learn * 1 + 2 * numbers.is_null().to_numpy(zero_copy_only=False), "<u1")
            row |= {"seq": _zip(seq, "<u4"), "dict": _zip(known, "<u8"), "times": _zip(times, "<u4")}
            yield pa.RecordBatch.from_pylist([{"batch": batch, **row}], schema=_BATCH_ARROW)
            batch += 1

    return written(rows.mapInArrow(pack, _BATCH), "encoded")


_BATCH_ARROW = pa.schema([("batch", pa.int64())] + [(n, pa.binary()) for n in ("docs", "lens", "train", "seq", "dict", "times")])
_ASKED = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("dict", pa.binary()), ("times", pa.binary())])
_TOLD = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("top", pa.binary()), ("sums", pa.binary())])


def count_words(encoded: DataFrame, buckets: int, frequent: int) -> DataFrame:
    """For every batch and bucket of hashes, the corpus counts of the batch's words there, in hash order. One more row
    per bucket (batch -1): its ``frequent`` most frequent words with their counts, and its sums
    (tokens, distinct words, words seen once, seen twice)."""
    edge = (1 << 64) // buckets + 1

    def ask(batches):
        for b in batches:
            for r in b.to_pylist():
                h, times = _unzip(r["dict"], "<u8"), _unzip(r["times"], "<u4")
                cuts = np.searchsorted(h, np.array([min(i * edge, (1 << 64) - 1) for i in range(1, buckets)], np.uint64))
                parts = [
                    {"bucket": i, "batch": r["batch"], "dict": x.tobytes(), "times": _zip(n, "<u4")}
                    for i, (x, n) in enumerate(zip(np.split(h, cuts), np.split(times, cuts)))
                    if len(x)
                ]
                if parts:
                    yield pa.RecordBatch.from_pylist(parts, schema=_ASKED)

    def tell(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, "<u8") for x in table["dict"].to_pylist()]
        known, back = np.unique(np.concatenate(hashes), return_inverse=True)
        times = np.concatenate([_unzip(x, "<u4") for x in table["times"].to_pylist()])
        total = np.bincount(back, weights=times, minlength=len(known)).astype(np.int64)
        ends = np.cumsum([len(h) for h in hashes])
        counts = [_zip(total[p], "<u8") for p in np.split(back, ends[:-1])]
        best = np.lexsort((known, -total))[:frequent]
        best = best[total[best] > 0]
        sums = np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()])
        bucket = table["bucket"][0].as_py()
        out = [{"batch": b, "bucket": bucket, "counts": c} for b, c in zip(table["batch"].to_pylist(), counts)]
        out.append({"batch": -1, "bucket": bucket, "top": known[best].astype("<u8").tobytes() + total[best].astype("<u8").tobytes(), "sums": sums.astype("<i8").tobytes()})
        return pa.Table.from_pylist(out, schema=_TOLD)

    asked = encoded.select("batch", "dict", "times").mapInArrow(ask, "bucket long, batch long, dict binary, times binary")
    return written(asked.groupBy("bucket").applyInArrow(tell, "batch long, bucket long, counts binary, top binary, sums binary"), "word-counts")


def top_words(told: DataFrame, buckets: int, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``frequent`` most frequent words of all, their counts, and the sums. Buckets are merged ``TOPS`` at a time, so that
    no task and not the driver holds more than that many lists."""
    schema = "bucket long, top binary, sums binary"

    def merge(table: pa.Table) -> pa.Table:
        pairs = np.concatenate([np.frombuffer(x, "<u8").reshape(2, -1) for x in table["top"].to_pylist()], axis=1)
        pairs = pairs[:, np.lexsort((pairs[0], -pairs[1].astype(np.int64)))[:frequent]]
        sums = sum(np.frombuffer(x, "<i8") for x in table["sums"].to_pylist())
        row = {"bucket": table["bucket"][0].as_py() // TOPS, "top": np.ascontiguousarray(pairs).tobytes(), "sums": sums.astype("<i8").tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([("bucket", pa.int64()), ("top", pa.binary()), ("sums", pa.binary())]))

    heads = told.where("batch < 0").select("bucket", "top", "sums")
    while buckets > TOPS:
        heads = written(heads.groupBy(F.floor(F.col("bucket") / TOPS).alias("of")).applyInArrow(merge, schema), "top-words")
        buckets = -(-buckets // TOPS)
    found = heads.toArrow()
    if not found.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(4, np.int64)
    last = merge(found)
    pairs = np.frombuffer(last["top"][0].as_py(), "<u8").reshape(2, -1)
    return pairs[0], pairs[1].astype(np.int64), np.frombuffer(last["sums"][0].as_py(), "<i8")


def _likelihood(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n * np.log(np.maximum(n, 1)), 0.0)


def exchange(bigrams: np.ndarray, movable: int, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every symbol. The first ``movable`` symbols are moved, one after the other, to the class (of the first
    ``classes``) that most raises the likelihood of the class bigrams, until a round moves none; every other symbol
    is a class of its own. Ties keep the class or take the lowest."""
    n = len(bigrams)
    classes = max(1, min(classes, movable))
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(n - movable)])
    k = classes + n - movable
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    big = bigrams.astype(np.float64)
    table = member.T @ big @ member
    inner = np.arange(classes)
    for _ in range(rounds):
        moves = 0
        for w in range(movable):
            here = of[w]
            out_w, in_w, own = big[w] @ member, big[:, w] @ member, big[w, w]
            out_w[here] -= own
            in_w[here] -= own
            base = table.copy()  # without w
            base[here] -= out_w
            base[:, here] -= in_w
            base[here, here] -= own
            row, col = base.sum(axis=1), base.sum(axis=0)
            # Putting w into class c changes row c, column c and their totals.
            gain = (_likelihood(base[inner] + out_w) - _likelihood(base[inner])).sum(axis=1)
            gain += (_likelihood(base[:, inner] + in_w[:, None]) - _likelihood(base[:, inner])).sum(axis=0)
            diag = base[inner, inner]
            gain += _likelihood(diag + out_w[inner] + in_w[inner] + own) + _likelihood(diag)
            gain -= _likelihood(diag + out_w[inner]) + _likelihood(diag + in_w[inner])
            gain -= _likelihood(row[inner] + out_w.sum() + own) - _likelihood(row[inner])
            gain -= _likelihood(col[inner] + in_w.sum() + own) - _likelihood(col[inner])
            best = int(gain.argmax())
            if gain[best] <= gain[here] + 1e-9:
                best = here
            moves += best != here
            table = base
            table[best] += out_w
            table[:, best] += in_w
            table[best, best] += own
            member[w, here], member[w, best], of[w] = 0, 1, best
        if not moves:
            break
    return of


class _Frequent:
    """The symbols of the clustering: the frequent words, any other word, and the end of a text."""

    def __init__(self, top: np.ndarray):
        order = np.argsort(top)
        self.sorted, self.at = top[order], order
        self.other = len(top)
        self.end = self.other + 1
        self.size = self.end + 1

    def of(self, known: np.ndarray) -> np.ndarray:
        """Symbol of each word of a batch's sorted dictionary, then that of the end."""
        out = np.full(len(known) + 1, self.other)
        out[-1] = self.end
        if self.other:
            at = np.minimum(np.searchsorted(self.sorted, known), self.other - 1)
            hit = self.sorted[at] == known
            out[:-1][hit] = self.at[at[hit]]
        return out


def _open(r: dict):
    return _unzip(r["seq"], "<u4").astype(np.int64), _unzip(r["lens"], "<i8"), _unzip(r["train"], "<u1")


def _sums(batches: DataFrame, of, size: int) -> tuple[np.ndarray, int]:
    """How often each symbol follows each in the training texts, and the number of these. ``of(row)`` gives the symbols of
    a batch's dictionary and, last, of the end. ``size`` ** 2 sums at most reach the driver."""

    def pairs(part):
        found = np.zeros(size * size, np.int64)
        texts = 0
        for b in part:
            for r in b.to_pylist():
                seq, lens, train = _open(r)
                symbol = of(r)
                s = symbol[seq - 1][np.repeat(train & 1 == 1, lens + 1)]  # whole texts, so each still follows an end
                if len(s):
                    found += np.bincount(np.concatenate([symbol[-1:], s[:-1]]) * size + s, minlength=size * size)
                texts += int((train & 1).sum())
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], texts))], names=["key", "n"])

    learned = batches.mapInArrow(pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = learned["key"].to_numpy(), learned["n"].to_numpy()
    out = np.zeros(size * size)
    out[keys[keys >= 0]] = n[keys >= 0]
    return out.reshape(size, size), int(n[keys < 0].sum())


_SEEN = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("dict", pa.binary()), ("number", pa.binary()), ("beside", pa.binary())])
_CLASSED = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("classes", pa.binary())])


def exchange_rest(encoded: DataFrame, buckets: int, symbols: _Frequent, of: np.ndarray, table: np.ndarray) -> DataFrame:
    """For every batch and bucket of hashes, the classes of the batch's words there, in hash order.

    ``of`` are the classes of the symbols, ``table`` the class bigrams. A frequent word keeps its class. Another word's neighbours
    are added up over all batches, and it goes into the class that raises the likelihood of these bigrams most (ties: the
    lowest); a word without any in the training texts goes where most of the others would."""
    kinds = len(table)
    classes = int(of[: symbols.other].max(initial=-1)) + 1 or 1
    edge = (1 << 64) // buckets + 1
    row, col = table.sum(axis=1), table.sum(axis=0)
    # What a bigram with a class before, or behind, is worth to each class.
    behind = np.log(table[:, :classes] + 0.5) - np.log(row[:, None] + 0.5 * classes) - np.log(col[None, :classes] + 0.5 * kinds)
    front = np.log(table[:classes] + 0.5) - np.log(row[:classes, None] + 0.5 * kinds) - np.log(col[None] + 0.5 * classes)
    worth = (np.concatenate([behind, front.T]) + math.log(table.sum() + 1)).astype(np.float32)

    def ask(batches):
        for b in batches:
            for r in b.to_pylist():
                seq, lens, train = _open(r)
                known = _unzip(r["dict"], "<u8")
                symbol = symbols.of(known)
                cls = of[symbol]
                learn = np.repeat(train & 1 == 1, lens + 1)
                s = seq[learn]  # texts follow each other, an end between
                word = np.flatnonzero(s > 0)
                word = word[symbol[s[word] - 1] == symbols.other]
                last = np.concatenate([[0], s[:-1]])[word]
                index = np.concatenate([s[word], s[word]]) - 1
                beside = np.concatenate([cls[last - 1], kinds + cls[s[word + 1] - 1]])
                order = np.argsort(index * (2 * kinds) + beside, kind="stable")
                index, beside = index[order], beside[order]
                number = np.bincount(index, minlength=len(known))
                cuts = np.searchsorted(known, np.array([min(i * edge, (1 << 64) - 1) for i in range(1, buckets)], np.uint64))
                ends = np.cumsum(number)
                parts, lo = [], 0
                for i, hi in enumerate([*cuts.tolist(), len(known)]):
                    if hi > lo:
                        x = beside[ends[lo - 1] if lo else 0 : ends[hi - 1]]
                        parts.append({"bucket": i, "batch": r["batch"], "dict": known[lo:hi].tobytes(), "number": _zip(number[lo:hi], "<u4"), "beside": _zip(x, "<u2")})
                    lo = hi
                if parts:
                    yield pa.RecordBatch.from_pylist(parts, schema=_SEEN)

    def tell(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, "<u8") for x in table["dict"].to_pylist()]
        known, back = np.unique(np.concatenate(hashes), return_inverse=True)
        gain = np.zeros((len(known), classes))
        seen = np.zeros(len(known), bool)
        at = 0
        for h, number, beside in zip(hashes, table["number"].to_pylist(), table["beside"].to_pylist()):
            # A batch's words come once each, with their neighbours side by side.
            word, number, beside = back[at : at + len(h)], _unzip(number, "<u4").astype(np.int64), _unzip(beside, "<u2")
            at += len(h)
            word, number = word[number > 0], number[number > 0]
            seen[word] = True
            ends = np.cumsum(number)
            lo = 0
            while lo < len(word):  # so many neighbours at once
                first = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, first + (1 << 16), side="right")))
                part = worth[beside[first : int(ends[hi - 1])]]
                gain[word[lo:hi]] += np.add.reduceat(part, ends[lo:hi] - number[lo:hi] - first, axis=0)
                lo = hi
        cls = gain.argmax(axis=1)
        cls[~seen] = np.bincount(cls[seen], minlength=classes).argmax()
        at = symbols.of(known)[:-1]
        cls = np.where(at < symbols.other, of[at], cls)
        ends = np.cumsum([len(h) for h in hashes])
        bucket = table["bucket"][0].as_py()
        out = [{"batch": b, "bucket": bucket, "classes": _zip(cls[p], "<u2")} for b, p in zip(table["batch"].to_pylist(), np.split(back, ends[:-1]))]
        return pa.Table.from_pylist(out, schema=_CLASSED)

    asked = encoded.mapInArrow(ask, "bucket long, batch long, dict binary, number binary, beside binary")
    return written(asked.groupBy("bucket").applyInArrow(tell, "batch long, bucket long, classes binary"), "word-classes")


_KNOWN = "batch long, docs binary, lens binary, train binary, seq binary, counts binary, classes binary"


def _with_counts(encoded: DataFrame, told: DataFrame, classed: DataFrame) -> DataFrame:
    """The batches, with the corpus counts and the classes of their words in place of the words themselves."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        parts = [(c, k) for c, k in zip(right["counts"].to_pylist(), right["classes"].to_pylist())]
        counts = np.concatenate([_unzip(c, "<u8") for c, _ in parts if c is not None]) if parts else np.zeros(0)
        classes = np.concatenate([_unzip(k, "<u2") for _, k in parts if k is not None]) if parts else np.zeros(0)
        n = left.num_rows
        return left.append_column("counts", pa.array([_zip(counts, "<u8")] * n, pa.binary())).append_column("classes", pa.array([_zip(classes, "<u2")] * n, pa.binary()))

    counts = told.where("batch >= 0").select("batch", "bucket", "counts", F.lit(None).cast("binary").alias("classes"))
    both = counts.unionByName(classed.select("batch", "bucket", F.lit(None).cast("binary").alias("counts"), "classes"))
    slim = encoded.select("batch", "docs", "lens", "train", "seq")
    return written(slim.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(join, _KNOWN), "encoded")


def _class_sums(batches: DataFrame, classes: int) -> np.ndarray:
    """Of the words that stand once in the training texts, how many are in each class."""

    def count(part):
        found = np.zeros(classes, np.int64)
        for b in part:
            for r in b.to_pylist():
                seq, lens, train = _open(r)
                counts, cls = _unzip(r["counts"], "<u8"), _unzip(r["classes"], "<u2")
                here = np.bincount(seq[np.repeat(train & 1 == 1, lens + 1)], minlength=len(counts) + 1)[1:]
                found += np.bincount(cls[(counts == 1) & (here > 0)], minlength=classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(found)], names=["cls", "n"])

    sums = batches.mapInArrow(count, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes)
    out[sums["cls"].to_numpy()] = sums["n"].to_numpy()
    return out


class ClassBigrams:
    """The smoothed model: transitions between classes and words' shares of their classes.

    Of ``n`` classes the last is the end of a text; class ``n`` stands for an unknown word."""

    def __init__(self, bigrams: np.ndarray, once: np.ndarray):
        k = len(bigrams)
        before, total = bigrams.sum(axis=1), bigrams.sum(axis=0)
        single = (total + 0.5) / (total.sum() + 0.5 * k)
        kinds = (bigrams > 0).sum(axis=1)
        # Witten-Bell: the more kinds of classes follow, the more goes to the classes' own rates.
        own = np.divide(before, before + kinds, out=np.zeros(k), where=before + kinds > 0)
        follow = np.divide(bigrams, before[:, None], out=np.zeros_like(bigrams), where=before[:, None] > 0)
        follow = own[:, None] * follow + (1 - own[:, None]) * single
        # Turing's estimate per class: as much as its words seen once have.
        fresh = np.append(np.where(total[:-1] > 0, np.minimum((once + 0.5) / (total[:-1] + 1.0), 0.5), 1.0), 0.0)
        weight = np.append(once + 0.5 / max(1, k - 1), 0.0)
        rows = np.concatenate([follow, (weight / weight.sum())[None] @ follow if weight.sum() else single[None]])
        self.end, self.unknown = k - 1, k
        self.log_follow = np.log10(np.maximum(np.concatenate([rows, (rows @ fresh)[:, None]], axis=1), 1e-300))
        self.log_total = np.log10(np.maximum(total, 1)) - np.log10(np.maximum(1 - fresh, 1e-300))

    def symbols(self, counts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word and log10 P(word | class), then those of the end. The unknown class holds all of its word's probability."""
        known = counts > 0
        cls = np.append(np.where(known, classes, self.unknown), self.end)
        share = np.zeros(len(cls))
        share[:-1][known] = np.log10(counts[known]) - self.log_total[classes[known]]
        return cls, share


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, classes: int = CLASSES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``perplexity`` per row.

    * Learns from every row whose crc32 of the number leaves anything but ``HELD_OUT`` modulo ``FOLDS`` (a null number:
      learned from, with a null ``held_out``). Words have A-Z as a-z. Each text ends with one end token; null and empty texts
      are that token alone.
    * ``base_score``: log10 of the unigrams with 0.5 added to every count and to that of one unknown word. ``score``:
      log10 of the class bigrams; a text starts after an end. ``perplexity`` is that per token.
    * Repeated rows are learned from and scored as often as they stand; further columns are ignored; an empty table
      gives an empty one. Words are told apart by 64-bit hashes.

    The driver sees the ``frequent`` top words, four sums, and the bigrams of ``frequent`` + 2 symbols and of ``classes`` + 1 classes.
    """
    total_bytes = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")))).first()[0] or 0
    buckets = max(8, -(-total_bytes // bucket_bytes))
    encoded = encode(docs, id_col, text_col)
    told = count_words(encoded, buckets, frequent)
    top, _, sums = top_words(told, buckets, frequent)
    symbols = _Frequent(top)
    bigrams, texts = _sums(encoded.select("seq", "lens", "train", "dict"), lambda r: symbols.of(_unzip(r["dict"], "<u8")), symbols.size)
    of = exchange(bigrams, symbols.other, classes)
    kinds = int(of.max()) + 1
    member = np.zeros((symbols.size, kinds))
    member[np.arange(symbols.size), of] = 1
    classed = exchange_rest(encoded, buckets, symbols, of, member.T @ bigrams @ member)
    batches = _with_counts(encoded, told, classed)
    n = max(1, int(of[: symbols.other].max(initial=0)) + 1) + 1  # the words' classes and the end

    def classes_of(r: dict) -> np.ndarray:
        return np.append(_unzip(r["classes"], "<u2").astype(np.int64), n - 1)

    table, _ = _sums(batches.select("seq", "lens", "train", "classes"), classes_of, n)
    once = _class_sums(batches.select("seq", "lens", "train", "counts", "classes"), n - 1)
    model = ClassBigrams(table, once)
    tokens = int(sums[0]) + texts
    distinct = int(sums[1]) + (texts > 0)
    below = math.log10(tokens + 0.5 * (distinct + 1))

    def score(part):
        for b in part:
            for r in b.to_pylist():
                seq, lens, train = _open(r)
                counts, of_word = _unzip(r["counts"], "<u8").astype(np.int64), _unzip(r["classes"], "<u2").astype(np.int64)
                cls, share = model.symbols(counts, of_word)
                base = np.log10(np.append(counts, texts) + 0.5) - below
                s = cls[seq - 1]
                step = model.log_follow[np.concatenate([[model.end], s[:-1]]), s] + share[seq - 1]
                size = lens + 1
                first = np.cumsum(size) - size
                known_word = np.append(counts, texts) > 0
                score_ = np.add.reduceat(step, first)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(_unzip(r["docs"], "<i8"), pa.int64(), mask=train >= 2),
                        "n_tokens": pa.array(size, pa.int64()),
                        "n_known": pa.array(np.add.reduceat(known_word[seq - 1].astype(np.int64), first)),
                        "base_score": pa.array(np.add.reduceat(base[seq - 1], first)),
                        "score": pa.array(score_),
                        "perplexity": pa.array(10.0 ** np.minimum(-score_ / size, 300)),
                    }
                )

    out = batches.mapInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")
    held = F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT
    return out.withColumn("held_out", held).withColumn("train_tokens", F.lit(tokens).cast("long"))


def op5_class_lm(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
