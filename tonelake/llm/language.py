"""Language of a text by segmentation-marginalised unigrams.

The pieces of a public vocabulary have a probability in every language. A word's probability is the sum over all ways to
cut it into pieces (a forward pass); a text's is the product over its words. The vocabulary's 256 byte pieces
give every word at least one way. Piece probabilities are learned by expectation over all segmentations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonelake.llm.texts import chunks, text_bytes, word_hashes, words
from tonelake.llm.worker import kept

FOLDS, HELD_OUT = 4, 2
SAMPLE_PER_LANGUAGE = 600
SAMPLE_TOTAL = 12_000
ROUNDS = 3
UNKNOWN = "und"
_TEXT_BYTES = 4_000_000
_CACHE_WORDS = 400_000
_MARK = "▁".encode()  # stands for the space before a word in the vocabulary
_PLACES = 256  # places of a word whose pieces are looked up at once
_BASE = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary_pieces(path: str) -> list[bytes]:
    """The vocabulary's lower-cased pieces, each once, after the 256 single bytes.
    A leading space mark is the byte 0x20."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]): None for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        p = model.id_to_piece(i).lower().encode().replace(_MARK, b" ")
        if p.strip(b" ") and b" " not in p[1:]:
            found[p] = None
    return list(found)


def _hash(buffers: np.ndarray) -> np.ndarray:
    """Hash of every row of bytes, all of one length."""
    h = np.zeros(len(buffers), np.uint64)
    for column in buffers.T:
        h = h * _BASE + column.astype(np.uint64) + np.uint64(1)
    return h


class Pieces:
    """Looks up the pieces that start at each place of many words."""

    def __init__(self, pieces: list[bytes]):
        self.size, self.longest = len(pieces), max(map(len, pieces))
        self.tables = []
        for n in range(1, self.longest + 1):
            at = np.array([i for i, p in enumerate(pieces) if len(p) == n], np.int64)
            raw = np.frombuffer(b"".join(pieces[i] for i in at), np.uint8).reshape(-1, n)
            h = _hash(raw)
            order = np.argsort(h)
            self.tables.append((h[order], at[order]))

    def find(self, letters: np.ndarray) -> np.ndarray:
        """For words as rows of bytes (0 after the end): piece that starts at [word, place] with each length, or -1."""
        n, width = letters.shape
        out = np.full((n, width, self.longest), -1, np.int32)
        h = np.zeros((n, width), np.uint64)
        for k in range(1, min(self.longest, width) + 1):
            room = width - k + 1
            h = h[:, :room] * _BASE + letters[:, k - 1 :].astype(np.uint64) + np.uint64(1)
            hashes, ids = self.tables[k - 1]
            if not len(hashes):
                continue
            flat = h.ravel()
            at = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
            out[:, :room, k - 1] = np.where(hashes[at] == flat, ids[at], -1).reshape(n, room)
        return out


def _by_length(lens: np.ndarray, cells: int = 1 << 16):
    """Indices of words of one length, in groups of a bounded number of bytes."""
    if not len(lens):
        return
    order = np.argsort(lens, kind="stable")
    cuts = np.flatnonzero(np.diff(lens[order])) + 1
    for same in np.split(order, cuts):
        step = max(1, cells // int(lens[same[0]]))
        for lo in range(0, len(same), step):
            yield same[lo : lo + step]


def _near_length(lens: np.ndarray, cells: int = 1 << 16, total: int = 1 << 21):
    """Indices of words of about one length, in groups of a bounded number of bytes, at once and in a block of places."""
    order = np.argsort(lens, kind="stable")
    lo = 0
    while lo < len(order):
        wide = int(lens[order[lo]]) + 1
        most = max(1, min(cells // min(wide, _PLACES), total // wide))
        same = np.searchsorted(lens[order], wide - 1 + wide // 4, side="right")
        hi = min(lo + most, int(same))
        yield order[lo:hi]
        lo = hi


def _padded(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Words as rows, each behind a space and with zeros after its end."""
    places = np.arange(int(lens.max()))
    out = np.full((len(starts), len(places) + 1), 32, np.uint8)
    out[:, 1:] = np.where(places < lens[:, None], data[np.minimum(starts[:, None] + places, len(data) - 1)], 0)
    return out


def _letters(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Words of ``n`` bytes as rows, each behind a space."""
    out = np.empty((len(starts), n + 1), np.uint8)
    out[:, 0] = 32
    out[:, 1:] = data[starts[:, None] + np.arange(n)]
    return out


def word_scores(data, starts, lens, pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """Log probability of every word in every language: the forward sum over all its segmentations.

    ``logs``: log probability by piece and language, a last row of -inf for "no piece". The sums are rescaled on the way,
    so words of any length are exact.
    """
    p = np.exp(logs)
    out = np.zeros((len(starts), p.shape[1]))
    for group in _by_length(lens):
        n = int(lens[group[0]])
        letters = _letters(data, starts[group], n)
        wide = n + 1
        forward = [np.ones((len(group), p.shape[1]))]  # the last sums, as many as the longest piece has bytes
        scale = np.zeros((len(group), p.shape[1]))
        found = pieces.find(letters) if wide <= 256 else None
        for end in range(1, wide + 1):
            total = np.zeros_like(forward[0])
            if found is None and (end - 1) % 256 == 0:
                lo = max(0, end - pieces.longest)
                local, base = pieces.find(letters[:, lo : end + 255]), lo
            for k in range(1, min(pieces.longest, end) + 1):
                at = end - k
                ids = found[:, at, k - 1] if found is not None else local[:, at - base, k - 1]
                if (ids >= 0).any():
                    total += forward[-k] * p[ids]
            forward.append(total)
            if len(forward) > pieces.longest:
                forward.pop(0)
            if end % 8 == 0:
                top = forward[-1]  # by the newest, so it cannot vanish beside the oldest
                forward = [f / top for f in forward]
                scale += np.log(top)
        out[group] = np.log(forward[-1]) + scale
    return out


def expected_pieces(data, starts, lens, times: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in the words (``times`` each) under the probabilities ``p`` of one language.

    The forward and backward sums are kept as logarithms of the steps from one place to the next, each step made from sums
    relative to the last, so words of any length count and none underflows.
    """
    p = np.append(p, 0.0)
    out = np.zeros(pieces.size)
    steps = np.arange(1, pieces.longest + 1)
    for group in _near_length(lens):
        letters, ends = _padded(data, starts[group], lens[group]), lens[group] + 1
        n, wide = letters.shape

        def found_at(lo):
            """Pieces that start at the places from ``lo`` on and end within their words."""
            found = pieces.find(letters[:, lo : lo + _PLACES + pieces.longest - 1])[:, :_PLACES]
            past = lo + np.arange(found.shape[1])[:, None] + steps > ends[:, None, None]
            found[past] = -1
            return found

        blocks = range(0, wide, _PLACES)
        found = found_at(0)
        a = np.ones((n, wide + 1))  # each forward sum relative to the one before
        ahead = np.zeros((n, pieces.longest))  # what the places so far give to the next ones
        for lo in blocks:
            prob = p[found if lo == 0 else found_at(lo)]
            for at in range(lo, lo + prob.shape[1]):
                ahead += prob[:, at - lo]
                a[:, at + 1] = step = np.where(at < ends, ahead[:, 0], 1.0)
                ahead[:, :-1] = ahead[:, 1:] / step[:, None]
                ahead[:, -1] = 0
        a = np.cumsum(np.log(a), axis=1)
        b = np.zeros((n, wide + 1))
        after = np.zeros((n, pieces.longest))  # backward sums of the next places relative to the next one's
        after[:, 0] = 1
        for lo in reversed(blocks):
            if len(blocks) > 1:
                found = found_at(lo)
            prob = p[found]
            for at in range(lo + prob.shape[1] - 1, lo - 1, -1):
                step = np.where(at < ends, (prob[:, at - lo] * after).sum(axis=1), 1.0)
                b[:, at] = b[:, at + 1] + np.log(step)
                after[:, 1:] = after[:, :-1] / step[:, None]
                after[:, 0] = 1
            row, at, k = np.nonzero(found >= 0)
            piece = found[row, at, k]
            use = np.exp(a[row, lo + at] + b[row, lo + at + k + 1] - a[row, -1]) * p[piece] * times[group][row]
            out += np.bincount(piece, weights=use, minlength=pieces.size)
    return out


class LanguageModel:
    """Piece probabilities of the languages, in code-point order of their names."""

    def __init__(self, names: list[str], pieces: Pieces, logs: np.ndarray):
        self.names, self.pieces, self.logs = names, pieces, logs

    def known_words(self, data, starts, ends) -> np.ndarray:
        """Scores of all words of a batch; a worker keeps those of the words it has met (a bounded number)."""
        h = word_hashes(data, starts, ends)
        new, first, back = np.unique(h, return_index=True, return_inverse=True)
        name = f"language words {hash(self.logs.tobytes())}"
        have, values = kept().get(name, (np.zeros(0, np.uint64), np.zeros((0, len(self.names)))))
        at = np.searchsorted(have, new)
        hit = np.zeros(len(new), bool)
        hit[at < len(have)] = have[at[at < len(have)]] == new[at < len(have)]
        scores = np.empty((len(new), len(self.names)))
        scores[hit] = values[at[hit]]
        miss = np.flatnonzero(~hit)
        s = starts[first[miss]]
        scores[miss] = word_scores(data, s, ends[first[miss]] - s, self.pieces, self.logs)
        if len(have) + len(miss) > _CACHE_WORDS:
            kept()[name] = (new, scores)
        else:
            order = np.argsort(np.concatenate([have, new[miss]]))
            kept()[name] = (np.concatenate([have, new[miss]])[order], np.concatenate([values, scores[miss]])[order])
        return scores[back]


def _lowered(column) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pc.utf8_lower(column))


def sample_languages(rows: DataFrame, counts: dict[str, int], want: int) -> pa.Table:
    """``lang`` and ``text`` of each language's ``want`` rows with the smallest hashes of the number, or all if there are fewer.

    Only rows under a bound far above the last hash that is wanted are ranked; where that gives too few (numbers that
    repeat a lot), the language is ranked whole.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit("language"), "doc_id"), 1))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))

    def smallest(bounds: dict[str, int]) -> pa.Table:
        some = F.broadcast(spark.createDataFrame(list(bounds.items()), "of string, bound long"))  # one row per language
        near = rows.join(some, (F.col("lang") == F.col("of")) & (F.col("draw") <= F.col("bound")))
        return near.withColumn("nth", first).where(F.col("nth") <= want).select("lang", "text").toArrow()

    top = (1 << 63) - 1
    enough = want + 8 * want**0.5 + 20
    found = smallest({name: min(top, int(top * min(1.0, enough / n))) for name, n in counts.items()})
    got = {x["values"].as_py(): x["counts"].as_py() for x in found["lang"].value_counts()}
    few = {name: top for name, n in counts.items() if got.get(name, 0) < min(want, n)}
    if few:
        whole = pc.invert(pc.is_in(found["lang"], pa.array(list(few), pa.string())))
        found = pa.concat_tables([found.filter(whole), smallest(few)])
    return found


def fit(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS) -> LanguageModel:
    """Learns from a bounded sample of the rows with a language whose crc32 of the number does not leave ``HELD_OUT``.

    Each language gives ``SAMPLE_PER_LANGUAGE`` documents (fewer with very many languages: ``SAMPLE_TOTAL`` in all, but one
    each), those of the smallest hashes of the number. Words of any length count, so a text without spaces does too.
    """
    pieces_list = vocabulary_pieces(vocabulary)
    pieces = Pieces(pieces_list)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT, F.lit(False)))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    names = sorted(counts)
    sample = sample_languages(rows, counts, max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_TOTAL // max(1, len(names))))) if names else None
    logs = np.full((pieces.size + 1, len(names)), -np.inf)
    for i, name in enumerate(names):
        data, at = _lowered(sample["text"].filter(pc.equal(sample["lang"], name)))
        starts, ends, _ = words(data, at)
        h = word_hashes(data, starts, ends)
        _, first, times = np.unique(h, return_index=True, return_counts=True)
        s, n = starts[first], ends[first] - starts[first]
        p = np.full(pieces.size, 1.0 / pieces.size)
        for _ in range(rounds):
            use = expected_pieces(data, s, n, times, pieces, p) + 0.05
            p = use / use.sum()
        logs[:-1, i] = np.log(p)
    return LanguageModel(names, pieces, logs)


def _has_letter(data: np.ndarray, at: np.ndarray, texts) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = total[at[1:]] > total[at[:-1]]
    for i in np.flatnonzero(~out):
        t = texts[int(i)].as_py()
        out[i] = bool(t) and any(c.isalpha() for c in t)
    return out


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (the language's share of the probability) of every row.

    The whole text counts, lower-cased. Null texts and texts without a letter are ``und`` with score 0, and so is everything
    if no row had a language to learn from. Of equal languages the first in code-point order wins. Null numbers give a
    null ``held_out``; repeated rows get equal results; further columns are ignored; an empty table gives an empty one.
    The model (one number per piece and language) goes to every task.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def predict(batches):
        for t in chunks(batches, _TEXT_BYTES):
            text = t["text"].combine_chunks()
            data, at = _lowered(text)
            starts, ends, before = words(data, at)
            n = t.num_rows
            letter = _has_letter(data, at, text)
            if not model.names:
                letter[:] = False
                names, score = [UNKNOWN] * n, np.zeros(n)
            else:
                s = model.known_words(data, starts, ends)
                total = np.concatenate([np.zeros((1, s.shape[1])), np.cumsum(s, axis=0)])
                total = total[before[1:]] - total[before[:-1]]
                best = total.argmax(axis=1)
                score = np.where(letter, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                names = [model.names[b] if ok else UNKNOWN for b, ok in zip(best, letter)]
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op3_language_id(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs, default_vocabulary()))
