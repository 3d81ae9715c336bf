"""Toxicity of texts whose words may be disguised: a noisy channel is undone first, then the restored words are scored.

The channel writes letters as look-alike digits and signs, repeats them, and sets spaces or signs between them. A token's
lattice has one slot per character it shows, each with the letters (or the gap, or nothing) that may stand behind it and what
the channel charges for that. Viterbi decoding finds the reading of the lattice that is likeliest under a character trigram
model of the corpus. Plain words have one reading only and are left as they are.

Scores come from restored words and their beginnings. A logistic model with weights of zero or more, learned from labelled
rows, tells which of them say that a text is toxic (words that only stand beside those get no weight); the score is the larger
of its probability and the share of label 1 among the labelled texts with the strongest of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.store import written
from tonelake.llm.texts import chunks, mixed, ragged, text_bytes, word_hashes, words
from tonelake.llm.worker import kept

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
SAMPLE_PER_LABEL = 8_000
FEATURES = 1_000
RESIDUE = 5  # texts that have a feature and no surer one, from which it is judged by these
DOUBT = 3.0  # texts of the usual share of label 1 that are added to those with a feature
BEGINNINGS = (4, 5, 6)  # bytes of a word's beginnings that count as features
_TEXT_BYTES = 2_000_000
_CACHE_WORDS = 400_000

#: Letters that a digit or sign may stand for (fixed values).
LOOK_ALIKES = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "€": "e",
    "(": "c",
    "£": "l",
    "¥": "y",
}
#: What the channel charges, in nats: a look-alike; a digit or a sign that stands for nothing; a gap inside a word and between
#: two; between single characters, a gap that parts words; a letter written twice that is one, one written more often that is two.
ALIKE, NO_DIGIT, NO_SIGN, GAP, PART, TWICE, OFTEN = 1.0, 12.0, 7.0, 2.0, 5.0, 5.0, 1.0

SYMBOLS = 64  # 0: no letter; 1-26: a-z; all other letters share the rest by code point
_OTHERS = SYMBOLS - 27
_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$+|(")
_SIGN = np.zeros(256, bool)  # signs that may stand around a word
_SIGN[[ord(c) for c in _TRIM]] = True
_LETTER = np.zeros(256, bool)  # bytes of letters; beyond ASCII all but the blocks that hold signs
_LETTER[97:123] = True
_LETTER[128:] = True
_LETTER[[0xC2, 0xE2]] = False


def symbol(letter: str) -> int:
    c = ord(letter)
    if 97 <= c <= 122:
        return c - 96
    return 27 + c % _OTHERS if letter.isalpha() else 0


def _symbols(text: str) -> np.ndarray:
    """Symbol of every character of lower-case text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = np.where((c >= 97) & (c <= 122), c - 96, 0)
    far = np.flatnonzero(c >= 128)
    if len(far):
        kinds, back = np.unique(c[far], return_inverse=True)
        out[far] = np.array([symbol(chr(k)) for k in kinds.tolist()])[back]
    return out


def trigram_codes(text: str) -> np.ndarray:
    """(letter before the last, last letter, letter) of every letter and every word end, as one number each; outside words 0."""
    s = np.concatenate([[0, 0], _symbols(text), [0]])
    last = s[1:-1]
    before = np.where(last > 0, s[:-2], 0)
    this = s[2:]
    here = (this > 0) | (last > 0)
    return ((before * SYMBOLS + last) * SYMBOLS + this)[here]


class LetterModel:
    """log P(letter | two letters before), each order mixed with the next lower by Witten-Bell."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        c2 = c3.sum(axis=0)
        c1 = c2.sum(axis=0)
        p = (c1 + 0.5) / (c1.sum() + 0.5 * SYMBOLS)
        for c in (c2, c3):
            n, kinds = c.sum(axis=-1, keepdims=True), (c > 0).sum(axis=-1, keepdims=True)
            p = (c + np.maximum(kinds, 1) * p) / (n + np.maximum(kinds, 1))
        self.log = np.log(p).astype(np.float32)
        self.name = xxhash.xxh3_64_hexdigest(self.log.tobytes())

    def restore(self, form: str) -> str:
        """The likeliest reading of a lower-case token or of several with gaps between them."""
        log = self.log
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in lattice(form):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                for letter, cost in options:
                    if letter == "":
                        key, s, way = (a, b), score - cost, path
                    elif letter == " ":
                        if b == 0:
                            key, s, way = (0, 0), score - cost, path
                        else:
                            key, s, way = (0, 0), score - cost + float(log[a, b, 0]), (path, " ")
                    else:
                        x = symbol(letter)
                        key, s, way = (b, x), score - cost + float(log[a, b, x]), (path, letter)
                    if key not in new or s > new[key][0]:
                        new[key] = (s, way)
            states = new
        _, path = max(((s + (float(log[a, b, 0]) if b else 0.0), w) for (a, b), (s, w) in states.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            path, letter = path
            out.append(letter)
        return "".join(reversed(out))


def lattice(form: str):
    """One list of (letter, charge) per slot; "" is nothing and " " the gap between two words."""
    runs = []
    for ch in form:
        if runs and runs[-1][0] == ch:
            runs[-1][1] += 1
        else:
            runs.append([ch, 1])
    shown = [ch.isalpha() or ch in LOOK_ALIKES for ch, _ in runs]
    for k, (ch, n) in enumerate(runs):
        if ch.isalpha():
            yield [(ch, 0.0)]
            if n == 2:
                yield [(ch, 0.0), ("", TWICE)]
            elif n > 2:
                yield [(ch, OFTEN), ("", 0.0)]
        elif ch in LOOK_ALIKES:
            read = [(x, ALIKE) for x in LOOK_ALIKES[ch]]
            yield [*read, ("", NO_DIGIT if ch.isdigit() else NO_SIGN)]
            if n > 1:
                yield [*((x, 0.0) for x in LOOK_ALIKES[ch]), ("", TWICE if n == 2 else 0.0)]
        else:  # spelled out: one character before it and one behind
            alone = (k < 2 or not shown[k - 2]) and (k + 2 >= len(runs) or not shown[k + 2])
            yield [(" ", PART), ("", 0.0)] if alone else [(" ", 0.0), ("", GAP)]


def restored_words(raw: str, model: LetterModel) -> list[str]:
    """The words behind a token (or several single characters with gaps): lower-case, without signs around them."""
    form = raw.lower().strip(_TRIM)
    if not any(c.isalpha() for c in form):
        return []
    if form.isalpha() and all(a != b for a, b in zip(form, form[1:])):
        return [form]
    core = form.rstrip("@$+|(")
    if len(form) - len(core) > 2:  # three signs or more are no letters
        form = core
    return model.restore(form).split()


def word_features(data, starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """Word and feature of every whole word and of its beginnings. A feature's upper half is the word's first four bytes."""
    size = ends - starts
    head = _heads(data, starts, size, 4)
    word, found = [], []
    for k in (None, *BEGINNINGS):
        on = np.arange(len(starts)) if k is None else np.flatnonzero(size >= k)
        h = word_hashes(data, starts[on], ends[on] if k is None else starts[on] + k, 0 if k is None else 1)
        word.append(on)
        found.append(((head[on] << np.uint64(32)) | (h >> np.uint64(32))).view(np.int64))
    return np.concatenate(word), np.concatenate(found)


def _heads(data, starts, size, n: int) -> np.ndarray:
    """The first ``n`` bytes of every word as a number, zeros behind a shorter word."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(n):
        on = size > k
        out[on] |= data[starts[on] + k].astype(np.uint64) << np.uint64(8 * k)
    return out


class Features:
    """The features that have a weight, and which words can have one at all."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.sort(ids)
        heads = [int(x) >> 32 & 0xFFFFFFFF for x in self.ids]
        self.heads = np.array(sorted(set(heads)), np.uint64)
        # Without repeated letters, by length: a disguised word has the same one.
        bare: dict[int, set[int]] = {}
        for head in heads:
            b = head.to_bytes(4, "little").rstrip(b"\0")
            b = bytes(x for x, last in zip(b, b"\0" + b) if x != last)
            bare.setdefault(len(b), set()).add(int.from_bytes(b, "little"))
        self.bare = {n: np.array(sorted(x), np.uint64) for n, x in bare.items()}

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ids have a weight, and their numbers."""
        if not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        hit = np.flatnonzero(self.ids[at] == ids)
        return hit, at[hit]


def _single(data, starts, ends) -> np.ndarray:
    """Tokens of one character, a sign behind it aside."""
    head = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    n = head[ends] - head[starts]
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    sign = (last < 128) & ~(((last | 32) >= 97) & ((last | 32) <= 122)) & ~((last >= 48) & (last <= 57))
    return (n == 1) | ((n == 2) & sign)


def spelled_out(data, at) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Row, first and end byte of every run of three or more single characters, and the words of the batch."""
    starts, ends, before = words(data, at)
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))
    one = _single(data, starts, ends)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (row + 1) * one, [0]])))
    first, end = edge[:-1], edge[1:]
    run = one[first] & (end - first >= 3) if len(first) else np.zeros(0, bool)
    first, end = first[run], end[run]
    return row[first], starts[first], ends[end - 1], (starts, ends, row)


def _below(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def batch_features(column, model: LetterModel, only: Features | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature (its number in ``only``, or its hash) of every distinct pair in a batch of texts.

    Plain words are looked up as they stand, all at once. Words with doubled letters are decoded if, without the doubles, they
    begin like a feature; words with signs or digits inside and spelled-out ones always are. A worker keeps what it has decoded.
    """
    data, at = text_bytes(pc.utf8_lower(column))
    run_row, run_lo, run_hi, (starts, ends, row) = spelled_out(data, at)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(data))
    inside = ~_SIGN[data]
    lo = np.minimum.accumulate(np.where(inside, place, len(data))[::-1])[::-1][starts]
    hi = np.maximum.accumulate(np.where(inside, place, -1))[ends - 1] + 1
    some = np.flatnonzero(lo < hi)
    some = some[(lo[some] < ends[some]) & (hi[some] > starts[some])]
    lo, hi, row = lo[some], hi[some], row[some]
    letter = _LETTER[data]
    letters = _below(letter)
    n_letters = letters[hi] - letters[lo]
    twice = np.zeros(len(data), bool)
    twice[1:] = letter[1:] & (data[1:] == data[:-1]) & (data[1:] < 128)
    wide = np.zeros(len(data), bool)  # the second of two equal characters of two bytes
    wide[3:] = (data[3:] >= 128) & (data[2:-1] >= 0xC3) & (data[3:] == data[1:-2]) & (data[2:-1] == data[:-3])
    doubles, wides = _below(twice), _below(wide)
    n_twice, n_wide = doubles[hi] - doubles[np.minimum(lo + 1, hi)], wides[hi] - wides[np.minimum(lo + 3, hi)]
    plain = n_letters == hi - lo
    odd = ~plain & (n_letters > 0)
    doubled = plain & ((n_twice > 0) | (n_wide > 0))
    direct = np.flatnonzero(plain & ~doubled)
    if only is not None:
        if not len(only.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = _among(_heads(data, lo[direct], hi[direct] - lo[direct], 4), only.heads)
        direct = direct[near]
        twin = np.flatnonzero(doubled)
        keep = ~twice
        keep[lo] = True
        bare_at = _below(keep)
        bare, b_lo = data[keep], bare_at[lo[twin]]
        size = bare_at[hi[twin]] - b_lo
        near = n_wide[twin] > 0
        for n, heads in only.bare.items():
            near |= _among(_heads(bare, b_lo, np.minimum(size, n), n), heads)
        doubled = twin[near]
    else:
        doubled = np.flatnonzero(doubled)
    word, f = word_features(data, lo[direct], hi[direct])
    rows, feats = [row[direct][word]], [f]
    spelled = np.concatenate([doubled, np.flatnonzero(odd)])
    s_lo, s_hi = np.concatenate([lo[spelled], run_lo]), np.concatenate([hi[spelled], run_hi])
    s_row = np.concatenate([row[spelled], run_row])
    _, first, back = np.unique(word_hashes(data, s_lo, s_hi), return_index=True, return_inverse=True)
    read = kept().setdefault(f"read {model.name}", {})
    if len(read) > _CACHE_WORDS:
        read.clear()
    found = []
    for a, b in zip(s_lo[first].tolist(), s_hi[first].tolist()):
        raw = data[a:b].tobytes()
        if (got := read.get(raw)) is None:
            got = [w.encode() for w in restored_words(raw.decode(errors="replace"), model)]
            if len(raw) <= 64:
                read[raw] = got
        found.append(got)
    flat = [w for ws in found for w in ws]
    if flat:
        end = np.cumsum([len(w) for w in flat])
        joined = np.frombuffer(b"".join(flat), np.uint8)
        of = np.repeat(np.arange(len(found)), [len(ws) for ws in found])
        word, f = word_features(joined, end - [len(w) for w in flat], end)
        # Every token that shows the same gets the features of its reading.
        order = np.argsort(of[word], kind="stable")
        f, n = f[order], np.bincount(of[word], minlength=len(found))
        take = ragged((np.cumsum(n) - n)[back], n[back])
        rows.append(np.repeat(s_row, n[back]))
        feats.append(f[take])
    rows, feats = np.concatenate(rows), np.concatenate(feats)
    if only is not None:
        hit, feats = only.of(feats)
        rows = rows[hit]
    if not len(rows):
        return rows.astype(np.int64), feats
    order = np.lexsort((feats, rows))
    rows, feats = rows[order], feats[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (feats[1:] != feats[:-1])])
    return rows[new], feats[new]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def letter_model(docs: DataFrame, text_col: str = "text") -> LetterModel:
    """Trigram counts of all texts (lower-cased); at most ``SYMBOLS`` ** 3 sums reach the driver."""

    def count(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for t in chunks(batches, _TEXT_BYTES):
            text = "\n".join(x for x in pc.utf8_lower(t["text"].combine_chunks()).to_pylist() if x)
            total += np.bincount(trigram_codes(text), minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])

    rows = docs.select(docs[text_col].cast("string").alias("text")).where("text is not null")
    sums = rows.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3, np.int64)
    counts[sums["code"].to_numpy()] = sums["n"].to_numpy()
    return LetterModel(counts)


def fit_weights(rows: np.ndarray, features: np.ndarray, labels: np.ndarray, times: np.ndarray, size: int, penalty: float = 1.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights of zero or more and the constant of a logistic model with ``penalty`` times the weights, by coordinate descent.

    ``rows`` and ``features`` say which feature stands in which row, a row counts ``times``. Features that stand in the same
    rows share one weight. With a penalty of 1 a feature of n rows, all of label 1, gives at most 1 - 1/n."""
    mark = np.zeros(size, np.uint64)
    np.add.at(mark, features, mixed(rows.astype(np.uint64) + np.uint64(1)))
    _, lead, group = np.unique(mark, return_index=True, return_inverse=True)
    one = lead[group[features]] == features
    order = np.argsort(group[features[one]], kind="stable")
    rows, features = rows[one][order], group[features[one]][order]
    columns = np.split(rows, np.searchsorted(features, np.arange(1, len(lead)))) if len(lead) else []
    total = np.zeros(len(labels))
    w, constant = np.zeros(len(columns)), 0.0

    def step(on, charge: float, least: float) -> float:
        """The Newton step of one weight, at most 1 long."""
        p = 1 / (1 + np.exp(-np.clip(total[on], -30, 30)))
        slope = ((labels[on] - p) * times[on]).sum() - charge
        bend = (p * (1 - p) * times[on]).sum() + 1e-6
        return max(least, min(1.0, max(-1.0, slope / bend)))

    moving = range(len(columns))
    for n in range(rounds):
        move = step(slice(None), 0.0, -1.0)
        constant, total = constant + move, total + move
        largest = abs(move)
        for j in moving:
            move = step(columns[j], penalty, -w[j])
            w[j] += move
            total[columns[j]] += move
            largest = max(largest, abs(move))
        if largest < 1e-4 and len(moving) == len(columns):
            break
        # Weights at zero are looked at every tenth round only, and before the end.
        moving = range(len(columns)) if n % 10 == 9 or largest < 1e-4 else np.flatnonzero(w > 0).tolist()
    return (w / np.maximum(np.bincount(group, minlength=len(lead)), 1))[group] if size else np.zeros(0), float(constant)


class ToxicityModel:
    """The letters' trigrams, the features that count with their weights and their shares of label 1, and the constant."""

    def __init__(self, letters: LetterModel, ids: np.ndarray, weights: np.ndarray, shares: np.ndarray, constant: float):
        order = np.argsort(ids)
        self.letters, self.features, self.constant = letters, Features(ids), constant
        self.weights, self.shares = weights[order], shares[order]

    def scores(self, column) -> np.ndarray:
        row, f = batch_features(column, self.letters, self.features)
        total = np.bincount(row, weights=self.weights[f], minlength=len(column)) + self.constant
        out = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        np.maximum.at(out, row, self.shares[f])
        return out


def feature_shares(rows: np.ndarray, features: np.ndarray, labels: np.ndarray, times: np.ndarray, size: int, base: float) -> np.ndarray:
    """The share of label 1 among the texts with a feature, as low as chance may have it, with ``DOUBT`` texts of the usual share added.

    A feature that often stands beside a surer one proves nothing by that: where there are ``RESIDUE`` texts without any surer
    feature, these alone tell (the beginning of a toxic word may begin many others)."""
    order = np.argsort(features, kind="stable")
    columns = np.split(rows[order], np.searchsorted(features[order], np.arange(1, size))) if size else []

    def least(on) -> tuple[float, float]:
        n, ones = times[on].sum(), (times[on] * labels[on]).sum()
        share = (ones + DOUBT * base) / (n + DOUBT)
        return max(0.0, share - 2 * math.sqrt(share * (1 - share) / (n + DOUBT))), n

    out = np.array([least(c)[0] for c in columns])
    covered = np.zeros(len(labels), bool)
    for j in np.argsort(-out, kind="stable").tolist():
        alone = columns[j][~covered[columns[j]]]
        share, n = least(alone)
        if n >= RESIDUE:
            out[j] = min(out[j], share)
        if out[j] >= THRESHOLD:
            covered[columns[j]] = True
    return out


def _sample(labels: DataFrame, id_col: str, label_col: str, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    clean = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).dropna()
    clean = clean.where(F.col("label").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT))
    clean = clean.groupBy("doc_id").agg(F.max("label").alias("label"))
    there = {r[0]: r[1] for r in clean.groupBy("label").count().collect()}
    rank = F.md5(F.concat(F.lit("toxic-"), F.col("doc_id").cast("string")))
    picked = [clean.where(F.col("label") == v).orderBy(rank, "doc_id").limit(per_label) for v in (0, 1)]
    return picked[0].unionByName(picked[1]), there


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_label: int = SAMPLE_PER_LABEL,
    max_features: int = FEATURES,
) -> ToxicityModel:
    """Learns letters from all texts and labels from a bounded sample: up to ``per_label`` labelled documents of each
    label, the first by a hash of their number.

    A number with several labels counts with the highest, one with several texts with each of them; equal texts of one label
    count once; rows without number or label are left out. Rows whose crc32 of the number leaves ``HELD_OUT`` modulo ``FOLDS``
    are never learned from, neither labels nor letters (those without a number give letters). The ``max_features`` features that
    say most for label 1 (likelihood ratio; ties by hash) may get weights; all is set to the labels' true shares.
    """
    number = docs[id_col].cast("long")
    rows = docs.select(number.alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT, F.lit(True)))
    letters = letter_model(rows)
    picked, there = _sample(labels, id_col, label_col, per_label)
    sample = rows.join(F.broadcast(picked), "doc_id").groupBy(F.xxhash64("text").alias("mark"), "label").agg(F.min("text").alias("text"))
    schema = "mark long, label int, features array<long>"

    def find(batches):
        for t in chunks(batches, _TEXT_BYTES):
            row, f = batch_features(t["text"], letters)
            cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=t.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {"mark": t["mark"].combine_chunks(), "label": t["label"].combine_chunks(), "features": pa.ListArray.from_arrays(pa.array(cut), pa.array(f, pa.int64()))}
            )

    sample = written(sample.mapInArrow(find, schema), "toxic-features")
    size = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n1:
        return ToxicityModel(letters, np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 0.0 if not n0 else math.log(0.5 / (n0 + 0.5)))
    counts = sample.select(F.explode("features").alias("f"), "label").groupBy("f").agg(F.sum("label").alias("b"), F.sum(1 - F.col("label")).alias("a"))

    def part(x, e):
        return F.when(x > 0, x * F.log(x / e)).otherwise(0.0)

    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(n0 + n1)
    gain = F.lit(0.0)
    for x, total in ((a, n0), (b, n1)):
        gain = gain + part(x, (a + b) * (total / n)) + part(total - x, (n - a - b) * (total / n))
    best = counts.where((b * max(n0, 1) > a * n1) & (b > 1)).orderBy(gain.desc(), "f").limit(max_features)
    chosen = best.collect()
    names = [r["f"] for r in chosen]
    wanted = np.array(names, np.int64)
    order = np.argsort(wanted)

    def only(batches):
        for batch in batches:
            each = []
            for x in batch["features"]:
                _, at, _ = np.intersect1d(wanted[order], x.values.to_numpy(), return_indices=True)
                each.append(order[at].astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(each, pa.binary())], names=["label", "f"])

    # Texts with the same few features are one row; there are no more rows than sampled texts, of two bytes a feature.
    table = sample.select("label", "features").mapInArrow(only, "label int, f binary").groupBy("label", "f").count().orderBy("label", "f").toArrow()
    each = [np.frombuffer(x, "<i2") for x in table["f"].to_pylist()]
    at, feats = np.repeat(np.arange(len(each)), [len(x) for x in each]), np.concatenate([*each, np.zeros(0, np.int16)]).astype(np.int64)
    weights, constant = fit_weights(at, feats, table["label"].to_numpy().astype(float), table["count"].to_numpy().astype(float), len(names))
    ratio = 1.0  # the share of clean texts that were drawn, against that of toxic ones
    if n0 and there.get(0) and there.get(1):
        ratio = (there[0] / n0) / (there[1] / n1)
        constant -= math.log(ratio)
    labelled, times = table["label"].to_numpy().astype(float), table["count"].to_numpy() * np.where(table["label"].to_numpy() == 0, ratio, 1.0)
    shares = feature_shares(at, feats, labelled, times, len(names), n1 / (n1 + n0 * ratio))
    keep = np.flatnonzero(weights > 0)
    return ToxicityModel(letters, wanted[keep], weights[keep], shares[keep], constant)


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row, from its whole text alone.

    A feature counts once per text, however often it stands there. Null, empty and blank texts and texts without any feature
    get the constant's probability. Repeated rows get equal scores; null numbers give a null ``held_out``; further columns are
    ignored; an empty table gives an empty one. The model (64 ** 3 numbers and ``FEATURES`` weights, about 1 MB) goes to every task.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def score(batches):
        for t in chunks(batches, _TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(model.scores(t["text"]), pa.float64())], names=["doc_id", "score"])

    out = rows.mapInArrow(score, "doc_id long, score double")
    return out.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def restored_texts(docs: DataFrame, letters: LetterModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``restored``: every text with its words as the channel's Viterbi decoding reads them, one space between."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def restore(batches):
        for t in chunks(batches, _TEXT_BYTES):
            texts = [" ".join(restored_tokens(x, letters)) for x in t["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(texts, pa.string())], names=["doc_id", "restored"])

    return rows.mapInArrow(restore, "doc_id long, restored string")


def restored_tokens(text: str | None, letters: LetterModel) -> list[str]:
    """The restored words of one text, in order."""
    data, at = text_bytes(pa.array([text], pa.string()))
    _, lo, hi, (starts, ends, _) = spelled_out(data, at)
    out, k = [], 0
    while k < len(starts):
        run = np.flatnonzero(lo == starts[k])
        end = int(hi[run[0]]) if len(run) else int(ends[k])
        out += restored_words(data[starts[k] : end].tobytes().decode(), letters)
        k = int(np.searchsorted(starts, end))
    return out


def op11_toxicity(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, fit(docs, labels))
