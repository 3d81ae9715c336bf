"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A word is a maximal run of bytes other than space and 0x09-0x0D. All functions
work on the UTF-8 bytes of a whole batch; null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from tonelake.llm.worker import release

WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD_ODDS = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F))
_WINDOW_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_SLICE = 1 << 16  # words hashed at once
_LONG = 256  # bytes; longer words are hashed one by one
_SPAN = 32  # words under one polynomial
_EIGHTS = (np.uint64(2) ** (np.arange(9, dtype=np.uint64) * np.uint64(8) % np.uint64(64))) - np.uint64(1)
_EIGHTS[8] = np.uint64((1 << 64) - 1)  # the first n of eight bytes


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column, and where each row starts and ends in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return _LOWER[data]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each row (one more at the end)."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]  # a word does not run on into the next row
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 (the public splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """64-bit hash of every word's bytes, eight at a time, all bits mixed after each eight; ``kind`` 0 and 1 are independent."""
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    odd = _WORD_ODDS[kind]
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, len(starts), _SLICE):
        at, size = starts[lo : lo + _SLICE], ends[lo : lo + _SLICE] - starts[lo : lo + _SLICE]
        h = mixed(size.astype(np.uint64) + odd)
        h = mixed(h ^ (eights[at] & _EIGHTS[np.minimum(size, 8)]) * odd)
        on = np.flatnonzero((size > 8) & (size <= _LONG))
        for k in range(8, _LONG, 8):
            if not len(on):
                break
            h[on] = mixed(h[on] ^ (eights[at[on] + k] & _EIGHTS[np.minimum(size[on] - k, 8)]) * odd)
            on = on[size[on] > k + 8]
        for i in np.flatnonzero(size > _LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i] + size[i]].tobytes(), int(odd))
        out[lo : lo + _SLICE] = h
    return out


def _runs(values: np.ndarray, first: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of ``size`` values from each place, from one running sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[first + size] - total[first]) * powers(inverse(base), len(values) + 1)[first]


def _windows(hashes: np.ndarray, first: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Rabin-Karp hash of ``size`` words from each place. A running sum modulo 2**64 has known collisions over very
    long spans, so one covers ``_SPAN`` words at most and a longer window is a chain of them (the last two may overlap)."""
    if size <= _SPAN:
        return mixed(_runs(hashes, first, size, base))
    spans = np.zeros(len(hashes), np.uint64)
    places = np.arange(len(hashes) - _SPAN + 1)
    spans[: len(places)] = mixed(_runs(hashes, places, _SPAN, base))
    h = spans[first]
    for off in [*range(_SPAN, size - _SPAN, _SPAN), size - _SPAN]:
        h = mixed(h * base + spans[first + off])
    return h


def window_hashes(hashes: tuple[np.ndarray, np.ndarray], before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every ``size`` consecutive words of one row: two independent
    hashes (one of each kind of word hash), and the index of each window's first word."""
    n = len(hashes[0])
    ok = np.zeros(n + 1, np.int8)
    lens = np.diff(before)
    some = lens >= size
    np.add.at(ok, before[:-1][some], 1)
    np.add.at(ok, (before[1:] - size + 1)[some], -1)
    first = np.flatnonzero(np.cumsum(ok[:-1], dtype=np.int8))
    return (*(_windows(h, first, size, b) for h, b in zip(hashes, _WINDOW_BASES)), first)


def chunks(batches, byte_size: int, column: str = "text") -> Iterator[pa.Table]:
    """Arrow batches gathered and cut into tables of about ``byte_size`` bytes of text.

    A single longer text makes a table of its own; nothing is cut.
    """
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        _, at = text_bytes(t[column])
        lo = 0
        while lo < t.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + byte_size - size, side="right")) - 1)
            held.append(t.slice(lo, hi - lo))
            size += int(at[hi] - at[lo])
            lo = hi
            if size >= byte_size or lo < t.num_rows:
                out = pa.concat_tables(held).combine_chunks()
                held, size = [], 0
                yield out
                del out
                release()
    if held:
        yield pa.concat_tables(held).combine_chunks()
        held = []
        release()


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of all the runs start .. start+len-1, one after the other."""
    lens = np.asarray(lens, np.int64)
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)
