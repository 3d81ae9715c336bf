"""Adaptive context-mixing range coder for token ids, many lanes at once.

A block's ids are dealt to lanes (runs of consecutive ids) that are coded in
step: one id of every lane per step, in numpy. All lanes share the block's
models, which start empty in every block:

* order 0: how often each id has come, as cumulative frequencies, renewed as the ids seen grow;
* order 1 and order 2: the id that last followed the last one (two) ids, with a confidence
  that rises when it is right and falls when it is wrong.

The mix is linear: an id's share is w0 * order0(id) + w1 * [id = order-1 prediction]
+ w2 * [id = order-2 prediction], in 64ths. The weights are learned per pair of
confidences, as the rate at which each prediction has been right so far.
The share drives a carry-less range coder with 64-bit low and range that puts out 16 bits at a time.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 4096
LANE_IDS = 256  # a lane has no fewer, so what closes it stays a small share
MAGIC = b"TIDC"
_HEAD = "<4sIIIQII"  # magic, documents, ids, vocabulary, payload bytes, crc of ids, crc of payload

_ORDER0_BITS = 22
_WEIGHT = 64
_TOTAL_BITS = _ORDER0_BITS + 6
_BITS2 = 18  # slots of the order-2 table
_CONFIDENT = 7  # confidences have three bits

_U = np.uint64
_SETTLED = _U(1 << 48)
_LEAST = _U(1 << 40)
_SIXTEEN = _U(16)
_TOP = _U(48)
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))

#: A prediction's entry is id * 8 + confidence. What a step adds to it, by the bits of ``_Model.learn``: one more if it was right,
#: half of the confidence gone if it was wrong, and the id that came instead (``_FRESH``) if none is left.
_FRESH = -64
_SURE = [np.arange(512) >> shift & 7 for shift in (0, 3)]
_CHANGE = [
    np.where(np.arange(512) >> bit & 1, np.minimum(sure + 1, _CONFIDENT) - sure, np.where(sure > 1, sure // 2 - sure, _FRESH)).astype(np.int32)
    for sure, bit in zip(_SURE, (7, 8))
]


class _Model:
    """The shared models of one block; coder and decoder make the same calls on it.

    What a step has seen is kept aside and counted when the shares are renewed: after every step at first, later when the ids seen
    have grown by a sixteenth."""

    def __init__(self, vocabulary: int):
        if not 0 < vocabulary <= 1 << (_ORDER0_BITS - 2):
            raise ValueError("vocabulary too large for the order-0 frequencies")
        self.v = vocabulary
        self.counts = np.zeros(vocabulary, np.int64)
        self.seen = 0
        self.next1 = np.zeros(vocabulary, np.int32)
        self.next2 = np.zeros(1 << _BITS2, np.int32)
        cells = np.arange(128)  # confidence of order 2, of order 1, and whether both say the same
        self.sure1, self.sure2, self.same = cells & 7, cells >> 3 & 7, cells >> 6
        self.tried, self.right1, self.right2 = (np.zeros(128) for _ in range(3))
        self.late: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self._renew()

    def _renew(self) -> None:
        if self.late:
            self.counts += np.bincount(np.concatenate([x for x, _ in self.late]), minlength=self.v)
            told = np.bincount(np.concatenate([x for _, x in self.late]), minlength=512).astype(float)
            self.tried += told.reshape(4, 128).sum(axis=0)
            self.right1 += told[128:256]  # order 1 alone, or both without a confident order 2
            self.right2 += told[256:384] + told[384:]
            self.right1 += np.where(self.sure2 == 0, told[384:], 0)
            self.seen, self.waiting, self.late = self.seen + self.waiting, 0, []
        space = (1 << _ORDER0_BITS) - self.v
        f = 1 + (self.counts * (space / max(self.seen, 1))).astype(np.int64)
        f[0] += (1 << _ORDER0_BITS) - int(f.sum())
        self.freq = f.astype(np.int32)
        self.cum = np.zeros(self.v + 1, np.int32)
        np.cumsum(self.freq, out=self.cum[1:])
        n = self.tried + 2
        w2 = np.where(self.sure2 > 0, np.minimum(_WEIGHT * (self.right2 + 0.3) / n, _WEIGHT - 4).astype(np.int64), 0)
        room = _WEIGHT - 2 - w2
        w1 = np.where(self.sure1 > 0, np.minimum(_WEIGHT * (self.right1 + 0.3) / n, room).astype(np.int64), 0)
        w1 = np.where((self.same > 0) & (w2 > 0), 0, w1)
        self.w0, self.w1, self.w2 = ((_WEIGHT - w1 - w2).astype(np.int32), w1.astype(np.int32), w2.astype(np.int32))

    def predict(self, one: np.ndarray, two: np.ndarray):
        """For each lane, the predicted ids and the weights of the three orders; contexts are unsigned 32-bit."""
        self.one = one
        slot = two * _MIX[0]
        slot += one * _MIX[1]
        slot >>= np.uint32(32 - _BITS2)
        self.slot = slot
        self.e1, self.e2 = self.next1[one], self.next2[slot]
        self.p1, self.p2 = self.e1 >> 3, self.e2 >> 3
        self.cell = (self.e2 & 7) << 3
        self.cell += self.e1 & 7
        self.cell += (self.p1 == self.p2).view(np.int8).astype(np.int32) << 6
        return self.p1, self.p2, self.w0[self.cell], self.w1[self.cell], self.w2[self.cell]

    def learn(self, ids: np.ndarray, hit1: np.ndarray, hit2: np.ndarray) -> None:
        told = self.cell
        told += hit1.view(np.int8).astype(np.int32) << 7
        told += hit2.view(np.int8).astype(np.int32) << 8
        fresh = (ids << 3) + 1
        # Of lanes with the same context the last one counts.
        change = _CHANGE[0][told]
        self.next1[self.one] = np.where(change == _FRESH, fresh, self.e1 + change)
        change = _CHANGE[1][told]
        self.next2[self.slot] = np.where(change == _FRESH, fresh, self.e2 + change)
        self.late.append((ids, told))
        self.waiting += len(ids)
        if self.waiting * 16 >= self.seen:
            self._renew()


def _lanes(n: int) -> tuple[int, int, int]:
    """Number of lanes, ids of each, and how many have one more."""
    lanes = max(1, min(LANES, n // LANE_IDS))
    return lanes, n // lanes, n % lanes


def _renormalise(low, rng, put):
    """Puts out 16 bits of every lane whose top is settled or whose range is small."""
    at = None  # all lanes first, then only those that have just put out
    while True:
        lo, r = (low, rng) if at is None else (low[at], rng[at])
        settled = (lo ^ (lo + r)) < _SETTLED
        go = np.flatnonzero(settled | (r < _LEAST))
        if not len(go):
            return
        lo, r = lo[go], r[go]
        cut = ~settled[go]
        at = go if at is None else at[go]
        if cut.any():
            r = np.where(cut, (~lo + _U(1)) & (_LEAST - _U(1)), r)
        put(at, lo)
        low[at] = lo << _SIXTEEN
        rng[at] = r << _SIXTEEN


def _encode_ids(ids: np.ndarray, vocabulary: int) -> bytes:
    n = len(ids)
    lanes, base, extra = _lanes(n)
    lens = np.full(lanes, base)
    lens[:extra] += 1
    starts = np.cumsum(lens) - lens
    ids = ids.astype(np.int32)
    model = _Model(vocabulary)
    low, rng = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    one, two = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    width = 2 * (base + 1) + 8
    out = np.zeros(lanes * width, np.uint16)
    pos = np.arange(lanes) * width

    def put(at, lo):
        p = pos[at]
        out[p] = lo >> _TOP
        pos[at] = p + 1

    for t in range(base + (extra > 0)):
        a = lanes if t < base else extra
        x = ids[starts[:a] + t]
        p1, p2, w0, w1, w2 = model.predict(one[:a], two[:a])
        hit1, hit2 = p1 == x, p2 == x
        c = model.cum[x] * w0
        c += ((p1 < x) * w1 + (p2 < x) * w2) << _ORDER0_BITS
        f = model.freq[x] * w0
        f += (hit1 * w1 + hit2 * w2) << _ORDER0_BITS
        lo, r = low[:a], rng[:a]
        unit = r >> _U(_TOTAL_BITS)
        lo += unit * c.astype(_U)
        np.multiply(unit, f.astype(_U), out=r)
        _renormalise(lo, r, put)
        model.learn(x, hit1, hit2)
        two[:a], one[:a] = one[:a], x
    # One more word, or two, so that whatever follows stays inside the lane's range.
    top = low >> _TOP
    short = (top + _U(2) <= (low + rng) >> _TOP) & (top < _U(0xFFFE))
    last = np.where(short, (top + _U(1)) << _TOP, ((low >> _U(32)) + _U(1)) << _U(32))
    out[pos] = last >> _TOP
    pos += 1
    more = np.flatnonzero(~short)
    out[pos[more]] = (last[more] >> _U(32)) & _U(0xFFFF)
    pos[more] += 1
    pos -= np.arange(lanes) * width
    keep = np.arange(width) < pos[:, None]
    sizes = zlib.compress(pos.astype("<u4").tobytes(), 6)
    return struct.pack("<I", len(sizes)) + sizes + out.reshape(lanes, width)[keep].astype("<u2").tobytes()


def _decode_ids(payload: bytes, n: int, vocabulary: int) -> np.ndarray:
    lanes, base, extra = _lanes(n)
    (head,) = struct.unpack_from("<I", payload)
    size = np.frombuffer(zlib.decompress(payload[4 : 4 + head]), "<u4", lanes).astype(np.int64)
    code_words = np.concatenate([np.frombuffer(payload, "<u2", offset=4 + head), np.zeros(4, np.uint16)]).astype(_U)
    at_word = np.cumsum(size) - size
    lens = np.full(lanes, base)
    lens[:extra] += 1
    starts = np.cumsum(lens) - lens
    model = _Model(vocabulary)
    low, rng, code = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U), np.zeros(lanes, _U)
    for _ in range(4):
        code = (code << _SIXTEEN) | code_words[at_word]
        at_word += 1
    one, two = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    ids = np.zeros(n, np.int32)

    def put(at, lo):
        p = at_word[at]
        code[at] = (code[at] << _SIXTEEN) | code_words[np.minimum(p, len(code_words) - 1)]
        at_word[at] = p + 1

    for t in range(base + (extra > 0)):
        a = lanes if t < base else extra
        p1, p2, w0, w1, w2 = model.predict(one[:a], two[:a])
        lo, r = low[:a], rng[:a]
        unit = r >> _U(_TOTAL_BITS)
        v = np.minimum((code[:a] - lo) // unit, _U((1 << _TOTAL_BITS) - 1)).astype(np.int32)
        cum, freq = model.cum, model.freq
        big1, big2 = w1 << _ORDER0_BITS, w2 << _ORDER0_BITS
        same = p1 == p2
        f1, f2 = freq[p1] * w0 + big1, freq[p2] * w0 + big2
        f1 += same * big2
        f2 += same * big1
        c1, c2 = cum[p1] * w0, cum[p2] * w0
        c1 += (p2 < p1) * big2
        c2 += (p1 < p2) * big1
        # Where the place lies behind a prediction's share, in it (a hit), or before it.
        above1, above2 = v >= c1 + f1, v >= c2 + f2
        hit1, hit2 = (v >= c1) & ~above1, (v >= c2) & ~above2
        x, c, f = (np.where(hit1, a1, a2) for a1, a2 in ((p1, p2), (c1, c2), (f1, f2)))
        miss = np.flatnonzero(~(hit1 | hit2))
        past = (above1 * big1 + above2 * big2)[miss]
        w0 = w0[miss]
        found = np.searchsorted(cum, (v[miss] - past) // w0, side="right") - 1
        x[miss], c[miss], f[miss] = found, cum[found] * w0 + past, freq[found] * w0
        lo += unit * c.astype(_U)
        np.multiply(unit, f.astype(_U), out=r)
        _renormalise(lo, r, put)
        ids[starts[:a] + t] = x
        model.learn(x, hit1, hit2)
        two[:a], one[:a] = one[:a], x
    return ids


def encode_block(ids: np.ndarray, doc_ids: np.ndarray, lens: np.ndarray, vocabulary: int) -> bytes:
    """One block: header, then document numbers and lengths, then the coded ids.

    ``doc_ids`` are signed 64-bit; the checksums are crc32 of the ids as
    little-endian unsigned 32-bit integers and of everything behind the header.
    """
    ids = np.ascontiguousarray(ids, np.int64)
    table = zlib.compress(np.diff(doc_ids, prepend=0).astype("<i8").tobytes() + np.asarray(lens).astype("<u4").tobytes(), 6)
    body = struct.pack("<I", len(table)) + table + (_encode_ids(ids, vocabulary) if len(ids) else b"")
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    return struct.pack(_HEAD, MAGIC, len(doc_ids), len(ids), vocabulary, len(body), crc, zlib.crc32(body)) + body


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document numbers, lengths and ids of a block; raises ``ValueError`` if a checksum is wrong."""
    if len(block) < struct.calcsize(_HEAD):
        raise ValueError("truncated block")
    magic, docs, n, vocabulary, size, crc, body_crc = struct.unpack_from(_HEAD, block)
    body = block[struct.calcsize(_HEAD) : struct.calcsize(_HEAD) + size]
    if magic != MAGIC or len(body) != size or zlib.crc32(body) != body_crc:
        raise ValueError("damaged block")
    (table_size,) = struct.unpack_from("<I", body)
    table = zlib.decompress(body[4 : 4 + table_size])
    doc_ids = np.cumsum(np.frombuffer(table, "<i8", docs))
    lens = np.frombuffer(table, "<u4", docs, offset=8 * docs).astype(np.int64)
    ids = _decode_ids(body[4 + table_size :], n, vocabulary) if n else np.zeros(0, np.int64)
    ids = ids.astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("decoded ids differ from those written")
    return doc_ids, lens, ids
