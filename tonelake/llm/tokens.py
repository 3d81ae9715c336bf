"""Token ids of whole texts with a vocabulary file of the tokenizers library.

``word_bpe_49k.json`` never joins characters across white space, so a text's
ids are its words' ids in a row. A worker keeps the ids of the words it has
met, by 64-bit hash (a bounded memory), and asks the library only for new ones.
A second, independent hash is compared on every hit: words of one hash never share ids.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from tonelake.llm.texts import ragged, text_bytes, word_hashes, words
from tonelake.llm.worker import kept

END = 1
CACHE_WORDS = 1_500_000
CACHE_RECENT = 150_000
CACHE_PARTS = 200_000

#: Words of these characters alone are cut as the vocabulary's own pattern cuts them:
#: runs of letters, single digits, runs of anything else.
_PLAIN = re.compile("[\x21-\x26\x28-\x3b\x3d-\x7eÀ-ÖØ-öø-ÿ]+")
_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_ENDS = frozenset(".,;:!?")
_PART = re.compile("[a-zß-öø-ÿ]+|[0-9]|[\x21-\x26\x28-\x2f\x3a\x3b\x3d-\x40\x5b-\x60\x7b-\x7e]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of many texts at once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.parts: dict[str, list[int]] = {}
        spelled = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.alphabet = {c: spelled(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self._clear()

    def _clear(self) -> None:
        # Hashes of known words in two sorted tables, a large one and what came since; where their ids are.
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.tables = [none, none]
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Adds the ids of new words; where each one's start and how many they are."""
        parts, whole = self.parts, _PLAIN.fullmatch
        if len(parts) > CACHE_PARTS:
            parts.clear()
        model = self.library.model.tokenize
        ids: list[list[int]] = [None] * len(found)  # of each word
        hard = []
        for i, w in enumerate(found):
            # Most words are letters alone, or with one sign behind: already what the cutting would make of them.
            tail = None
            if w[-1] in _ENDS:
                w, tail = w[:-1], w[-1]
            if not w.isalpha() or not (w.isascii() or whole(w)):
                hard.append(i)
                continue
            w = w.lower()
            known = parts.get(w)
            if known is None:
                known = parts[w] = [t.id for t in model(w if w.isascii() else w.translate(self.alphabet))]
            if tail is not None:
                if tail not in parts:
                    parts[tail] = self.library.encode(tail, add_special_tokens=False).ids
                known = known + parts[tail]
            ids[i] = known
        if hard:
            self._learn_hard([found[i] for i in hard], ids, hard)
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        need = self.used + int(lens.sum())
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat) // 2), np.uint32)])
        self.flat[self.used : need] = np.fromiter(chain.from_iterable(ids), np.uint32, need - self.used)
        starts = self.used + np.cumsum(lens) - lens
        self.used = need
        return starts, lens

    def _learn_hard(self, found: list[str], ids: list, places: list[int]) -> None:
        """The ids of words with other characters, cut into parts as the vocabulary's own pattern cuts them, or left to the library."""
        parts, whole = self.parts, _PLAIN.fullmatch
        cut = [_PARTS.findall(w.lower()) if whole(w) else [w] for w in found]
        odd = []
        model = self.library.model.tokenize
        for p in set(chain.from_iterable(cut)).difference(parts):
            if _PART.fullmatch(p):  # already what the normaliser and the cutting would make of it
                parts[p] = [t.id for t in model(p if p.isascii() else p.translate(self.alphabet))]
            else:
                odd.append(p)
        for p, e in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False)):
            parts[p] = e.ids
        for i, ps in zip(places, cut):
            ids[i] = parts[ps[0]] if len(ps) == 1 else list(chain.from_iterable(parts[p] for p in ps))

    def _remember(self, *found: np.ndarray) -> None:
        def joined(a, b):
            rows = [np.concatenate(x) for x in zip(a, b)]
            order = np.argsort(rows[0], kind="stable")
            return tuple(x[order] for x in rows)

        large, recent = self.tables
        recent = joined(recent, found)
        if len(recent[0]) > CACHE_RECENT:
            large, recent = joined(large, recent), tuple(x[:0] for x in recent)
        self.tables = [large, recent]

    def _words(self, h: np.ndarray, check: np.ndarray, spell) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of words start and how many they are; ``h`` is without repeats, ``spell(i)`` gives the words themselves."""
        starts, lens, other = np.empty(len(h), np.int64), np.full(len(h), -1), np.zeros(len(h), bool)
        for known, checks, s, n in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                same = hit & (checks[at] == check)
                other |= hit & ~same
                starts[same], lens[same] = s[at[same]], n[at[same]]
        new = np.flatnonzero(lens < 0)
        if len(new):
            starts[new], lens[new] = self._learn(spell(new))
            new = new[~other[new]]  # another word already has the hash: this one is asked for each time
            self._remember(h[new], check[new], starts[new], lens[new])
        return starts, lens

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Of an Arrow column of texts, all ids (unsigned 32 bits) in a row, each text closed by ``END``, and
        their number per text."""
        if sum(len(t[0]) for t in self.tables) > CACHE_WORDS:
            self._clear()
        data, at = text_bytes(column)
        first, last, before = words(data, at)
        h, one, back = np.unique(word_hashes(data, first, last), return_index=True, return_inverse=True)
        check = word_hashes(data, first, last, 1)

        def spell(new):
            return [data[a:b].tobytes().decode() for a, b in zip(first[new].tolist(), last[new].tolist())]

        starts, lens = self._words(h, check[one], lambda new: spell(one[new]))
        odd = np.flatnonzero(check != check[one][back])  # words whose hash another word of the batch has
        starts, lens = starts[back], lens[back]
        if len(odd):
            starts[odd], lens[odd] = self._learn(spell(odd))
        ids = self.flat[ragged(starts, lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])[before[1:]]
        return np.insert(ids, ends, END).astype(np.uint32, copy=False), np.diff(ends, prepend=0) + 1


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary."""
    name = f"encoder {path}"
    if name not in kept():
        kept()[name] = WordEncoder(path)
    return kept()[name]
