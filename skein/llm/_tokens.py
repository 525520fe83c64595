"""Whole-batch tokenization: the library's ids, looked up by distinct unit of text.

A text is cut at places where the tokenizer's own splitting always has a
boundary, so the ids of a text are those of its units in a row. Units repeat;
each distinct one is encoded once by the tokenizers library and then found by
its 64-bit hash (its size and end bytes are compared too), a table look-up for a whole batch at once. A text that holds
the start of a special token's string is encoded by the library as a whole.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from ._text import U64, span_ends, span_hash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: First bytes of characters that may be white space beyond ASCII.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: ASCII marks that end a run of letters.
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True

#: A unit that is one run of letters, perhaps behind a space.
_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Byte-level BPE writes each byte as a visible character: itself where it is one, else the next from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: b if b in _VISIBLE else 256 + sum(x not in _VISIBLE for x in range(b)) for b in range(256)}

_LOADED: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, keeps_space: bool) -> "Encoder":
    """The encoder of a tokenizer file, one for each Python worker."""
    if (path, keeps_space) not in _LOADED:
        _LOADED[path, keeps_space] = Encoder(path, keeps_space)
    return _LOADED[path, keeps_space]


def unit_starts(buf: np.ndarray, offs: np.ndarray, keeps_space: bool) -> np.ndarray:
    """Byte positions at which units start, those of the documents among them.

    Cuts lie before the last white space of a run that text follows, behind it
    if it is no plain space (which opens the next token), and between an ASCII or
    Latin-1 letter and an ASCII mark. With ``keeps_space`` false the tokenizer
    drops white space.
    """
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    if n:
        space = _SPACE[buf]
        last = space.copy()
        last[:-1] &= ~space[1:] & ~_MAYBE_SPACE[buf[1:]]
        last[-1] = False
        inner = offs[(offs > 0) & (offs < n)]
        last[inner - 1] = False  # white space at a document's end has no text behind it
        at = np.flatnonzero(last)
        cut[at] = True
        cut[at[buf[at] != 32] + 1] = True
        marks = np.flatnonzero(_MARK[buf[1:]]) + 1
        before = buf[marks - 1]
        latin = np.zeros(len(marks), bool)
        two = marks >= 2
        latin[two] = (buf[marks[two] - 2] == 0xC3) & (before[two] != 0x97) & (before[two] != 0xB7)
        cut[marks[_LETTER[before] | latin]] = True
    cut[offs] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """Ids of documents by distinct unit. The table of units is bounded by ``most``; beyond it starts anew."""

    SLOTS = 1 << 21

    def __init__(self, path: str, keeps_space: bool, most: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keeps_space, self.most = Tokenizer.from_file(path), keeps_space, most
        self.specials = sorted({t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self._clear()

    def _clear(self) -> None:
        self.slot_hash = np.zeros((2, self.SLOTS), U64)
        self.slot_unit = np.full((2, self.SLOTS), -1, np.int32)
        self.slot_check = np.zeros((2, self.SLOTS), np.uint32)
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.first, self.size, self.n_units = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), 0

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = U64(self.SLOTS - 1)
        return (h & mask).astype(np.int64), ((h >> U64(32)) & mask).astype(np.int64)

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Number of each unit, by its hash, held against its size and end bytes; -1 if unknown."""
        a, b = self._slots(h)
        out = np.where((self.slot_hash[0][a] == h) & (self.slot_check[0][a] == check), self.slot_unit[0][a], -1)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            hb, cb, bb = h[miss], check[miss], b[miss]
            out[miss] = np.where((self.slot_hash[1][bb] == hb) & (self.slot_check[1][bb] == cb), self.slot_unit[1][bb], -1)
        return out

    def _learn(self, texts: list[str], h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Encode new units; their numbers."""
        flat, size = self._encoded(texts)
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_units + len(size) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        own = np.arange(self.n_units, self.n_units + len(size), dtype=np.int32)
        self.size[own] = size
        self.first[own] = self.n_ids + np.cumsum(size) - size
        self.n_ids, self.n_units = self.n_ids + len(flat), self.n_units + len(size)
        a, b = self._slots(h)
        taken = self.slot_unit[0][a] >= 0
        for k, at, w in ((0, a, np.flatnonzero(~taken)), (1, b, np.flatnonzero(taken))):
            self.slot_hash[k][at[w]] = h[w]
            self.slot_check[k][at[w]] = check[w]
            self.slot_unit[k][at[w]] = own[w]
        return own

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has.

        A unit that is one run of ASCII or Latin-1 letters is one piece for the
        model, so it goes there at once; the others take the whole way.
        """
        model, parts, rest = self.tokenizer.model, [], []
        for k, t in enumerate(texts):
            if _WORD.fullmatch(t):
                t = t if self.keeps_space else t.lstrip().lower()
                parts.append([x.id for x in model.tokenize(t.encode().decode("latin-1").translate(_BYTE_CHARS))])
            else:
                parts.append(None)
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch([texts[k] for k in rest], add_special_tokens=False)):
            parts[k] = e.ids
        size = np.fromiter(map(len, parts), np.int32, len(parts))
        return np.fromiter(chain.from_iterable(parts), np.uint32, int(size.sum())), size

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents of a chunk in a row (uint32), and where each document's start (n + 1)."""
        if self.n_units > self.most:
            self._clear()
        start = unit_starts(buf, offs, self.keeps_space)
        end = np.r_[start[1:], len(buf)][: len(start)]
        h, check = span_hash(buf, start, end), span_ends(buf, start, end).astype(np.uint32)
        unit = self._find(h, check)
        miss = np.flatnonzero(unit < 0)
        if len(miss):
            _, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            if (check[miss] != check[miss][where][back]).any():  # units of one hash
                _, where, back = np.unique(np.stack([h[miss], check[miss].astype(U64)]), axis=1, return_index=True, return_inverse=True)
                back = back.reshape(-1)
            at = miss[where]
            unit[miss] = self._learn([buf[s:e].tobytes().decode() for s, e in zip(start[at], end[at])], h[at], check[at])[back]
        size = self.size[unit]
        total = np.r_[0, np.cumsum(size, dtype=np.int64)]
        pos = np.arange(total[-1]) - np.repeat(total[:-1] - self.first[unit], size)
        ids, bounds = self.ids[pos], total[np.searchsorted(start, offs)]
        whole = sorted({int(np.searchsorted(offs, p, "right")) - 1 for s in self.specials for p in _places(buf, s)})
        if whole:
            parts = [ids[bounds[d] : bounds[d + 1]] for d in range(len(offs) - 1)]
            for d in whole:
                parts[d] = np.array(self.tokenizer.encode(buf[offs[d] : offs[d + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            ids, bounds = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        return ids, bounds


def _places(buf: np.ndarray, what: bytes) -> list[int]:
    text, out = buf.tobytes(), []
    at = text.find(what)
    while at >= 0:
        out.append(at)
        at = text.find(what, at + 1)
    return out
