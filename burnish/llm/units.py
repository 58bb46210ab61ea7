"""Token ids of many texts at once, each distinct piece coded once.

Both vocabularies split a text into pieces before any merge. Where these pieces are
certain (ASCII, Latin letters of U+00C0 to U+00FF, punctuation of U+2010 to U+2027),
numpy cuts a slice of texts into pieces, equal ones are told by their bytes, and the
library's model codes each distinct piece; a bounded cache keeps pieces from slice to
slice. A text with any other character, or with a special string, is split at spaces
where no piece can cross, and the units without plain characters alone go to the
library as they are; runs of white space send a text to the library whole.
Texts longer than a slice are cut between words, so memory is bounded for any length.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import _shared
from .words import mixed

#: Entries of one generation of a worker's caches; two generations are kept of each.
CACHE_UNITS, CACHE_PIECES = 100_000, 400_000
#: Bytes of texts that are cut into pieces at once.
SLICE_BYTES = 2 << 20

PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[.,!?;:#$%&*|()+@_=<>/\"-]+|\n")
#: A space that begins a piece whatever is before it.
CUT = re.compile(rb"(?<=[^\s]) (?=[^\s])")

SPACE, BREAK, LETTER, DIGIT, MARK, ODD, NONE = range(7)
KIND = np.full(256, ODD, np.uint8)
KIND[0x20] = SPACE
KIND[0x09:0x0E] = BREAK
KIND[0x21:0x7F] = MARK
KIND[0x30:0x3A] = DIGIT
KIND[0x41:0x5B] = KIND[0x61:0x7B] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Masks of the first 0 to 8 bytes of a little-endian word.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: a printable
    byte stands for itself, the others get the letters from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of character that each byte of valid UTF-8 belongs to."""
    kind = KIND[data]
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = (padded[high + k] for k in range(3))
        two = high[(a == 0xC3) & (b != 0x97) & (b != 0xB7)]
        kind[two] = kind[two + 1] = LETTER
        three = high[(a == 0xE2) & (b == 0x80) & (c >= 0x90) & (c <= 0xA7)]
        for k in range(3):
            kind[three + k] = MARK
    return kind


def equals(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct pairs of words, and for each pair which of them it is."""
    n = len(low)
    chosen, open_, h = np.zeros(n, np.int64), np.arange(n), mixed(low ^ mixed(high))
    table = np.zeros(1 << (2 * n).bit_length(), np.int64)
    while len(open_):
        slot = h[open_] & np.uint64(len(table) - 1)
        table[slot] = open_  # of all that come to a slot one stays, which its equals find
        held = table[slot]
        same = (low[held] == low[open_]) & (high[held] == high[open_])
        chosen[open_[same]] = held[same]
        open_ = open_[~same]
        h = h >> np.uint64(9) | h << np.uint64(55)
    at = np.flatnonzero(chosen == np.arange(n))
    number = np.zeros(n, np.int64)
    number[at] = np.arange(len(at))
    return at, number[chosen]


class Risky(Exception):
    """The unit belongs to a run of white space that began before it."""


class Pieces(dict):
    """ids of pieces (UTF-8), coded when first asked for. Of the last two generations
    of CACHE_PIECES entries each, the older goes when the younger is full."""

    def __init__(self, code):
        super().__init__()
        self.code, self.old = code, {}

    def __missing__(self, piece: bytes) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.code(piece)
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class UnitEncoder(dict):
    """ids() and each() give texts' ids as little-endian unsigned 32-bit bytes.

    keeps_space: whether a space is part of the piece that follows (byte-level
    vocabularies) or is dropped (lower-case vocabularies with word ends).
    """

    def __init__(self, path: str, keeps_space: bool):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_space = keeps_space
        self.letters = byte_letters()
        self.old: dict[str, bytes] = {}
        self.pieces = Pieces(self.merged)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, piece: bytes) -> bytes:
        """ids of one piece, which the library's model merges."""
        return array("I", [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]).tobytes()

    def __missing__(self, unit: str) -> bytes:
        value = self.old.get(unit)
        if value is None:
            value = self.coded(unit)
        self[unit] = value
        return value

    def coded(self, unit: str) -> bytes:
        if self.keeps_space and (not unit or unit[0].isspace()):
            raise Risky
        found = PLAIN.findall(unit)
        if sum(map(len, found)) != len(unit) or "\n\n" in unit or unit.endswith("\n"):
            return self.whole(" " + unit if self.keeps_space else unit)
        if self.keeps_space:
            if found:
                found[0] = " " + found[0]
        else:
            found = [p for x in found if x != "\n" for p in (x if x.isdigit() else [x.lower()])]
        return b"".join([self.pieces[x.encode()] for x in found])

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        if len(self) > CACHE_UNITS:
            self.old = dict(self)
            self.clear()
        units = text.split(" ")
        try:
            if self.keeps_space:
                return self.whole(units[0]) + b"".join(map(self.__getitem__, units[1:]))
            return b"".join(map(self.__getitem__, units))
        except Risky:
            return self.whole(text)

    def each(self, column: pa.LargeStringArray) -> Iterator[bytes | memoryview]:
        """ids of each text of a column without nulls, in order."""
        for first, last in _shared.slices(column, SLICE_BYTES):
            data, ends = _shared.raw(column.slice(first, last - first))
            if len(data) <= 2 * SLICE_BYTES:
                yield from self.slice(data, ends)
                continue
            whole, at, parts = data.tobytes(), 0, []  # one long text
            while at < len(whole):
                cut = CUT.search(whole, at + SLICE_BYTES)
                stop = cut.start() if cut else len(whole)
                parts += self.slice(data[at:stop], np.array([0, stop - at]))
                at = stop
            yield b"".join(parts)

    def slice(self, data: np.ndarray, ends: np.ndarray) -> list[bytes | memoryview]:
        """ids of the texts data[ends[k]:ends[k + 1]]."""
        if not len(data):
            return [b""] * (len(ends) - 1)
        kind = kinds(data)
        whole = text = data.tobytes()
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(kind == ODD), "right") - 1).tolist()
        if any(s.encode() in whole for s in self.special):
            odd = [k for k in range(len(ends) - 1) if k in set(odd) or any(s.encode() in whole[ends[k] : ends[k + 1]] for s in self.special)]
        if not self.keeps_space:
            data = LOWER[data]
            high = np.flatnonzero(data == 0xC3)  # capitals of two bytes
            high = high[(kind[high] == LETTER) & (data[np.minimum(high + 1, len(data) - 1)] < 0x9F)]
            data[high + 1] += 32
            whole = data.tobytes()
        start, stop = self.cut(data, kind, ends)
        sizes, index, flat = self.distinct(data, whole, start, stop)
        n = sizes[index]
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        before = np.cumsum(sizes) - sizes
        ids = memoryview(flat[np.repeat(before[index] - total[:-1], n) + np.arange(total[-1])].tobytes())
        bounds = (4 * total[np.searchsorted(start, ends)]).tolist()
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for k in odd:
            out[k] = self.ids(text[ends[k] : ends[k + 1]].decode())
        return out

    def cut(self, data: np.ndarray, kind: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start and stop. Of a run of blanks the last one is a piece of its
        own, or begins the next piece if it is a space; the others are one piece."""
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        before = np.concatenate([[np.uint8(NONE)], kind[:-1]])
        before[edge[:-1]] = NONE
        after = np.concatenate([kind[1:], [np.uint8(NONE)]])
        after[edge[1:]] = NONE
        blank = kind <= BREAK
        if self.keeps_space:
            start = np.where(blank, (before > BREAK) | (after > BREAK) & (after < NONE), (before != SPACE) & (before != kind))
        else:
            start = ~blank & ((before != kind) | (kind == DIGIT))
        # 's 't 'm 'd 're 've 'll are pieces where a piece can begin.
        quote = np.flatnonzero((data == 0x27) & (before != MARK) & (before != ODD))
        if self.keeps_space:
            quote = quote[before[quote] != SPACE]
        if len(quote):
            padded = np.concatenate([data, np.zeros(3, np.uint8)])
            a, b = padded[quote + 1], padded[quote + 2]
            long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            size = np.where(long, 3, np.where(np.isin(a, [*b"stmd"]), 2, 0))
            inside = (size > 0) & (quote + size <= ends[np.searchsorted(ends, quote, "right")])
            quote, size = quote[inside], size[inside]
            start[quote + 1] = False
            beyond = (quote + size)[~edge[quote + size]]
            start[beyond[kind[beyond] == LETTER]] = True
        begins = np.flatnonzero(start)
        if self.keeps_space:
            return begins, np.append(begins[1:], len(data))
        return begins, np.flatnonzero(~blank & ((after <= BREAK) | (after == NONE) | np.append(start[1:], True))) + 1

    def distinct(self, data: np.ndarray, whole: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many ids each distinct piece has, which of them each piece is, and the ids
        of all distinct pieces one after another."""
        size = stop - start
        short = np.flatnonzero(size < 16)
        # Up to 15 bytes and their number are two words, which are equal if the pieces are.
        padded = np.concatenate([data, np.zeros(24, np.uint8)])
        words = np.ndarray((len(data) + 16,), "<u8", padded, strides=(1,))
        low = words[start[short]] & FIRST[np.minimum(size[short], 8)]
        high = words[start[short] + 8] & FIRST[np.maximum(size[short] - 8, 0)] | size[short].astype(np.uint64) << np.uint64(56)
        at, inverse = equals(low, high)
        index = np.zeros(len(start), np.int64)
        index[short] = inverse
        long = np.flatnonzero(size >= 16)
        index[long] = len(at) + np.arange(len(long))
        those = np.concatenate([short[at], long])
        code = self.pieces
        coded = [code[whole[a:b]] for a, b in zip(start[those].tolist(), stop[those].tolist(), strict=True)]
        return np.fromiter(map(len, coded), np.int64, len(coded)) // 4, index, np.frombuffer(b"".join(coded), "<u4")


_encoders: dict[tuple[str, bool], UnitEncoder] = {}


def encoder(path: str, keeps_space: bool) -> UnitEncoder:
    """The worker's encoder; its caches stay from task to task."""
    at = (path, keeps_space)
    if at not in _encoders:
        _encoders.clear()
        _encoders[at] = UnitEncoder(path, keeps_space)
    return _encoders[at]
