"""Byte-pair encoding of whole texts by their pre-tokens.

A text is cut by the public byte-level pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
The cut is computed for many texts at once from the classes of their
characters; a piece is then encoded once by a tokenizer library and its ids are
kept while the task runs, as the pieces of a corpus repeat. Kept pieces are
found by a hash and compared by their characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

from cuewright.llm.kernels import SLICE, span_hashes, text_slices

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
_classes: list[np.ndarray] = []


def byte_to_char() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others for characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, other."""
    if not _classes:
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        every = "".join(map(chr, points))
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[points[m.start()] : points[m.end() - 1] + 1] = kind
        table[0xD800:0xE000] = OTHER
        _classes.append(table)
    return _classes[0]


def piece_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces start in texts laid end to end; ``begins``: where each non-empty text starts."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = char_classes()[points]
    new = np.zeros(n, bool)
    new[begins] = True
    start = new.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space before other characters is a piece of its own, or joins them if it is a blank
    joins = np.flatnonzero(start[1:] & ~new[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[joins - 1] = True
    start[joins[points[joins - 1] == 0x20]] = False
    # contractions
    quote = np.flatnonzero(start & (points == 0x27))
    if len(quote):
        text = np.concatenate([points, np.zeros(3, points.dtype)])
        fresh = np.concatenate([new, np.ones(3, bool)])
        a, b = text[quote + 1], text[quote + 2]
        ok = ~fresh[quote + 1]
        one = ok & np.isin(a, [ord(c) for c in "stmd"])
        two = ok & ~one & ~fresh[quote + 2] & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        for at, size in ((quote[one], 2), (quote[two], 3)):
            start[at + 1] = False
            after = at + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


def _safe_cuts(text: str, most: int) -> list[str]:
    """A very long text in parts: a piece always starts at a blank that follows a letter."""
    parts, at = [], 0
    while len(text) - at > most:
        cut = at + most
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or text[cut - 1].isalpha():
                break
            cut += 1
        if cut < 0:
            break
        parts.append(text[at:cut])
        at = cut
    parts.append(text[at:])
    return parts


class PieceEncoder:
    """Encodes texts to ids; ``encode_pieces`` gives the ids of each of a list of pieces."""

    #: Ids, and characters of pieces, that are kept (about 50 MB together); with more, the kept pieces are forgotten.
    MOST, MOST_CHARS = 1_500_000, 4_000_000

    def __init__(self, encode_pieces: Callable[[list[str]], list[list[int]]]):
        self._encode = encode_pieces
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.slots = np.empty(0, np.int64)
        self.off, self.char_off = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.flat, self.chars = np.empty(0, np.uint32), np.empty(0, np.uint32)

    def _add(self, pieces: list[str]) -> np.ndarray:
        """The slots of newly encoded pieces."""
        ids, first = self._encode(pieces), len(self.off) - 1
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for own in ids for x in own), np.uint32, int(sizes.sum()))
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, flat])
        self.char_off = np.concatenate([self.char_off, self.char_off[-1] + np.cumsum([len(p) for p in pieces])])
        self.chars = np.concatenate([self.chars, np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)])
        return np.arange(first, first + len(pieces))

    def _slots(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> np.ndarray:
        if len(self.flat) > self.MOST or len(self.chars) > self.MOST_CHARS:
            self._forget()
        distinct, first, inverse = np.unique(span_hashes(points, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        missing = np.flatnonzero(~known)
        if len(missing):
            slots = self._add([text[s:e] for s, e in zip(starts[first[missing]].tolist(), ends[first[missing]].tolist(), strict=True)])
            self.keys = np.insert(self.keys, at[missing], distinct[missing])
            self.slots = np.insert(self.slots, at[missing], slots)
            at = np.searchsorted(self.keys, distinct)
        slot = self.slots[at][inverse]
        # the kept pieces laid end to end are the text, but where a hash stands for another piece
        size = ends - starts
        other = self.char_off[slot + 1] - self.char_off[slot] != size
        place = np.arange(starts[0], ends[-1]) + np.repeat(np.where(other, 0, self.char_off[slot]) - starts, size)
        unlike = self.chars.take(place, mode="clip") != points[starts[0] : ends[-1]]
        if unlike.any() or other.any():
            other |= np.logical_or.reduceat(unlike, starts - starts[0])
            wrong = np.flatnonzero(other)
            pieces, back = np.unique([text[s:e] for s, e in zip(starts[wrong].tolist(), ends[wrong].tolist(), strict=True)], return_inverse=True)
            slot[wrong] = self._add(pieces.tolist())[back]
        return slot

    def _encode_slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        begins = np.cumsum([0, *map(len, texts)])
        starts = piece_starts(points, np.unique(begins[begins < len(points)]))
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        slot = self._slots(points, starts, ends, whole)
        size = self.off[slot + 1] - self.off[slot]
        cum = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.off[slot] - cum[:-1], size) + np.arange(cum[-1])]
        return ids, cum[np.searchsorted(starts, begins)]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of a batch: (index of the first text, ids, offsets of the texts in them)."""
        for held, first in text_slices(texts):
            if len(held) == 1 and len(held[0]) > SLICE:
                parts = [self._encode_slice([p])[0] for p in _safe_cuts(held[0], SLICE)]
                ids = np.concatenate(parts)
                yield first, ids, np.array([0, len(ids)])
            else:
                ids, off = self._encode_slice(held)
                yield first, ids, off
