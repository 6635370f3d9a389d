"""Array kernels that run inside Spark tasks, on one Arrow batch at a time.

Everything here works on whole texts, in slices of bounded size, so that a
task's memory depends on the longest document and not on the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters or bytes handled at once; one longer document is cut at white space.
SLICE = 400_000

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE:  # longer ones are not kept
            _powers[name] = have
    return have[:n]


#: The field of the word hashes, two bases of it, and their powers and inverse powers.
_FIELD, _BASES = np.uint64((1 << 31) - 1), (1_398_022_307, 876_543_211)
_fields: list[np.ndarray] = []


def _folded(x: np.ndarray) -> np.ndarray:
    """``x`` below 2^62 as an equal number of the field below 2^32."""
    return (x & _FIELD) + (x >> np.uint64(31))


def _field_powers(n: int) -> list[np.ndarray]:
    """Powers of the two bases and of their inverses, each from 0 up to ``n`` at least."""
    if _fields and len(_fields[0]) > n:
        return _fields
    size, p, tables = max(n, SLICE) + 1, int(_FIELD), []
    for base in (x for b in _BASES for x in (b, pow(b, -1, p))):
        table, k = np.ones(size, np.uint64), 1
        while k < size:
            more = min(k, size - k)
            table[k : k + more] = table[:more] * np.uint64(pow(base, k, p)) % _FIELD
            k += more
        tables.append(table.astype(np.uint32))  # 31 bits: half the memory
    if size <= 4 * SLICE:  # longer ones are not kept
        _fields[:] = tables
    return tables


def field_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each span, from two polynomials over the field of 2^31 - 1.

    Two given spans of L values meet in a share (L / 2^31)^2 of all pairs of
    bases; no regular pattern of values meets under each, as patterns do that
    are hashed modulo a power of two.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    tables, shifted, parts = _field_powers(len(values)), values.astype(np.uint64) + np.uint64(1), []
    total = np.zeros(len(values) + 1, np.uint64)
    for up, down in (tables[:2], tables[2:]):
        np.cumsum(_folded(shifted * up[: len(values)]), out=total[1:])
        parts.append((total[ends] - total[starts]) % _FIELD * down[starts] % _FIELD)
    return mix64((parts[0] | parts[1] << np.uint64(31)) ^ mix64((ends - starts).astype(np.uint64)))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each span; equal contents hash alike wherever they stand.

    Cheap, but regular patterns of two values (as of Thue and Morse) share a
    hash: whoever uses it compares the contents.
    """
    n = len(values)
    if not len(starts):
        return np.empty(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power_table("r", _R, n), out=total[1:])
    h = (total[ends] - total[starts]) * _power_table("rinv", _RINV, n + 1)[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, and afterwards what the worker, which other tasks use again, holds of memory that nothing needs."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the C library that most clusters run on
            trim(0)


def text_slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[list[str], int]]:
    """Texts (null: empty) as lists of at most ``most`` characters or one text each, with the first one's index."""
    held: list[str] = []
    size = first = 0
    every = (t for k in range(0, len(texts), 16) for t in texts.slice(k, 16).to_pylist())
    for i, text in enumerate(every):
        text = text or ""
        if held and size + len(text) > most:
            yield held, first
            held, size, first = [], 0, i
        held.append(text)
        size += len(text)
    if held:
        yield held, first


_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True


#: White space and ASCII punctuation.
NO_WORD = _ASCII_SPACE.copy()
NO_WORD[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _hash_words(raw: bytes, between: np.ndarray = _ASCII_SPACE) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = between[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return field_hashes(data, edge[0::2], edge[1::2])


def word_hashes(text: str | None, most: int = 4 * SLICE, between: np.ndarray = _ASCII_SPACE) -> np.ndarray:
    """Hashes of the words of a text with A-Z lower-cased, in order: [^\\x20\\x09-\\x0D]+ or what stands ``between`` words."""
    raw = (text or "").encode().lower()
    parts, at = [], 0
    while len(raw) - at > most:
        cut = raw.find(b" ", at + most)
        if cut < 0:
            break
        parts.append(_hash_words(raw[at:cut], between))
        at = cut
    parts.append(_hash_words(raw[at:] if at else raw, between))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def batch_word_hashes(texts: pa.Array, between: np.ndarray = _ASCII_SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of a batch: (index of the first text, hashes of all its words, offsets of the texts in them)."""
    for held, first in text_slices(texts):
        if len(held) == 1:
            h = word_hashes(held[0], between=between)
            yield first, h, np.array([0, len(h)])
            continue
        raws = [t.encode().lower() for t in held]
        data = b"\n".join(raws)
        arr = np.frombuffer(data, np.uint8)
        space = np.ones(len(arr) + 2, bool)
        space[1:-1] = between[arr]
        edge = np.flatnonzero(space[1:] != space[:-1])
        starts = edge[0::2]
        begin = np.cumsum([0, *(len(r) + 1 for r in raws)])
        yield first, field_hashes(arr, starts, edge[1::2]), np.searchsorted(starts, begin)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes, ascending, of the windows of ``width`` words; of the whole text if it has fewer; none without words."""
    if not len(h):
        return h
    width = min(width, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = (out + h[k : k + len(out)]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return np.unique(mix64(out))
