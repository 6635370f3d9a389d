"""Bounds and products on rows of the document by n-gram incidence matrix.

A row is the ascending array of 64-bit hashes of a document's distinct
n-grams. ``percent`` is the least similarity: 100 * |A & B| >= percent * |A | B|.
"""

from __future__ import annotations

import numpy as np

from cuewright.llm.kernels import mix64


def fingerprint(s: np.ndarray) -> int:
    """64 bits that stand for a whole row, as a signed number."""
    total = np.sum(mix64(s ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(s))
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


def prefix(s: np.ndarray, hot: np.ndarray, percent: int) -> np.ndarray:
    """The first columns of a row, rare ones before the ``hot`` (sorted): two rows that are linked share one of them.

    A link needs at least percent/100 of the larger row in common, so the rows
    cannot differ in all of the first n - ceil(percent * n / 100) + 1 columns of
    an order that is the same for all rows.
    """
    p = len(s) - -(-percent * len(s) // 100) + 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        common = hot[at] == s
        s = np.concatenate([s[~common], s[common]])
    return s[:p]


def parity_bits(n: int, percent: int) -> int:
    """Cells of a sketch: four for each column in which two linked rows of ``n`` columns may differ.

    Rows that have little in common differ in about half of the cells, which is
    twice as many as linked ones may.
    """
    most = 2 * n * (100 - percent) // (100 + percent)
    return max(64, 1 << (4 * most - 1).bit_length()) if most else 64


def parity_sketch(s: np.ndarray, percent: int) -> np.ndarray:
    """For each of a power of two of hash cells, whether the row has an odd number of columns there, as 64-bit words."""
    bits = parity_bits(len(s), percent)
    odd = np.bincount((mix64(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer cells; the parities of cells that fall together are added."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def possible_edges(ids: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], percent: int, left: int | None = None) -> list[tuple[int, int]]:
    """A forest over rows that the bounds of size and parity don't keep apart.

    Rows that are linked differ in at most (100-percent)/(100+percent) * (a+b)
    columns, and they differ in at least as many as their parities do. With
    ``left``, only pairs of one of the first ``left`` rows with a later one.
    """
    m = len(ids)
    order = np.argsort(sizes, kind="stable")
    side = np.zeros(m, bool) if left is None else np.arange(m) >= left
    ids, sizes, side = ids[order], sizes[order], side[order]
    words = np.array([len(sketches[k]) for k in order])
    tree = np.arange(m)  # which tree of the forest a row is in
    edges, tables = [], {}
    far = np.searchsorted(sizes * percent, sizes * 100, side="right")  # sizes[j] * percent <= sizes[i] * 100
    for i in range(m):
        lo, hi = i + 1, int(far[i])
        other = tree[lo:hi] != tree[i]
        if left is not None:
            other &= side[lo:hi] != side[i]
        # rows that are in one tree already need no comparison
        at = np.flatnonzero(other)
        if not len(at):
            continue
        w = int(words[i])
        if w not in tables:
            first, last = int(np.searchsorted(words, w)), int(np.searchsorted(sizes * percent, sizes[words == w].max() * 100, side="right"))
            tables[w] = first, np.stack([folded(sketches[k], w) for k in order[first:last]])
        first, table = tables[w]
        differ = np.bitwise_count(table[at + lo - first] ^ table[i - first]).sum(1, dtype=np.int64)
        near = at[differ * (100 + percent) <= (100 - percent) * (sizes[at + lo] + sizes[i])] + lo
        found, which = np.unique(tree[near], return_index=True)
        edges += [(int(ids[i]), int(ids[j])) for j in near[which].tolist()]
        if len(found):
            tree[np.isin(tree, found)] = tree[i]
    return edges


def row_product(rows: list[np.ndarray], columns_at_once: int = 2048) -> np.ndarray:
    """How many columns each two rows share, accumulated over blocks of columns.

    Columns that many of the rows have are multiplied as dense blocks; the
    others add one for each two of their rows.
    """
    m = len(rows)
    out = np.zeros((m, m), np.int64)
    if m == 2:
        out[:] = len(np.intersect1d(rows[0], rows[1], assume_unique=True))
        np.fill_diagonal(out, [len(s) for s in rows])
        return out
    row = np.repeat(np.arange(m), [len(s) for s in rows])
    _, column, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    dense = count[column] * 16 >= m
    r, (_, c) = row[dense], np.unique(column[dense], return_inverse=True)
    for lo in range(0, int(c[-1]) + 1 if len(c) else 0, columns_at_once):
        a, b = np.searchsorted(c, [lo, lo + columns_at_once])
        block = np.zeros((m, columns_at_once), np.float32)
        block[r[a:b], c[a:b] - lo] = 1
        out += (block @ block.T).astype(np.int64)  # at most columns_at_once each: exact
    r, c = row[~dense], column[~dense]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(c)))
    for d in np.unique(size).tolist():
        at, step = first[size == d], max(1, 1_000_000 // (d * d))
        for k in range(0, len(at), step):
            own = r[at[k : k + step, None] + np.arange(d)]
            np.add.at(out, (own[:, :, None], own[:, None, :]), 1)
    np.fill_diagonal(out, [len(s) for s in rows])
    return out


def linked(rows: list[np.ndarray], percent: int) -> np.ndarray:
    """Which rows are linked; a pair whose overlap stays below the bound of its two sizes is discarded."""
    n = np.array([len(s) for s in rows], np.float64)
    overlap = row_product(rows).astype(np.float64)
    found = overlap * (100 + percent) >= percent * (n[:, None] + n[None, :])
    np.fill_diagonal(found, False)
    return found
