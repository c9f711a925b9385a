"""Substrings and best segmentations of many words at once, as arrays: what unigram training runs in its tasks.

Pieces are numbers.  A chunk of words holds, for each position, the pieces that begin there, shortest first: the
character and the longer ones.  All substrings of a word are beginnings of its suffixes, so suffixes, and not
substrings, are sorted and counted.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Places of a dense table (word, position, length) at once.
CELLS = 1 << 18


def matrix(suffixes: list[str], width: int) -> np.ndarray:
    """Their code points plus one, a row each; 0 is the end."""
    flat = np.frombuffer("".join(suffixes).encode("utf-32-le"), np.uint32) + np.uint32(1)
    sizes = np.fromiter(map(len, suffixes), np.int64, len(suffixes))
    out = np.zeros((len(suffixes), width), np.uint32)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def repeated_beginnings(suffixes: list[str], freq: np.ndarray, width: int, least: int = 2):
    """Beginnings of 2 to ``width`` characters that the suffixes show at least ``least`` times, weighted by ``freq``, in
    their order: (one suffix that begins so, length, n), and of every suffix (how many of its beginnings are among
    them, their numbers one after the other, shortest first)."""
    rows = matrix(suffixes, width)
    order = np.argsort(np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * width}").ravel(), kind="stable")
    rows, weight = rows[order], freq[order]
    n = len(order)
    common = np.zeros(n, np.int64)  # characters that a row has in common with the one before
    same = np.ones(n - 1, bool)
    for i in range(width):
        same = same & (rows[1:, i] == rows[:-1, i]) & (rows[1:, i] > 0)
        common[1:] += same
    size = (rows > 0).sum(axis=1)
    found, owner = [], []  # (row that begins it, length, n); for each row and length, which of them
    total = 0
    for length in range(2, width + 1):
        long = np.flatnonzero(size >= length)
        if not len(long):
            break
        # rows of one beginning follow each other, and rows too short for it never lie between them
        begin = np.flatnonzero(np.r_[True, common[long[1:]] < length])
        sums = np.add.reduceat(weight[long], begin)
        kept = sums >= least
        number = np.where(kept, np.cumsum(kept) - 1 + total, -1)
        owner.append((long, np.repeat(number, np.diff(np.r_[begin, len(long)]))))
        found.append((long[begin[kept]], np.full(int(kept.sum()), length), sums[kept]))
        total += int(kept.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3, np.zeros(n, np.int64), np.zeros(0, np.int64)
    first, length, sums = (np.concatenate(x) for x in zip(*found))
    ranked = np.lexsort((length, first))  # shorter ones of a row come first: the order of the strings
    rank = np.empty(total, np.int32)
    rank[ranked] = np.arange(total, dtype=np.int32)
    table = np.full((n, width), -1, np.int32)
    for i, (long, number) in enumerate(owner):
        table[long, i] = np.where(number >= 0, rank[number], -1)
    back = np.empty((n, width), np.int32)
    back[order] = table
    held = back >= 0
    return (order[first[ranked]], length[ranked], sums[ranked]), held.sum(axis=1), back[held]


class Chunk(NamedTuple):
    """Words as arrays: their sizes and frequencies; of each position how many pieces begin there, and the pieces."""
    sizes: np.ndarray
    freq: np.ndarray
    begun: np.ndarray
    pieces: np.ndarray


def best_pieces(chunk: Chunk, logp: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, n) of the most probable segmentation of every word, weighted by its frequency; the earlier first cut of
    equal ones.  ``logp`` by piece, with minus infinity last and for pieces that are none."""
    first = np.cumsum(chunk.sizes) - chunk.sizes  # positions of the words, pieces of the positions
    at = np.cumsum(chunk.begun) - chunk.begun
    ids, counts = [], []
    for size in np.unique(chunk.sizes).tolist():
        own = np.flatnonzero(chunk.sizes == size)
        most = max(1, CELLS // (size * width))
        for lo in range(0, len(own) if size else 0, most):
            words = own[lo:lo + most]
            place = (first[words][None, :] + np.arange(size)[:, None]).ravel()  # position by position
            held = chunk.begun[place]
            longest = int(held.max())
            cell = np.arange(longest)[None, :]
            inside = cell < held[:, None]
            table = np.full((len(place), longest), -1, np.int32)
            table[inside] = chunk.pieces[(at[place][:, None] + cell)[inside]]
            table = np.ascontiguousarray(table.reshape(size, len(words), longest).transpose(0, 2, 1))
            found, n = _segmented(table, logp, chunk.freq[words])
            ids.append(found)
            counts.append(n)
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(counts)


def _segmented(table: np.ndarray, logp: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``table``: the piece at (position, length less one, word)."""
    size, width, m = table.shape
    lp = logp[table]
    best = np.full((size + 1, m), -np.inf)
    best[0] = 0.0
    back = np.zeros((size + 1, m), np.int32)
    for e in range(1, size + 1):
        s = np.arange(max(0, e - width), e)
        tried = best[s] + lp[s, e - 1 - s]
        cut = tried.argmax(axis=0)  # the first of equal ones
        best[e] = tried[cut, np.arange(m)]
        back[e] = s[0] + cut
    word = np.flatnonzero(best[size] > -np.inf)
    e = np.full(len(word), size)
    ids, owner = [], []
    while len(word):
        s = back[e, word]
        ids.append(table[s, e - s - 1, word])
        owner.append(word)
        word, e = word[s > 0], s[s > 0]
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ids).astype(np.int64), freq[np.concatenate(owner)]
