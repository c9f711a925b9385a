"""Merges in words held as flat arrays of symbol numbers: what the trainers of ``subword`` run on the
bounded part of a corpus that the driver fetches, and what the tasks run to bring their words up to date.

A word is a run of positions linked to their neighbours; a merge rewrites all places of a pair at once and
says which pairs it took away and made.  All loops over places are numpy's.
"""

from __future__ import annotations

import heapq

import numpy as np

_LOW = (1 << 32) - 1


def pair_code(a, b):
    """One number for a pair of symbols."""
    return (np.asarray(a, np.int64) << 32) | np.asarray(b, np.int64)


def split_code(code: int) -> tuple[int, int]:
    return int(code) >> 32, int(code) & _LOW


def summed_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the exact sum of each of ``values`` (integers) over them."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[begin], *[np.add.reduceat(v[order], begin) for v in values]


def boundaries(sizes: np.ndarray) -> np.ndarray:
    """Positions of the flat words that have a neighbour to the right."""
    inner = np.ones(int(sizes.sum()), bool)
    inner[np.cumsum(sizes[sizes > 0]) - 1] = False
    return np.flatnonzero(inner)


def counted_pairs(sym: np.ndarray, sizes: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, n, places) of the adjacent pairs of flat words: weighted by frequency, and how many places hold them."""
    at = boundaries(sizes)
    weight = np.repeat(freq, sizes)[at]
    return summed_by(pair_code(sym[at], sym[at + 1]), weight, np.ones(len(at), np.int64))


class Words:
    """Flat words (``sym``, their ``sizes``, their ``freq``) that pairs are merged in."""

    def __init__(self, sym: np.ndarray, sizes: np.ndarray, freq: np.ndarray):
        n = len(sym)
        self.sym = sym.astype(np.int32)
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.freq = freq.astype(np.int64)
        self.next = np.full(n, -1, np.int32)
        at = boundaries(sizes)
        self.next[at] = at + 1
        self.prev = np.full(n, -1, np.int32)
        self.prev[at + 1] = at
        code = pair_code(self.sym[at], self.sym[at + 1])
        order = np.argsort(code, kind="stable")
        code, self._at = code[order], at[order].astype(np.int32)
        begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        #: Pairs at the start, sorted, and where their places lie; pairs made since, each with its places.
        self._codes, self._begin = code[begin], np.r_[begin, len(code)]
        self._made: dict[int, list[np.ndarray]] = {}

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(code, n) of the pairs at the start."""
        if not len(self._codes):
            return self._codes, np.zeros(0, np.int64)
        return self._codes, np.add.reduceat(self.freq[self.owner[self._at]], self._begin[:-1])

    def _places(self, a: int, b: int) -> np.ndarray:
        code = int(pair_code(a, b))
        found = self._made.pop(code, [])
        i = int(np.searchsorted(self._codes, code))
        if i < len(self._codes) and self._codes[i] == code:
            found = [self._at[self._begin[i]:self._begin[i + 1]], *found]
        if not found:
            return np.zeros(0, np.int32)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        at = at[self.sym[at] == a]
        right = self.next[at]
        at = at[(right >= 0) & (self.sym[right] == b)]
        if a == b and len(at):  # in a run of equal symbols every second place, from the left
            first = np.r_[True, self.next[at[:-1]] != at[1:]]
            begin = np.flatnonzero(first)
            at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))) % 2 == 0]
        return at

    def _codes_at(self, at: np.ndarray) -> np.ndarray:
        return pair_code(self.sym[at], self.sym[self.next[at]])

    def merge(self, a: int, b: int, ab: int, count: bool = True):
        """Every place of (a, b), left to right, becomes ``ab``.  With ``count``: (weight of the places, pairs
        taken away, pairs made), pairs as (codes, n), without (a, b) itself at the places merged."""
        p = self._places(a, b)
        if not len(p):
            return 0, None, None
        q = self.next[p]
        r, left = self.next[q], self.prev[p]
        if count:
            gone = np.unique(np.concatenate([left[left >= 0], q[r >= 0]]))
            gone = summed_by(self._codes_at(gone), self.freq[self.owner[gone]])
        self.sym[p] = ab
        self.sym[q] = -1
        self.next[p] = r
        self.prev[r[r >= 0]] = p[r >= 0]
        left = self.prev[p]
        new = np.unique(np.concatenate([left[left >= 0], p[r >= 0]]))
        code = self._codes_at(new)
        order = np.argsort(code, kind="stable")
        code, new = code[order], new[order]
        begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        own = code[begin]
        for c, lo, hi in zip(own.tolist(), begin.tolist(), np.r_[begin[1:], len(code)].tolist()):
            self._made.setdefault(c, []).append(new[lo:hi])
        if not count:
            return 0, None, None
        made = np.add.reduceat(self.freq[self.owner[new]], begin) if len(own) else np.zeros(0, np.int64)
        return int(self.freq[self.owner[p]].sum()), gone, (own, made)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """The words as they are now: (sym, sizes)."""
        alive = self.sym >= 0
        return self.sym[alive], np.bincount(self.owner[alive], minlength=len(self.freq))


#: Numbers of symbols: a character is its code point (a byte its value), one with a continuation mark that much
#: more, products come after them.
MARKED, PRODUCTS = 1 << 21, 1 << 22


class Symbols:
    """Numbers of symbol strings: those of an alphabet, and of products as they are made."""

    def __init__(self, alphabet: list[str], continuation: str | None = None, byte_level: bool = False):
        self.continuation, mark = continuation, continuation or ""

        def number(s: str) -> int:
            if byte_level:
                return int(s, 16)
            return MARKED + ord(s[len(mark):]) if mark and len(s) > 1 else ord(s)

        self.number = {s: number(s) for s in alphabet}
        self.names = {i: s for s, i in self.number.items()}
        self.made = 0

    def joined(self, a: int, b: int) -> tuple[int, bool]:
        """The number of the product of a pair, and whether it has been a symbol before."""
        left, right, mark = self.names[a], self.names[b], self.continuation
        s = left + (right[len(mark):] if mark and right.startswith(mark) else right)
        if s in self.number:
            return self.number[s], True
        self.number[s] = i = PRODUCTS + self.made
        self.names[i] = s
        self.made += 1
        return i, False


def bpe_merges(words: Words, symbols: Symbols, room: int, least: int, whole: bool) -> list[tuple[int, int, int, int]]:
    """(a, b, product, n) of at most ``room`` merges: the most frequent pair first, ties by the strings, none below
    ``least``.  Unless the words are ``whole``, it ends with a merge whose product has been a symbol before:
    the pairs of that symbol may have places that are not among these words."""
    names = symbols.names
    codes, ns = words.counts()
    n = dict(zip(codes.tolist(), ns.tolist()))
    heap = [(-c, names[k >> 32], names[k & _LOW], k) for k, c in n.items() if c >= least]
    heapq.heapify(heap)
    out: list[tuple[int, int, int, int]] = []
    while heap and len(out) < room:
        seen, left, right, code = heapq.heappop(heap)
        now = n.get(code, 0)
        if now < least:
            continue
        if now != -seen:
            if now < -seen:  # a higher count was pushed when it was made
                heapq.heappush(heap, (-now, left, right, code))
            continue
        a, b = split_code(code)
        ab, known = symbols.joined(a, b)
        out.append((a, b, ab, now))
        weight, gone, made = words.merge(a, b, ab)
        n[code] = now - weight
        for c, x in zip(gone[0].tolist(), gone[1].tolist()):
            n[c] -= x
        for c, x in zip(made[0].tolist(), made[1].tolist()):
            n[c] = total = n.get(c, 0) + x
            if total >= least:
                heapq.heappush(heap, (-total, names[c >> 32], names[c & _LOW], c))
        if n.get(code, 0) >= least:  # left of a run of equal symbols
            heapq.heappush(heap, (-n[code], left, right, code))
        if known and not whole:
            break
    return out


class WordPieceTable:
    """Pairs with n >= ``least`` and the frequencies of symbols, for the pair of the highest
    ``n / (freq(a) * freq(b))``, ties by the strings."""

    def __init__(self, symbols: Symbols, codes: np.ndarray, n: np.ndarray, freq: dict[int, int], least: int):
        self.symbols, self.least = symbols, least
        self.n = dict(zip(codes.tolist(), n.tolist()))
        self.freq = np.zeros(PRODUCTS + (1 << 16), np.int64)
        self.freq[list(freq)] = list(freq.values())
        kept = n >= least
        self.size = int(kept.sum())
        self.codes, self.counts = codes[kept].astype(np.int64), n[kept].astype(np.int64)
        self.at = {c: i for i, c in enumerate(self.codes.tolist())}

    def scores(self) -> np.ndarray:
        c = self.codes[:self.size]
        return self.counts[:self.size] / (self.freq[c >> 32].astype(float) * self.freq[c & _LOW])

    def best(self) -> tuple[int, int] | None:
        """(code, n)"""
        if not self.size:
            return None
        score = self.scores()
        ties = np.flatnonzero(score == score.max())
        names = self.symbols.names
        i = min(ties.tolist(), key=lambda i: (names[int(self.codes[i]) >> 32], names[int(self.codes[i]) & _LOW]))
        return int(self.codes[i]), int(self.counts[i])

    def next_ones(self, among: set[int], most: int) -> list[int]:
        """The best pairs among some, whose n are ``most`` together, or the best one."""
        out, total = [], 0
        for i in np.argsort(-self.scores(), kind="stable").tolist():
            if int(self.codes[i]) in among:
                total += int(self.counts[i])
                if out and total > most:
                    break
                out.append(int(self.codes[i]))
        return sorted({*out, self.best()[0]})

    def _set(self, code: int, n: int) -> None:
        if n:
            self.n[code] = n
        else:
            self.n.pop(code, None)
        i = self.at.get(code)
        if n >= self.least:
            if i is None:
                if self.size == len(self.codes):
                    grow = max(1024, self.size)
                    self.codes = np.r_[self.codes, np.zeros(grow, np.int64)]
                    self.counts = np.r_[self.counts, np.zeros(grow, np.int64)]
                i = self.at[code] = self.size
                self.codes[i] = code
                self.size += 1
            self.counts[i] = n
        elif i is not None:  # the last one takes its place
            del self.at[code]
            self.size -= 1
            last = int(self.codes[self.size])
            if i < self.size:
                self.codes[i], self.counts[i], self.at[last] = last, self.counts[self.size], i

    def merged(self, code: int, ab: int, weight: int, gone, made) -> None:
        """After the merge of a pair in all words that hold it."""
        a, b = split_code(code)
        if ab >= len(self.freq):
            self.freq = np.r_[self.freq, np.zeros(len(self.freq) - PRODUCTS, np.int64)]
        self.freq[a] -= weight
        self.freq[b] -= weight
        self.freq[ab] += weight
        change = {code: -weight}
        for c, x in zip(gone[0].tolist(), gone[1].tolist()):
            change[c] = change.get(c, 0) - x
        for c, x in zip(made[0].tolist(), made[1].tolist()):
            change[c] = change.get(c, 0) + x
        for c, x in change.items():
            if x:
                self._set(c, self.n.get(c, 0) + x)
