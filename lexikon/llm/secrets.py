"""Secret scan: fixed patterns, and character Markov models of random strings
against ordinary identifiers.

The labelled samples come from the documents themselves: what a pattern matches
is a random string; every other run of identifier characters that is too short
to be a candidate is an ordinary one.  Longer ones may be secrets themselves, so
a second pass adds those that the model of the first does not take for random.
First-order transition counts of both classes are summed over all documents (a
table of at most 2 * 68 * 68 numbers); a run is a secret if its log-likelihood
ratio per character is above the threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexikon.llm.common import append_columns, as_bytes, map_rows

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # maximal runs, so the length can stand in the pattern
KINDS = ("assign", "access", "hex", "random")

#: Identifier characters; 0 is the edge of a run.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SIZE = len(ALPHABET) + 1
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(ALPHABET)] = np.arange(1, SIZE)
MIN_RUN, MIN_CANDIDATE = 8, 20
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=-]{%d,}" % MIN_CANDIDATE)
THRESHOLD = 0.5
BACK_OFF = 10.0


def base_spans(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the fixed patterns, in bytes."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def pieces(raw: bytes, base: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of what is left of the candidate runs outside the ``base`` spans, where long enough."""
    for m in CANDIDATE.finditer(raw):
        at = m.start()
        for s, _, e, _ in base:
            if at < e and s < m.end():
                if s - at >= MIN_CANDIDATE:
                    yield at, s
                at = e
        if m.end() - at >= MIN_CANDIDATE:
            yield at, m.end()


def _classes(run: bytes) -> np.ndarray:
    """The classes of a run's characters between its two edges."""
    return np.concatenate([[0], _CLASS[np.frombuffer(run, np.uint8)], [0]])


def _score(classes: np.ndarray, ratio: np.ndarray) -> float:
    """The mean log-likelihood ratio of a run's transitions."""
    return ratio[classes[:-1], classes[1:]].sum() / (len(classes) - 1)


def _transitions(data: np.ndarray, least: int, below: float = np.inf) -> np.ndarray:
    """Counts of class pairs within runs of ``least`` characters or more, but fewer than
    ``below``, edges included."""
    edge = np.flatnonzero(np.diff(data != 0, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    fits = (end - start >= least) & (end - start < below)
    start, end = start[fits], end[fits]
    mark = np.zeros(len(data) + 1, np.int8)
    mark[start] = 1
    mark[end] -= 1
    inside = np.cumsum(mark[:-1]).astype(bool)
    own = np.where(inside, data, 0).astype(np.int32)
    pair = own * SIZE
    pair[:-1] += own[1:]
    counts = np.bincount(pair[inside], minlength=SIZE * SIZE)  # (c, next), next = 0 after the last
    counts[:SIZE] += np.bincount(own[start], minlength=SIZE)  # (0, first)
    return counts


def _count_batch():
    def fn(batch):
        total = np.zeros((2, SIZE * SIZE), np.int64)
        for raw in as_bytes(batch.column(0)):
            if not raw:
                continue
            data = _CLASS[np.frombuffer(raw, np.uint8)]
            for _, _, end, value in base_spans(raw):
                total[1] += _transitions(data[value:end], 1)
                data[value:end] = 0
            total[0] += _transitions(data, MIN_RUN, MIN_CANDIDATE)
        label, pair = np.nonzero(total)
        yield {"random": label.tolist(), "pair": pair.tolist(), "n": total[label, pair].tolist()}
    return fn


def _count_long(ratio: np.ndarray, threshold: float):
    def make():
        def fn(batch):
            total = np.zeros(SIZE * SIZE, np.int64)
            for raw in as_bytes(batch.column(0)):
                if not raw:
                    continue
                for a, b in pieces(raw, base_spans(raw)):
                    c = _classes(raw[a:b])
                    if _score(c, ratio) <= threshold:
                        total += np.bincount(c[:-1].astype(np.int32) * SIZE + c[1:], minlength=SIZE * SIZE)
            pair = np.flatnonzero(total)
            yield {"pair": pair.tolist(), "n": total[pair].tolist()}
        return fn
    return make


def long_counts(docs: DataFrame, text: str, ratio: np.ndarray, threshold: float) -> DataFrame:
    """(random = 0, pair, n): transition counts of the candidates that ``ratio`` does not take for random."""
    return (map_rows(docs.select(text), "pair int, n bigint", _count_long(ratio, threshold))
            .groupBy(F.lit(0).alias("random"), "pair").agg(F.sum("n").alias("n")))


def markov_counts(docs: DataFrame, text: str) -> DataFrame:
    """(random, pair, n): transition counts of both classes over all documents."""
    return (map_rows(docs.select(text), "random int, pair int, n bigint", _count_batch)
            .groupBy("random", "pair").agg(F.sum("n").alias("n")))


def log_ratio(counts: list[tuple[int, int, int]]) -> np.ndarray | None:
    """log p(next | c, random) - log p(next | c, ordinary); None without random samples.
    A character's followers are smoothed towards how often each one occurs at all."""
    table = np.zeros((2, SIZE, SIZE))
    for label, pair, n in counts:
        table[label, pair // SIZE, pair % SIZE] += n
    if not table[1].any():
        return None
    single = table.sum(axis=1, keepdims=True) + 1
    single /= single.sum(axis=2, keepdims=True)
    p = (table + BACK_OFF * single) / (table.sum(axis=2, keepdims=True) + BACK_OFF)
    return np.log(p[1]) - np.log(p[0])


def find_secrets(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with spans (kind, start, end; code points, end exclusive, by start
    and then by kind), n_assign, n_access and n_hex.

    The patterns assign, access and hex match leftmost and non-overlapping, each
    kind by itself; ``random`` spans are runs of 20 or more identifier characters,
    those spans cut out of them, whose mean log-likelihood ratio exceeds ``threshold``.  With no
    random sample in the documents there are no such spans.  A null text counts
    as empty; repeated rows are scanned one by one; columns with the names of
    the new ones are replaced.
    """
    counts = [(r[0], r[1], r[2]) for r in markov_counts(docs, text).collect()]  # at most 2 * SIZE * SIZE rows
    ratio = log_ratio(counts)
    if ratio is not None:
        counts += [(r[0], r[1], r[2]) for r in long_counts(docs, text, ratio, threshold).collect()]  # SIZE * SIZE rows
        ratio = log_ratio(counts)

    def make():
        def one(raw: bytes | None) -> tuple:
            if not raw:
                return [], 0, 0, 0
            base = base_spans(raw)
            found = [(s, k, e) for s, k, e, _ in base]
            if ratio is not None:
                found += [(a, 3, b) for a, b in pieces(raw, base) if _score(_classes(raw[a:b]), ratio) > threshold]
            if not found:
                return [], 0, 0, 0
            found.sort()
            kinds = [k for _, k, _ in found]
            if raw.isascii():
                at = range(len(raw) + 1)
            else:
                at = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            spans = [{"kind": KINDS[k], "start": int(at[s]), "end": int(at[e])} for s, k, e in found]
            return spans, kinds.count(0), kinds.count(1), kinds.count(2)

        def fn(texts):
            rows = [one(t) for t in as_bytes(texts)]
            return [list(c) for c in zip(*rows, strict=True)] or [[]] * 4
        return fn

    return append_columns(docs, [text], "spans array<struct<kind: string, start: int, end: int>>, n_assign bigint, "
                                        "n_access bigint, n_hex bigint", make)
