"""Benchmark decontamination with one Aho-Corasick automaton.

The words of every benchmark item are cut into windows of 13 (an item of fewer
words is one window).  All windows go into an automaton that scans each
document once, over its normalised words joined by single spaces; hits are
mapped back to words and to code point offsets of the original text.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexikon.llm.common import append_columns, as_bytes, map_rows

WINDOW = 13
#: (window, item) pairs of one automaton; a larger benchmark takes several
#: automata and as many passes, so what is broadcast stays bounded.
PAIRS_PER_AUTOMATON = 40_000
#: Longer patterns than this take a place in the automaton for each so many bytes.
PATTERN_BYTES = 128


def _normal(b: int) -> int:
    if 65 <= b <= 90:
        return b + 32
    return b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32


#: A-Z lower-cased; all but digits, letters and non-ASCII becomes a space.
NORMAL = bytes(_normal(b) for b in range(256))


def item_windows(bench: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """Distinct (window, words in it, item) of the benchmark; windows are words joined by a space."""
    def make():
        def fn(batch):
            out = {"gram": [], "words": [], "item": []}
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                w = (text or b"").translate(NORMAL).split()
                for i in range(max(1, len(w) - window + 1) if w else 0):
                    part = w[i:i + window]
                    out["gram"].append(b" ".join(part))
                    out["words"].append(len(part))
                    out["item"].append(item)
            yield out
        return fn

    pairs = map_rows(bench.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")),
                     "gram binary, words int, item string", make)
    return pairs.distinct()


def _spans(text: bytes, ranges: list[int]) -> list[dict]:
    """Code point offsets in the original text of the word ranges."""
    data = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(data, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(points[start[a]]), "end": int(points[end[b - 1]])}
            for a, b in zip(ranges[0::2], ranges[1::2], strict=True)]


def _merged(ranges: list[tuple[int, int]]) -> list[int]:
    """Overlapping or touching word ranges as one flat list start, end, start, end, ..."""
    out: list[int] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, share: int = 20,
                  pairs_per_automaton: int = PAIRS_PER_AUTOMATON) -> DataFrame:
    """``docs`` with the columns n_words, n_hit, hit_ranges (word ranges, flat),
    hit_items (ids as strings, sorted), spans (code points of the original text)
    and contaminated (``n_hit > 0 and share * n_hit >= n_words``).

    A null or empty text has no words and is never contaminated; an item
    without words has no window; items with equal ids count once, a null item
    id marks words but is not listed; repeated documents are judged row by row;
    columns of ``docs`` with these names are replaced.  Texts pass whole.
    """
    spark = docs.sparkSession
    pairs = item_windows(bench, item_id, item_text, window).withColumn(
        "places", F.ceil(F.length("gram") / PATTERN_BYTES)).persist()
    places = pairs.agg(F.sum("places")).first()[0] or 0
    blocks = max(1, math.ceil(places / pairs_per_automaton))
    out = docs
    for k in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("gram", "item"), F.lit(blocks)) == k)
        found: dict[bytes, tuple[int, list]] = {}
        for r in own.select("gram", "words", "item").collect():
            found.setdefault(bytes(r["gram"]), (r["words"], []))[1].append(r["item"])
        sent = spark.sparkContext.broadcast(found)
        out = _scan(out, text, sent, share, first=k == 0)
    pairs.unpersist()
    return out


def _scan(docs: DataFrame, text: str, sent, share: int, first: bool) -> DataFrame:
    schema = ("n_words bigint, n_hit bigint, hit_ranges array<int>, hit_items array<string>, "
              "spans array<struct<start: int, end: int>>, contaminated boolean")

    def make():
        auto = ahocorasick.Automaton()
        for gram, (words, items) in sent.value.items():
            pattern = (b" " + gram + b" ").decode("latin-1")
            auto.add_word(pattern, (len(pattern), words, items))
        auto.make_automaton()
        some = len(auto) > 0

        def one(raw: bytes | None, ranges: list, items: list) -> tuple:
            words = (raw or b"").translate(NORMAL).split()
            if not words:
                return 0, 0, [], [], [], False
            line = (b" " + b" ".join(words) + b" ").decode("latin-1")
            hits = list(auto.iter(line)) if some else []
            if hits:
                before = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
                starts = np.searchsorted(before, [end - size + 1 for end, (size, _, _) in hits])
                ranges = _merged([(int(s), int(s) + n) for s, (_, (_, n, _)) in zip(starts, hits, strict=True)]
                                 + list(zip(ranges[0::2], ranges[1::2], strict=True)))
                items = sorted({*items, *(i for _, (_, _, ids) in hits for i in ids if i is not None)})
            n_hit = sum(ranges[1::2]) - sum(ranges[0::2])
            spans = _spans(raw, ranges) if ranges else []
            return len(words), n_hit, ranges, items, spans, n_hit > 0 and share * n_hit >= len(words)

        def fn(texts, *before):
            raw = as_bytes(texts)
            old = [c.to_pylist() for c in before] or [[[]] * len(raw)] * 2
            rows = [one(*x) for x in zip(raw, *old, strict=True)]
            return [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
        return fn

    return append_columns(docs, [text] if first else [text, "hit_ranges", "hit_items"], schema, make)
