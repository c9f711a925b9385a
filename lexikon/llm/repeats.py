"""Substring dedup with fixed-block anchors.

A repeat of ``WINDOW`` words covers, wherever it lies, one whole block of
``BLOCK`` words that starts at a multiple of ``BLOCK`` in its document.  These
non-overlapping reference blocks are indexed and probed with every rolling
window of ``BLOCK`` words.  Around the anchors found, hits are extended window by
window: a window of ``WINDOW`` words that also starts in a smaller document is a
repeat, and neighbouring ones make up the maximal exact repeats.

The rolling windows of a corpus are as many as its words, so they travel
packed: documents are gathered in chunks of a few MB, and a chunk sends each
bucket one array of 31-bit prints, every print once however many of its
documents hold it.  A hot passage thus costs one entry a chunk, and nothing is
ever paired.  Documents of one chunk meet there in the same way: its reference
blocks are indexed, its rolling blocks probe them, and only windows around the
anchors are compared.  Two different windows with one print only cost a needless check:
the extension compares 64-bit hashes of whole windows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexikon.llm.common import Words, as_bytes, by_size, map_rows, windows, written

WINDOW, BLOCK = 50, 25
CHUNK_BYTES = 1 << 22
#: Words of the corpus for each bucket of prints, which bounds what one task holds.
BUCKET_WORDS = 1 << 18
LAST_ID = (1 << 63) - 1


def chunks(docs: DataFrame, doc_id: str, text: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, ids, sizes, texts, n_words): documents packed as compressed chunks of about
    ``chunk_bytes``; a longer text is a chunk by itself, and a null text has size -1."""
    def make():
        pack = zstandard.ZstdCompressor(level=3)
        state = {"next": 0}

        def part(ids: list, raw: list[bytes | None]) -> dict:
            uid = (TaskContext.get().partitionId() << 32) + state["next"]
            state["next"] += 1
            whole = b"".join(t or b"" for t in raw)
            return {"chunk": [uid], "ids": [ids], "sizes": [[-1 if t is None else len(t) for t in raw]],
                    "texts": [pack.compress(whole)], "n_words": [sum(len(t.split()) for t in raw if t)]}

        def fn(batch):
            ids, raw = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for a, b in by_size(raw, chunk_bytes):
                yield part(ids[a:b], raw[a:b])
        return fn

    return written(map_rows(docs.select(F.col(doc_id).cast("long"), text),
                            "chunk bigint, ids array<bigint>, sizes array<long>, texts binary, n_words bigint", make),
                   "chunks")


def _texts(sizes: list[int], packed: bytes) -> list[bytes | None]:
    whole = zstandard.ZstdDecompressor().decompress(packed)
    out: list[bytes | None] = []
    at = 0
    for n in sizes:
        out.append(None if n < 0 else whole[at:at + n])
        at += max(n, 0)
    return out


def _rows(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _starts(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and word number of every window of ``width`` words within one document."""
    sizes = np.maximum(np.diff(words.first) - width + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    skipped = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return doc, np.arange(len(doc)) - skipped[doc] + words.first[doc]


def _buckets(key: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit hash, in the order of the hashes."""
    return ((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _prints(words: Words, h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket and print as one number, document, word number) of every rolling
    block of the documents that are long enough for a whole window."""
    doc, at = _starts(words, BLOCK)
    fits = np.diff(words.first)[doc] >= WINDOW
    doc, at = doc[fits], at[fits]
    key = windows(h, BLOCK)[at]
    return (_buckets(key, n_buckets) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFE)), doc, at


def _split(bucket: np.ndarray):
    """(bucket, from, to) of the runs of an ascending array."""
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(bucket)]]).tolist(), strict=True):
        if b > a:
            yield int(bucket[a]), a, b


def _probe(n_buckets: int):
    """Prints of a chunk by bucket; the low bit says that one is a reference block."""
    def make():
        def fn(batch):
            for row in _rows(batch):
                words = Words(_texts(row["sizes"], row["texts"]))
                key, doc, at = _prints(words, words.hashes(), n_buckets)
                key |= ((at - words.first[doc]) % BLOCK == 0).astype(np.uint64)
                key = np.unique(key)
                last = np.append((key[1:] ^ key[:-1]) > 1, True) if len(key) else np.empty(0, bool)
                key = key[last]  # of two with one print, the one with the bit
                out = {"bucket": [], "chunk": [], "prints": []}
                for bucket, a, b in _split(key >> np.uint64(32)):
                    out["bucket"].append(bucket)
                    out["chunk"].append(row["chunk"])
                    out["prints"].append(key[a:b].astype(np.uint32).tobytes())
                yield out
        return fn
    return make


def _anchors(table: pa.Table) -> pa.Table:
    """For each chunk of a bucket, the prints that another chunk has too and that are a block in one."""
    of_chunk, parts = table.column("chunk").to_pylist(), [np.frombuffer(x, np.uint32)
                                                          for x in table.column("prints").to_pylist()]
    bucket = table.column("bucket")[0].as_py()
    whole = np.concatenate(parts)
    order = np.argsort(whole, kind="stable")
    prints = whole[order]
    head = np.flatnonzero(np.append(True, (prints[1:] ^ prints[:-1]) > 1))
    times = np.diff(np.append(head, len(prints)))
    hit = np.repeat((times > 1) & (np.bitwise_or.reduceat(prints, head) & 1 == 1), times)
    found = np.zeros(len(whole), bool)
    found[order] = hit
    out, at = {"bucket": [], "chunk": [], "prints": []}, 0
    for chunk, p in zip(of_chunk, parts, strict=True):
        own = p[found[at:at + len(p)]]
        at += len(p)
        if len(own):
            out["bucket"].append(bucket)
            out["chunk"].append(chunk)
            out["prints"].append((own & np.uint32(0xFFFFFFFE)).tobytes())
    return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("prints", pa.binary())]))


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values if len(ordered) else np.zeros(len(values), bool)


def _doc_order(ids: list) -> np.ndarray:
    return np.array([LAST_ID if i is None else i for i in ids], np.int64)


def _smallest(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, ascending, with the smallest document."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    return k[head], np.minimum.reduceat(doc[order], head) if len(k) else doc


def _extend(n_buckets: int):
    """Hashes of the whole windows around the anchors of a chunk, each with its smallest document there."""
    def make():
        def fn(batch):
            for row in _rows(batch):
                words = Words(_texts(row["sizes"], row["texts"]))
                h = words.hashes()
                key, _, at = _prints(words, h, n_buckets)
                wanted = np.sort(np.concatenate([(np.uint64(x["bucket"]) << np.uint64(32))
                                                 | np.frombuffer(x["prints"], np.uint32).astype(np.uint64)
                                                 for x in row["anchors"]]))
                doc, start = _starts(words, WINDOW)
                near = _around(words, at[_member(key, wanted)], start)
                doc, start = doc[near], start[near]
                key, smallest = _smallest(windows(h, WINDOW)[start], _doc_order(row["ids"])[doc])
                out = {"bucket": [], "chunk": [], "keys": [], "docs": []}
                for bucket, a, b in _split(_buckets(key, n_buckets)):
                    out["bucket"].append(bucket)
                    out["chunk"].append(row["chunk"])
                    out["keys"].append(key[a:b].tobytes())
                    out["docs"].append(smallest[a:b].tobytes())
                yield out
        return fn
    return make


def _holders(table: pa.Table) -> pa.Table:
    """For each chunk of a bucket, the windows that a smaller document of another chunk holds, and which."""
    of_chunk = table.column("chunk").to_pylist()
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    docs = [np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()]
    key, smallest = _smallest(np.concatenate(keys), np.concatenate(docs))
    out = {"chunk": [], "keys": [], "docs": []}
    for chunk, k, d in zip(of_chunk, keys, docs, strict=True):
        best = smallest[np.searchsorted(key, k)]
        less = best < d
        if less.any():
            out["chunk"].append(chunk)
            out["keys"].append(k[less].tobytes())
            out["docs"].append(best[less].tobytes())
    return pa.table(out, schema=pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())]))


def inner_anchors(words: Words, h: np.ndarray) -> np.ndarray:
    """Word numbers of the rolling blocks that several documents of the chunk hold, one of them
    as a reference block: the blocks are indexed, and every rolling block probes them."""
    doc, at = _starts(words, BLOCK)
    fits = np.diff(words.first)[doc] >= WINDOW
    doc, at = doc[fits], at[fits]
    key = windows(h, BLOCK)[at]
    index = np.sort(key[(at - words.first[doc]) % BLOCK == 0])
    hit = _member(key, index)
    key, doc, at = key[hit], doc[hit], at[hit]
    if not len(key):
        return at
    order = np.argsort(key, kind="stable")  # documents ascend within a key
    head = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    last = np.append(head[1:], len(key)) - 1
    several = np.repeat(doc[order][head] != doc[order][last], last - head + 1)
    return at[order[several]]


def _around(words: Words, anchors: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of the whole windows at ``start`` hold one of the anchors."""
    before = np.zeros(len(words) + 1, np.int64)
    before[anchors + 1] = 1
    before = np.cumsum(before)
    return before[start + WINDOW - BLOCK + 1] > before[start]


def _remove():
    def fn(batch):
        for row in _rows(batch):
            raw = _texts(row["sizes"], row["texts"])
            words = Words(raw)
            ids = _doc_order(row["ids"])
            doc, start = _starts(words, WINDOW)
            h = words.hashes()
            key = windows(h, WINDOW)[start]
            best = ids[doc]
            near = np.flatnonzero(_around(words, inner_anchors(words, h), start))
            own, smallest = _smallest(key[near], best[near])
            best[near] = smallest[np.searchsorted(own, key[near])]
            if row["holders"] and len(key):  # from other chunks; buckets do not share a key
                k = np.concatenate([np.frombuffer(x["keys"], np.uint64) for x in row["holders"]])
                d = np.concatenate([np.frombuffer(x["docs"], np.int64) for x in row["holders"]])
                k, d = _smallest(k, d)
                at = np.minimum(np.searchsorted(k, key), len(k) - 1)
                best = np.where(k[at] == key, np.minimum(best, d[at]), best)
            repeat = best < ids[doc]
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, start[repeat], 1)
            np.add.at(edge, start[repeat] + WINDOW, -1)
            gone = np.cumsum(edge)[:-1] > 0
            out = {"id": row["ids"], "n_words": np.diff(words.first).tolist(), "n_removed": [], "removed": [], "kept": []}
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                g = gone[a:b]
                n = int(g.sum())
                w = (raw[i] or b"").split()
                out["n_removed"].append(n)
                ends = np.flatnonzero(np.diff(g, prepend=False, append=False)) if n else np.empty(0, np.int64)
                out["removed"].append([{"start": int(x), "end": int(y)}
                                       for x, y in zip(ends[0::2], ends[1::2], strict=True)])
                out["kept"].append(b" ".join(w if not n else [x for x, cut in zip(w, g, strict=True) if not cut]))
            out["kept"] = pa.array(out["kept"], pa.binary()).cast(pa.string())
            yield out
    return fn


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   chunk_bytes: int = CHUNK_BYTES, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """One row per document: id, n_words, n_removed, removed (word ranges, maximal
    repeats) and kept (the other words, joined by one space).

    A word goes if it lies in a window of 50 words of its document whose word
    sequence also starts in a document with a smaller id; windows are judged on
    the input.  A null or empty text has no words and keeps the empty text; a
    null id is larger than every other; rows of equal ids do not remove each
    other's words; an empty table gives no rows.
    """
    packed = chunks(docs, doc_id, text, chunk_bytes)
    total = packed.agg(F.sum("n_words")).first()[0] or 0
    n_buckets = max(1, math.ceil(total / bucket_words))
    prints = map_rows(packed.select("chunk", "sizes", "texts"), "bucket int, chunk bigint, prints binary",
                      _probe(n_buckets))
    anchors = written(prints.groupBy("bucket").applyInArrow(_anchors, "bucket int, chunk bigint, prints binary"),
                      "anchors")
    with_anchors = packed.join(anchors.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "prints")).alias("anchors")),
                               "chunk").select("chunk", "ids", "sizes", "texts", "anchors")
    keys = map_rows(with_anchors, "bucket int, chunk bigint, keys binary, docs binary", _extend(n_buckets))
    holders = written(keys.groupBy("bucket").applyInArrow(_holders, "chunk bigint, keys binary, docs binary"), "holders")
    with_holders = packed.join(holders.groupBy("chunk").agg(F.collect_list(F.struct("keys", "docs")).alias("holders")),
                               "chunk", "left").select("chunk", "ids", "sizes", "texts", "holders")
    return map_rows(with_holders, "id bigint, n_words bigint, n_removed bigint, "
                    "removed array<struct<start: int, end: int>>, kept string", _remove)
