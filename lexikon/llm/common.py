"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexikon.session import scratch_path

#: The white space of the contracts, ``[\x20\x09-\x0D]``; ``bytes.split()`` and
#: ``bytes.strip()`` use exactly these six characters.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table below the shared checkpoint folder."""
    return scratch_path(spark, os.path.join("llm", f"{name}-{uuid.uuid4().hex}"))


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: later
    jobs survive the loss of any executor and never compute it again."""
    path = scratch_table(df.sparkSession, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def aside(docs: DataFrame, used: dict[str, str], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operator`` over the columns ``used`` (column -> the name the operator knows) and ``rest``, a struct of all
    others, so that no name can clash.  It keeps these columns (``rest`` always) and adds its own, which
    replace columns of ``docs`` of the same name; a used column that it drops is dropped."""
    rest = [c for c in docs.columns if c not in used]
    out = operator(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in used.items()],
                               F.struct(F.lit(None).alias("none"), *[F.col(f"`{c}`") for c in rest]).alias("rest")))
    new = [c for c in out.columns if c != "rest" and c not in used.values()]
    taken = {c.lower() for c in new}
    kept = [c for c in docs.columns if c.lower() not in taken and (c not in used or used[c] in out.columns)]
    return out.select(*[F.col(used[c]).alias(c) if c in used else F.col("rest").getField(c).alias(c) for c in kept], *new)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def by_size(texts: list, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbouring texts of about ``limit`` bytes together; a longer text is one by itself."""
    lo = size = 0
    for hi, t in enumerate(texts):
        size += len(t or b"")
        if size >= limit:
            yield lo, hi + 1
            lo, size = hi + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


#: Bytes of one Arrow batch; Spark's default of 64 MB, held several times on both sides
#: of the pipe and by every task, is more than a small executor has beside its heap.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit for the bytes of an Arrow batch to BATCH_BYTES; results do not depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower()
    size = int(now.rstrip("kmgb")) << {"k": 10, "m": 20, "g": 30}.get(now.rstrip("b")[-1], 0)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release_memory() -> None:
    """Gives memory that Arrow and the C library hold for later use back to the system: the same
    worker serves tasks of other stages, and what it keeps is missing beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def append_columns(df: DataFrame, inputs: list[str], schema: str,
                   make: Callable[[], Callable[..., list]]) -> DataFrame:
    """``df`` with the columns of ``schema``, computed batch by batch in Arrow.

    ``make()`` runs once in each task and returns a function from the Arrow
    arrays of ``inputs`` to one list (or Arrow array) for each new column.  A
    column of ``df`` whose name a new one has (in either case) is replaced.
    """
    bounded_batches(df.sparkSession)
    new = T._parse_datatype_string(schema)
    taken = {f.name.lower() for f in new.fields}
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in taken]
    at = [df.columns.index(c) for c in inputs]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    held = plain.select(*[F.col(f"c{i}") for i in keep], *[F.col(f"c{i}").alias(f"i{n}") for n, i in enumerate(at)])
    n_keep, n_all = len(keep), len(keep) + len(at)
    types = [to_arrow_type(f.dataType) for f in new.fields]
    names = [f"c{i}" for i in keep] + [f"n{n}" for n in range(len(new.fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            out = fn(*[b.column(i) for i in range(n_keep, n_all)])
            cols = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n_keep)] + cols, names=names)
        release_memory()

    out = T.StructType([plain.schema[i] for i in keep]
                       + [T.StructField(f"n{n}", f.dataType) for n, f in enumerate(new.fields)])
    return held.mapInArrow(run, out).toDF(*[df.columns[i] for i in keep], *[f.name for f in new.fields])


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]]) -> DataFrame:
    """Rows of ``schema`` that ``make()`` yields, as lists by column, from each Arrow batch."""
    bounded_batches(df.sparkSession)
    fields = T._parse_datatype_string(schema).fields
    types = [(f.name, to_arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            for part in fn(b):
                cols = [part[n] if isinstance(part[n], pa.Array) else pa.array(part[n], t) for n, t in types]
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays(cols, names=[n for n, _ in types])
        release_memory()

    return df.mapInArrow(run, schema)


# ---- hashing of words in numpy -------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of a list of texts: ``start``/``end`` byte offsets in ``data``, the
    64-bit hash of each word, and ``first[i]:first[i + 1]`` the words of text i."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        parts = [t or b"" for t in texts]
        self.data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        ends = np.cumsum(lengths)
        word = ~_IS_SPACE[self.data]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """One hash for each word: a polynomial over its bytes, finalised."""
        if not len(self):
            return np.empty(0, np.uint64)
        total = np.zeros(len(self), np.uint64)
        # by blocks of bytes: prefix sums of byte * base^offset, divided by base^start
        step = 1 << 20
        i = 0
        while i < len(self):
            lo = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, lo + step, side="right")))
            hi = self.end[j - 1]
            up = _powers(int(hi - lo), _BASE)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[self.data[lo:hi]] * up, dtype=np.uint64)])
            down = _powers(int(hi - lo), _INVERSE)
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            total[i:j] = (sums[e] - sums[s]) * down[s]
            i = j
        return mix(total)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_sums(mask: np.ndarray, texts: list[bytes | None]) -> np.ndarray:
    """How many bytes of each text are marked in ``mask``, which goes over ``Words.data``."""
    if not texts:
        return np.empty(0, np.int64)
    starts = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])[:-1]]).astype(np.int64)
    return np.add.reduceat(mask.view(np.int8), starts, dtype=np.int64)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring words (also across texts: the
    caller keeps those that lie within one)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if width <= 8:
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = out * np.uint64(_BASE) + hashes[k:k + n]
        return mix(out)
    out = np.empty(n, np.uint64)
    step = 1 << 20
    up, down = _powers(step + width, _BASE), _powers(step + 1, _INVERSE)
    for lo in range(0, n, step):
        m = min(step, n - lo)
        sums = np.concatenate([np.zeros(1, np.uint64),
                               np.cumsum(hashes[lo:lo + m + width - 1] * up[:m + width - 1], dtype=np.uint64)])
        out[lo:lo + m] = (sums[width:width + m] - sums[:m]) * down[:m]
    return mix(out)
