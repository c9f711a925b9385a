"""Line dedup over levelled sorted runs of line hashes.

The index is a set of runs, tables bucketed and sorted by the 128-bit hash of a
line.  A batch of documents (a range of ids, in ascending order) takes from its
lines the hashes that no run holds yet -- a merge anti join with each run, which
is read in place, neither shuffled nor sorted again -- and writes them, with the
smallest document that holds each, as a new run of level 0.  When a level holds
``fanout`` runs they are merged into one run of the next level, two at a time and
bucket by bucket, so n batches leave O(fanout * log n) runs.
"""

from __future__ import annotations

import uuid

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexikon.llm.common import append_columns, as_bytes, aside, map_rows, scratch_table

MIN_CHARS = 10
BATCHES = 4
FANOUT = 3
LAST_ID = (1 << 63) - 1
#: Whether a scan of sorted buckets of one file each counts as sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def _hash(key: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(key)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= chars)


class LineIndex:
    """Levelled runs of (hi, lo, doc): each line hash once, with its smallest holder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

        # a bucket is one sorted file, so that joins need not sort it again
        self.before = spark.conf.get(ORDERED, None)
        spark.conf.set(ORDERED, "true")

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").format("parquet").saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose hash no run holds: one merge anti join for each run."""
        for run in self.runs():
            keys = keys.join(self.spark.table(run).select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti")
        return keys

    def add(self, fresh: DataFrame) -> DataFrame:
        """Writes ``fresh`` as a run of level 0; returns it as read back."""
        run = self._write(fresh.repartition(self.buckets, "hi", "lo"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        return self.spark.table(run)

    def _merged(self, a: str, b: str) -> DataFrame:
        """Two runs merged: a full outer merge join of their sorted buckets, which share no hash."""
        left, right = (self.spark.table(t).toDF(*[f"{c}_{side}" for c in ("hi", "lo", "doc")])
                       for t, side in ((a, "a"), (b, "b")))
        both = left.join(right.hint("merge"), (F.col("hi_a") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b")), "full")
        return both.select(*[F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in ("hi", "lo", "doc")])

    def compact(self) -> None:
        """Merges every full level into one run of the next."""
        k = 0
        while k < len(self.levels):
            level = self.levels[k]
            if len(level) >= self.fanout:
                name = level[0]
                for n, run in enumerate(level[1:]):
                    merged = self._write(self._merged(name, run))
                    if n:
                        self.spark.sql(f"DROP TABLE {name}")
                    name = merged
                for run in level:
                    self.spark.sql(f"DROP TABLE {run}")
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(name)
            k += 1

    def drop(self) -> None:
        for run in self.runs():
            self.spark.sql(f"DROP TABLE {run}")
        self.levels = []
        if self.before is None:
            self.spark.conf.unset(ORDERED)
        else:
            self.spark.conf.set(ORDERED, self.before)


def line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc, hi, lo): the distinct line hashes of each document; a null id is the last one."""
    def make():
        def fn(batch):
            out = {"doc": [], "hi": [], "lo": []}
            for doc, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                for hi, lo in {_hash(k) for k in map(line_key, (raw or b"").split(b"\n"))
                               if _long_enough(k, min_chars)}:
                    out["doc"].append(doc)
                    out["hi"].append(hi)
                    out["lo"].append(lo)
            yield out
        return fn

    ids = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID))
    return map_rows(docs.select(ids, F.col(text)), "doc bigint, hi bigint, lo bigint", make)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` without the repeated lines: a line whose key has at least
    ``min_chars`` code points stays only in the smallest document that holds it
    (there, every copy of it).  Adds n_lines and n_dropped.

    The number of batches never changes the result.  A null text stays null and
    counts, like an empty one, as one empty line; a null id is larger than
    every other; rows of equal ids count as one document; columns of ``docs``
    named n_lines or n_dropped are replaced; an empty table stays empty.
    """
    return aside(docs, {doc_id: "id", text: "text"}, lambda own: _deduped(own, min_chars, batches, fanout))


def _deduped(docs: DataFrame, min_chars: int, batches: int, fanout: int) -> DataFrame:
    spark, doc_id, text = docs.sparkSession, "id", "text"
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set(docs.agg(F.percentile_approx(doc_id, shares, 1000)).first()[0] or [])) if shares else []
    batch = F.lit(0)
    for c in cuts:
        batch = batch + (F.col("doc") >= F.lit(int(c))).cast("int")
    path = scratch_table(spark, "line_hashes")
    line_hashes(docs, doc_id, text, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc bigint, hi bigint, lo bigint, batch int").parquet(path)
    index, dropped_path = LineIndex(spark, fanout), scratch_table(spark, "line_drops")
    try:
        for b in range(len(cuts) + 1):
            rows = lines.where(F.col("batch") == b).drop("batch")
            own = rows.groupBy("hi", "lo").agg(F.min("doc").alias("doc"))
            kept = index.add(index.unseen(own))
            rows.join(kept.hint("merge"), ["hi", "lo", "doc"], "left_anti").write.mode("append").parquet(dropped_path)
            index.compact()
    finally:
        index.drop()
    drops = (spark.read.schema("hi bigint, lo bigint, doc bigint").parquet(dropped_path)
             .groupBy(F.col("doc").alias("line_doc")).agg(F.collect_list(F.struct("hi", "lo")).alias("drops")))
    joined = docs.join(drops, F.coalesce(docs[doc_id].cast("long"), F.lit(LAST_ID)) == F.col("line_doc"), "left")
    return append_columns(joined, [text, "drops"], "kept_text string, n_lines bigint, n_dropped bigint",
                          _without_lines).drop("line_doc", "drops").withColumn(text, F.col("kept_text")).drop("kept_text")


def _without_lines():
    def one(raw: bytes | None, drops: list | None) -> tuple:
        lines = (raw or b"").split(b"\n")
        if not drops:
            return raw, len(lines), 0
        gone = {(d["hi"], d["lo"]) for d in drops}
        kept = [x for x in lines if _hash(line_key(x)) not in gone]
        return b"\n".join(kept), len(lines), len(lines) - len(kept)

    def fn(texts, drops):
        rows = [one(*x) for x in zip(as_bytes(texts), drops.to_pylist(), strict=True)]
        return [_strings([r[0] for r in rows]), [r[1] for r in rows], [r[2] for r in rows]]
    return fn


def _strings(values):
    import pyarrow as pa
    return pa.array(values, pa.binary()).cast(pa.string())
