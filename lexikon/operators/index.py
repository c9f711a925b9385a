"""Row index, seeded order, fold assignment and running sums without a single-task window.

``row_number() OVER (ORDER BY id)`` moves every row to one task.  Here rows are
range-partitioned on the whole order (any number of columns of any type, nulls
included, ties split by the later columns) and written once together with the
number of their range.  Whatever is computed afterwards reads the written
ranges, so a range never depends on a second sampling of its boundaries or on a
recomputed task.  Rows are numbered inside their range, and the offsets of the
ranges -- one row per range, or per group and range -- are joined on.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexikon.session import scratch_path

MODULUS = 2147483647


def arithmetic_order(id_col: str | Column, seed: int) -> Column:
    """Order key that any SQL engine reproduces; ids of any size (ties by id)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.pmod(c.cast("long"), F.lit(MODULUS)) * F.lit(2654435761) + F.lit(seed), F.lit(MODULUS))


def bucketize(df: DataFrame, splits: list[float], src: Column, out: str) -> DataFrame:
    """Range id of ``src`` among sorted ``splits`` (binary search in the JVM)."""
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0))
    tmp = "_b_" + out
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    return b.transform(df.withColumn(tmp, src.cast("double"))).drop(tmp).withColumn(out, F.col(out).cast("int"))


def _ranged(df: DataFrame, order: list[Column], ranges: int | None) -> DataFrame:
    """``df`` with ``_rng``, written range by range; ``ranges`` is by default the
    number of shuffle partitions the session asks for."""
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, f"ranges-{uuid.uuid4().hex}")
    dealt = df.repartitionByRange(n, *order).withColumn("_rng", F.spark_partition_id())
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def _with_offsets(ranged: DataFrame, parts: list[str], sums: dict[str, Column],
                  totals: dict[str, Column]) -> DataFrame:
    """``ranged`` with, for each of ``sums``, its sum over the earlier ranges of the
    group, and each of ``totals`` over the whole group (null groups included)."""
    per = ranged.groupBy(*parts, "_rng").agg(*[c.alias("_s_" + k) for k, c in {**sums, **totals}.items()])
    group = Window.partitionBy(*parts)
    before = group.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parts)], F.col("_rng").alias("_r"),
                         *[F.coalesce(F.sum("_s_" + k).over(before), F.lit(0)).alias(k) for k in sums],
                         *[F.sum("_s_" + k).over(group).alias(k) for k in totals])
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_p{i}")) for i, p in enumerate(parts)],
                  F.col("_rng") == F.col("_r"))
    # without groups there is one row per range; with groups AQE decides by size
    side = offsets if parts else F.broadcast(offsets)
    return ranged.join(side, same).drop("_r", *[f"_p{i}" for i in range(len(parts))])


def with_row_index(df: DataFrame, order: list[str | Column], name: str = "row_idx", ranges: int | None = None,
                   partition_by: list[str] | None = None, count_name: str | None = None) -> DataFrame:
    """Add a dense 0-based ``name`` following ``order`` (a total order; nulls first
    as in ``ORDER BY``), restarting in every ``partition_by`` group.

    Ranges are cut on group and order together, so a hot group is spread over
    many ranges.  ``count_name`` adds the group size (all rows without groups).
    """
    parts = list(partition_by or [])
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = _ranged(df, [*map(F.col, parts), *keys], ranges)
    one = F.count(F.lit(1))
    out = _with_offsets(ranged, parts, {"_off": one}, {count_name: one} if count_name else {})
    w = Window.partitionBy(*parts, "_rng").orderBy(*keys)
    return out.withColumn(name, (F.row_number().over(w) - 1 + F.col("_off")).cast("long")).drop("_rng", "_off")


def fold_of(idx: Column, n: Column | int, folds: int) -> Column:
    """0-based fold of row ``idx`` among ``n`` rows, equal to ``ntile(folds) - 1``:
    the first ``n % folds`` folds hold one extra row, folds are contiguous."""
    n = F.lit(n) if isinstance(n, int) else n
    q = F.floor(n / folds)
    r = n - q * folds
    big = r * (q + 1)
    return F.when(idx < big, F.floor(idx / (q + 1))).otherwise(
        r + F.floor((idx - big) / F.greatest(q, F.lit(1)))).cast("int")


def assign_folds(df: DataFrame, order: list[str | Column], folds: int, name: str = "fold",
                 ranges: int | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Contiguous folds over ``order`` (in each group of ``partition_by``) as a column, never L copies."""
    idx = with_row_index(df, order, "_idx", ranges, partition_by, "_n")
    return idx.withColumn(name, fold_of(F.col("_idx"), F.col("_n"), folds)).drop("_idx", "_n")


def assign_stratified_folds(df: DataFrame, label: str, order: list[str | Column], folds: int,
                            name: str = "fold", ranges: int | None = None) -> DataFrame:
    """``ntile(folds)`` inside each label (null is a label too), rows in ``order``."""
    idx = with_row_index(df, order, "_idx", ranges, partition_by=[label], count_name="_n")
    return idx.withColumn(name, fold_of(F.col("_idx"), F.col("_n"), folds)).drop("_idx", "_n")


def running_sums(df: DataFrame, partition_by: list[str], order_key: Column, values: list[str],
                 suffix: str = "_cum", ranges: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` in ascending ``order_key`` (unique
    within each group), restarting per ``partition_by`` group.

    Same scheme as ``with_row_index``: only one range of one group is ever
    sorted in a task.
    """
    parts = list(partition_by)
    ranged = _ranged(df.withColumn("_k0", order_key), [*map(F.col, parts), F.col("_k0")], ranges)
    out = _with_offsets(ranged, parts, {"_o_" + v: F.sum(v) for v in values}, {})
    w = Window.partitionBy(*parts, "_rng").orderBy("_k0").rowsBetween(Window.unboundedPreceding, 0)
    for v in values:
        out = out.withColumn(v + suffix, F.sum(v).over(w) + F.col("_o_" + v))
    return out.drop("_rng", "_k0", *["_o_" + v for v in values])
