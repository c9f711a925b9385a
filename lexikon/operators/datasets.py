"""Labelled-dataset preparation: label cleaning, label sets, class merging,
oversampling, splits and folds (P1-P17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.utils import AnalysisException

from lexikon.operators.index import (arithmetic_order, assign_folds, assign_stratified_folds,
                                     fold_of, with_row_index)

INVALID = -1
COPY_CHUNK = 1_000_000


def cast_label(c: Column | str, dtype=None) -> Column:
    """``int(x)`` or -1.  Strings must hold an integer (surrounding blanks
    allowed, no decimals, as Python's ``int('3.7')`` fails); doubles truncate,
    NaN and null give -1."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, StringType) or dtype == "string":
        t = F.regexp_replace(c, r"^\s+|\s+$", "")
        return F.coalesce(F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int")), F.lit(INVALID))
    return F.coalesce(F.when(~F.isnan(c.cast("double")), c.try_cast("int")), F.lit(INVALID))


def cast_label_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return df.select(*[cast_label(F.col(c), types[c]).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def label_set_columns(df: DataFrame, prefix: str = "label_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def unpivot_label_sets(df: DataFrame, ids: list[str], prefix: str = "label_") -> DataFrame:
    """Every ``label_<set>`` column becomes rows ``(ids..., label_set, label)``."""
    cols = label_set_columns(df, prefix)
    clean = cast_label_columns(df.select(*ids, *cols), cols)
    long = clean.unpivot(ids, cols, "label_set", "label")
    return long.withColumn("label_set", F.expr(f"substring(label_set, {len(prefix) + 1})"))


def select_label_set(df: DataFrame, label_set: str, description: bool = True,
                     prefix: str = "label_") -> DataFrame:
    """Text-file column + int label of one set, invalid labels kept as -1."""
    col = prefix + label_set
    if col not in df.columns:
        raise AnalysisException(f"label set {label_set} does not exist")
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    file_col = "description_text_files" if description else "diagnosis_text_files"
    return df.select(F.col(file_col).alias("file"), cast_label(F.col(col), types[col]).alias("label"))


def drop_invalid_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Keep rows with a label >= 0."""
    return df.where(F.col(label) >= 0)


def label_set_stats(long: DataFrame, keys: list[str] | None = None, label: str = "label") -> DataFrame:
    """P5/P6 and the skipped count of P2 in one pass."""
    return long.groupBy(*(keys or [])).agg(
        F.count_distinct(F.when(F.col(label) != INVALID, F.col(label))).alias("n_classes"),
        F.count_if(F.col(label) >= 0).alias("n_valid"),
        F.count_if(F.col(label) < 0).alias("n_skipped"))


def merge_classes(c: Column | str, groups: list[tuple[int, ...]]) -> Column:
    """Later members of each group become its first member; the original
    label is compared, so merges do not chain."""
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for g in groups:
        for member in g[1:]:
            cond = c == F.lit(member)
            out = F.when(cond, F.lit(g[0])) if out is None else out.when(cond, F.lit(g[0]))
    return c if out is None else out.otherwise(c)


def oversample(df: DataFrame, label: str, id_col: str, seed: int = 0) -> DataFrame:
    """Add copies of each smaller class up to the size of the largest.

    Deterministic: the k-th copy of class c takes row ``h(seed, k) mod n_c`` of
    that class (rows numbered by id).  Original rows get ``copy_no = 0``.
    The per-class counts are one row per class (bounded); the copies are
    generated per class row, never by a cross join, and joined back on
    (label, row number)."""
    idx = with_row_index(df, [id_col], "_rn", partition_by=[label], count_name="_nc")
    # one row per class: the window over it is tiny
    counts = (idx.groupBy(F.col(label).alias("_label")).agg(F.first("_nc").alias("_nc"))
              .withColumn("_max", F.max("_nc").over(Window.partitionBy())))
    need = (counts.where(F.col("_nc") < F.col("_max"))
            # copies are generated in chunks so one small class never makes one huge task
            .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_max") - F.col("_nc") - 1)
                                                                         / COPY_CHUNK).cast("int"))))
            .repartition("_chunk", "_label")
            .withColumn("copy_no", F.explode(F.sequence(
                F.col("_chunk") * COPY_CHUNK + 1,
                F.least((F.col("_chunk") + 1) * COPY_CHUNK, F.col("_max") - F.col("_nc")))))
            .withColumn("_pick", F.pmod(arithmetic_order(F.col("copy_no"), seed), F.col("_nc")))
            .select("_label", "_pick", "copy_no"))
    rows = idx.drop("_nc")
    copies = rows.join(need, rows[label].eqNullSafe(need["_label"]) & (F.col("_rn") == F.col("_pick"))).drop(
        "_label", "_pick")
    base = idx.drop("_nc").withColumn("copy_no", F.lit(0).cast("int"))
    return base.unionByName(copies.withColumn("copy_no", F.col("copy_no").cast("int"))).drop("_rn")


def label_histogram(df: DataFrame, label: str = "label", keys: list[str] | None = None) -> DataFrame:
    """P10: documents per label."""
    return df.groupBy(*(keys or []), label).agg(F.count(F.lit(1)).alias("n"))


def train_test_split(df: DataFrame, order: list[Column | str], test_share: float,
                     name: str = "split") -> DataFrame:
    """The first ``ceil(n * share)`` rows of a seeded order are the test
    side; exact and repeatable, unlike ``randomSplit``."""
    idx = with_row_index(df, order, "_i", count_name="_n")
    n_test = F.ceil(F.col("_n") * F.lit(float(test_share)))
    return idx.withColumn(name, F.when(F.col("_i") < n_test, "test").otherwise("train")).drop("_i", "_n")


def slice_rows(df: DataFrame, order: list[Column | str], start: int, stop: int | None = None) -> DataFrame:
    """Rows ``[start:stop)`` of an order; negative bounds count from the end."""
    idx = with_row_index(df, order, "row_idx", count_name="_n")
    lo = F.lit(start) if start >= 0 else F.col("_n") + start
    hi = F.col("_n") if stop is None else (F.lit(stop) if stop >= 0 else F.col("_n") + stop)
    return idx.where((F.col("row_idx") >= lo) & (F.col("row_idx") < hi)).drop("_n")


def tail_validation(df: DataFrame, order: list[Column | str], share: float = 0.2,
                    name: str = "is_val") -> DataFrame:
    """The last ``share`` of the rows (index >= floor(n * (1 - share)))."""
    idx = with_row_index(df, order, "_i", count_name="_n")
    cut = F.floor(F.col("_n") * F.lit(1.0 - share) + 1e-9)
    return idx.withColumn(name, F.col("_i") >= cut).drop("_i", "_n")


def kfold(df: DataFrame, order: list[Column | str], folds: int, name: str = "fold") -> DataFrame:
    """P14 (and P15 with a seeded order)."""
    return assign_folds(df, order, folds, name)


def stratified_kfold(df: DataFrame, label: str, order: list[Column | str], folds: int,
                     name: str = "fold") -> DataFrame:
    """P16."""
    return assign_stratified_folds(df, label, order, folds, name)


def fold_split(df: DataFrame, fold_col: str, i: int) -> tuple[DataFrame, DataFrame]:
    """Test fold vs the rest, as two filters over the same column."""
    return df.where(F.col(fold_col) != i), df.where(F.col(fold_col) == i)


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int, order: Column | None = None) -> DataFrame:
    """``n`` rows in a seeded order (a top-n, no full sort)."""
    key = order if order is not None else arithmetic_order(id_col, seed)
    return df.orderBy(key, F.col(id_col)).limit(n)
