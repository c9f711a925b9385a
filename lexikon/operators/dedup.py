"""Path and text de-duplication, renaming and counts.

Every step is a hash aggregate or a join; nothing is compared pairwise.  Texts
are grouped by their ``sha2`` and length with fixed-size aggregates only, and
the texts themselves are joined back by position, so no sort and no aggregation
buffer ever holds a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexikon.functions.text import base_name, clean_path, padded_id, title_of
from lexikon.operators.index import with_row_index


def dedup_paths(df: DataFrame, path: str = "path", order: str = "ord") -> DataFrame:
    """Keep the first of equal paths (its position kept)."""
    return df.groupBy(path).agg(F.min(order).alias(order))


def last_write_wins(df: DataFrame, key: str, text: str = "text", order: str = "ord") -> DataFrame:
    """One row per key (e.g. the 16-character title): the text of the last
    write, the position of the first.  Positions are unique."""
    ends = df.groupBy(F.col(key).alias("_key")).agg(F.max(order).alias("_last"), F.min(order).alias("_first"))
    return (df.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col(order) == F.col("_last")))
            .select(key, text, F.col("_first").alias(order)))


def dedup_exact_text(df: DataFrame, text: str = "text", title: str = "title",
                     order: str = "ord") -> DataFrame:
    """D3: for each distinct text the first title (and position) and the copy count.
    Positions are unique."""
    groups = (df.groupBy(F.sha2(F.col(text), 256).alias("text_sha"), F.length(text))
              .agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("copies")))
    return (df.join(groups.select("text_sha", "_first", "copies"), F.col(order) == F.col("_first"))
            .select("text_sha", text, title, order, "copies"))


def keep_survivors(df: DataFrame, survivors: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the survivors (left semi join)."""
    return df.join(survivors.select(key), key, "left_semi")


def duplicate_report(df: DataFrame, path: str = "path", text: str = "text", approx: bool = False,
                     rsd: float = 0.01) -> DataFrame:
    """Total rows, distinct texts and distinct paths -- exact, or with
    ``approx`` HyperLogLog++ sketches (``rsd`` relative error), which merge
    map-side and never shuffle the distinct values."""
    if approx:
        return df.agg(F.count(F.lit(1)).alias("total"),
                      F.approx_count_distinct(F.sha2(F.col(text), 256), rsd).alias("distinct_texts"),
                      F.approx_count_distinct(path, rsd).alias("unique_paths"))
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_distinct(F.sha2(F.col(text), 256), F.length(text)).alias("distinct_texts"),
                  F.count_distinct(path).alias("unique_paths"))


def rename_map(df: DataFrame, path: str = "path", order: str = "ord", left: bool = True) -> DataFrame:
    """Original path -> ``textNrNNNNNN`` name (position in ``order``, from 1)
    -> new path in the clean folder."""
    idx = with_row_index(df, [order], "_i")
    new_name = padded_id(F.col("_i") + 1, left=left)
    return idx.select(F.col(path).alias("original_path"), base_name(F.col(path)).alias("txt_name"),
                      new_name.alias("new_name"),
                      F.concat(clean_path(F.regexp_extract(F.col(path), r"^(.*/)[^/]*$", 1)), new_name,
                               F.lit(".txt")).alias("new_path"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency list, most common first (ties by value), with a rank."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    ranked = with_row_index(c, [F.desc("n"), F.col(col)], "rank")
    return ranked.withColumn("rank", (F.col("rank") + 1).cast("bigint"))


def titles(df: DataFrame, path: str = "path", width: int = 16) -> DataFrame:
    return df.withColumn("title", title_of(F.col(path), width))
