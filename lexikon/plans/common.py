"""Helpers shared by the registered queries."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexikon.session import spread_partitions


# tables whose rows carry long texts or vectors: per-row work dominates
CPU_HEAVY = {"documents", "pages", "conversations", "benchmark", "embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread_partitions(df) if name in CPU_HEAVY else df


def r6(c: Column | str) -> Column:
    """Round doubles at the very end so partition order does not show."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def derived_score(doc_id: Column | str, mult: int = 37, add: int = 11) -> Column:
    """Deterministic stand-in for a model score in [0, 1]: ((id*mult+add) % 101)/100."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.pmod(c * mult + add, F.lit(101)) / F.lit(100.0)).cast("double")


def sql_score(col: str, mult: int = 37, add: int = 11) -> str:
    return f"CAST((({col} * {mult} + {add}) % 101) AS DOUBLE) / 100.0"
