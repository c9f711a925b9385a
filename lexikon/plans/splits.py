"""Splits and folds over ``documents``, ``labels`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexikon.operators import datasets as P
from lexikon.operators.index import arithmetic_order
from lexikon.plans.common import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang")


def kfold_sizes(spark, sf_dir):
    f = P.kfold(_docs(spark, sf_dir), ["doc_id"], 10)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"),
                                 F.max("doc_id").alias("last_id"))


def shuffled_kfold(spark, sf_dir):
    return P.kfold(_docs(spark, sf_dir), [arithmetic_order("doc_id", 20), "doc_id"], 5).select("doc_id", "fold")


def stratified_kfold(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return P.stratified_kfold(lab, "quality", ["doc_id"], 5)


def split_sizes(spark, sf_dir):
    """Test 10 % (seed 99), then 10 % of the rest as validation (seed 100): 81/9/10."""
    first = P.train_test_split(_docs(spark, sf_dir), [arithmetic_order("doc_id", 99), "doc_id"], 0.1, "s1")
    test = first.where(F.col("s1") == "test").select("doc_id", F.lit("test").alias("split"))
    rest = P.train_test_split(first.where(F.col("s1") == "train").drop("s1"),
                              [arithmetic_order("doc_id", 100), "doc_id"], 0.1, "s2")
    rest = rest.select("doc_id", F.when(F.col("s2") == "test", "val").otherwise("train").alias("split"))
    return test.unionByName(rest)


def tail_validation(spark, sf_dir):
    return P.tail_validation(_docs(spark, sf_dir), ["doc_id"], 0.2).select("doc_id", "is_val")


def slice_rows(spark, sf_dir):
    d = _docs(spark, sf_dir)
    n = d.count()
    return P.slice_rows(d, ["doc_id"], n // 5, 2 * n // 5).select("row_idx", "doc_id")


def sample_rows(spark, sf_dir):
    return P.sample_rows(_docs(spark, sf_dir), "doc_id", 10, 42)


_SPLIT_SQL = """
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY (doc_id * 2654435761 + 99) % 2147483647, doc_id) - 1 AS i,
                  count(*) OVER () AS n FROM documents),
b AS (SELECT doc_id, row_number() OVER (ORDER BY (doc_id * 2654435761 + 100) % 2147483647, doc_id) - 1 AS j,
             count(*) OVER () AS m FROM a WHERE i >= ceil(n * 0.1))
SELECT doc_id, 'test' AS split FROM a WHERE i < ceil(n * 0.1)
UNION ALL SELECT doc_id, CASE WHEN j < ceil(m * 0.1) THEN 'val' ELSE 'train' END FROM b
"""

QUERIES = {
    "kfold_sizes": (kfold_sizes, """SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, min(doc_id) AS first_id,
        max(doc_id) AS last_id FROM (SELECT doc_id, ntile(10) OVER (ORDER BY doc_id) - 1 AS fold FROM documents)
        GROUP BY fold"""),
    "shuffled_kfold": (shuffled_kfold, """SELECT doc_id, CAST(ntile(5) OVER (ORDER BY
        (doc_id * 2654435761 + 20) % 2147483647, doc_id) - 1 AS INTEGER) AS fold FROM documents"""),
    "stratified_kfold": (stratified_kfold, """SELECT doc_id, quality, CAST(ntile(5) OVER (PARTITION BY quality
        ORDER BY doc_id) - 1 AS INTEGER) AS fold FROM labels"""),
    "split_sizes": (split_sizes, _SPLIT_SQL),
    "tail_validation": (tail_validation, """SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)
        >= floor(count(*) OVER () * 0.8 + 1e-9) AS is_val FROM documents"""),
    "slice_rows": (slice_rows, """SELECT row_idx, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1
        AS row_idx, count(*) OVER () AS n FROM documents) WHERE row_idx >= n // 5 AND row_idx < 2 * n // 5"""),
    "sample_rows": (sample_rows, """SELECT doc_id, lang FROM documents
        ORDER BY (doc_id * 2654435761 + 42) % 2147483647, doc_id LIMIT 10"""),
}
