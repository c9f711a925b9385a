"""Label-set queries over a case table derived from ``documents`` + ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexikon.operators import datasets as P
from lexikon.plans.common import table

MERGE = [(0, 1), (2, 3, 4)]


def case_table(spark, sf_dir):
    """Wide case table: file names and three label sets with messy values
    (padded strings, decimals, doubles, nulls), as a clustering export holds."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    lab = table(spark, sf_dir, "labels")
    q = F.col("quality").cast("string")
    src = F.expr("substring(source, 4)")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("case_id"),
        F.concat(F.lit("desc_"), F.col("doc_id"), F.lit(".txt")).alias("description_text_files"),
        F.concat(F.lit("diag_"), F.col("doc_id"), F.lit(".txt")).alias("diagnosis_text_files"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" "), q, F.lit(" "))).otherwise(q).alias("label_quality"),
        F.col("toxic").cast("double").alias("label_toxic"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(src, F.lit(".5"))).otherwise(src).alias("label_source"))


CASES_SQL = """cases AS (
  SELECT d.doc_id AS case_id, 'desc_' || d.doc_id || '.txt' AS description_text_files,
         'diag_' || d.doc_id || '.txt' AS diagnosis_text_files,
         CASE WHEN d.doc_id % 4 = 0 THEN ' ' || CAST(l.quality AS VARCHAR) || ' '
              ELSE CAST(l.quality AS VARCHAR) END AS label_quality,
         CAST(l.toxic AS DOUBLE) AS label_toxic,
         CASE WHEN d.doc_id % 7 = 0 THEN substr(d.source, 4) || '.5' ELSE substr(d.source, 4) END AS label_source
  FROM documents d LEFT JOIN labels l USING (doc_id)),
clean AS (
  SELECT case_id, description_text_files, diagnosis_text_files,
    CASE WHEN regexp_full_match(trim(label_quality), '[+-]?[0-9]+') THEN CAST(trim(label_quality) AS INTEGER) ELSE -1 END AS label_quality,
    CASE WHEN label_toxic IS NULL OR isnan(label_toxic) THEN -1 ELSE CAST(trunc(label_toxic) AS INTEGER) END AS label_toxic,
    CASE WHEN regexp_full_match(trim(label_source), '[+-]?[0-9]+') THEN CAST(trim(label_source) AS INTEGER) ELSE -1 END AS label_source
  FROM cases),
long AS (
  SELECT case_id, 'quality' AS label_set, label_quality AS label FROM clean
  UNION ALL SELECT case_id, 'toxic', label_toxic FROM clean
  UNION ALL SELECT case_id, 'source', label_source FROM clean)
"""


def cast_labels(spark, sf_dir):
    c = case_table(spark, sf_dir)
    return P.cast_label_columns(c, P.label_set_columns(c)).drop("description_text_files",
                                                                 "diagnosis_text_files")


def unpivot_label_sets(spark, sf_dir):
    return P.unpivot_label_sets(case_table(spark, sf_dir), ["case_id"])


def drop_invalid(spark, sf_dir):
    return P.drop_invalid_labels(unpivot_label_sets(spark, sf_dir))


def class_counts(spark, sf_dir):
    return P.label_set_stats(unpivot_label_sets(spark, sf_dir), ["label_set"])


def merge_classes(spark, sf_dir):
    s = P.drop_invalid_labels(P.select_label_set(case_table(spark, sf_dir), "source")
                              .withColumnRenamed("file", "description_text_files"))
    return s.select("description_text_files", "label", P.merge_classes("label", MERGE).alias("merged"))


def oversample(spark, sf_dir):
    long = drop_invalid(spark, sf_dir).where(F.col("label_set") == "source").drop("label_set")
    return P.oversample(long, "label", "case_id", seed=7).select("case_id", "label", "copy_no")


def histogram(spark, sf_dir):
    return P.label_histogram(unpivot_label_sets(spark, sf_dir), keys=["label_set"])


def select_label_set(spark, sf_dir):
    return P.select_label_set(case_table(spark, sf_dir), "quality", description=False)


def attach_texts(spark, sf_dir):
    """Valid quality cases with their description and diagnosis texts, looked
    up by file name in a text table (documents as descriptions, benchmark items
    as diagnoses)."""
    texts = (table(spark, sf_dir, "documents")
             .select(F.concat(F.lit("desc_"), "doc_id", F.lit(".txt")).alias("file"), "text")
             .unionByName(table(spark, sf_dir, "benchmark")
                          .select(F.concat(F.lit("diag_"), "item_id", F.lit(".txt")).alias("file"), "text")))
    cases = P.drop_invalid_labels(P.cast_label_columns(case_table(spark, sf_dir), ["label_quality"])
                                  .withColumnRenamed("label_quality", "label"))
    d = texts.select(F.col("file").alias("description_text_files"), F.col("text").alias("description"))
    g = texts.select(F.col("file").alias("diagnosis_text_files"), F.col("text").alias("diagnosis"))
    j = cases.join(d, "description_text_files", "left").join(g, "diagnosis_text_files", "left")
    return j.select("case_id", "label", F.md5("description").alias("description_md5"),
                    F.md5("diagnosis").alias("diagnosis_md5"),
                    F.length("description").cast("bigint").alias("description_chars"))


W = "WITH " + CASES_SQL
QUERIES = {
    "cast_labels": (cast_labels, W + "SELECT case_id, label_quality, label_toxic, label_source FROM clean"),
    "unpivot_label_sets": (unpivot_label_sets, W + "SELECT case_id, label_set, label FROM long"),
    "drop_invalid": (drop_invalid, W + "SELECT case_id, label_set, label FROM long WHERE label >= 0"),
    "class_counts": (class_counts, W + """SELECT label_set,
        count(DISTINCT CASE WHEN label <> -1 THEN label END) AS n_classes,
        CAST(count_if(label >= 0) AS BIGINT) AS n_valid, CAST(count_if(label < 0) AS BIGINT) AS n_skipped
        FROM long GROUP BY label_set"""),
    "merge_classes": (merge_classes, W + """SELECT description_text_files, label_source AS label,
        CASE WHEN label_source = 1 THEN 0 WHEN label_source IN (3, 4) THEN 2 ELSE label_source END AS merged
        FROM clean WHERE label_source >= 0"""),
    "oversample": (oversample, W + """, v AS (SELECT case_id, label,
            row_number() OVER (PARTITION BY label ORDER BY case_id) - 1 AS rn,
            count(*) OVER (PARTITION BY label) AS nc FROM long WHERE label_set = 'source' AND label >= 0),
        c AS (SELECT label, any_value(nc) AS nc, max(any_value(nc)) OVER () AS mx FROM v GROUP BY label),
        need AS (SELECT label, nc, unnest(range(1, mx - nc + 1)) AS copy_no FROM c WHERE nc < mx)
        SELECT case_id, label, 0 AS copy_no FROM v
        UNION ALL
        SELECT v.case_id, v.label, CAST(need.copy_no AS INTEGER) FROM need JOIN v
          ON v.label = need.label AND v.rn = ((need.copy_no * 2654435761 + 7) % 2147483647) % need.nc"""),
    "histogram": (histogram, W + "SELECT label_set, label, count(*) AS n FROM long GROUP BY ALL"),
    "select_label_set": (select_label_set, W + "SELECT diagnosis_text_files AS file, label_quality AS label FROM clean"),
    "attach_texts": (attach_texts, W + """, texts AS (
            SELECT 'desc_' || doc_id || '.txt' AS file, text FROM documents
            UNION ALL SELECT 'diag_' || item_id || '.txt', text FROM benchmark)
        SELECT c.case_id, c.label_quality AS label, md5(d.text) AS description_md5,
               md5(g.text) AS diagnosis_md5, CAST(length(d.text) AS BIGINT) AS description_chars
        FROM clean c LEFT JOIN texts d ON d.file = c.description_text_files
             LEFT JOIN texts g ON g.file = c.diagnosis_text_files
        WHERE c.label_quality >= 0"""),
}
