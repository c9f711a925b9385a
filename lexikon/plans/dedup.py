"""De-duplication over ``documents`` with report-like paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexikon.operators import dedup as D
from lexikon.plans.common import table


def corpus(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = F.concat(F.lit("/corpus/reports/"), "source", F.lit("/Nr"), (F.col("doc_id") % 50).cast("string"),
                    F.lit(".txt"))
    return d.select(path.alias("path"), F.col("doc_id").alias("ord"), "text", "source")


def dedup_paths(spark, sf_dir):
    return D.dedup_paths(corpus(spark, sf_dir))


def last_write_wins(spark, sf_dir):
    c = D.titles(corpus(spark, sf_dir))
    return D.last_write_wins(c, "title").select("title", F.md5("text").alias("text_md5"), "ord")


def dedup_text(spark, sf_dir):
    c = D.titles(corpus(spark, sf_dir))
    return D.dedup_exact_text(c).select("text_sha", "title", "ord", "copies")


def survivors(spark, sf_dir):
    c = D.titles(corpus(spark, sf_dir))
    keep = D.dedup_exact_text(c).select("ord")
    return D.keep_survivors(c, keep, "ord").select(F.col("ord").alias("doc_id"), "title")


def duplicate_report(spark, sf_dir):
    return D.duplicate_report(corpus(spark, sf_dir))


def rename_map(spark, sf_dir):
    return D.rename_map(D.dedup_paths(corpus(spark, sf_dir)))


def text_table(spark, sf_dir):
    """Every text stored under its new path (rename map) as a Parquet text
    table in a fresh scratch folder, read back."""
    from lexikon.sources.files import scratch_dir, write_text_table
    c = corpus(spark, sf_dir)
    firsts = D.dedup_paths(c)
    names = D.rename_map(firsts).join(firsts.withColumnRenamed("path", "original_path"), "original_path")
    t = names.join(c.select("ord", "text"), "ord").select("new_path", "text")
    path = scratch_dir(spark, "text_table")
    write_text_table(t, path)
    back = spark.read.parquet(path)
    return back.select("new_path", F.md5("text").alias("text_md5"))


def filter_label(spark, sf_dir):
    return table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id", "quality")


def value_counts(spark, sf_dir):
    return D.value_counts(corpus(spark, sf_dir), "source")


C = """WITH c AS (SELECT '/corpus/reports/' || source || '/Nr' || CAST(doc_id % 50 AS VARCHAR) || '.txt' AS path,
        doc_id AS ord, text, source FROM documents),
ct AS (SELECT *, right(path, 16) AS title FROM c)
"""

QUERIES = {
    "dedup_paths": (dedup_paths, C + "SELECT path, min(ord) AS ord FROM c GROUP BY path"),
    "last_write_wins": (last_write_wins, C + """SELECT title, md5(arg_max(text, ord)) AS text_md5, min(ord) AS ord
        FROM ct GROUP BY title"""),
    "dedup_text": (dedup_text, C + """SELECT sha256(text) AS text_sha, arg_min(title, ord) AS title, min(ord) AS ord,
        count(*) AS copies FROM ct GROUP BY text"""),
    "survivors": (survivors, C + """SELECT ord AS doc_id, title FROM ct WHERE ord IN (SELECT min(ord) FROM ct
        GROUP BY text)"""),
    "duplicate_report": (duplicate_report, C + """SELECT count(*) AS total, count(DISTINCT text) AS distinct_texts,
        count(DISTINCT path) AS unique_paths FROM c"""),
    "rename_map": (rename_map, C + """, p AS (SELECT path, min(ord) AS ord FROM c GROUP BY path),
        r AS (SELECT path, row_number() OVER (ORDER BY ord) AS i FROM p),
        n AS (SELECT path, 'textNr' || CASE WHEN length(CAST(i AS VARCHAR)) >= 6 THEN CAST(i AS VARCHAR)
              ELSE lpad(CAST(i AS VARCHAR), 6, '0') END AS new_name FROM r)
        SELECT path AS original_path, string_split(path, '/')[-1] AS txt_name, new_name,
            replace(replace(regexp_extract(path, '^(.*/)[^/]*$', 1), 'reports', 'clean'), 'Nr', '#') || new_name
            || '.txt' AS new_path FROM n"""),
    "text_table": (text_table, C + """, p AS (SELECT path, min(ord) AS ord FROM c GROUP BY path),
        r AS (SELECT path, ord, row_number() OVER (ORDER BY ord) AS i FROM p)
        SELECT replace(replace(regexp_extract(r.path, '^(.*/)[^/]*$', 1), 'reports', 'clean'), 'Nr', '#') || 'textNr'
            || CASE WHEN length(CAST(i AS VARCHAR)) >= 6 THEN CAST(i AS VARCHAR) ELSE lpad(CAST(i AS VARCHAR), 6, '0') END
            || '.txt' AS new_path, md5(c.text) AS text_md5 FROM r JOIN c ON c.ord = r.ord"""),
    "filter_label": (filter_label, "SELECT doc_id, quality FROM labels WHERE toxic = 1"),
    "value_counts": (value_counts, C + """SELECT source, count(*) AS n,
        row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM c GROUP BY source"""),
}
