"""Sources and sinks exercised on files that Spark writes from the driver
tables into a fresh scratch folder (below the shared checkpoint folder) and
reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexikon.plans.common import r6, table
from lexikon.plans.vocab import sequences
from lexikon.sources import files as S
from lexikon.sources import logs as L
from lexikon.sources.conll import read_conll_dir, sentences_to_conll_text


def conll_sentences(spark, sf_dir):
    """Conversation turns as CoNLL sentences (token SP tag), four files."""
    s = sequences(spark, sf_dir).where(F.size("tokens") > 0)
    s = s.withColumn("file", F.concat(F.lit("c"), (F.col("conv_id") % 4).cast("string")))
    path = S.scratch_dir(spark, "conll")
    (sentences_to_conll_text(s, "tokens", "tags").select("value", "file", "conv_id", "turn")
     .repartitionByRange(8, "file", "conv_id", "turn").sortWithinPartitions("file", "conv_id", "turn")
     .select("value", "file").write.partitionBy("file").text(path))
    c = read_conll_dir(spark, path, glob="*.txt")
    return c.select("file", "sent_no", F.array_join("predictors", " ").alias("predictors"),
                    F.array_join("labels", " ").alias("labels"))


def _labeled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("id"), "text",
                                        F.array("quality", "toxic").alias("label"))


ITEM = "id bigint, text string, label array<int>"


def _out(df):
    return df.select("id", F.md5("text").alias("text_md5"), F.array_join("label", ",").alias("label"))


def labeled_json(spark, sf_dir):
    path = S.scratch_dir(spark, "json")
    _labeled(spark, sf_dir).write.json(path)
    return _out(S.read_labeled_json(spark, path, ITEM))


def _wrapped_docs(spark, sf_dir):
    # ten items per {"data": [...]} document: bounded groups
    g = _labeled(spark, sf_dir).groupBy(F.floor(F.col("id") / 10).alias("g")).agg(
        F.collect_list(F.struct("id", "text", "label")).alias("data"))
    return g.select(F.to_json(F.struct("data")).alias("doc"))


def labeled_json_wrapped(spark, sf_dir):
    path = S.scratch_dir(spark, "json_wrapped")
    _wrapped_docs(spark, sf_dir).select(F.col("doc").alias("value")).write.text(path)
    return _out(S.read_labeled_json(spark, path, ITEM, wrapped=True))


def double_json(spark, sf_dir):
    path = S.scratch_dir(spark, "json_double")
    quoted = F.concat(F.lit('"'), F.replace(F.replace("doc", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
                      F.lit('"'))
    _wrapped_docs(spark, sf_dir).select(quoted.alias("value")).write.text(path)
    return _out(S.read_double_json(spark, path, ITEM))


def text_lines(spark, sf_dir):
    path = S.scratch_dir(spark, "text_lines")
    table(spark, sf_dir, "documents").select(F.col("text").alias("value"), "lang") \
        .write.partitionBy("lang").text(path)
    lines = S.read_text_lines(spark, path, encoding="UTF-8")
    lang = F.regexp_extract("path", r"/lang=([^/]+)/", 1)
    return lines.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("lines"),
                                                F.sum(F.length("line")).cast("bigint").alias("chars"))


def text_files(spark, sf_dir):
    path = S.scratch_dir(spark, "text_files")
    table(spark, sf_dir, "documents").select(F.col("text").alias("value"), "lang") \
        .write.partitionBy("lang").text(path)
    files = S.read_text_dir(spark, path, encoding="UTF-8")
    lang = F.regexp_extract("path", r"/lang=([^/]+)/", 1)
    return files.groupBy(lang.alias("lang")).agg(F.sum(F.length("text")).cast("bigint").alias("chars"))


def labeled_dataset(spark, sf_dir):
    path = S.scratch_dir(spark, "labeled")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("diagnose"))
    ds = d.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", "diagnose",
                                                                  F.col("quality").alias("label"))
    back = S.write_labeled_dataset(ds, path, overwrite=True, lower=True)
    again = S.write_labeled_dataset(ds.limit(0), path, overwrite=False)  # kept: ignore mode
    return again.select("doc_id", F.md5("text").alias("text_md5"), "diagnose", "label") if back is not None else back


SCORE_SCHEMA = "name string, fold_amount bigint, accuracy array<double>, f1 array<double>, time array<double>"


def append_scores(spark, sf_dir):
    from lexikon.operators import metrics as E
    from lexikon.plans.evaluation import predictions
    s = E.summary_scores(E.confusion_counts(predictions(spark, sf_dir), ["model", "fold"]), ["model", "fold"])
    summ = E.fold_summary(s).select("name", "fold_amount", "accuracy", "f1", "time")
    log = S.scratch_dir(spark, "scores")
    L.append_scores(spark, summ, log, SCORE_SCHEMA)
    L.append_scores(spark, summ, log, SCORE_SCHEMA)
    back = spark.read.schema(SCORE_SCHEMA).json(log)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    return back.select("name", "fold_amount", r6(mean(F.col("accuracy"))).alias("accuracy"),
                       r6(mean(F.col("f1"))).alias("f1"))


def upsert_metric(spark, sf_dir):
    """Metric table of one label set: value counts per language as metrics,
    then ``cls accuracy`` appended, then replaced."""
    d = table(spark, sf_dir, "documents")
    t = d.groupBy(F.concat(F.lit("n_"), "lang").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    name = L.metric_file_name("KMeans_d2v")
    t1 = L.upsert_metric(t, "cls accuracy", 0.5)
    t2 = L.upsert_metric(t1, "cls accuracy", 0.75)
    return t2.withColumn("table", F.lit(name))


_AGG = """WITH p AS (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'knn' WHEN 1 THEN 'sgd' ELSE 'svm' END AS model,
        CAST(l_orderkey % 5 AS INTEGER) AS fold, l_linenumber - 1 AS y_true,
        CAST(CASE WHEN l_partkey % 4 = 0 THEN l_linenumber % 7 ELSE l_linenumber - 1 END AS INTEGER) AS y_pred
    FROM lineitem)"""

TOKSQL = r"""WITH tok AS (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_\s]') AS tokens
        FROM conversations),
t AS (SELECT 'c' || CAST(conv_id % 4 AS VARCHAR) AS file, conv_id, turn, tokens,
      list_transform(tokens, lambda x: CASE WHEN regexp_matches(x, '^\p{Lu}') THEN 'B-CAP'
          WHEN regexp_matches(x, '^\p{L}') THEN 'O' WHEN regexp_matches(x, '^\p{Nd}') THEN 'NUM' ELSE 'PUNCT' END) AS tags
      FROM tok WHERE len(tokens) > 0)"""

LAB = """WITH l AS (SELECT d.doc_id AS id, d.text, CAST(l.quality AS VARCHAR) || ',' || CAST(l.toxic AS VARCHAR) AS label
    FROM documents d JOIN labels l USING (doc_id))
SELECT id, md5(text) AS text_md5, label FROM l"""

QUERIES = {
    "conll_sentences": (conll_sentences, TOKSQL + """ SELECT file, CAST(row_number() OVER (PARTITION BY file
        ORDER BY conv_id, turn) - 1 AS INTEGER) AS sent_no, array_to_string(tokens, ' ') AS predictors,
        array_to_string(tags, ' ') AS labels FROM t"""),
    "labeled_json": (labeled_json, LAB),
    "labeled_json_wrapped": (labeled_json_wrapped, LAB),
    "double_json": (double_json, LAB),
    "text_lines": (text_lines, """SELECT lang, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines,
        CAST(sum(length(text)) - sum(len(string_split(text, chr(10))) - 1) AS BIGINT) AS chars
        FROM documents GROUP BY lang"""),
    "text_files": (text_files, """SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents
        GROUP BY lang"""),
    "labeled_dataset": (labeled_dataset, """SELECT d.doc_id, md5(lower(d.text)) AS text_md5, lower(d.source) AS diagnose,
        l.quality AS label FROM documents d JOIN labels l USING (doc_id)"""),
    "append_scores": (append_scores, _AGG + """,
        conf AS (SELECT model, fold, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL),
        t AS (SELECT model, fold, y_true AS cls, sum(n) AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp
              FROM conf GROUP BY ALL),
        pr AS (SELECT model, fold, y_pred AS cls, sum(n) AS predicted FROM conf GROUP BY ALL),
        cs0 AS (SELECT coalesce(t.model, pr.model) AS model, coalesce(t.fold, pr.fold) AS fold,
                coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
                FROM t FULL JOIN pr ON t.model = pr.model AND t.fold = pr.fold AND t.cls = pr.cls),
        cs AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS prec,
               CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rec FROM cs0),
        cs2 AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM cs),
        s AS (SELECT model, fold, sum(tp) / sum(support) AS accuracy, sum(f1 * support) / sum(support) AS f1
              FROM cs2 GROUP BY ALL),
        m AS (SELECT model AS name, count(*) AS fold_amount, round(avg(accuracy), 6) AS accuracy,
              round(avg(f1), 6) AS f1 FROM s GROUP BY model)
        SELECT name, fold_amount, accuracy, f1 FROM m UNION ALL SELECT name || '_2', fold_amount, accuracy, f1 FROM m"""),
    "upsert_metric": (upsert_metric, """SELECT 'n_' || lang AS metric, CAST(count(*) AS DOUBLE) AS value,
        'kmeans_doc2vec_Diagnosis' AS "table" FROM documents GROUP BY lang
        UNION ALL SELECT 'cls accuracy', 0.75, 'kmeans_doc2vec_Diagnosis'"""),
}
