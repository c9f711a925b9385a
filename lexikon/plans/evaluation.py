"""Classification measures over predictions derived from ``lineitem``.

The predictions are a deterministic function of the rows (7 classes from the
line number; a quarter of rows mispredicted), three "models" and five folds,
so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexikon.operators import metrics as E
from lexikon.plans.common import r6, table

LABELS = list(range(7))


def predictions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.when(F.col("l_suppkey") % 3 == 0, "knn").when(F.col("l_suppkey") % 3 == 1, "sgd")
        .otherwise("svm").alias("model"),
        (F.col("l_orderkey") % 5).cast("int").alias("fold"),
        (F.col("l_linenumber") - 1).alias("y_true"),
        F.when(F.col("l_partkey") % 4 == 0, F.col("l_linenumber") % 7)
        .otherwise(F.col("l_linenumber") - 1).cast("int").alias("y_pred"))


def _conf(spark, sf_dir, keys):
    return E.confusion_counts(predictions(spark, sf_dir), keys)


def accuracy(spark, sf_dir):
    s = E.summary_scores(_conf(spark, sf_dir, ["model", "fold"]), ["model", "fold"])
    return s.select("model", "fold", r6("accuracy").alias("accuracy"))


def weighted_prf(spark, sf_dir):
    s = E.summary_scores(_conf(spark, sf_dir, ["model", "fold"]), ["model", "fold"])
    return s.select("model", "fold", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1").alias("f1"))


def kappa(spark, sf_dir):
    s = E.summary_scores(_conf(spark, sf_dir, ["model", "fold"]), ["model", "fold"])
    return s.select("model", "fold", r6("cohen_kappa").alias("cohen_kappa"))


def pooled(spark, sf_dir):
    s = E.summary_scores(_conf(spark, sf_dir, ["model"]), ["model"])
    return s.select("model", *[r6(c).alias(c) for c in ["accuracy", "precision", "recall", "f1", "cohen_kappa"]])


def report(spark, sf_dir):
    r = E.classification_report(_conf(spark, sf_dir, ["model"]), ["model"])
    return r.select("model", "row", *[r6(c).alias(c) for c in ["precision", "recall", "f1"]], "support")


def class_table(spark, sf_dir):
    return E.class_score_table(_conf(spark, sf_dir, ["model"]), ["model"])


def confusion(spark, sf_dir):
    return E.confusion_matrix(_conf(spark, sf_dir, ["model"]), ["model"], LABELS)


def _fold_scores(spark, sf_dir):
    return E.summary_scores(_conf(spark, sf_dir, ["model", "fold"]), ["model", "fold"])


def fold_summary(spark, sf_dir):
    s = E.fold_summary(_fold_scores(spark, sf_dir))
    return s.select("name", "fold_amount", F.posexplode("accuracy").alias("fold", "accuracy"),
                    F.element_at("time", 1).alias("time")).select(
        "name", "fold_amount", F.col("fold").cast("int").alias("fold"), r6("accuracy").alias("accuracy"), "time")


def leaderboard(spark, sf_dir):
    return E.leaderboard(E.fold_summary(_fold_scores(spark, sf_dir)))


def support_share(spark, sf_dir):
    s = E.support_share(_conf(spark, sf_dir, ["model"]), ["model"])
    return s.select("model", "cls", F.col("support").cast("bigint").alias("support"), r6("share").alias("share"))


PRED_SQL = """p AS (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'knn' WHEN 1 THEN 'sgd' ELSE 'svm' END AS model,
        CAST(l_orderkey % 5 AS INTEGER) AS fold, l_linenumber - 1 AS y_true,
        CAST(CASE WHEN l_partkey % 4 = 0 THEN l_linenumber % 7 ELSE l_linenumber - 1 END AS INTEGER) AS y_pred
    FROM lineitem)"""


def _cs_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"t.{x} = pr.{x}" for x in keys + ["cls"])
    co = ", ".join(f"coalesce(t.{x}, pr.{x}) AS {x}" for x in keys)
    return f"""WITH {PRED_SQL},
conf AS (SELECT {k}, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL),
t AS (SELECT {k}, y_true AS cls, sum(n) AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp
      FROM conf GROUP BY ALL),
pr AS (SELECT {k}, y_pred AS cls, sum(n) AS predicted FROM conf GROUP BY ALL),
cs0 AS (SELECT {co}, coalesce(t.cls, pr.cls) AS cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
               coalesce(predicted, 0) AS predicted FROM t FULL JOIN pr ON {on}),
cs1 AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS prec,
               CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rec FROM cs0),
cs AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM cs1),
s0 AS (SELECT {k}, sum(support) AS n, sum(tp) AS tp, sum(prec * support) AS wp, sum(rec * support) AS wr,
              sum(f1 * support) AS wf, sum(CAST(support AS DOUBLE) * predicted) AS pe FROM cs GROUP BY ALL),
s AS (SELECT {k}, tp / n AS accuracy, wp / n AS precision, wr / n AS recall, wf / n AS f1,
             ((tp / n) - pe / (CAST(n AS DOUBLE) * n)) / (1 - pe / (CAST(n AS DOUBLE) * n)) AS cohen_kappa
      FROM s0)
"""


_MF = _cs_sql(["model", "fold"])
_M = _cs_sql(["model"])

QUERIES = {
    "accuracy": (accuracy, _MF + "SELECT model, fold, round(accuracy, 6) AS accuracy FROM s"),
    "weighted_prf": (weighted_prf, _MF + """SELECT model, fold, round(precision, 6) AS precision,
        round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s"""),
    "kappa": (kappa, _MF + "SELECT model, fold, round(cohen_kappa, 6) AS cohen_kappa FROM s"),
    "pooled": (pooled, _M + """SELECT model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
        round(recall, 6) AS recall, round(f1, 6) AS f1, round(cohen_kappa, 6) AS cohen_kappa FROM s"""),
    "report": (report, _M + """SELECT model, CAST(cls AS VARCHAR) AS row, round(prec, 6) AS precision,
            round(rec, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM cs
        UNION ALL SELECT model, 'macro avg', round(avg(prec), 6), round(avg(rec), 6), round(avg(f1), 6),
            CAST(sum(support) AS BIGINT) FROM cs GROUP BY model
        UNION ALL SELECT model, 'weighted avg', round(precision, 6), round(recall, 6), round(f1, 6),
            CAST(n AS BIGINT) FROM s JOIN s0 USING (model)
        UNION ALL SELECT model, 'accuracy', round(accuracy, 6), round(accuracy, 6), round(accuracy, 6),
            CAST(n AS BIGINT) FROM s JOIN s0 USING (model)"""),
    "class_table": (class_table, _M + """SELECT model, cls, round(f1, 3) AS f1_score, CAST(support AS BIGINT) AS support,
        row_number() OVER (PARTITION BY model ORDER BY round(f1, 3) DESC, cls) AS rank FROM cs WHERE support > 0"""),
    "confusion": (confusion, f"""WITH {PRED_SQL},
        conf AS (SELECT model, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL),
        g AS (SELECT model, a.l AS y_true, b.l AS y_pred FROM (SELECT DISTINCT model FROM conf),
              (SELECT unnest(range(7)) AS l) a, (SELECT unnest(range(7)) AS l) b),
        m AS (SELECT g.model, g.y_true, g.y_pred, coalesce(n, 0) AS n FROM g LEFT JOIN conf
              USING (model, y_true, y_pred))
        SELECT model, CAST(y_true AS INTEGER) AS y_true, CAST(y_pred AS INTEGER) AS y_pred,
               round(CASE WHEN sum(n) OVER (PARTITION BY model, y_true) = 0 THEN 0.0
                     ELSE n / sum(n) OVER (PARTITION BY model, y_true) END, 2) AS value FROM m"""),
    "fold_summary": (fold_summary, _MF + """SELECT model AS name, count(*) OVER (PARTITION BY model) AS fold_amount,
        fold, round(accuracy, 6) AS accuracy, CAST(-1.0 AS DOUBLE) AS time FROM s"""),
    "leaderboard": (leaderboard, _MF + """, lb AS (SELECT model AS name, count(*) AS fold_amount,
            round(avg(accuracy), 3) AS accuracy, round(avg(precision), 3) AS precision,
            round(avg(recall), 3) AS recall, round(avg(f1), 3) AS f1, round(avg(cohen_kappa), 3) AS cohen_kappa
            FROM s GROUP BY model)
        SELECT *, row_number() OVER (ORDER BY f1 DESC, name) AS rank FROM lb"""),
    "support_share": (support_share, _M + """SELECT model, cls, CAST(support AS BIGINT) AS support,
        round(support / sum(support) OVER (PARTITION BY model), 6) AS share FROM cs WHERE support > 0"""),
}
