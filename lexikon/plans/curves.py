"""Multi-label thresholds, curves and averages over ``labels`` with a
deterministic score per (document, label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexikon.operators import curves as C
from lexikon.plans.common import derived_score, r6, sql_score, table

T_BEST = 0.41


def scores(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    # one scan: every row yields one cell per label column
    cells = F.explode(F.array(
        F.struct(F.lit("quality").alias("label"), F.col("quality").alias("y_true"),
                 derived_score("doc_id", 37, 11).alias("score")),
        F.struct(F.lit("toxic").alias("label"), F.col("toxic").alias("y_true"),
                 derived_score("doc_id", 53, 7).alias("score"))))
    return lab.select(F.col("doc_id").alias("id"), cells.alias("c")).select("id", "c.*")


def threshold_predictions(spark, sf_dir):
    return scores(spark, sf_dir).select("id", "label", C.predict(F.col("score"), T_BEST).alias("y_pred"))


def threshold_sweep(spark, sf_dir):
    s = C.threshold_sweep(scores(spark, sf_dir), C.threshold_grid())
    return s.select("threshold", "tp", "fp", "fn", r6("f1").alias("f1"), "best")


def multilabel_confusion(spark, sf_dir):
    return C.multilabel_confusion(scores(spark, sf_dir), T_BEST)


def roc_curve(spark, sf_dir):
    r = C.roc_curve(C.with_micro(scores(spark, sf_dir)), ["label"])
    return r.select("label", "threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


def pr_curve(spark, sf_dir):
    r = C.pr_curve(C.with_micro(scores(spark, sf_dir)), ["label"])
    return r.select("label", "threshold", r6("precision").alias("precision"), r6("recall").alias("recall"))


def roc_auc(spark, sf_dir):
    a = C.averaged_scores(scores(spark, sf_dir))
    return a.select("label", r6("roc_auc").alias("roc_auc"), r6("average_precision").alias("average_precision"),
                    "support")


def macro_roc(spark, sf_dir):
    m = C.macro_roc_curve(scores(spark, sf_dir))
    return m.select(r6("fpr").alias("fpr"), r6("mean_tpr").alias("mean_tpr"))


def micro_scores(spark, sf_dir):
    m = C.micro_scores(scores(spark, sf_dir), T_BEST)
    return m.select(*[r6(c).alias(c) for c in m.columns])


def label_precision(spark, sf_dir):
    return C.label_precision(scores(spark, sf_dir), T_BEST).select("label", r6("precision").alias("precision"))


def sample_precision(spark, sf_dir):
    s = C.sample_precision(scores(spark, sf_dir), T_BEST)
    return s.select(r6("sample_precision").alias("sample_precision"), "rows")


def bce_loss(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("logit", (F.col("score") - 0.5) * 8)
    return C.bce_loss(s, keys=["label"]).select("label", r6("bce").alias("bce"))


def score_and_predict(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("prob", C.sigmoid((F.col("score") - 0.5) * 8))
    return s.select("id", "label", r6("prob").alias("prob"), C.predict(F.col("prob"), T_BEST, strict=True)
                    .alias("pred_gt"), C.predict(F.col("prob"), T_BEST).alias("pred_ge"))


def prediction_table(spark, sf_dir):
    names = C.prediction_names(scores(spark, sf_dir), T_BEST)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return names.join(docs, "id").select("id", F.md5("text").alias("text_md5"), "actual", "predicted")


ML = f"""ml AS (SELECT doc_id AS id, 'quality' AS label, quality AS y_true, {sql_score('doc_id', 37, 11)} AS score
             FROM labels
             UNION ALL SELECT doc_id, 'toxic', toxic, {sql_score('doc_id', 53, 7)} FROM labels)"""
CUM = ML + """,
mlm AS (SELECT * FROM ml UNION ALL SELECT id, 'micro', y_true, score FROM ml),
cells AS (SELECT label, score, count_if(y_true = 1) AS pos, count_if(y_true <> 1) AS neg FROM mlm GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY label) AS P,
               sum(neg) OVER (PARTITION BY label) AS N FROM cells
        WINDOW w AS (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""

_DIV = "CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / {b} END"

AUC_SQL = "WITH " + CUM + """,
per AS (SELECT label, sum((fp / N - (fp - neg) / N) * (tp / P + (tp - pos) / P) / 2) AS auc,
               sum((tp / P - (tp - pos) / P) * (tp / (tp + fp))) AS ap, any_value(P) AS P, any_value(N) AS N
        FROM cum GROUP BY label),
r AS (SELECT label, CASE WHEN P > 0 AND N > 0 THEN auc END AS roc_auc, CASE WHEN P > 0 THEN ap END AS ap,
             CAST(P AS BIGINT) AS support FROM per),
lab AS (SELECT * FROM r WHERE label <> 'micro'),
srt AS (SELECT id, score, count_if(y_true = 1) AS pos FROM ml GROUP BY ALL),
sc AS (SELECT id, score, pos, sum(pos) OVER w AS tp, sum(cnt) OVER w AS n, sum(pos) OVER (PARTITION BY id) AS P
       FROM (SELECT id, score, pos, (SELECT count(*) FROM ml m WHERE m.id = s.id AND m.score = s.score) AS cnt FROM srt s)
       WINDOW w AS (PARTITION BY id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
sap AS (SELECT id, sum((pos / P) * (tp / n)) AS ap FROM sc WHERE P > 0 GROUP BY id)
SELECT label, round(roc_auc, 6) AS roc_auc, round(ap, 6) AS average_precision, support FROM r
UNION ALL SELECT 'macro', round(avg(roc_auc), 6), round(avg(ap), 6), CAST(sum(support) AS BIGINT) FROM lab
UNION ALL SELECT 'weighted', round(sum(roc_auc * support) / sum(CASE WHEN roc_auc IS NOT NULL THEN support END), 6),
    round(sum(ap * support) / sum(CASE WHEN ap IS NOT NULL THEN support END), 6), CAST(sum(support) AS BIGINT) FROM lab
UNION ALL SELECT 'samples', NULL, round(avg(ap), 6), count(*) FROM sap
"""

MACRO_SQL = "WITH " + CUM + """,
roc AS (SELECT label, fp / N AS fpr, tp / P AS tpr FROM cum WHERE label <> 'micro'),
pts AS (SELECT label, fpr, max(tpr) AS tpr FROM (SELECT * FROM roc UNION ALL SELECT DISTINCT label, 0.0, 0.0 FROM roc)
        GROUP BY ALL),
lg AS (SELECT l.label, g.fpr FROM (SELECT DISTINCT label FROM pts) l, (SELECT DISTINCT fpr FROM pts) g),
f AS (SELECT lg.label, lg.fpr, pts.tpr FROM lg LEFT JOIN pts USING (label, fpr)),
f2 AS (SELECT *,
  last_value(CASE WHEN tpr IS NOT NULL THEN fpr END IGNORE NULLS) OVER (PARTITION BY label ORDER BY fpr
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x0,
  last_value(tpr IGNORE NULLS) OVER (PARTITION BY label ORDER BY fpr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y0,
  first_value(CASE WHEN tpr IS NOT NULL THEN fpr END IGNORE NULLS) OVER (PARTITION BY label ORDER BY fpr
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1,
  first_value(tpr IGNORE NULLS) OVER (PARTITION BY label ORDER BY fpr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y1
  FROM f)
SELECT round(fpr, 6) AS fpr, round(avg(coalesce(tpr, CASE WHEN x1 IS NULL THEN y0
       ELSE y0 + (y1 - y0) * (fpr - x0) / (x1 - x0) END)), 6) AS mean_tpr FROM f2 GROUP BY fpr
"""

W = "WITH " + ML + " "
QUERIES = {
    "threshold_predictions": (threshold_predictions, W + """SELECT id, label, CAST(score >= 0.41 AS INTEGER) AS y_pred
        FROM ml"""),
    "threshold_sweep": (threshold_sweep, W + """, t AS (SELECT i, CAST(i AS DOUBLE) / 100.0 AS threshold
            FROM range(20, 51) r(i)),
        c AS (SELECT i, threshold, CAST(count_if(score >= threshold AND y_true = 1) AS BIGINT) AS tp,
                     CAST(count_if(score >= threshold AND y_true <> 1) AS BIGINT) AS fp,
                     CAST(count_if(score < threshold AND y_true = 1) AS BIGINT) AS fn FROM t, ml GROUP BY ALL),
        f AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM c)
        SELECT threshold, tp, fp, fn, round(f1, 6) AS f1, row_number() OVER (ORDER BY f1 DESC, i) = 1 AS best
        FROM f"""),
    "multilabel_confusion": (multilabel_confusion, W + """SELECT label,
        CAST(count_if(score < 0.41 AND y_true <> 1) AS BIGINT) AS tn,
        CAST(count_if(score >= 0.41 AND y_true <> 1) AS BIGINT) AS fp,
        CAST(count_if(score < 0.41 AND y_true = 1) AS BIGINT) AS fn,
        CAST(count_if(score >= 0.41 AND y_true = 1) AS BIGINT) AS tp FROM ml GROUP BY label"""),
    "roc_curve": (roc_curve, "WITH " + CUM + """ SELECT label, score AS threshold,
        round(""" + _DIV.format(a="fp", b="N") + ", 6) AS fpr, round(" + _DIV.format(a="tp", b="P")
        + ", 6) AS tpr FROM cum"),
    "pr_curve": (pr_curve, "WITH " + CUM + """ SELECT label, score AS threshold,
        round(""" + _DIV.format(a="tp", b="(tp + fp)") + ", 6) AS precision, round("
        + _DIV.format(a="tp", b="P") + ", 6) AS recall FROM cum"),
    "roc_auc": (roc_auc, AUC_SQL),
    "macro_roc": (macro_roc, MACRO_SQL),
    "micro_scores": (micro_scores, W + """, g AS (SELECT count_if(score >= 0.41 AND y_true = 1) AS tp,
            count_if(score >= 0.41 AND y_true <> 1) AS fp, count_if(score < 0.41 AND y_true = 1) AS fn,
            count(*) AS cells FROM ml)
        SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
               round(1.25 * tp / (1.25 * tp + 0.25 * fn + fp), 6) AS fbeta, round(2 * tp / (2 * tp + fn + fp), 6) AS f1,
               round((fp + fn) / cells, 6) AS hamming_loss FROM g"""),
    "label_precision": (label_precision, W + """SELECT label, round(CASE WHEN count_if(score >= 0.41) = 0 THEN 0.0
        ELSE count_if(score >= 0.41 AND y_true = 1) / count_if(score >= 0.41) END, 6) AS precision
        FROM ml GROUP BY label"""),
    "sample_precision": (sample_precision, W + """, per AS (SELECT id, CASE WHEN count_if(score >= 0.41) = 0 THEN 0.0
            ELSE count_if(score >= 0.41 AND y_true = 1) / count_if(score >= 0.41) END AS p FROM ml GROUP BY id)
        SELECT round(avg(p), 6) AS sample_precision, count(*) AS rows FROM per"""),
    "bce_loss": (bce_loss, W + """SELECT label, round(avg(greatest((score - 0.5) * 8, 0.0) - (score - 0.5) * 8 * y_true
        + ln(1 + exp(-abs((score - 0.5) * 8)))), 6) AS bce FROM ml GROUP BY label"""),
    "score_and_predict": (score_and_predict, W + """, p AS (SELECT id, label, 1.0 / (1.0 + exp(-((score - 0.5) * 8)))
            AS prob FROM ml)
        SELECT id, label, round(prob, 6) AS prob, CAST(prob > 0.41 AS INTEGER) AS pred_gt,
               CAST(prob >= 0.41 AS INTEGER) AS pred_ge FROM p"""),
    "prediction_table": (prediction_table, W + """, n AS (SELECT id,
            coalesce(string_agg(CASE WHEN y_true = 1 THEN label END, ',' ORDER BY label), '') AS actual,
            coalesce(string_agg(CASE WHEN score >= 0.41 THEN label END, ',' ORDER BY label), '') AS predicted
            FROM ml GROUP BY id)
        SELECT n.id, md5(d.text) AS text_md5, actual, predicted FROM n JOIN documents d ON d.doc_id = n.id"""),
}
