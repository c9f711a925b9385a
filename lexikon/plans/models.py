"""Features, classifiers and model selection over ``documents``, ``labels``,
``conversations`` and the derived predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexikon.functions.text import word_tokens
from lexikon.operators import metrics as E
from lexikon.operators import models as M
from lexikon.operators.datasets import kfold, unpivot_label_sets
from lexikon.operators.index import assign_folds
from lexikon.operators.vocab import label_index
from lexikon.plans.common import r6, table
from lexikon.sources.files import scratch_dir

TAGS = ["B-CAP", "NUM", "O", "PUNCT"]


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", word_tokens("text").alias("tokens"))


def tfidf(spark, sf_dir):
    t = M.tfidf(_docs(spark, sf_dir), "doc_id", "tokens")
    return t.select("doc_id", "term", r6("weight").alias("weight"))


def svd(spark, sf_dir):
    from pyspark.ml import Pipeline
    d = _docs(spark, sf_dir)
    feats = Pipeline(stages=M.text_features("tokens", 1 << 12)).fit(d).transform(d)
    comps = M.truncated_svd(feats, "doc_id", "features", 10)
    norm = F.sqrt(F.aggregate("components", F.lit(0.0), lambda a, x: a + x * x))
    return comps.select("doc_id", F.size("components").alias("k"), r6(norm).alias("norm"))


def _cross_validated(data, docs, sets, epochs=5):
    """Ten folds of every label set of ``data`` (id, label_set, label), all fits in common scans; ``docs``
    (id, tokens) goes into no plan before its tokens are numbers."""
    from lexikon.operators.linear import hashed_terms, joint_cross_validation
    folded = assign_folds(data, ["id"], 10, partition_by=["label_set"])
    found = folded.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(
        "label_set", F.struct("label", "fold")))).alias("own"))  # one entry a label set
    classes = {r[0]: sorted(r[1]) for r in data.groupBy("label_set").agg(F.collect_set("label")).collect()}
    terms = docs.select("id", hashed_terms("tokens").alias("terms")).dropDuplicates(["id"])
    rows = terms.join(found, "id").select(
        "id", "terms", *[F.array(*[F.col("own")[s][c] for s in sets]).alias(c + "s") for c in ("label", "fold")])
    return joint_cross_validation(rows, [classes[s] for s in sets], 10, epochs=epochs, terms="terms")


def text_cv(spark, sf_dir):
    """Ten-fold one-vs-rest hinge classifier on TF-IDF, language labels."""
    d = _docs(spark, sf_dir).withColumnRenamed("doc_id", "id")
    data = d.select("id", "lang").join(label_index(d, "lang", "id"), "lang").select(
        "id", F.lit("lang").alias("label_set"), F.col("label_id").cast("int").alias("label"))
    s = E.summary_scores(E.confusion_counts(_cross_validated(data, d, ["lang"]), ["fold"]), ["fold"])
    return s.select("fold", r6("accuracy").alias("accuracy"), r6("f1").alias("f1"))


def svm_proba(spark, sf_dir):
    """Quality by a linear SVM of all labelled documents, saved and loaded again, with
    probabilities calibrated on margins of folds the SVM has not seen."""
    from lexikon.operators.linear import SvmProba
    d = table(spark, sf_dir, "documents").select("doc_id", word_tokens("text").alias("tokens"))
    data = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    path = scratch_dir(spark, "svm_model")
    SvmProba.fit(data, "doc_id", label="quality").save(spark, path)
    out = SvmProba.load(spark, path).transform(data)
    return out.select("doc_id", r6("probability").alias("prob"), F.col("prediction").alias("y_pred"))


def label_set_scores(spark, sf_dir):
    """Mean accuracy over all ten folds for every label set of the case
    table, upserted into the stored metric table of each set (S10) and read back."""
    from lexikon.plans.labels import case_table
    from lexikon.sources.logs import MetricTables
    long = unpivot_label_sets(case_table(spark, sf_dir), ["case_id"]).where(F.col("label") >= 0)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), word_tokens("text").alias("tokens"))
    data = long.join(d.select("case_id"), "case_id").withColumnRenamed("case_id", "id")
    counts = {r[0]: r[1] for r in long.groupBy("label_set").count().orderBy("label_set").collect()}  # label-set names
    sets = sorted(counts)
    pred = _cross_validated(data, d.withColumnRenamed("case_id", "id"), sets)
    scores = pred.groupBy("label_set").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("value"))
    metrics = MetricTables(spark, scratch_dir(spark, "metrics"))
    for r in scores.collect():  # one row a label set
        name = sets[r["label_set"]]
        metrics.create(name, [("n_docs", float(counts[name]))])
        metrics.upsert(name, "cls accuracy", -1.0)
        metrics.upsert(name, "cls accuracy", r["value"])
    return metrics.read_all()


def _tagger_folds(spark, sf_dir):
    """Held-out predictions of all five folds, one token a row."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.functions import vector_to_array

    from lexikon.plans.vocab import sequences
    from lexikon.session import keep, stored
    seqs = kfold(sequences(spark, sf_dir), ["conv_id", "turn"], 5)
    rows = M.token_rows(seqs, ["conv_id", "turn", "fold"], "tokens", "tags")
    tag_map = F.create_map(*[x for i, t in enumerate(TAGS) for x in (F.lit(t), F.lit(float(i)))])
    # every task of a fit sends a gradient of all features and classes, so there are no more tasks than cores
    rows = M.token_features(rows.withColumn("tag_id", tag_map[F.col("tag")]).coalesce(spark.sparkContext.defaultParallelism))
    rows = keep(rows.drop(*[c for c in M.TOKEN_FEATURES if c != "token"]))  # hashed once for all folds

    def one(i):
        model = M.token_tagger(TAGS, max_iter=20, hashed=True).fit(rows.where(F.col("fold") != i))
        p = F.element_at(vector_to_array("probability"), F.col("tag_id").cast("int") + 1).alias("p_true")
        return stored(model.transform(rows.where(F.col("fold") == i)).select(
            "fold", "conv_id", "turn", "pos", "token", "tag", "tag_id", "prediction", p), "tagged")

    with ThreadPoolExecutor(max_workers=2) as pool:
        preds = list(pool.map(one, range(5)))
    out = preds[0]
    for p in preds[1:]:
        out = out.unionByName(p)
    rows.unpersist()
    return out


def tagger_predictions(spark, sf_dir):
    """E22, NER form: the sentences of the best fold (M13 over the tagger's own
    losses and scores) as words with true and predicted tags."""
    pred = _tagger_folds(spark, sf_dir)
    tags = pred.select("fold", F.col("tag_id").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))
    s = E.summary_scores(E.confusion_counts(tags, ["fold"]), ["fold"])
    losses = pred.groupBy("fold").agg(F.avg(-F.log(F.greatest("p_true", F.lit(1e-15)))).alias("loss"))
    hist = s.join(losses, "fold").select("fold", "loss", (1 - F.col("f1")).alias("val_loss"), "accuracy",
                                         F.col("cohen_kappa").alias("val_accuracy"))
    pred = pred.join(M.select_best_fold(hist).select("fold"), "fold", "left_semi")
    names = F.array(*[F.lit(t) for t in TAGS])
    pred = pred.withColumn("pred_tag", F.element_at(names, F.col("prediction").cast("int") + 1))
    lists = M.sequences_from_tokens(pred.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()),
                                    ["conv_id", "turn"], "token", "tag", "pred_tag")
    return (lists.select("conv_id", "turn", F.array_join("token", " ").alias("words"),
                    F.array_join("tag", " ").alias("tags"), F.array_join("pred_tag", " ").alias("predicted")))


def token_tagger(spark, sf_dir):
    """Five-fold cross-validated per-token tagger over the conversations,
    evaluated token-level on every fold's held-out sentences (report rows by fold)."""
    pred = _tagger_folds(spark, sf_dir).select(
        "fold", F.col("tag_id").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))
    rep = E.classification_report(E.confusion_counts(pred, ["fold"]), ["fold"])
    return rep.select("fold", "row", r6("precision").alias("precision"), r6("recall").alias("recall"),
                      r6("f1").alias("f1"), "support")


def multilabel_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", word_tokens("text").alias("tokens"))
    data = d.join(table(spark, sf_dir, "labels"), "doc_id")
    s = M.multilabel_scores(data, "doc_id", "tokens", {"quality": F.col("quality"), "toxic": F.col("toxic")},
                            max_iter=20)
    return s.select(F.col("doc_id").alias("id"), "label", "y_true", r6("score").alias("score"))


def best_fold(spark, sf_dir):
    """M13 over the per-fold scores of the derived predictions, for every model."""
    from lexikon.plans.evaluation import predictions
    s = E.summary_scores(E.confusion_counts(predictions(spark, sf_dir), ["model", "fold"]), ["model", "fold"])
    hist = s.select("model", "fold", (1 - F.col("precision")).alias("loss"), (1 - F.col("f1")).alias("val_loss"),
                    "accuracy", F.col("cohen_kappa").alias("val_accuracy"))
    return M.select_best_fold(hist, keys=("model",))


_TOK = r"regexp_extract_all(text, '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_\s]')"

BEST_SQL = """WITH p AS (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'knn' WHEN 1 THEN 'sgd' ELSE 'svm' END AS model,
        CAST(l_orderkey % 5 AS INTEGER) AS fold, l_linenumber - 1 AS y_true,
        CAST(CASE WHEN l_partkey % 4 = 0 THEN l_linenumber % 7 ELSE l_linenumber - 1 END AS INTEGER) AS y_pred
    FROM lineitem),
conf AS (SELECT model, fold, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL),
t AS (SELECT model, fold, y_true AS cls, sum(n) AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp
      FROM conf GROUP BY ALL),
pr AS (SELECT model, fold, y_pred AS cls, sum(n) AS predicted FROM conf GROUP BY ALL),
cs0 AS (SELECT coalesce(t.model, pr.model) AS model, coalesce(t.fold, pr.fold) AS fold, coalesce(support, 0) AS support,
        coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
        FROM t FULL JOIN pr ON t.model = pr.model AND t.fold = pr.fold AND t.cls = pr.cls),
cs AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS prec,
       CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rec FROM cs0),
cs2 AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM cs),
s0 AS (SELECT model, fold, sum(support) AS n, sum(tp) AS tp, sum(f1 * support) AS wf, sum(prec * support) AS wp,
       sum(CAST(support AS DOUBLE) * predicted) AS pe FROM cs2 GROUP BY model, fold),
h AS (SELECT model, fold, round(1 - wp / n, 12) AS loss, round(1 - wf / n, 12) AS val_loss, tp / n AS accuracy,
      ((tp / n) - pe / (CAST(n AS DOUBLE) * n)) / (1 - pe / (CAST(n AS DOUBLE) * n)) AS val_accuracy FROM s0),
v AS (SELECT model, arg_min(fold, (loss, fold)) AS w FROM h GROUP BY model
      UNION ALL SELECT model, arg_min(fold, (val_loss, fold)) FROM h GROUP BY model
      UNION ALL SELECT model, arg_min(fold, (-accuracy, fold)) FROM h GROUP BY model
      UNION ALL SELECT model, arg_min(fold, (-val_accuracy, fold)) FROM h GROUP BY model),
c AS (SELECT model, w, count(*) AS votes FROM v GROUP BY model, w)
SELECT model, w AS fold, votes FROM c QUALIFY row_number() OVER (PARTITION BY model ORDER BY votes DESC, w) = 1"""

QUERIES = {
    "tfidf": (tfidf, f"""WITH t AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        w AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM tf JOIN df USING (term), n)
        SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""),
    "svd": (svd, None),
    "text_cv": (text_cv, None),
    "svm_proba": (svm_proba, None),
    "label_set_scores": (label_set_scores, None),
    "token_tagger": (token_tagger, None),
    "tagger_predictions": (tagger_predictions, None),
    "multilabel_scores": (multilabel_scores, None),
    "best_fold": (best_fold, BEST_SQL),
}
