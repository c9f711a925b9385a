"""Features, linear models and model selection.

TF-IDF is written with DataFrame operations on the long ``(doc, term, tf)``
form so it can be checked against SQL; the classifiers use Spark ML
estimators (distributed fitting) on hashed features, so no vocabulary has to
be gathered anywhere.  Cross-validation over label sets and calibrated margins (M9-M12) are in ``linear``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexikon.session import cut_lineage, keep, stored

NUM_FEATURES = 1 << 16
#: Terms of most documents whose frequencies are broadcast, and their most characters: a few MB at any size.
COMMON_TERMS = 1 << 16
COMMON_LENGTH = 64


# --- M7: TF-IDF ---------------------------------------------------------------------------

def _term_counts(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, term, tf) of every row by itself: its tokens sorted, each run of equal ones is a term."""
    runs = df.select(key, F.sort_array(F.array_compact(tokens)).alias("_s")).where(F.size("_s") > 0)
    start = F.filter(F.sequence(F.lit(0), F.size("_s") - 1),
                     lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    runs = runs.select(key, "_s", start.alias("_a"))
    end = F.concat(F.slice("_a", 2, F.size("_a")), F.array(F.size("_s")))
    counts = F.zip_with("_a", end, lambda a, b: F.struct(F.get("_s", a).alias("term"), (b - a).cast("long").alias("tf")))
    return runs.select(key, F.explode(counts).alias("_c")).select(key, "_c.term", "_c.tf")


def tfidf(df: DataFrame, key: str, tokens: str, smooth: bool = True) -> DataFrame:
    """``(key, term, weight)``: raw term counts times ``ln((1+n)/(1+df)) + 1``
    (smoothed idf, no lowercasing), L2-normalised per document.

    The document frequencies of the COMMON_TERMS go to the rows; only rows of rarer terms move to
    their document frequency.  All rows move to their document once, for its norm."""
    n, most = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)), F.max("_n")).first()
    tf = _term_counts(df, key, tokens)
    if (most or 0) > 1:  # rows of one key are one document
        tf = tf.groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    # counted once; document frequencies and weights both read the written table
    tf = stored(tf, "term_counts")
    dfreq = stored(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "document_frequencies")
    common = dfreq.where(F.length("term") <= COMMON_LENGTH).orderBy(F.desc("df"), "term").limit(COMMON_TERMS)
    marked = tf.join(F.broadcast(common), "term", "left")
    # no broadcast hint: the whole term table grows with the vocabulary; AQE turns the
    # join into a broadcast only when the measured size is under its threshold
    rare = marked.where(F.col("df").isNull()).drop("df").join(dfreq, "term")
    found = marked.where(F.col("df").isNotNull()).unionByName(rare)
    idf = (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0) if smooth else (F.log(F.lit(float(n)) / F.col("df")) + 1.0)
    # counts go to the document and not their product, which hardly compresses
    w = found.repartition(key).withColumn("w", F.col("tf") * idf)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / norm).alias("weight"))


def text_features(tokens: str = "tokens", num_features: int = NUM_FEATURES) -> list:
    """Hashed term counts + IDF stages for ML pipelines (no vocabulary)."""
    return [HashingTF(inputCol=tokens, outputCol="tf", numFeatures=num_features),
            IDF(inputCol="tf", outputCol="features")]


# --- M8: truncated SVD ----------------------------------------------------------------------

def truncated_svd(df: DataFrame, key: str, features: str, k: int) -> DataFrame:
    """M8: rows projected on the top ``k`` singular directions (U * S) without
    centring, ``(key, components array<double>)``.  The decomposition is
    Spark's distributed ``IndexedRowMatrix.computeSVD`` (an RDD API: the one
    place the survey keeps one); ``key`` must be a long id.

    The solver scans the matrix once for each of its iterations, so the rows are written
    first, as vectors of its own kind: no scan computes features or goes through Python."""
    from pyspark.mllib.linalg.distributed import IndexedRowMatrix
    from pyspark.mllib.util import MLUtils
    spark = df.sparkSession
    rows = cut_lineage(MLUtils.convertVectorColumnsFromML(
        df.select(F.col(key).cast("long").alias("index"), F.col(features).alias("vector")), "vector"))
    svd = IndexedRowMatrix(rows).computeSVD(k, computeU=True)
    s = [float(x) for x in svd.s.toArray()]
    us = svd.U.rows.map(lambda r: (int(r.index), [float(u) * sv for u, sv in zip(r.vector.toArray(), s)]))
    return spark.createDataFrame(us, f"{key} long, components array<double>")


# --- M13: best fold ------------------------------------------------------------------------------

def select_best_fold(hist: DataFrame, fold: str = "fold", keys: tuple[str, ...] = (),
                     lower: tuple[str, ...] = ("loss", "val_loss"),
                     higher: tuple[str, ...] = ("accuracy", "val_accuracy")) -> DataFrame:
    """Each metric votes for its best fold (lowest loss, highest accuracy,
    ties to the lowest fold); the fold with most votes wins, ties lowest fold.
    One row for each of ``keys`` (e.g. each model)."""
    best = [F.min_by(fold, F.struct(F.col(m), F.col(fold))).alias(m) for m in lower]
    best += [F.min_by(fold, F.struct(-F.col(m), F.col(fold))).alias(m) for m in higher]
    won = hist.groupBy(*keys).agg(*best).select(*keys, F.explode(F.array(*lower, *higher)).alias("winner"))
    counts = won.groupBy(*keys, "winner").agg(F.count(F.lit(1)).alias("votes"))
    return counts.groupBy(*keys).agg(
        F.min_by(F.struct("winner", "votes"), F.struct(-F.col("votes"), F.col("winner"))).alias("b")) \
        .select(*keys, F.col("b.winner").alias(fold), F.col("b.votes").alias("votes"))


# --- M14: token tagger ---------------------------------------------------------------------------

def token_rows(df: DataFrame, keys: list[str], tokens: str, labels: str | None = None) -> DataFrame:
    """One row per token with its neighbours taken by array index inside the
    sentence (no shuffle, no window)."""
    cols = [F.col(tokens).alias("_t")] + ([F.col(labels).alias("_l")] if labels else [])
    base = df.select(*keys, *cols)
    z = F.posexplode("_t").alias("pos", "token")
    ex = base.select(*keys, "_t", *(["_l"] if labels else []), z)
    prev = F.when(F.col("pos") > 0, F.element_at("_t", F.col("pos"))).otherwise(F.lit("<S>"))
    nxt = F.when(F.col("pos") + 2 <= F.size("_t"), F.element_at("_t", F.col("pos") + 2)).otherwise(F.lit("</S>"))
    out = ex.select(*keys, "pos", "token", prev.alias("prev"), nxt.alias("next"),
                    F.lower("token").alias("lower"), F.substring("token", 1, 1).alias("first"),
                    F.right("token", F.lit(3)).alias("suffix"),
                    *([F.element_at("_l", F.col("pos") + 1).alias("tag")] if labels else []))
    return out


#: Columns of ``token_rows`` that are features of a token.
TOKEN_FEATURES = ["token", "prev", "next", "lower", "first", "suffix"]


def token_features(rows: DataFrame, num_features: int = 1 << 16) -> DataFrame:
    """``rows`` with their hashed features: several fits need them, and hashing costs as much as some of their iterations."""
    return FeatureHasher(inputCols=TOKEN_FEATURES, outputCol="features", numFeatures=num_features).transform(rows)


def token_tagger(tag_index: list[str], max_iter: int = 30, num_features: int = 1 << 16, hashed: bool = False) -> Pipeline:
    """Hashed token/context features + multinomial logistic regression.  ``hashed``: over ``token_features``."""
    hasher = FeatureHasher(inputCols=TOKEN_FEATURES, outputCol="features", numFeatures=num_features)
    lr = LogisticRegression(featuresCol="features", labelCol="tag_id", maxIter=max_iter, regParam=1e-4,
                            family="multinomial")
    return Pipeline(stages=[lr] if hashed else [hasher, lr])


def sequences_from_tokens(pred: DataFrame, keys: list[str], *cols: str) -> DataFrame:
    """Back to per-sentence sequences in token order (a group bounded by the
    sentence length), all ``cols`` in one shuffle."""
    g = pred.groupBy(*keys).agg(F.collect_list(F.struct("pos", *cols)).alias("_s"))

    def listed(col: str) -> Column:
        own = F.array_sort(F.transform("_s", lambda s: F.struct(s["pos"], s[col].alias("v"))))  # ties by value
        return F.transform(own, lambda s: s["v"]).alias(col)

    return g.select(*keys, *[listed(c) for c in cols])


# --- M15: multi-label scores -----------------------------------------------------------------------

def multilabel_scores(df: DataFrame, id_col: str, tokens: str, labels: dict[str, Column],
                      max_iter: int = 30, num_features: int = NUM_FEATURES) -> DataFrame:
    """One logistic regression per label on shared hashed TF-IDF
    features; long output ``(id, label, y_true, score)``."""
    feats = Pipeline(stages=text_features(tokens, num_features)).fit(df)
    base = keep(feats.transform(df.select(id_col, tokens, *[c.alias(n) for n, c in labels.items()])))
    out = None
    for name in labels:
        lr = LogisticRegression(featuresCol="features", labelCol=name, maxIter=max_iter, regParam=1e-3,
                                probabilityCol="p_" + name, rawPredictionCol="r_" + name,
                                predictionCol="y_" + name)
        scored = lr.fit(base.withColumn(name, F.col(name).cast("double"))).transform(base)
        part = scored.select(id_col, F.lit(name).alias("label"), F.col(name).cast("int").alias("y_true"),
                             vector_to_array("p_" + name)[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return out
