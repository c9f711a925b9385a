"""Classification measures as distributed aggregates.

Every measure starts from one scan of the predictions into a confusion-count
table ``(keys..., y_true, y_pred, n)`` -- a hash aggregate with map-side
partial aggregation, whose size is keys x classes^2 and does not grow with
the rows.  Everything after it works on that small table.  A ratio with a
zero denominator is 0, as the reference's library reports it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def confusion_counts(df: DataFrame, keys: list[str], y_true: str = "y_true",
                     y_pred: str = "y_pred") -> DataFrame:
    return (df.groupBy(*keys, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_stats(conf: DataFrame, keys: list[str]) -> DataFrame:
    """Per class: tp, support (true count), predicted count, precision, recall, f1.
    Classes that only appear as predictions get support 0."""
    # every confusion cell feeds its true-class margin and its predicted-class
    # margin: one aggregate, no join, one pass over the (small) count table
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.explode(F.array(
        F.struct(F.col("y_true").alias("cls"), F.col("n").alias("s"), hit.alias("t"), zero.alias("p")),
        F.struct(F.col("y_pred").alias("cls"), zero.alias("s"), zero.alias("t"), F.col("n").alias("p"))))
    s = (conf.select(*keys, sides.alias("m"))
         .groupBy(*keys, F.col("m.cls").alias("cls"))
         .agg(F.sum("m.s").alias("support"), F.sum("m.t").alias("tp"), F.sum("m.p").alias("predicted")))
    prec = _div(F.col("tp"), F.col("predicted"))
    rec = _div(F.col("tp"), F.col("support"))
    return (s.withColumn("precision", prec).withColumn("recall", rec)
            .withColumn("f1", _div(2 * F.col("precision") * F.col("recall"),
                                   F.col("precision") + F.col("recall"))))


def summary_scores(conf: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, support-weighted precision/recall/F1, Cohen's kappa."""
    cs = class_stats(conf, keys)
    agg = cs.groupBy(*keys).agg(
        F.sum("support").alias("_n"), F.sum("tp").alias("_tp"),
        F.sum(F.col("precision") * F.col("support")).alias("_wp"),
        F.sum(F.col("recall") * F.col("support")).alias("_wr"),
        F.sum(F.col("f1") * F.col("support")).alias("_wf"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("_pe"))
    po = _div(F.col("_tp"), F.col("_n"))
    pe = _div(F.col("_pe"), F.col("_n").cast("double") * F.col("_n"))
    return agg.select(*keys, po.alias("accuracy"), _div(F.col("_wp"), F.col("_n")).alias("precision"),
                      _div(F.col("_wr"), F.col("_n")).alias("recall"),
                      _div(F.col("_wf"), F.col("_n")).alias("f1"),
                      F.when(pe == 1, F.lit(0.0)).otherwise((po - pe) / (1 - pe)).alias("cohen_kappa"),
                      F.col("_n").alias("n"))


def classification_report(conf: DataFrame, keys: list[str]) -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg``, ``weighted avg``.
    Returns ``(keys..., row, precision, recall, f1, support)``; class rows are
    named by the class value."""
    cs = class_stats(conf, keys)
    per = cs.select(*keys, F.col("cls").cast("string").alias("row"), "precision", "recall", "f1",
                    F.col("support").cast("bigint").alias("support"))
    tot = cs.groupBy(*keys).agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        _div(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
        _div(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
        _div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"),
        _div(F.sum("tp"), F.sum("support")).alias("acc"), F.sum("support").cast("bigint").alias("n"))
    macro = tot.select(*keys, F.lit("macro avg").alias("row"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support"))
    weighted = tot.select(*keys, F.lit("weighted avg").alias("row"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support"))
    acc = tot.select(*keys, F.lit("accuracy").alias("row"), F.col("acc").alias("precision"),
                     F.col("acc").alias("recall"), F.col("acc").alias("f1"), F.col("n").alias("support"))
    return per.unionByName(macro).unionByName(weighted).unionByName(acc)


def class_score_table(conf: DataFrame, keys: list[str]) -> DataFrame:
    """E5: F1 rounded to 3 and support per class, best first (rank column)."""
    cs = class_stats(conf, keys).where(F.col("support") > 0)
    w = Window.partitionBy(*keys).orderBy(F.desc("f1r"), "cls")
    return (cs.select(*keys, "cls", F.round("f1", 3).alias("f1r"), F.col("support").cast("bigint").alias("support"))
            .withColumn("rank", F.row_number().over(w).cast("bigint")).withColumnRenamed("f1r", "f1_score"))


def confusion_matrix(conf: DataFrame, keys: list[str], labels: list, normalized: bool = True,
                     name_fallback: bool = True) -> DataFrame:
    """The full label x label grid (given label list), row-normalised and
    rounded to 2 decimals; empty rows give 0.  The grid comes from literal
    label arrays, never from the data.  When integer labels starting at 0 are
    given but the predictions hold names, the names ``class0, class1, ...``
    are used instead (the reference's retry)."""
    if name_fallback and labels and labels[0] == 0 and isinstance(conf.schema["y_true"].dataType, StringType):
        labels = [f"class{i}" for i in range(len(labels))]
    grid = (conf.select(*keys).distinct()
            .withColumn("y_true", F.explode(F.array(*[F.lit(x) for x in labels])))
            .withColumn("y_pred", F.explode(F.array(*[F.lit(x) for x in labels]))))
    m = grid.join(conf, [*keys, "y_true", "y_pred"], "left").fillna(0, ["n"])
    if not normalized:
        return m.withColumn("value", F.col("n").cast("double")).drop("n")
    row = F.sum("n").over(Window.partitionBy(*keys, "y_true"))
    return m.withColumn("value", F.round(_div(F.col("n"), row), 2)).drop("n")


def fold_summary(scores: DataFrame, model: str = "model", fold: str = "fold",
                 time_col: str | None = None) -> DataFrame:
    """Per model the fold count, the per-fold metric lists in fold order and
    the mean time per fold (-1 where no time was taken)."""
    tcol = F.coalesce(F.col(time_col), F.lit(-1.0)) if time_col else F.lit(-1.0)
    s = scores.withColumn("_t", tcol.cast("double"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(fold), F.col(c)))),
                                    lambda x: x[c])
    return s.groupBy(F.col(model).alias("name")).agg(
        F.count(F.lit(1)).alias("fold_amount"),
        *[ordered(c).alias(c) for c in ["accuracy", "precision", "recall", "f1", "cohen_kappa"]],
        ordered("_t").alias("time"))


def leaderboard(summary: DataFrame, decimals: int = 3) -> DataFrame:
    """Mean of every metric list per model, rounded, sorted by F1 (rank),
    time dropped."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    out = summary.select("name", "fold_amount",
                         *[F.round(mean(F.col(c)), decimals).alias(c)
                           for c in ["accuracy", "precision", "recall", "f1", "cohen_kappa"]])
    w = Window.orderBy(F.desc("f1"), "name")  # one row per model: small
    return out.withColumn("rank", F.row_number().over(w).cast("bigint"))


def support_share(conf: DataFrame, keys: list[str]) -> DataFrame:
    """Support of each true class divided by the number of rows."""
    t = conf.groupBy(*keys, F.col("y_true").alias("cls")).agg(F.sum("n").alias("support"))
    return t.withColumn("share", F.col("support") / F.sum("support").over(Window.partitionBy(*keys)))


def flatten_sequences(df: DataFrame, keys: list[str], true_col: str, pred_col: str) -> DataFrame:
    """Token-level form of E4: pairs of equal-length label arrays to rows."""
    z = df.select(*keys, F.explode(F.arrays_zip(F.col(true_col).alias("t"), F.col(pred_col).alias("p"))).alias("z"))
    return z.select(*keys, F.col("z.t").alias("y_true"), F.col("z.p").alias("y_pred"))
