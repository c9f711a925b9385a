"""Threshold, multi-label and ranking measures over a long score table
``(id, label, y_true int, score double)`` (E10-E23, M16).

Curves are built from the distinct (label, score) cells -- counts of
positives and negatives per cell -- and running sums in descending score,
computed range by range (``running_sums``), so neither one label nor the
pooled micro curve is ever sorted in a single task.  Trapezoids and
average-precision steps need the previous point, which is the running sum
minus the current cell: no ``lag`` window.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexikon.operators.index import running_sums, with_row_index
from lexikon.session import cut_lineage

MICRO = "micro"


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def threshold_grid(lo: int = 20, hi: int = 50, scale: float = 100.0) -> list[float]:
    """Thresholds from integers (i / 100), never by repeated addition."""
    return [i / scale for i in range(lo, hi + 1)]


def predict(score: Column, t: float, strict: bool = False) -> Column:
    """1 where the score passes the threshold (``>`` if ``strict``)."""
    return (score > F.lit(t) if strict else score >= F.lit(t)).cast("int")


def threshold_sweep(df: DataFrame, thresholds: list[float], score: str = "score",
                    y_true: str = "y_true") -> DataFrame:
    """Micro F1 over all cells for every threshold, in ONE scan:
    conditional sums per threshold, then unpivot.  ``best`` marks the first
    threshold with the highest F1."""
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= F.lit(t)
        aggs += [F.count_if(hit & (F.col(y_true) == 1)).alias(f"tp{i}"),
                 F.count_if(hit & (F.col(y_true) != 1)).alias(f"fp{i}"),
                 F.count_if(~hit & (F.col(y_true) == 1)).alias(f"fn{i}")]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold"),
                                        F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                                        F.col(f"fn{i}").alias("fn"))
                               for i, t in enumerate(thresholds)]))
    long = wide.select(rows.alias("r")).select("r.*")
    long = long.withColumn("f1", _div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    w = Window.orderBy(F.desc("f1"), "i")  # 31 rows
    return long.withColumn("best", F.row_number().over(w) == 1).drop("i")


def multilabel_confusion(df: DataFrame, t: float, label: str = "label") -> DataFrame:
    """Tn, fp, fn, tp per label at threshold ``t``."""
    p = F.col("score") >= F.lit(t)
    y = F.col("y_true") == 1
    return df.groupBy(label).agg(F.count_if(~p & ~y).alias("tn"), F.count_if(p & ~y).alias("fp"),
                                 F.count_if(~p & y).alias("fn"), F.count_if(p & y).alias("tp"))


def with_micro(df: DataFrame, label: str = "label") -> DataFrame:
    """Per-label rows plus the pooled rows under label ``micro``."""
    return df.unionByName(df.withColumn(label, F.lit(MICRO)))


def curve_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative counts at every distinct score, highest score first:
    ``(keys..., score, pos, neg, tp, fp, P, N)``; ``tp``/``fp`` count the cells
    with score >= this score."""
    cells = df.groupBy(*keys, "score").agg(F.count_if(F.col("y_true") == 1).alias("pos"),
                                           F.count_if(F.col("y_true") != 1).alias("neg"))
    # the cell table (distinct key x score) feeds several jobs (count, quantiles,
    # offsets, totals): cut it once so the scores are scanned once
    cells = cut_lineage(cells)
    cum = running_sums(cells, keys, -F.col("score"), ["pos", "neg"])
    tot = cells.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    same = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], F.lit(True))
    cum = cum.alias("c").join(tot.alias("t"), same).select("c.*", "t.P", "t.N")
    return (cum
            .withColumnRenamed("pos_cum", "tp").withColumnRenamed("neg_cum", "fp"))


def roc_curve(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., threshold, fpr, tpr)`` at every distinct score."""
    c = curve_points(df, keys)
    return c.select(*keys, F.col("score").alias("threshold"), _div(F.col("fp"), F.col("N")).alias("fpr"),
                    _div(F.col("tp"), F.col("P")).alias("tpr"))


def pr_curve(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., threshold, precision, recall)``."""
    c = curve_points(df, keys)
    return c.select(*keys, F.col("score").alias("threshold"),
                    _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    _div(F.col("tp"), F.col("P")).alias("recall"))


def auc_and_ap(df: DataFrame, keys: list[str]) -> DataFrame:
    """E14/E17 per key: ROC AUC by trapezoids and average precision
    ``sum((R_n - R_{n-1}) * P_n)``; null where a key has only one class."""
    c = curve_points(df, keys)
    fpr, tpr = F.col("fp") / F.col("N"), F.col("tp") / F.col("P")
    fpr0, tpr0 = (F.col("fp") - F.col("neg")) / F.col("N"), (F.col("tp") - F.col("pos")) / F.col("P")
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    area = (fpr - fpr0) * (tpr + tpr0) / 2
    ap = (tpr - tpr0) * prec
    g = c.groupBy(*keys).agg(F.sum(area).alias("_auc"), F.sum(ap).alias("_ap"),
                             F.first("P").alias("support"), F.first("N").alias("negatives"))
    valid = (F.col("support") > 0) & (F.col("negatives") > 0)
    return g.select(*keys, F.when(valid, F.col("_auc")).alias("roc_auc"),
                    F.when(F.col("support") > 0, F.col("_ap")).alias("average_precision"),
                    F.col("support").cast("bigint").alias("support"))


def averaged_scores(df: DataFrame, label: str = "label", id_col: str = "id") -> DataFrame:
    """E14/E17 averages: per label, ``micro`` (pooled), ``macro`` (mean of
    labels), ``weighted`` (by positives) and ``samples`` (AP per id, mean)."""
    per = auc_and_ap(df, [label])
    micro = auc_and_ap(df.withColumn(label, F.lit(MICRO)), [label])
    macro = per.agg(F.avg("roc_auc").alias("roc_auc"), F.avg("average_precision").alias("average_precision"),
                    F.sum("support").cast("bigint").alias("support")).withColumn(label, F.lit("macro"))
    wavg = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum(F.when(F.col(c).isNotNull(), F.col("support")))
    weighted = per.agg(wavg("roc_auc").alias("roc_auc"), wavg("average_precision").alias("average_precision"),
                       F.sum("support").cast("bigint").alias("support")).withColumn(label, F.lit("weighted"))
    # samples: AP of every id over its labels (a group bounded by the label count)
    sample_ap = _sample_average_precision(df, id_col, label)
    samples = sample_ap.agg(F.lit(None).cast("double").alias("roc_auc"),
                            F.avg("ap").alias("average_precision"),
                            F.count(F.lit(1)).cast("bigint").alias("support")).withColumn(label, F.lit("samples"))
    cols = [label, "roc_auc", "average_precision", "support"]
    return (per.select(*cols).unionByName(micro.select(*cols)).unionByName(macro.select(*cols))
            .unionByName(weighted.select(*cols)).unionByName(samples.select(*cols)))


def _sample_average_precision(df: DataFrame, id_col: str, label: str) -> DataFrame:
    w = Window.partitionBy(id_col).orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    s = (df.withColumn("_tp", F.sum((F.col("y_true") == 1).cast("int")).over(w))
         .withColumn("_n", F.count(F.lit(1)).over(w))
         .withColumn("_P", F.sum((F.col("y_true") == 1).cast("int")).over(Window.partitionBy(id_col))))
    # one step per distinct score inside the id; precision at that score times recall gain
    cells = s.groupBy(id_col, "score").agg(F.first("_tp").alias("tp"), F.first("_n").alias("n"),
                                           F.first("_P").alias("P"),
                                           F.count_if(F.col("y_true") == 1).alias("pos"))
    return (cells.where(F.col("P") > 0)
            .groupBy(id_col).agg(F.sum((F.col("pos") / F.col("P")) * (F.col("tp") / F.col("n"))).alias("ap")))


def macro_roc_curve(df: DataFrame, label: str = "label", rows_per_bucket: int | None = None) -> DataFrame:
    """The union of all labels' fpr points, each label's tpr linearly
    interpolated there (largest tpr where a label has several at one fpr), and
    the mean over labels.  (Because a label's curve is taken at its largest tpr
    at every fpr, the area of this curve can exceed the mean per-label AUC.)

    A sum of piecewise linear curves is piecewise linear: every point of a label
    changes the slope of the sum there.  So the mean at all points is one
    running sum of slope changes over the grid, linear in the points; no label
    is evaluated on another one's points.  ``rows_per_bucket`` sets how many
    points a range of that sum holds (by default there is one range for each
    shuffle partition)."""
    roc = roc_curve(df, [label])
    pts = roc.select(label, "fpr", "tpr")
    starts = pts.select(label).distinct().select(label, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    pts = cut_lineage(pts.unionByName(starts).groupBy(label, "fpr").agg(F.max("tpr").alias("tpr")))
    ranges = max(1, math.ceil(pts.count() / rows_per_bucket)) if rows_per_bucket else None
    idx = with_row_index(pts, ["fpr"], "i", ranges, partition_by=[label])
    here = idx.select(F.col(label).alias("l"), "i", F.col("fpr").alias("x0"), F.col("tpr").alias("y0")).alias("h")
    after = idx.select(F.col(label).alias("l"), (F.col("i") - 1).alias("i"), F.col("fpr").alias("x1"),
                       F.col("tpr").alias("y1")).alias("a")
    seg = (here.join(after, F.col("h.l").eqNullSafe(F.col("a.l")) & (F.col("h.i") == F.col("a.i")), "left")
           .select("h.i", "x0", "y0", "x1", F.coalesce((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")),
                                                       F.lit(0.0)).alias("slope")))
    turns = seg.select(F.explode(F.array(
        F.struct(F.col("x0").alias("fpr"), F.col("slope").alias("turn"),
                 F.when(F.col("i") == 0, F.col("y0")).otherwise(0.0).alias("start")),
        F.struct(F.col("x1").alias("fpr"), (-F.col("slope")).alias("turn"), F.lit(0.0).alias("start")))).alias("t"))
    grid = (turns.select("t.*").where(F.col("fpr").isNotNull()).groupBy("fpr")
            .agg(F.sum("turn").alias("turn"), F.sum(F.col("turn") * F.col("fpr")).alias("lift"),
                 F.sum("start").alias("start")))
    n_labels = starts.agg(F.count(F.lit(1)).alias("n_labels"))
    cum = running_sums(grid, [], F.col("fpr"), ["turn", "lift", "start"], ranges=ranges).crossJoin(F.broadcast(n_labels))  # one row
    return cum.select("fpr", ((F.col("start_cum") + F.col("fpr") * F.col("turn_cum") - F.col("lift_cum"))
                              / F.col("n_labels")).alias("mean_tpr"))


def micro_scores(df: DataFrame, t: float, beta: float = 0.5) -> DataFrame:
    """Pooled precision, recall, F-beta, F1 and Hamming loss."""
    p = F.col("score") >= F.lit(t)
    y = F.col("y_true") == 1
    g = df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
               F.count_if(~p & y).alias("fn"), F.count(F.lit(1)).alias("cells"))
    prec = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _div(F.col("tp"), F.col("tp") + F.col("fn"))
    b2 = beta * beta
    fb = _div((1 + b2) * F.col("tp"), (1 + b2) * F.col("tp") + b2 * F.col("fn") + F.col("fp"))
    f1 = _div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fn") + F.col("fp"))
    ham = (F.col("fp") + F.col("fn")) / F.col("cells")
    return g.select(prec.alias("precision"), rec.alias("recall"), fb.alias("fbeta"), f1.alias("f1"),
                    ham.alias("hamming_loss"))


def label_precision(df: DataFrame, t: float, label: str = "label") -> DataFrame:
    """E18 per label column."""
    p = F.col("score") >= F.lit(t)
    return df.groupBy(label).agg(_div(F.count_if(p & (F.col("y_true") == 1)), F.count_if(p)).alias("precision"))


def sample_precision(df: DataFrame, t: float, id_col: str = "id") -> DataFrame:
    """Precision of every row (id) over its labels, then the mean."""
    p = F.col("score") >= F.lit(t)
    per = df.groupBy(id_col).agg(_div(F.count_if(p & (F.col("y_true") == 1)), F.count_if(p)).alias("p"))
    return per.agg(F.avg("p").alias("sample_precision"), F.count(F.lit(1)).alias("rows"))


def bce_loss(df: DataFrame, logit: str = "logit", y: str = "y_true", keys: list[str] | None = None) -> DataFrame:
    """Mean binary cross-entropy on logits, in the stable form."""
    x, t = F.col(logit), F.col(y).cast("double")
    term = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    return df.groupBy(*(keys or [])).agg(F.avg(term).alias("bce"))


def prediction_names(df: DataFrame, t: float, id_col: str = "id", label: str = "label") -> DataFrame:
    """E22/V10 core: per id the names of true labels and of predicted labels,
    sorted and comma-joined (a group bounded by the label count)."""
    p = F.col("score") >= F.lit(t)
    names = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col(label)))), ",")
    return df.groupBy(id_col).agg(names(F.col("y_true") == 1).alias("actual"), names(p).alias("predicted"))

