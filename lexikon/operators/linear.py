"""Many linear classifiers in one scan.

Cross-validating a one-vs-rest classifier over several label sets asks for a fit
per label set, fold and class.  All of them read the same rows, so they are
trained together: a row carries its label and its fold for each label set, the
weights of all fits are one matrix (term x set x fold x class), and a fold's
weights simply skip the rows they are to be tested on.  Each epoch is one scan:
every shard of rows runs stochastic gradient descent on the hinge loss from the
common weights, and weights are averaged over the shards that met a term.  TF-IDF
weights are those of each fold's own training rows, with rows of length one.

A task runs many shards one after the other and sends the sum of their weights, so what is
shuffled grows with the tasks that run at once, not with the shards.  What goes through the
driver is the model: ``num_features`` x columns, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexikon.session import cut_lineage

#: Features, rows of a shard and number of shards at most.
NUM_FEATURES, SHARD_ROWS, SHARDS = 1 << 16, 1024, 256
#: Buckets of terms whose weights are averaged by one task each.
BUCKETS = 64
ALPHA, FIRST_STEP, EPOCHS = 1e-4, 1e3, 5


@dataclass
class Task:
    """Classes of each label set, and the number of folds."""
    classes: list[list[int]]
    folds: int

    @property
    def groups(self) -> int:
        return len(self.classes) * self.folds

    def cut(self, flat: np.ndarray) -> list[np.ndarray]:
        """Rows of all weights as one (rows, folds, classes) view for each label set."""
        ends = np.cumsum([self.folds * len(c) for c in self.classes])
        return [x.reshape(len(flat), self.folds, len(c))
                for x, c in zip(np.split(flat, ends[:-1], axis=1), self.classes, strict=True)]

    @property
    def columns(self) -> int:
        return self.folds * sum(map(len, self.classes))


def hashed_terms(tokens: Column | str, num_features: int = NUM_FEATURES) -> Column:
    """The column number of each token."""
    return F.transform(tokens, lambda t: F.pmod(F.hash(t), F.lit(num_features)))


def term_rows(df: DataFrame, id_col: str, tokens: str, labels: str, folds: str, num_features: int,
              terms: str | None = None) -> DataFrame:
    """(shard, id, terms: hashed, labels, folds), dealt to shards by the hash of the id and in a fixed order there,
    written.  The rows of a shard follow each other; a partition holds about as many shards as any other.
    ``terms``: a column of ``hashed_terms``, in place of ``tokens``."""
    numbers = F.col(terms) if terms else hashed_terms(tokens, num_features)
    df = df.select(F.col(id_col).alias("id"), numbers.alias("terms"), F.col(labels).alias("labels"), F.col(folds).alias("folds"))
    n = df.select("id").count()
    shards = max(1, min(SHARDS, -(-n // SHARD_ROWS)))
    rows = cut_lineage(df.repartition(shards, F.hash("id")).withColumn("shard", F.spark_partition_id())
                       .sortWithinPartitions(F.hash("id"), "id"))
    # whole partitions, one after the other
    return rows.coalesce(min(shards, rows.sparkSession.sparkContext.defaultParallelism))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, terms, counts, labels, folds) of each row."""
    for b in batches:
        terms, labels, folds = b.column("terms"), b.column("labels").to_pylist(), b.column("folds").to_pylist()
        flat, at = terms.values.to_numpy(zero_copy_only=False), terms.offsets.to_numpy()
        for i, row in enumerate(b.column("id").to_pylist()):
            term, count = np.unique(flat[at[i]:at[i + 1]], return_counts=True)
            yield row, term, count.astype(np.float32), labels[i], folds[i]


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[Iterator[pa.RecordBatch]]:
    """The batches of each shard, cut where the next one begins."""
    def cut() -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in batches:
            shard = b.column("shard").to_numpy()
            ends = [*(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for lo, hi in zip([0, *ends], ends):
                if hi > lo:
                    yield shard[lo], b.slice(lo, hi - lo)

    for _, own in groupby(cut(), key=lambda x: x[0]):
        yield (b for _, b in own)


def _summed(rows: DataFrame, make: Callable[[Iterable[pa.RecordBatch]], tuple[np.ndarray, np.ndarray]], width: int,
            num_rows: int) -> tuple:
    """(terms, sums, shards) of what ``make`` gives for each shard: terms below ``num_rows`` and as many rows of
    ``width`` numbers.  The sums of a task's shards are sent, not each of them."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = None, np.zeros(num_rows, np.int32)
        for shard in _shards(batches):
            terms, values = make(shard)
            if sums is None:
                sums = np.zeros((num_rows, width))
            sums[terms] += values
            n[terms] += 1
        met = np.flatnonzero(n)
        for lo in range(0, len(met), 4096):
            at = met[lo:lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(at % BUCKETS, pa.int32()), pa.array(at, pa.int32()),
                                              pa.array([x.tobytes() for x in sums[at].astype(np.float32)], pa.binary()),
                                              pa.array(n[at])], ["bucket", "term", "values", "n"])

    def total(table: pa.Table) -> pa.Table:
        term, at = np.unique(table.column("term").to_numpy(), return_inverse=True)
        values = np.frombuffer(b"".join(table.column("values").to_pylist()), np.float32).reshape(-1, width)
        order = np.argsort(at, kind="stable")
        begin = np.searchsorted(at[order], np.arange(len(term)))
        sums = np.add.reduceat(values[order].astype(float), begin, axis=0).astype(np.float32)
        n = np.bincount(at, table.column("n").to_numpy()).astype(np.int32)
        return pa.table([pa.array([0] * len(term), pa.int32()), pa.array(term, pa.int32()),
                         pa.array([x.tobytes() for x in sums], pa.binary()), pa.array(n)],
                        names=["bucket", "term", "values", "n"])

    schema = "bucket int, term int, values binary, n int"
    found = rows.mapInArrow(task, schema).groupBy("bucket").applyInArrow(total, schema).toArrow()
    values = np.frombuffer(b"".join(found.column("values").to_pylist()), np.float32).reshape(-1, width)
    return found.column("term").to_numpy(), values, found.column("n").to_numpy()


def fold_idf(rows: DataFrame, task: Task, num_features: int) -> np.ndarray:
    """ln((1 + n) / (1 + df)) + 1 of each term (row) over the training rows of each label set and fold."""
    def counts(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((num_features + 1, task.groups), np.float32)  # the last row counts documents
        for _, term, _, labels, folds in _rows(batches):
            own = [s * task.folds + f for s, (x, f) in enumerate(zip(labels, folds, strict=True)) if x is not None]
            out[np.append(term, num_features)[:, None], own] += 1
        some = np.flatnonzero(out.any(axis=1))
        return some, out[some]

    terms, sums, _ = _summed(rows, counts, task.groups, num_features + 1)
    df = np.zeros((num_features + 1, task.groups))
    df[terms] = sums
    whole = df.reshape(-1, len(task.classes), task.folds)
    train = (whole.sum(axis=2, keepdims=True) - whole).reshape(-1, task.groups)
    return (np.log((1 + train[-1]) / (1 + train[:-1])) + 1).astype(np.float32)


def _vectors(term: np.ndarray, count: np.ndarray, idf: np.ndarray, task: Task) -> list[np.ndarray]:
    """The row as each fold of each label set sees it: (terms, folds) of length one, with a constant behind."""
    x = idf[term] * count[:, None]
    x = x / np.maximum(np.sqrt((x * x).sum(axis=0)), 1e-12)
    return np.split(np.vstack([x, np.full((1, task.groups), 0.1, np.float32)]), len(task.classes), axis=1)


def _epoch(batches: Iterable[pa.RecordBatch], task: Task, weights: np.ndarray, idf: np.ndarray, begun: int,
           alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Terms met by a shard and their weights after one pass; ``begun``: passes before."""
    rows = list(_rows(batches))
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, task.columns), np.float32)
    bias = len(weights) - 1
    met = np.unique(np.concatenate([np.append(term, bias) for _, term, *_ in rows]))
    own, scale, step = weights[met], 1.0, FIRST_STEP + begun * len(rows)
    sets = task.cut(own)
    classes = [np.array(c) for c in task.classes]
    for _, term, count, labels, folds in rows:
        at = np.searchsorted(met, np.append(term, bias))
        eta = 1 / (alpha * step)
        scale *= 1 - eta * alpha
        step += 1
        for w, x, c, label, fold in zip(sets, _vectors(term, count, idf, task), classes, labels, folds, strict=True):
            if label is None:
                continue
            target = np.where(c == label, 1.0, -1.0)
            margin = np.einsum("nf,nfc->fc", x, w[at]) * scale
            g = np.where(target * margin < 1, eta * target / scale, 0.0)
            g[fold] = 0  # held out
            w[at] += (x[:, :, None] * g[None]).astype(np.float32)
    return met, np.concatenate([w.reshape(len(met), -1) for w in sets], axis=1) * np.float32(scale)


@dataclass
class JointFit:
    """Fits of all label sets, folds and classes: ``idf`` (term x set, fold) and
    ``weights`` (term, the constant last, x set, fold, class)."""
    task: Task
    idf: np.ndarray
    weights: np.ndarray


def fit_jointly(rows: DataFrame, task: Task, epochs: int = EPOCHS, alpha: float = ALPHA,
                num_features: int = NUM_FEATURES) -> JointFit:
    """All fits over ``rows`` (of ``term_rows``), one scan for the idf and one an epoch.  A fold
    that holds no row is trained on all of them."""
    sc = rows.sparkSession.sparkContext
    found = fold_idf(rows, task, num_features)
    idf = sc.broadcast(found)
    weights = np.zeros((num_features + 1, task.columns), np.float32)
    for epoch in range(epochs):
        sent = sc.broadcast(weights)
        terms, sums, n = _summed(
            rows, lambda b, w=sent, e=epoch: _epoch(b, task, w.value, idf.value, e, alpha), task.columns,
            num_features + 1)
        weights = weights * np.float32(0)
        weights[terms] = sums / n[:, None]
        sent.destroy()
    idf.destroy()
    return JointFit(task, found, weights)


def joint_cross_validation(df: DataFrame, classes: list[list[int]], folds: int, id_col: str = "id", tokens: str = "tokens",
                           labels: str = "labels", fold_col: str = "folds", epochs: int = EPOCHS, alpha: float = ALPHA,
                           num_features: int = NUM_FEATURES, terms: str | None = None) -> DataFrame:
    """(label_set, fold, id, y_true, y_pred): held-out predictions of every fold of every label set.

    ``labels`` and ``fold_col`` are arrays with an entry for each label set (null: the row
    is not in it); ``classes`` lists the classes of each.  A row is predicted by the
    weights of its own fold, which never saw it; the first of equal scores wins.  Rows
    without a token get the constant's verdict.  ``terms``: a column of ``hashed_terms``, in place of ``tokens``.
    """
    rows = term_rows(df, id_col, tokens, labels, fold_col, num_features, terms)
    fit = fit_jointly(rows, Task(classes, folds), epochs, alpha, num_features)
    names = F.array(*[F.array(*[F.lit(c) for c in own]) for own in classes])
    margins = held_out_margins(rows, fit)
    best = F.array_position("margins", F.array_max("margins")).cast("int")
    return cut_lineage(margins.select("label_set", "fold", "id", "y_true", names[F.col("label_set")][best - 1].alias("y_pred")))


def held_out_margins(rows: DataFrame, fit: JointFit) -> DataFrame:
    """(label_set, fold, id, y_true, margins): of each class, by the weights of the row's own fold."""
    sent = rows.sparkSession.sparkContext.broadcast(fit)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, schema = sent.value, pa.schema([("label_set", pa.int32()), ("fold", pa.int32()), ("id", pa.int64()),
                                             ("y_true", pa.int32()), ("margins", pa.list_(pa.float64()))])
        cut = fit.task.cut(fit.weights)
        for b in batches:
            out = [[] for _ in schema]
            for row, term, count, own, held in _rows([b]):
                at = np.append(term, len(fit.weights) - 1)
                for s, x in enumerate(_vectors(term, count, fit.idf, fit.task)):
                    if own[s] is not None:
                        margin = x[:, held[s]] @ cut[s][at, held[s]]
                        for column, v in zip(out, (s, held[s], row, own[s], margin.tolist()), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return rows.mapInArrow(margins, "label_set int, fold int, id bigint, y_true int, margins array<double>")


# --- M10: linear classifier with probabilities --------------------------------------------------------------

#: Folds whose held-out margins calibrate the classifier.
CALIBRATION_FOLDS = 5


class SvmProba:
    """M10 (labels 0 and 1): a linear SVM of all rows whose margins a logistic curve turns
    into probabilities.  The curve is fitted on margins of folds that their SVM has not
    seen: margins of training rows are too far apart and give probabilities too sure.
    The SVMs of the folds and the one of all rows are trained in common scans.

    Rows with a null label are not trained on; null tokens are none; where all labels are
    equal, the probability is their smoothed share."""

    def __init__(self, idf: np.ndarray, weights: np.ndarray, slope: float, offset: float):
        self.idf, self.weights, self.slope, self.offset = idf, weights, slope, offset

    @classmethod
    def fit(cls, df: DataFrame, id_col: str, tokens: str = "tokens", label: str = "label", epochs: int = EPOCHS,
            num_features: int = NUM_FEATURES) -> SvmProba:
        fold = F.pmod(F.xxhash64(F.col(id_col)), F.lit(CALIBRATION_FOLDS)).cast("int")
        data = df.where(F.col(label).isNotNull()).select(
            F.col(id_col).alias("id"), F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("tokens"),
            F.array(F.col(label).cast("int")).alias("labels"), F.array(fold).alias("folds"))
        rows = term_rows(data, "id", "tokens", "labels", "folds", num_features)
        fit = fit_jointly(rows, Task([[1]], CALIBRATION_FOLDS + 1), epochs, num_features=num_features)  # the last holds no row
        held = held_out_margins(rows, fit).select("y_true", F.col("margins")[0].alias("margin"))
        slope, offset = platt_scaling(cut_lineage(held))
        return cls(fit.idf[:, -1].copy(), fit.weights[:, -1].copy(), slope, offset)

    def transform(self, df: DataFrame, tokens: str = "tokens") -> DataFrame:
        """``df`` with margin, probability (of label 1) and prediction; a column of one of these names is replaced."""
        sent = df.sparkSession.sparkContext.broadcast((self.idf[:, None], self.weights))
        size, one = len(self.idf), Task([[1]], 1)

        @F.pandas_udf("double")
        def margin(terms: pd.Series) -> pd.Series:
            idf, weights = sent.value
            out = []
            for own in terms:
                term, count = np.unique(np.asarray(own, np.int64), return_counts=True)
                x = _vectors(term, count.astype(np.float32), idf, one)[0][:, 0]
                out.append(float(x @ weights[np.append(term, size)]))
            return pd.Series(out, dtype=float)

        words = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
        terms = hashed_terms(words, size)
        p = 1 / (1 + F.exp(-(F.col("margin") * self.slope + self.offset)))
        return (df.withColumn("margin", margin(terms)).withColumn("probability", p)
                .withColumn("prediction", (F.col("probability") >= 0.5).cast("int")))

    def save(self, spark: SparkSession, path: str) -> None:
        """Terms with idf and weight (the constant has a null idf), and the curve, as Parquet."""
        terms = pa.table({"term": pa.array(np.arange(len(self.weights)), pa.int32()),
                          "idf": pa.array([*self.idf.tolist(), None], pa.float32()), "weight": pa.array(self.weights)})
        spark.createDataFrame(terms).write.mode("overwrite").parquet(f"{path}/terms")
        spark.createDataFrame([(self.slope, self.offset)], "slope double, offset double").write.mode("overwrite").parquet(
            f"{path}/curve")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SvmProba:
        terms = spark.read.parquet(f"{path}/terms").orderBy("term").toArrow()
        curve = spark.read.parquet(f"{path}/curve").first()
        return cls(terms.column("idf").to_numpy()[:-1].astype(np.float32), terms.column("weight").to_numpy().copy(),
                   curve["slope"], curve["offset"])


def platt_scaling(margins: DataFrame, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (y_true, margin), by Newton's method.  Targets are
    drawn in from 0 and 1 by the rule of one more row of either label, so separable margins have a finite curve."""
    n = margins.agg(F.coalesce(F.sum("y_true"), F.lit(0)).alias("ones"), F.count(F.lit(1)).alias("all")).first()
    high, low = (n["ones"] + 1) / (n["ones"] + 2), 1 / (n["all"] - n["ones"] + 2)
    t = F.when(F.col("y_true") == 1, F.lit(high)).otherwise(F.lit(low))
    m = F.col("margin")

    def at(slope: float, offset: float):
        z = m * slope + offset
        loss = F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - t * z
        p = 1 / (1 + F.exp(-z))
        w = p * (1 - p)
        return margins.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in (loss, (p - t) * m, p - t, w * m * m, w * m, w)]).first()

    slope, offset = 0.0, math.log((n["ones"] + 1) / (n["all"] - n["ones"] + 1))
    now, damping = at(slope, offset), 1e-9
    for _ in range(steps):
        loss, ga, gb, aa, ab, bb = now
        if max(abs(ga), abs(gb)) <= 1e-7 * max(1, n["all"]):
            break
        det = (aa + damping) * (bb + damping) - ab * ab
        step = (((bb + damping) * ga - ab * gb) / det, ((aa + damping) * gb - ab * ga) / det)
        tried = at(slope - step[0], offset - step[1])
        if tried[0] <= loss:
            slope, offset, now, damping = slope - step[0], offset - step[1], tried, damping / 10
        else:
            damping = max(damping * 100, 1e-3 * max(aa, bb))
    return slope, offset
