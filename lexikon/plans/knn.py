"""KNN on the ``embeddings`` table: error, grid search, best setting, prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexikon.operators.index import arithmetic_order, assign_folds, with_row_index
from lexikon.operators.neighbors import best_config, knn_classify, knn_cross_validation
from lexikon.plans.common import r6, table
from lexikon.session import keep

GRID_FOLDS = [2, 5, 10]
GRID_K = [1, 3, 5, 9, 11]


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label")


def _cv(spark, sf_dir, folds, ks):
    """All fold numbers in one search."""
    data = _emb(spark, sf_dir)
    for L in folds:
        data = assign_folds(data, ["id"], L, f"fold{L}")
    res = knn_cross_validation(keep(data), [f"fold{L}" for L in folds], ks)
    number = F.element_at(F.array(*[F.lit(L) for L in folds]), F.col("plan") + 1)
    return res.select(number.alias("folds"), "k", r6("mean_err").alias("mean_err"), r6("std_err").alias("std_err"))


def knn_error(spark, sf_dir):
    return _cv(spark, sf_dir, [5], [5])


def knn_grid(spark, sf_dir):
    return _cv(spark, sf_dir, GRID_FOLDS, GRID_K)


def knn_best(spark, sf_dir):
    return best_config(knn_grid(spark, sf_dir))


def knn_grid_table(spark, sf_dir):
    from lexikon.operators.neighbors import grid_table
    return grid_table(knn_grid(spark, sf_dir), GRID_FOLDS)


def knn_predict(spark, sf_dir):
    """60/40 split in a seeded order, K = 5, one prediction per test row."""
    emb = _emb(spark, sf_dir)
    idx = with_row_index(emb, [arithmetic_order("id", 0), "id"], "i", count_name="n")
    cut = F.col("n") - F.ceil(F.col("n") * 2 / 5)  # test share 0.4, rounded up
    train = idx.where(F.col("i") < cut)
    test = idx.where(F.col("i") >= cut)
    pred = knn_classify(test, train, 5)
    return (pred.join(test.select(F.col("id").alias("test_id"), F.col("label").alias("y_true")), "test_id")
            .select(F.col("test_id").alias("vec_id"), "y_true", F.col("y_pred").cast("int").alias("y_pred")))


def knn_neighbors_q(spark, sf_dir):
    """M1 distances: the 5 nearest training rows of every test row (60/40
    seeded split) with their Euclidean distance."""
    from lexikon.operators.neighbors import knn_neighbors
    emb = _emb(spark, sf_dir)
    idx = with_row_index(emb, [arithmetic_order("id", 0), "id"], "i", count_name="n")
    cut = F.col("n") - F.ceil(F.col("n") * 2 / 5)
    nb = knn_neighbors(idx.where(F.col("i") >= cut), idx.where(F.col("i") < cut), 5)
    return nb.select("test_id", "train_id", F.col("rank").cast("int").alias("rank"), r6("dist").alias("dist"))


_FOLD_SQL = """
  idx AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) v, folds,
                 row_number() OVER (PARTITION BY folds ORDER BY vec_id) - 1 AS i,
                 count(*) OVER (PARTITION BY folds) AS n
          FROM embeddings, Ls),
  f AS (SELECT *, CASE WHEN i < (n % folds) * (n // folds + 1) THEN i // (n // folds + 1)
                  ELSE (n % folds) + (i - (n % folds) * (n // folds + 1)) // (n // folds) END AS fold
        FROM idx),
  pairs AS (SELECT t.folds, t.vec_id test_id, t.fold, t.label y_true, r.vec_id train_id, r.label tl,
                   list_distance(t.v, r.v) d
            FROM f t JOIN f r ON t.folds = r.folds AND t.fold <> r.fold),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY folds, test_id ORDER BY d, train_id) rn FROM pairs),
  votes AS (SELECT r.folds, k, test_id, fold, y_true, tl, count(*) c
            FROM ranked r JOIN Ks ON rn <= k GROUP BY ALL),
  pred AS (SELECT *, row_number() OVER (PARTITION BY folds, k, test_id ORDER BY c DESC, tl) vr FROM votes),
  err AS (SELECT folds, k, fold, 100.0 * avg(CAST(y_true <> tl AS DOUBLE)) e FROM pred WHERE vr = 1 GROUP BY ALL)
SELECT CAST(folds AS INTEGER) AS folds, CAST(k AS INTEGER) AS k, round(avg(e), 6) AS mean_err,
       round(stddev_pop(e), 6) AS std_err
FROM err GROUP BY folds, k
"""


def _grid_sql(folds, ks):
    fl = ",".join(f"({x})" for x in folds)
    kl = ",".join(f"({x})" for x in ks)
    return (f"WITH Ls AS (SELECT * FROM (VALUES {fl}) t(folds)), Ks AS (SELECT * FROM (VALUES {kl}) t(k)),"
            + _FOLD_SQL)


KNN_PREDICT_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) v,
                  row_number() OVER (ORDER BY (vec_id * 2654435761 + 0) % 2147483647, vec_id) - 1 AS i,
                  count(*) OVER () AS n FROM embeddings),
tr AS (SELECT * FROM e WHERE i < n - ceil(n * 2 / 5)),
te AS (SELECT * FROM e WHERE i >= n - ceil(n * 2 / 5)),
pairs AS (SELECT te.vec_id test_id, te.label y_true, tr.vec_id train_id, tr.label tl,
                 list_distance(te.v, tr.v) d
          FROM te, tr),
ranked AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY d, train_id) rn FROM pairs),
votes AS (SELECT test_id, y_true, tl, count(*) c FROM ranked WHERE rn <= 5 GROUP BY ALL),
pred AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY c DESC, tl) vr FROM votes)
SELECT test_id AS vec_id, y_true, CAST(tl AS INTEGER) AS y_pred FROM pred WHERE vr = 1
"""

KNN_BEST_SQL = ("SELECT folds, k, mean_err FROM (" + _grid_sql(GRID_FOLDS, GRID_K)
                + ") ORDER BY mean_err, folds, k LIMIT 1")

KNN_NEIGHBORS_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) v,
                  row_number() OVER (ORDER BY (vec_id * 2654435761 + 0) % 2147483647, vec_id) - 1 AS i,
                  count(*) OVER () AS n FROM embeddings),
pairs AS (SELECT te.vec_id test_id, tr.vec_id train_id, list_distance(te.v, tr.v) d
          FROM (SELECT * FROM e WHERE i >= n - ceil(n * 2 / 5)) te, (SELECT * FROM e WHERE i < n - ceil(n * 2 / 5)) tr),
ranked AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY d, train_id) rn FROM pairs)
SELECT test_id, train_id, CAST(rn AS INTEGER) AS rank, round(d, 6) AS dist FROM ranked WHERE rn <= 5
"""

QUERIES = {
    "knn_neighbors": (knn_neighbors_q, KNN_NEIGHBORS_SQL),
    "knn_error": (knn_error, _grid_sql([5], [5])),
    "knn_grid": (knn_grid, _grid_sql(GRID_FOLDS, GRID_K)),
    "knn_best": (knn_best, KNN_BEST_SQL),
    "knn_grid_table": (knn_grid_table, "SELECT k, " + ", ".join(
        f"max(CASE WHEN folds = {L} THEN mean_err END) AS F{L}_mean, max(CASE WHEN folds = {L} THEN std_err END) AS F{L}_std"
        for L in GRID_FOLDS) + " FROM (" + _grid_sql(GRID_FOLDS, GRID_K) + ") GROUP BY k"),
    "knn_predict": (knn_predict, KNN_PREDICT_SQL),
}
