"""Nearest neighbours by cells: exact under every fold plan, pruned where vectors cluster."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexikon.operators.neighbors import knn_cross_validation, knn_neighbors, knn_search


def _frame(spark, x, folds=(5, 2)):
    rows = [(i, v.tolist(), i % 3, *[i % f for f in folds]) for i, v in enumerate(x)]
    names = ", ".join(f"f{f} int" for f in folds)
    return spark.createDataFrame(rows, f"id long, features array<double>, label int, {names}").repartition(4)


def _brute(x, k, mod=None):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    ids = np.arange(len(x))
    if mod:
        d = np.where((ids[:, None] % mod) == (ids[None, :] % mod), np.inf, d)
    return {(q, r + 1): int(t) for q in ids for r, t in enumerate(np.lexsort((ids, d[q]))[:k])}


def _clustered():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 8)) * 10
    x = np.concatenate([m + rng.normal(size=(60, 8)) for m in middles])
    return x[rng.permutation(len(x))]


def test_two_fold_plans_in_one_search(spark):
    x = _clustered()
    df = _frame(spark, x)
    s = knn_search(df, df, 4, folds=["f5", "f2"], rows_per_tile=40)
    rows = s.neighbors.collect()
    for plan, mod in ((0, 5), (1, 2)):
        assert {(r.test_id, r["rank"]): r.train_id for r in rows if r.plan == plan} == _brute(x, 4, mod)
    assert s.pairs == len(x) ** 2 and s.compared < s.pairs / 2


def test_a_third_of_the_rows_are_copies(spark):
    x = _clustered()
    x[::3] = x[0]
    got = knn_neighbors(_frame(spark, x), _frame(spark, x), 3, rows_per_tile=25, chunk_rows=64)
    ids = {(r.test_id, r["rank"]): (r.train_id, round(r.dist, 9)) for r in got.collect()}
    assert {k: v[0] for k, v in ids.items()} == _brute(x, 3)
    assert ids[(300, 1)] == (0, 0.0)  # ties by the smaller id


def test_grid_of_plans_equals_one_plan_each(spark):
    df = _frame(spark, _clustered())
    both = {(r.plan, r.k): (r.mean_err, r.std_err) for r in knn_cross_validation(df, ["f5", "f2"], [1, 3], rows_per_tile=50).collect()}
    for plan, col in enumerate(["f5", "f2"]):
        for r in knn_cross_validation(df, col, [1, 3], rows_per_tile=10 ** 6).collect():
            assert both[(plan, r.k)] == pytest.approx((r.mean_err, r.std_err))


def test_empty_null_and_few_rows(spark):
    df = _frame(spark, _clustered()[:3])
    assert knn_neighbors(df, df.where("id < 0"), 5).count() == 0
    assert knn_neighbors(df.where("id < 0"), df, 5).count() == 0
    assert knn_neighbors(df, df, 5).count() == 9  # all, if fewer
    holes = F.when(F.col("id") == 1, F.array(F.lit(None).cast("double"), F.lit(1.0))).when(F.col("id") == 0, F.col("features"))
    with_holes = df.withColumn("features", holes)
    assert {(r.test_id, r.train_id) for r in knn_neighbors(df, with_holes, 5).collect()} == {(0, 0), (1, 0), (2, 0)}


def test_work_of_spread_vectors_grows_with_blocks_not_tiles(spark, monkeypatch):
    """No bound helps here, so all tiles are visited: a test row goes once to a group of tiles, not once to each."""
    from lexikon.operators import neighbors
    groups = []
    real = neighbors._candidates
    monkeypatch.setattr(neighbors, "_candidates", lambda routed, tiled, tiles, visits, *a: (
        groups.append((len(tiles.ids), sum(visits.values()))), real(routed, tiled, tiles, visits, *a))[1])
    x = np.random.default_rng(5).normal(size=(400, 16))
    df = _frame(spark, x)
    got = {(r.test_id, r["rank"]): r.train_id for r in knn_neighbors(df, df, 3, fold="f5", rows_per_tile=20).collect()}
    assert got == _brute(x, 3, 5)
    assert all(tiles >= 20 and sent <= 400 for tiles, sent in groups) and len(groups) == 3


def test_far_off_huge_and_infinite_vectors(spark):
    rng = np.random.default_rng(6)
    x = 1e9 + rng.normal(size=(200, 5))  # single precision cannot tell these apart
    x[150:] = 1e100 * rng.normal(size=(50, 5))
    x[199, 2] = np.inf
    near = x[:150]
    df = _frame(spark, x)
    got = {(r.test_id, r["rank"]): r.train_id for r in knn_neighbors(df, df, 4, rows_per_tile=30).collect()}
    assert {k: v for k, v in got.items() if k[0] < 150} == _brute(near, 4)
    assert not any(t == 199 for t in got.values()) and (199, 1) not in got
