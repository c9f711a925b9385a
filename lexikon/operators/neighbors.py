"""Exact k-nearest-neighbour search, voting and cross-validation (M1-M6).

No cross join.  Centres are learned on a bounded sample of the training
vectors; every training row belongs to the *cell* of its nearest centre, and a
cell is cut into *tiles*: rings by the distance to its centre.  A tile knows
its number of rows and the least and greatest distance of its rows to its own
centre and to the first ``REFERENCES`` centres.  By the triangle inequality each
of these ranges gives a lower bound of a query's distance to all rows of the
tile; the largest of them counts.

A query visits tiles best first, in rounds with a shrinking radius: the tiles
around it, until they hold a few times K rows; then, among the next
``NEXT_TILES``, those whose bound is within the K-th distance found; then all the
rest within the new K-th distance.  No tile is visited twice, and a query that
found fewer than K rows has an infinite radius, so the result is exact.
Nothing is pruned where no bound helps (evenly spread vectors of many
dimensions); then every pair is compared once.

Tiles next to each other go together: a block is a group of tiles of at most
``BLOCK_VALUES`` numbers against one chunk of the test rows routed to any of them, so a
training row is copied once for each chunk and not for each tile and chunk.  In
a block one matrix product a tile bounds all distances from below (single precision, less
its rounding error); only pairs within the radius, or within the K-th bound of
the tile, are measured, in double precision and in the order of the
dimensions.  Of equal training vectors of the same folds the K smallest ids
take part; no other copy can be among K neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexikon.session import cut_lineage, keep

ROWS_PER_TILE = 4096
#: Numbers of the training and of the test side of a block: 2^16 and 2^14 vectors of 64 dimensions.
BLOCK_VALUES = 1 << 22
CHUNK_VALUES = 1 << 20
#: Bounds of what the driver holds and every task receives: centres, rings of a cell, tiles.
MAX_CENTRES = 256
MAX_RINGS = 64
MAX_TILES = MAX_CENTRES * MAX_RINGS
SAMPLE_PER_CENTRE = 8
REFERENCES = 8
NEXT_TILES = 4
_EPS = 1e-9
_GROUP_SHIFT = 14  # MAX_TILES numbers below that of the group
_SLICE = 256  # rows that are measured against all centres or tiles at once


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two equal-length double arrays, summed in order."""
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0).cast("double"), lambda acc, v: acc + v))


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All distances of two blocks, summed over the dimensions in order (the
    same rounding as a sequential SQL sum)."""
    acc = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        diff = q[:, j, None] - x[None, :, j]
        diff *= diff
        acc += diff
    return np.sqrt(acc, out=acc)


class Search(NamedTuple):
    """Neighbours, and how many of all (test, train) pairs were compared for them."""
    neighbors: DataFrame
    compared: int
    pairs: int


# --- cells and tiles ----------------------------------------------------------------------

def _centres(train: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` centres: Lloyd's steps over a sample of ``SAMPLE_PER_CENTRE``
    rows for each, drawn by the hash of the id."""
    rows = (train.select("train_id", "xv").orderBy(F.xxhash64("train_id"), "train_id")
            .limit(SAMPLE_PER_CENTRE * n).collect())
    sample = np.unique(np.array([r["xv"] for r in rows], dtype=np.float64), axis=0)
    centres = sample[np.random.default_rng(0).permutation(len(sample))[:n]]
    for _ in range(5):
        near = _distances(sample, centres).argmin(axis=1)
        centres = np.stack([sample[near == i].mean(axis=0) for i in np.unique(near)])
    return centres


def _cells(centres: np.ndarray):
    """mapInPandas kernel: cell, distance to its centre, distances to the reference centres."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), _SLICE):
                part = pdf.iloc[i:i + _SLICE].copy()
                d = _distances(np.stack(part["xv"].to_numpy()), centres)
                part["cell"] = d.argmin(axis=1).astype("int32")
                part["s"] = d.min(axis=1)
                part["refs"] = list(d[:, :REFERENCES])
                yield part
    return run


def _tiled(train: DataFrame, centres: np.ndarray, rows_per_tile: int) -> DataFrame:
    """Training rows with their ``tile``.  Rings are cut at quantiles, from one small row a cell."""
    schema = T.StructType(train.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("s", T.DoubleType()),
                                                 T.StructField("refs", T.ArrayType(T.DoubleType()))])
    placed = cut_lineage(train.mapInPandas(_cells(centres), schema))
    most = max(1, min(MAX_RINGS, MAX_TILES // len(centres)))
    grid = [F.lit(i / MAX_RINGS) for i in range(1, MAX_RINGS)]
    cuts = []
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"),
                                        F.percentile_approx("s", F.array(*grid), F.lit(1000)).alias("q")).collect():
        rings = min(most, math.ceil(r["n"] / rows_per_tile))
        cuts.append((r["cell"], sorted({r["q"][i * MAX_RINGS // rings - 1] for i in range(1, rings)})))
    small = train.sparkSession.createDataFrame(cuts, "cell int, cuts array<double>")  # at most MAX_CENTRES rows
    ring = F.size(F.filter("cuts", lambda c: c < F.col("s")))
    return placed.join(F.broadcast(small), "cell").withColumn("tile", F.col("cell") * MAX_RINGS + ring).drop("cuts")


def _group(tile: Column) -> Column:
    return F.shiftright(tile, _GROUP_SHIFT)


class _Tiles:
    """What routing has to know of every tile: at most ``MAX_TILES`` rows.

    Tiles are put into groups of at most ``block_rows`` rows, or of one larger tile of several
    ``parts``; ``codes`` are their numbers with that of the group before it."""

    def __init__(self, tiled: DataFrame, centres: np.ndarray, block_rows: int):
        self.centres = centres
        self.n_refs = min(REFERENCES, len(centres))
        ranges = [f(F.col("refs")[j]).alias(f"{n}{j}") for j in range(self.n_refs) for n, f in (("lo", F.min), ("hi", F.max))]
        rows = tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"),
                                         *ranges).orderBy("tile").collect()
        self.ids = np.array([r["tile"] for r in rows], dtype=np.int32)
        self.sizes = np.array([r["n"] for r in rows], dtype=np.int64)
        self.own = self.ids // MAX_RINGS
        group, rows_in = np.zeros(len(rows), np.int32), []
        for i in np.argsort(self._row(centres)[self.own], kind="stable"):
            if not rows_in or rows_in[-1] + self.sizes[i] > block_rows:
                rows_in.append(0)
            group[i] = len(rows_in) - 1
            rows_in[-1] += int(self.sizes[i])
        self.parts = [math.ceil(n / block_rows) for n in rows_in]
        self.codes = (group << _GROUP_SHIFT) + self.ids
        self.lo, self.hi = np.array([r["lo"] for r in rows]), np.array([r["hi"] for r in rows])
        self.ref_lo = np.array([[r[f"lo{j}"] for r in rows] for j in range(self.n_refs)])
        self.ref_hi = np.array([[r[f"hi{j}"] for r in rows] for j in range(self.n_refs)])

    @staticmethod
    def _row(centres: np.ndarray) -> np.ndarray:
        """Places of the centres in a row in which each one is followed by the nearest of those left."""
        place, at = np.full(len(centres), -1), 0
        for i in range(len(centres)):
            place[at] = i
            far = _distances(centres[at:at + 1], centres)[0]
            at = int(np.where(place < 0, far, math.inf).argmin())
        return place

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds of the distances to the tiles' rows, and the distances to their centres."""
        d = _distances(q, self.centres)
        near = d[:, self.own]
        low = np.maximum(np.maximum(near - self.hi, self.lo - near), 0.0)
        for j in range(self.n_refs):
            ref = d[:, j, None]
            np.maximum(low, ref - self.ref_hi[j], out=low)
            np.maximum(low, self.ref_lo[j] - ref, out=low)
        return low, near


def _visits(tiles: _Tiles, step: int, enough: int):
    """mapInPandas kernel: the tiles that a test row visits in round ``step``."""
    def one(row_low, row_near, upto: int, r: float) -> tuple[int, np.ndarray]:
        order = np.lexsort((row_near, row_low))
        if step == 0:
            end = min(len(order), int(np.searchsorted(np.cumsum(tiles.sizes[order]), enough)) + 1)
        else:
            end = min(len(order), upto + NEXT_TILES) if step == 1 else len(order)
        seen = order[upto:end]
        return end, seen[row_low[seen] <= r * (1 + _EPS) + _EPS]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), _SLICE):
                part = pdf.iloc[i:i + _SLICE].copy()
                low, near = tiles.bounds(np.stack(part["qv"].to_numpy()))
                found = [one(*v) for v in zip(low, near, part["upto"], part["r"])]
                part["upto"] = np.array([e for e, _ in found], dtype="int32")
                part["tiles"] = [tiles.codes[t] for _, t in found]
                part["compared"] = np.array([tiles.sizes[t].sum() for _, t in found], dtype="int64")
                yield part
    return run


# --- blocks -------------------------------------------------------------------------------

_FOUND = T.ArrayType(T.StructType([T.StructField("dist", T.DoubleType()), T.StructField("train_id", T.LongType()),
                                   T.StructField("train_label", T.IntegerType())]))
_BLOCK = T.StructType([T.StructField("test_id", T.LongType()), T.StructField("plan", T.IntegerType()),
                       T.StructField("found", _FOUND)])
_PAIR = pa.struct([("dist", pa.float64()), ("train_id", pa.int64()), ("train_label", pa.int32())])


def _matrix(column: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Lists of one length as rows."""
    lists = column.combine_chunks()
    n = np.unique(lists.value_lengths().to_numpy(zero_copy_only=False))
    if len(n) != 1:
        raise ValueError(f"vectors of different lengths: {n.tolist()}")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(lists), n[0])


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(np.iinfo(np.int64).min).to_numpy()  # nulls first, as in ORDER BY


class _Bounds:
    """Scores q.x - |x|^2 / 2 of scaled vectors in single precision, for lower bounds of distances: ``least`` is the
    least score of a pair within a squared distance, its rounding error allowed for."""

    def __init__(self, q: np.ndarray, x: np.ndarray):
        middle = x.mean(axis=0)
        q, x = q - middle, x - middle
        self.scale = max(np.abs(q).max(initial=0.0), np.abs(x).max(initial=0.0)) or 1.0
        q, x = q / self.scale, x / self.scale
        self.qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
        self.q = np.concatenate([q, np.ones((len(q), 1))], axis=1).astype(np.float32)
        self.x = np.concatenate([x, -xx[:, None] / 2], axis=1).astype(np.float32)
        most = xx.max(initial=0.0)
        # of each of the dims + 1 products and sums, and of the inputs
        self.error = (q.shape[1] + 8) * 2.0 ** -23 * (np.sqrt(self.qq * most) + most + self.qq) + 1e-30

    def least(self, rows: np.ndarray, square: np.ndarray) -> np.ndarray:
        return ((self.qq[rows] - square) / 2 - self.error[rows]).astype(np.float64)

    def square(self, rows: np.ndarray, score: np.ndarray) -> np.ndarray:
        """What the squared distance of a pair of this score is at most."""
        return np.maximum(self.qq[rows] - 2 * score.astype(np.float64) + 2 * self.error[rows], 0.0)


def _near_pairs(rows: np.ndarray, visits: np.ndarray, cuts: np.ndarray, bounds: _Bounds, square: np.ndarray,
                k: int, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(test row, training row) of all pairs that may be among the K nearest of any plan; ``square``
    holds the squared radius of ``rows`` and shrinks.  ``visits``: rows x tiles; ``cuts``: where tiles begin."""
    out_row, out_col = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in np.flatnonzero(visits.any(axis=0)):
        at = np.flatnonzero(visits[:, t])
        here = rows[at]
        for lo in range(cuts[t], cuts[t + 1], ROWS_PER_TILE):
            hi = min(lo + ROWS_PER_TILE, cuts[t + 1])
            score = bounds.q[here] @ bounds.x[lo:hi].T
            near = score >= bounds.least(here, square[at]).astype(np.float32)[:, None]
            many = np.flatnonzero(np.count_nonzero(near, axis=1) > 4 * k)
            if len(many) and hi - lo >= k:
                worst = np.zeros(len(many))
                for p in range(max(1, own.shape[1])):
                    part = score[many]
                    if own.shape[1]:
                        part = np.where(own[here[many], p][:, None] == other[None, lo:hi, p], -np.inf, part)
                    worst = np.maximum(worst, bounds.square(here[many], np.partition(part, hi - lo - k, axis=1)[:, hi - lo - k]))
                square[at[many]] = np.minimum(square[at[many]], worst)
                near[many] = score[many] >= bounds.least(here[many], square[at[many]]).astype(np.float32)[:, None]
            row, col = np.nonzero(near)
            out_row.append(here[row])
            out_col.append(col + lo)
    return np.concatenate(out_row), np.concatenate(out_col)


def _block_topk(k: int, plans: int):
    """Per block: exact distances, and the local top-k of every test row by
    (dist, train_id) for each fold plan (``plans`` = 0: no folds)."""
    def fn(te: pa.Table, tr: pa.Table) -> pa.Table:
        empty = pa.table({"test_id": pa.array([], pa.int64()), "plan": pa.array([], pa.int32()),
                          "found": pa.array([], pa.list_(_PAIR))})
        if not len(te) or not len(tr):
            return empty
        tr = tr.take(pa.array(np.argsort(tr["tile"].to_numpy(), kind="stable")))
        tiles, first = np.unique(tr["tile"].to_numpy(), return_index=True)
        cuts = np.append(first, len(tr))
        # test rows of the same tiles are worked on together
        te = te.take(pa.array(np.argsort(np.array([v[0].as_py() for v in te["tiles"]]), kind="stable")))
        q, x = _matrix(te["qv"]), _matrix(tr["xv"])
        ids = _ids(tr["train_id"])
        own, other = (_matrix(c, np.int32) for c in (te["test_folds"], tr["train_folds"]))
        routes = te["tiles"].combine_chunks()
        ends = np.concatenate([[0], np.cumsum(routes.value_lengths().to_numpy())])
        routes = routes.flatten().to_numpy()
        bounds = _Bounds(q, x)
        square = (te["r"].to_numpy() / bounds.scale * (1 + _EPS)) ** 2
        qt, xt = np.ascontiguousarray(q.T), np.ascontiguousarray(x.T)
        parts = []
        for i in range(0, len(q), 2 * _SLICE):
            rows = np.arange(i, min(i + 2 * _SLICE, len(q)))
            visits = np.zeros((len(rows), len(tiles)), bool)
            to = routes[ends[i]:ends[rows[-1] + 1]]
            place = np.minimum(np.searchsorted(tiles, to), len(tiles) - 1)
            held = tiles[place] == to  # another part of the group may hold a tile alone
            visits[np.repeat(rows - i, np.diff(ends[i:rows[-1] + 2]))[held], place[held]] = True
            row, col = _near_pairs(rows, visits, cuts, bounds, square[rows], k, own, other)
            dist = np.zeros(len(row))
            for a, b in zip(qt, xt, strict=True):  # in order: the same rounding as a sequential SQL sum
                diff = a[row] - b[col]
                dist += diff * diff
            np.sqrt(dist, out=dist)
            order = np.lexsort((ids[col], dist, row))
            row, col, dist = row[order], col[order], dist[order]
            for p in range(max(1, plans)):
                some = np.flatnonzero(np.isfinite(dist) & (own[row, p] != other[col, p] if plans else True))
                some = some[np.arange(len(some)) - np.searchsorted(row[some], row[some]) < k]
                who, start = np.unique(row[some], return_index=True)
                if len(who):
                    pairs = pa.StructArray.from_arrays(
                        [pa.array(dist[some]), *(tr[c].combine_chunks().take(pa.array(col[some]))
                                                 for c in ("train_id", "train_label"))], fields=list(_PAIR))
                    parts.append(pa.table({
                        "test_id": te["test_id"].take(pa.array(who)), "plan": pa.array(np.full(len(who), p, np.int32)),
                        "found": pa.ListArray.from_arrays(pa.array(np.append(start, len(some)).astype(np.int32)), pairs)}))
        return pa.concat_tables(parts) if parts else empty
    return fn


def _candidates(routed: DataFrame, tiled: DataFrame, tiles: _Tiles, visits: dict[int, int], k: int, plans: int,
                chunk_rows: int) -> DataFrame:
    """Local top-k of every routed test row in each group of tiles, a list a plan.  A group is copied once
    for each chunk of the ``visits`` test rows routed to it; a tile too large for a group of its own is dealt out."""
    rows = [(g, math.ceil(n / chunk_rows), tiles.parts[g]) for g, n in visits.items()]
    plan = F.broadcast(tiled.sparkSession.createDataFrame(rows, "group int, chunks int, subs int"))  # at most MAX_TILES rows
    blocks = sum(c * s for _, c, s in rows)

    def upto(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def dealt(id_col: str, n: str) -> Column:
        return F.pmod(F.xxhash64(id_col), F.col(n)).cast("int")

    keys = ["group", "sub", "chunk"]
    group = F.explode(F.array_distinct(F.transform("tiles", _group))).alias("group")
    te = (routed.select("test_id", "qv", "test_folds", "r", "tiles", group)
          .withColumn("tiles", F.filter("tiles", lambda t: _group(t) == F.col("group")))
          .join(plan, "group").withColumn("chunk", dealt("test_id", "chunks")).withColumn("sub", upto("subs"))
          .select(*keys, "test_id", "qv", "test_folds", "r", "tiles"))
    tr = (tiled.withColumn("group", _group(F.col("tile"))).join(plan, "group")
          .withColumn("sub", dealt("train_id", "subs")).withColumn("chunk", upto("chunks"))
          .select(*keys, "tile", "train_id", "xv", "train_label", "train_folds"))
    # the hash puts several blocks into some parts, so there are more parts than blocks
    n = max(int(tiled.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * blocks)
    te, tr = te.repartition(n, *keys), tr.repartition(n, *keys)
    return te.groupBy(*keys).cogroup(tr.groupBy(*keys)).applyInArrow(_block_topk(k, plans), _BLOCK)


def _sides(test: DataFrame, train: DataFrame, id_col: str, feat: str, label: str, folds: list[str]):
    vec = F.col(feat).cast("array<double>")
    whole = vec.isNotNull() & F.forall(vec, lambda v: v.isNotNull() & (F.abs(v) < math.inf))  # NaN is above
    own = F.array(*[F.col(f).cast("int") for f in folds]) if folds else F.array().cast("array<int>")
    tr = train.where(whole).select(F.col(id_col).cast("long").alias("train_id"), vec.alias("xv"),
                                   F.col(label).cast("int").alias("train_label"), own.alias("train_folds"))
    te = test.where(whole).select(F.col(id_col).cast("long").alias("test_id"), vec.alias("qv"), own.alias("test_folds"))
    return te, tr


def knn_search(test: DataFrame, train: DataFrame, k: int, *, id_col: str = "id", feat: str = "features",
               label: str = "label", folds: list[str] | None = None, rows_per_tile: int = ROWS_PER_TILE,
               chunk_rows: int | None = None) -> Search:
    """The ``k`` nearest training rows of every test row (all, if fewer), and the pairs compared.

    Neighbours are ``(test_id, plan, train_id, train_label, dist, rank)``, ``rank`` 1..k
    by ``(dist, train_id)``.  Each column of ``folds`` is a fold plan of its own, numbered
    from 0: under it a training row is only a candidate for test rows of another fold.
    All plans share one search, whose radius is that of the plan with the farthest
    k-th row.  Ids are unique; rows without a vector, or with a null or NaN in it, take no part."""
    folds = folds or []
    te, tr = _sides(test, train, id_col, feat, label, folds)
    spark = te.sparkSession
    n_train, n_test = tr.count(), te.count()
    if not n_train or not n_test:
        none = "test_id long, plan int, train_id long, train_label int, dist double, rank int"
        return Search(spark.createDataFrame([], none), 0, n_train * n_test)
    dims = max(1, tr.agg(F.max(F.size("xv"))).first()[0])
    block_rows, at_most = max(1, BLOCK_VALUES // dims), max(1, CHUNK_VALUES // dims)
    # few test rows are cut finer, so that all cores have blocks
    chunk_rows = chunk_rows or max(64, min(at_most, math.ceil(n_test / (2 * spark.sparkContext.defaultParallelism))))
    copies = Window.partitionBy("xv", "train_folds").orderBy("train_id")
    tr = cut_lineage(tr.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k).drop("copy"))
    centres = _centres(tr, min(MAX_CENTRES, MAX_TILES, math.ceil(n_train / rows_per_tile)))
    tiled = _tiled(tr, centres, rows_per_tile)
    tiles = _Tiles(tiled, centres, block_rows)
    codes = spark.createDataFrame([(int(i), int(c)) for i, c in zip(tiles.ids, tiles.codes, strict=True)], "tile int, code int")
    tiled = cut_lineage(tiled.join(F.broadcast(codes), "tile").select(  # at most MAX_TILES rows
        F.col("code").alias("tile"), "train_id", "xv", "train_label", "train_folds"))
    state = te.withColumn("upto", F.lit(0)).withColumn("r", F.lit(math.inf))
    schema = T.StructType(state.schema.fields + [T.StructField("tiles", T.ArrayType(T.IntegerType())),
                                                 T.StructField("compared", T.LongType())])
    best, compared = None, 0
    for step in range(3):
        routed = keep(state.mapInPandas(_visits(tiles, step, 4 * k), schema))
        compared += routed.agg(F.sum("compared")).first()[0] or 0
        visits = {r["group"]: r["count"] for r in routed.select(
            F.explode(F.array_distinct(F.transform("tiles", _group))).alias("group")).groupBy("group").count().collect()}
        if visits:
            found = _candidates(routed, tiled, tiles, visits, k, len(folds), chunk_rows)
            found = found if best is None else best.unionByName(found)
            best = cut_lineage(found.groupBy("test_id", "plan").agg(
                F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found")))  # at most k a group
        if step < 2 and len(tiles.ids) > 1:
            radius = (best.where(F.size("found") >= k).groupBy("test_id")
                      .agg(F.count(F.lit(1)).alias("ready"), F.max(F.element_at("found", k)["dist"]).alias("d")))
            r = F.when(F.col("ready") == max(1, len(folds)), F.col("d")).otherwise(F.lit(math.inf))
            state = cut_lineage(routed.drop("r", "tiles", "compared").join(radius, "test_id", "left")
                                .select("test_id", "qv", "test_folds", "upto", r.alias("r")))
        routed.unpersist()
        if len(tiles.ids) == 1:
            break
    out = best.select("test_id", "plan", F.posexplode("found").alias("pos", "f"))
    return Search(out.select("test_id", "plan", "f.train_id", "f.train_label", "f.dist", (F.col("pos") + 1).alias("rank")),
                  compared, n_train * n_test)


def knn_neighbors(test: DataFrame, train: DataFrame, k: int, *, fold: str | None = None, **kw) -> DataFrame:
    """M1: ``knn_search`` with at most one fold plan, ``(test_id, train_id, train_label, dist, rank)``."""
    return knn_search(test, train, k, folds=[fold] if fold else None, **kw).neighbors.drop("plan")


def majority_vote(neigh: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent neighbour label per key; ties go to the lowest label."""
    votes = neigh.groupBy(*keys, "train_label").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy(*keys).agg(
        F.max_by("train_label", F.struct(F.col("votes"), -F.col("train_label"))).alias("y_pred"))


def knn_classify(test: DataFrame, train: DataFrame, k: int, **kw) -> DataFrame:
    """M2: ``(test_id, y_pred)``."""
    return majority_vote(knn_neighbors(test, train, k, **kw), ["test_id"])


def error_rate(pred: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
               keys: list[str] | None = None) -> DataFrame:
    """M3: percent of wrong predictions (per ``keys``)."""
    e = (F.avg((F.col(y_true) != F.col(y_pred)).cast("double")) * 100).alias("error_rate")
    return pred.groupBy(*(keys or [])).agg(e)


def knn_cross_validation(data: DataFrame, folds_col: str | list[str], ks: list[int], *, id_col: str = "id",
                         feat: str = "features", label: str = "label",
                         rows_per_tile: int = ROWS_PER_TILE) -> DataFrame:
    """M4/M5: neighbours up to ``max(ks)`` once for all fold plans, every K derived by
    rank.  Returns ``(k, mean_err, std_err)``, and with a list of fold columns ``plan``,
    the place in that list, before them; std is the population standard deviation of the
    per-fold error rates."""
    plans = [folds_col] if isinstance(folds_col, str) else folds_col
    neigh = knn_search(data, data, max(ks), id_col=id_col, feat=feat, label=label, folds=plans,
                       rows_per_tile=rows_per_tile).neighbors
    ks_arr = F.array(*[F.lit(x) for x in sorted(ks)])
    per_k = neigh.withColumn("k", F.explode(F.filter(ks_arr, lambda x: x >= F.col("rank"))))
    pred = majority_vote(per_k, ["plan", "k", "test_id"])
    truth = data.select(F.col(id_col).alias("test_id"), F.col(label).alias("y_true"),
                        F.posexplode(F.array(*plans)).alias("plan", "fold"))
    per_fold = error_rate(pred.join(truth, ["test_id", "plan"]), keys=["plan", "k", "fold"])
    out = per_fold.groupBy("plan", "k").agg(F.avg("error_rate").alias("mean_err"),
                                            F.stddev_pop("error_rate").alias("std_err"))
    return out.drop("plan") if isinstance(folds_col, str) else out


def grid_table(grid: DataFrame, folds: list[int]) -> DataFrame:
    """M5 presentation: one row per K, a (mean, std) column pair per fold count
    (a pivot over the small grid table)."""
    p = grid.groupBy("k").pivot("folds", folds).agg(F.first("mean_err").alias("mean"),
                                                   F.first("std_err").alias("std"))
    return p.select("k", *[F.col(f"{L}_{m}").alias(f"F{L}_{m}") for L in folds for m in ("mean", "std")])


def best_config(grid: DataFrame) -> DataFrame:
    """M6: the (folds, k) with the lowest mean error; ties to fewer folds, smaller k."""
    return grid.agg(F.min_by(F.struct("folds", "k", "mean_err"),
                             F.struct("mean_err", "folds", "k")).alias("b")).select("b.*")
