"""Hard negatives by threshold joins in the manner of L2AP.

Vectors are dealt out in blocks, anchors in blocks of their own, and every pair
of blocks is one group.  A block of vectors gets an inverted index by dimension
that leaves out the leading dimensions of each vector as long as their norm alone
could not reach the lowest threshold.  An anchor scans the lists from the last
dimensions on, adds up partial scores, and drops a vector as soon as partial score
plus the product of the remaining norms stays below the anchor's threshold; what is
left is completed from the dimensions that have no entries.  An anchor whose
window does not fill comes again with a lower threshold, down to the window's
own limit, so results are exact.  First the positives are found so, then, between
two shares of each positive's score, the negatives.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexikon.llm.common import bounded_batches, written

#: Vectors and anchors of one block.
ROWS, ANCHORS = 1 << 15, 1 << 13
#: Neighbouring dimensions that share one list, and anchors that scan the lists together.
SEGMENT, TOGETHER = 8, 64
#: Components of larger magnitude count as this, so that scores are exact in 64 bits.
MOST = 1 << 24
#: Thresholds of a positive as shares of the largest score possible, then everything.
LOWERED = (0.6, 0.4, 0.25, 0.1, -math.inf)
#: Thresholds of a window as shares of its width below its upper limit.
WIDENED = (0.05, 0.3, 1.0)
#: Doubles add these integers exactly up to here.
EXACT = 1 << 53


class SuffixIndex:
    """Inverted lists of whole-number vectors (rows x dimensions) for anchors of
    norm ``most`` at most and thresholds of ``lowest`` at least.

    Dimensions come in ascending order of their energy; a row's entries begin at
    the last segment before which its norm times ``most`` stays below ``lowest``.
    """

    def __init__(self, rows: np.ndarray, most: float, lowest: float):
        self.dims = np.argsort((rows.astype(float) ** 2).sum(axis=0), kind="stable")
        rows = rows[:, self.dims]
        self.cuts = [*range(0, rows.shape[1], SEGMENT), rows.shape[1]]
        norms = _norms(rows, self.cuts)
        begin = np.maximum((norms * most * (1 + 1e-9) < lowest).sum(axis=1) - 1, 0)
        self.order = np.argsort(begin, kind="stable")  # the list of a segment is then a prefix of the rows
        self.begin, self.norms, self.rows = begin[self.order], norms[self.order], rows[self.order]
        self.slack = 0.5 + 1e-9 * most * norms[:, -1].max(initial=0)

    def join(self, anchors: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, row, score) of the pairs that score ``least`` of the anchor or more, a few anchors at a time."""
        anchors = anchors[:, self.dims]
        norms = _norms(anchors, self.cuts)
        for lo in range(0, len(anchors), TOGETHER):
            part = slice(lo, lo + TOGETHER)
            who, rows, score = self._scan(anchors[part], norms[part], least[part, None] - self.slack)
            kept = score >= least[lo + who]
            yield who[kept] + lo, self.order[rows[kept]], score[kept]

    def _scan(self, q: np.ndarray, norms: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        alive = np.arange(len(self.rows))
        sums = np.zeros((len(q), len(alive)), q.dtype)
        for s in range(len(self.cuts) - 2, -1, -1):
            dims = slice(self.cuts[s], self.cuts[s + 1])
            n = int(np.searchsorted(self.begin[alive], s, side="right"))
            sums[:, :n] += q[:, dims] @ self.rows[alive[:n], dims].T
            rest = np.maximum(self.begin[alive], s)
            live = (sums + norms[:, rest] * self.norms[alive, rest] >= least).any(axis=0)
            if 5 * np.count_nonzero(live) < 4 * len(live):
                alive, sums = alive[live], sums[:, live]
        rest = self.begin[alive]
        who, which = np.nonzero(sums + norms[:, rest] * self.norms[alive, rest] >= least)
        score, rows = sums[who, which], alive[which]
        for s in range(len(self.cuts) - 1):  # the dimensions without entries
            some = np.flatnonzero(self.begin[rows] > s)
            if len(some):
                dims = slice(self.cuts[s], self.cuts[s + 1])
                score[some] += np.einsum("ij,ij->i", q[who[some], dims], self.rows[rows[some], dims])
        return who, rows, score


def _norms(rows: np.ndarray, cuts: list[int]) -> np.ndarray:
    """The norm of each row before each cut."""
    energy = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(rows.astype(float) ** 2, axis=1)], axis=1)
    return np.sqrt(energy[:, cuts])


def pairs(q: np.ndarray, v: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, row, score) of all pairs that reach the anchors' thresholds, from one index."""
    most = float(_norms(q, [q.shape[1]]).max(initial=0))
    parts = list(SuffixIndex(v, most, float(least.min(initial=math.inf))).join(q, least))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(p[i].astype(np.int64) for p in parts)]) for i in range(3))


class Block:
    """Ids, labels (as numbers common to both) and vectors of a block of anchors and one of rows."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        self.anchors, self.rows = _distinct(anchors), _distinct(rows)
        self.q_id, self.v_id = (t.column("id").to_numpy() for t in (self.anchors, self.rows))
        labels = self.anchors.column("label").to_pylist() + self.rows.column("label").to_pylist()
        number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        codes = np.array([number[x] for x in labels], int)
        self.q_label, self.v_label = codes[:len(self.q_id)], codes[len(self.q_id):]
        q, v = (t.column("vector").combine_chunks() for t in (self.anchors, self.rows))
        width = max(1, *(int(c.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for c in (q, v)))
        self.q, self.v = _matrix(q, width), _matrix(v, width)
        if int(np.abs(self.q).max(initial=0)) * int(np.abs(self.v).max(initial=0)) * width < EXACT:
            self.q, self.v = self.q.astype(float), self.v.astype(float)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, zeros behind the shorter ones."""
    out = np.zeros((len(column), width), np.int64)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)
    out[np.repeat(np.arange(len(column)), ends), at] = flat
    return out


def _distinct(table: pa.Table) -> pa.Table:
    """The rows of a block by id, each id once (of the smallest label, then of the smallest vector)."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    if (ids[order][1:] == ids[order][:-1]).any():
        own, first = table.select(["label", "vector"]).to_pylist(), {}
        for i in order.tolist():
            j = first.setdefault(ids[i], i)
            if (own[i]["label"], own[i]["vector"]) < (own[j]["label"], own[j]["vector"]):
                first[ids[i]] = i
        order = np.array(list(first.values()))
    return table.take(pa.array(order))


def _ranked(who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of the pairs by anchor, higher scores first, then smaller ids."""
    return np.lexsort((ids, -score, who))


def best_positives(block: Block, n: int) -> list[np.ndarray]:
    """(anchor id, row id, score) of the ``n`` best other rows of each anchor's label in this block."""
    out: list[list] = [[np.zeros(0, np.int64)] for _ in range(3)]
    for label in np.intersect1d(block.q_label, block.v_label):
        left, own = np.flatnonzero(block.q_label == label), np.flatnonzero(block.v_label == label)
        top = float(_norms(block.v[own], [block.v.shape[1]]).max())
        for share in LOWERED:
            norms = _norms(block.q[left], [block.q.shape[1]])[:, 0]
            last = share == LOWERED[-1]
            who, row, score = pairs(block.q[left], block.v[own],
                                    np.full(len(left), share) if last else norms * top * share)
            other = block.v_id[own[row]] != block.q_id[left[who]]
            who, row, score = who[other], row[other], score[other]
            full = np.bincount(who, minlength=len(left)) >= (0 if last else n)
            order = _ranked(who, score, block.v_id[own[row]])
            w = who[order]
            begin = np.searchsorted(w, w)
            pick = order[(np.arange(len(w)) - begin < n) & full[w]]
            for column, x in zip(out, (block.q_id[left[who[pick]]], block.v_id[own[row[pick]]], score[pick]), strict=True):
                column.append(x)
            left = left[~full]
            if not len(left):
                break
    return [np.concatenate(c) for c in out]


def best_negatives(block: Block, n: int, low: int, high: int) -> list[np.ndarray]:
    """(anchor id, positive id, row id, positive score, score) of the ``n`` best rows of other
    labels between ``low`` and ``high`` percent of the score of each of the anchors' positives, in this block."""
    windows = [(i, p["id"], p["score"], -(-low * p["score"] // 100), high * p["score"] // 100)
               for i, own in enumerate(block.anchors.column("positives").to_pylist()) for p in own]
    windows = [w for w in windows if w[3] <= w[4]]
    out: list[tuple] = []
    for share in WIDENED:
        if not windows:
            break
        least: dict[int, int] = {}
        for i, _, _, a, b in windows:
            least[i] = min(least.get(i, b), b - int((b - a) * share) if share < 1 else a)
        asked = np.array(sorted(least))
        limits = np.array([least[i] for i in asked.tolist()], float)
        who, row, score = pairs(block.q[asked], block.v, limits)
        other = block.q_label[asked[who]] != block.v_label[row]
        who, ids, score = who[other], block.v_id[row[other]], score[other]
        order = _ranked(who, score, ids)
        who, ids, score = who[order], ids[order], score[order]
        at = dict(zip(asked.tolist(), zip(np.searchsorted(who, np.arange(len(asked))).tolist(),
                                          np.searchsorted(who, np.arange(len(asked)), side="right").tolist(),
                                          strict=True), strict=True))
        again = []
        for w in windows:
            i, positive, positive_score, a, b = w
            lo, hi = at[i]
            first = lo + int(np.searchsorted(-score[lo:hi], -b))
            inside = range(first, min(first + n, lo + int(np.searchsorted(-score[lo:hi], -a, side="right"))))
            if len(inside) < n and share < 1:
                again.append(w)
            else:
                out += [(block.q_id[i], positive, ids[k], positive_score, score[k]) for k in inside]
        windows = again
    return [np.array([r[k] for r in out], np.int64) for k in range(5)]


def _joined(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], schema: str,
            best: Callable[[Block], list[np.ndarray]]) -> DataFrame:
    """What ``best`` finds in every pair of a block of rows and a block of anchors."""
    n, m = blocks
    names = [x.split()[0] for x in schema.split(", ")]

    def spread(df: DataFrame, own: str, of: int, other: str, times: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(of)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).repartition(n * m, "r", "a"))

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return pa.table([pa.array([], pa.int64())] * len(names), names=names)
        return pa.table([pa.array(c, pa.int64()) for c in best(Block(anchors, rows))], names=names)

    bounded_batches(rows.sparkSession)
    left, right = spread(anchors, "a", m, "r", n), spread(rows, "r", n, "a", m)
    return left.groupBy("r", "a").cogroup(right.groupBy("r", "a")).applyInArrow(run, schema)


def _best(found: DataFrame, group: list[str], n: int, score: str, row_id: str) -> DataFrame:
    """The ``n`` best of each group over all blocks, with their rank."""
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(row_id))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine_negatives(vectors: DataFrame, is_anchor: str, vec_id: str = "vec_id", vector: str = "embedding",
                   label: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: float = 256.0, block_rows: int = ROWS, block_anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components count as ``floor(scale * x)`` (at most 2^24 in magnitude) and scores are
    inner products, zeros behind the shorter vector; higher scores come first, equal
    ones by smaller id.  An anchor, a row whose id (``id``) fulfils ``is_anchor``, has
    as positives the first other rows of its label; for each of them the first rows of
    other labels that score between ``low`` and ``high`` percent of it are returned.

    Rows without id, label or vector, or with a null or non-finite component, take no
    part; rows of one id count once (smallest label, then vector); an anchor without
    a positive, or a positive without a negative, gives no row.  Each pair of blocks
    is one bounded group and sends at most its best of each window on, so neither a
    hot label nor a crowd of equal vectors makes a group grow.
    """
    spark = vectors.sparkSession
    sound = F.forall(F.col(f"`{vector}`"), lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                     & (F.abs(x.cast("double")) < F.lit(math.inf)))
    whole = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(
        F.least(F.greatest(x.cast("double") * scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("long"))
    rows = written(vectors.where(F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{label}`").isNotNull() & sound)
                   .select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"),
                           whole.alias("vector")), "vectors")
    anchors = rows.where(is_anchor)
    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, m = rows.count(), anchors.count()
    blocks = max(1, -(-n // block_rows), min(at_once, n // 2048)), max(1, -(-m // block_anchors))
    near = _joined(rows, anchors, blocks, "anchor_id bigint, positive_id bigint, score bigint",
                   lambda b: best_positives(b, positives))
    windows = (_best(near, ["anchor_id"], positives, "score", "positive_id").groupBy(F.col("anchor_id").alias("id"))
               .agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), "score")).alias("positives")))
    asked = written(anchors.join(windows, "id"), "windows")
    hard = _joined(rows, asked, blocks, "anchor_id bigint, positive_id bigint, negative_id bigint, "
                   "positive_score bigint, negative_score bigint", lambda b: best_negatives(b, negatives, low, high))
    return _best(hard, ["anchor_id", "positive_id"], negatives, "negative_score", "negative_id").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
