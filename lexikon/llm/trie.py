"""Prefix trie of conversations by a splitter skeleton.

Conversations become paths of turn keys, are range-partitioned by (path, id) and
written.  A node that two ranges share is a common prefix of the last path of
the one and the first path of the other, so the trie of these few paths, the
skeleton, is known from one row for each range, and is broadcast.  Every other
node lies in one range: a walk over its sorted paths finishes it, with the
stack of one path in memory.  For the nodes of the skeleton a range gives partial
aggregates, which are reduced by node and then summed along the skeleton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexikon.llm.common import bounded_batches, written

#: Characters of a turn's key, an MD5 in hex digits.
KEY = 32
#: Turns of a range on average.
TURNS = 1 << 20
#: Ids of one part of the list of a skeleton node's ends, and finished nodes of one batch.
IDS, NODES = 4096, 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()
RESULT = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
          "saved_tokens bigint, ends_sha256 string")
#: What the walk yields: finished nodes (kind 0; skeleton: the node it hangs from, if that is one of the skeleton),
#: partial aggregates (1) and lists of ends (2) of skeleton nodes.
FOUND = ("kind int, conv_id bigint, depth bigint, parent_conv_id bigint, skeleton bigint, n_convs bigint, "
         "n_children bigint, n_leaves bigint, saved_tokens bigint, ends string")
NODE, PARTIAL, ENDS = 0, 1, 2


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv, turns: array of (key, size)) of every conversation, its rows in the order of ``turn`` (null first).

    ``key`` is an MD5 of role and text, which are empty if null, ``size`` the code points of the text.
    Rows of one turn number are in the order of their keys; a repeated row is a turn more;
    rows without an id belong to no conversation.
    """
    who, what = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    key = F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, what))
    rows = turns.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv"),
        F.struct(F.col(f"`{turn}`").alias("turn"), key.alias("key"), F.length(what).cast("long").alias("size")).alias("t"))
    return rows.groupBy("conv").agg(F.transform(F.sort_array(F.collect_list("t")),
                                                lambda t: F.struct(t["key"], t["size"])).alias("turns"))


def with_openings(convs: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """``convs`` whose first ``shared`` (0 to ``most``) turns are those of conversation ``base``
    (all if it has fewer, none if there is no such conversation), the rest being their own."""
    rows = convs.select("conv", "turns", base.alias("base"), shared.cast("int").alias("shared"))
    openings = (convs.join(rows.select(F.col("base").alias("conv")).distinct(), "conv")
                .select(F.col("conv").alias("base"), F.slice("turns", 1, most).alias("opening")))
    none = F.array().cast(convs.schema["turns"].dataType)
    first = F.when(F.col("shared") > 0, F.slice(F.coalesce("opening", none), F.lit(1), F.col("shared"))).otherwise(none)
    own = F.when(F.size("turns") > F.col("shared"),
                 F.slice("turns", F.col("shared") + 1, F.size("turns"))).otherwise(none)
    return rows.join(openings, "base", "left").select("conv", F.concat(first, own).alias("turns"))


class Skeleton:
    """The nodes that several ranges share: parent, size of the last text, and number by (parent, key); the root is 0."""

    def __init__(self):
        self.parent, self.size, self.depth, self.number = [-1], [0], [0], {}

    def add(self, a: str, b: str, sizes: list[int]) -> None:
        """Adds the common prefixes of the paths ``a`` and ``b``; ``sizes`` are those of ``b``."""
        at, d = 0, 0
        while d < len(sizes) and a[KEY * d:KEY * (d + 1)] == b[KEY * d:KEY * (d + 1)]:
            child = self.number.setdefault((at, b[KEY * d:KEY * (d + 1)]), len(self.parent))
            if child == len(self.parent):
                self.parent.append(at)
                self.size.append(sizes[d])
                self.depth.append(d + 1)
            at, d = child, d + 1


def skeleton_of(ranged: DataFrame) -> Skeleton:
    """From the first and the last path of each range: two rows of each come to the driver."""
    ends = ranged.groupBy("range").agg(F.min(F.struct("path", "conv", "sizes")).alias("first"),
                                       F.max(F.struct("path", "conv")).alias("last")).orderBy("range").collect()
    out = Skeleton()
    for a, b in zip(ends, ends[1:], strict=False):
        out.add(a["last"]["path"], b["first"]["path"], b["first"]["sizes"])
    return out


class _Open:
    """A node whose subtree is being walked over."""
    __slots__ = ("number", "size", "least", "n", "children", "leaves", "saved", "sha", "ids", "below")

    def __init__(self, number: int, size: int):
        self.number, self.size, self.least = number, size, None
        self.n = self.children = self.leaves = self.saved = 0
        self.sha, self.ids, self.below = None, [], []

    def end(self, conv: int) -> None:
        """A conversation ends here; those of a node come in ascending order."""
        self.n += 1
        self.least = conv if self.least is None else min(self.least, conv)
        if self.number >= 0:
            self.ids.append(conv)
        elif self.sha is None:
            self.sha = hashlib.sha256(b"%d" % conv)
        else:
            self.sha.update(b",%d" % conv)


class _Walk:
    """Nodes of sorted (path, conv) rows; ``rows`` holds finished ones by column of FOUND."""

    def __init__(self, number: dict[tuple[int, str], int]):
        self.number = number
        self.begin()
        self.take()

    def begin(self) -> None:
        self.path, self.open = "", [_Open(0, 0)]

    def take(self) -> list[list]:
        """What is finished so far; nothing is kept of it."""
        out, self.rows = getattr(self, "rows", None), [[] for _ in range(10)]
        return out

    def _put(self, *row) -> None:
        for column, value in zip(self.rows, row, strict=True):
            column.append(value)

    def _ids(self, node: _Open) -> None:
        if node.ids:
            self._put(ENDS, node.ids[0], None, None, node.number, None, None, None, None, ",".join(map(str, node.ids)))
            node.ids = []

    def add(self, conv: int, path: str, sizes: list[int]) -> None:
        same, last = 0, min(len(self.open) - 1, len(sizes))
        while same < last and path.startswith(self.path[KEY * same:KEY * (same + 1)], KEY * same):
            same += 1
        self.close(same)
        self.path = path
        for d in range(same, len(sizes)):
            at = self.open[-1].number
            number = self.number.get((at, path[KEY * d:KEY * (d + 1)]), -1) if at >= 0 else -1
            self.open.append(_Open(number, sizes[d]))
        top = self.open[-1]
        top.end(conv)
        if len(top.ids) == IDS:
            self._ids(top)

    def close(self, depth: int) -> None:
        """Finishes all open nodes below ``depth``."""
        while len(self.open) > depth + 1:
            node, above = self.open.pop(), self.open[-1]
            if node.number >= 0:
                self._partial(node)
                continue
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.size
            at = len(self.rows[0])
            self._put(NODE, node.least, len(self.open), None, above.number if above.number >= 0 else None, node.n,
                      node.children, node.leaves, node.saved, node.sha.hexdigest() if node.sha else NO_ENDS)
            for i in node.below:
                self.rows[3][i] = node.least
            if above.number < 0:
                above.below.append(at)
            above.n += node.n
            above.least = node.least if above.least is None else min(above.least, node.least)
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved

    def _partial(self, node: _Open) -> None:
        self._ids(node)
        self._put(PARTIAL, node.least, None, None, node.number, node.n, node.children, node.leaves, node.saved, None)

    def finish(self) -> None:
        """Ends a range."""
        self.close(0)
        self._partial(self.open[0])
        self.begin()

    def settled(self) -> bool:
        """No finished node waits for the smallest id of its parent."""
        return not any(node.below for node in self.open)


def walked(ranged: DataFrame, skeleton: Skeleton, ranges: int) -> DataFrame:
    """FOUND rows of every range, each walked over by one task in sorted order."""
    spark = ranged.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(skeleton.number)
    types = [pa.int32(), *[pa.int64()] * 8, pa.string()]
    names = [f.name for f in T._parse_datatype_string(FOUND).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, now = _Walk(sent.value), None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(walk.take(), types, strict=True)], names)

        for b in batches:
            for number, path, conv, sizes in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if number != now:
                    if now is not None:
                        walk.finish()
                    now = number
                walk.add(conv, path, sizes)
                if len(walk.rows[0]) >= NODES and walk.settled():
                    yield out()
        if now is not None:
            walk.finish()
            yield out()

    order = ranged.select("range", "path", "conv", "sizes").repartition(ranges, "range")
    return order.sortWithinPartitions("range", "path", "conv").mapInArrow(run, FOUND)


def _hashed(lists: DataFrame) -> DataFrame:
    """(skeleton, sha) of the lists of ends of each skeleton node, one after the other in ascending order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, str]] = []
        now, sha = None, None
        for b in batches:
            for node, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node != now:
                    if sha:
                        done.append((now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if sha:
            done.append((now, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()),
                                          pa.array([x[1] for x in done], pa.string())], ["skeleton", "sha"])

    return (lists.repartition("skeleton").sortWithinPartitions("skeleton", "conv_id").select("skeleton", "ends")
            .mapInArrow(run, "skeleton bigint, sha string"))


def _skeleton_rows(skeleton: Skeleton, found: DataFrame) -> list[tuple]:
    """RESULT rows of the skeleton's nodes, from partial aggregates reduced by node; summed from the leaves up."""
    sums = found.where(F.col("kind") == PARTIAL).groupBy("skeleton").agg(
        F.min("conv_id").alias("least"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    sha = dict(map(tuple, _hashed(found.where(F.col("kind") == ENDS)).collect()))  # skeleton rows only, as the next
    size = len(skeleton.parent)
    least, n, children, leaves, saved = [None] * size, [0] * size, [0] * size, [0] * size, [0] * size
    for r in sums.collect():
        i = r["skeleton"]
        least[i], n[i], children[i], leaves[i], saved[i] = (r[c] for c in (
            "least", "n_convs", "n_children", "n_leaves", "saved_tokens"))
    for i in range(size - 1, -1, -1):  # a child has a larger number than its parent
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * skeleton.size[i]
        if i:
            p = skeleton.parent[i]
            n[p] += n[i]
            least[p] = least[i] if least[p] is None else min(least[p], least[i])
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    return [(least[i], skeleton.depth[i], least[skeleton.parent[i]] if i else None, n[i], children[i], leaves[i], saved[i],
             sha.get(i, NO_ENDS)) for i in range(size)]


def prefix_trie(convs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Every node of the trie of ``convs`` (conv, turns: array of (key, size)); see ``conversations``.

    A node is a distinct sequence of the first ``depth`` turns, the root having
    none; its members are the conversations that begin with it, also those
    without a turn.  Columns of RESULT: smallest member, depth, the smallest
    member of the parent (null for the root), number of members, children and
    childless nodes of the subtree (itself included), the sum over the subtree of
    (members - 1) * size of the last turn, and the SHA-256 of the decimal ids,
    ascending and comma-joined, of the members that end here.  A conversation
    given twice counts twice; a table without conversations has no node.

    A conversation's path (40 bytes a turn) is one row; everything else is cut
    into ``ranges``, by default one for each 2^20 turns, but at least the session's
    number of shuffle partitions.  Ids break ties of paths, so a conversation
    that a third of all rows share is spread over many ranges.
    """
    spark = convs.sparkSession
    paths = written(convs.select("conv", F.array_join(F.transform("turns", lambda t: t["key"]), "").alias("path"),
                                 F.transform("turns", lambda t: t["size"]).alias("sizes")), "paths")
    turns = paths.agg(F.sum(F.size("sizes"))).first()[0]
    if turns is None:
        return spark.createDataFrame([], RESULT)
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // TURNS))
    ranged = written(paths.repartitionByRange(ranges, "path", "conv").withColumn("range", F.spark_partition_id()), "ranges")
    skeleton = skeleton_of(ranged)
    found = written(walked(ranged, skeleton, ranges), "found")
    top = _skeleton_rows(skeleton, found)
    hung = F.broadcast(spark.createDataFrame([(i, r[0]) for i, r in enumerate(top)], "skeleton bigint, above bigint"))
    nodes = found.where(F.col("kind") == NODE).join(hung, "skeleton", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
    return nodes.unionByName(spark.createDataFrame(top, RESULT))
