"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

Signature: every shingle ranks all slots by a permutation of its own (a lazy
Fisher-Yates shuffle driven by its hash) and offers slot s the value
(rank of s, random bits); a slot keeps its smallest offer.  Because a value of a
later rank never beats one of an earlier rank, the shuffles stop as soon as all
slots of a document are filled: two or three steps for most texts.

Documents with equal sets form a class, of which only the smallest id goes on.
Bands of the signature deal the classes into buckets.  For the members of shared
buckets it is counted how many shingles of each no other one holds; that bounds
its similarity to anything, and leaves out most texts that only share a passage.
No bucket is expanded into pairs: its members are first compared with its hub,
the member with the fewest shingles of its own (in a group of edited copies, the
least edited one); links are confirmed on the full sets and joined into
components; then only pairs of one bucket that lie in different components are
looked at, and of those the ones that share a rare shingle (found through it) or
can be linked by their frequent shingles alone.  What sketches allow of them is
confirmed as well.  So no link between different texts is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexikon.llm.common import Words, as_bytes, by_size, map_rows, mix, windows, written

WIDTH = 5
#: Links: 100 * intersection >= LINK * union.
LINK = 75
SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
#: Two bits of each slot make the sketch.  At a similarity of 0.75 the number of equal ones has
#: mean 104 and sd 4.4, so fewer than one pair in ten million falls below this; at 0.25 the mean is 56.
AGREE = 81
#: A shingle that no more of the documents in question hold is rare.
RARE = 10
SKETCH = ["s0", "s1", "s2", "s3"]
PART_BYTES = 1_200_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(texts, lower=True)
    h = words.hashes()
    grams = windows(h, width)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a:b - width + 1]))
        elif b > a:
            out.append(mix(windows(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def superminhash(h: np.ndarray, doc: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n_docs x slots) of the shingle hashes ``h`` with their document
    numbers; a value is the rank in its top byte and random bits below."""
    sig = np.full(n_docs * slots, EMPTY, np.uint64)
    order: np.ndarray | None = None
    for j in range(slots):
        r = mix(h + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        k = (np.uint64(j) + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32))).astype(np.int64)
        at = np.arange(len(h))
        if j == 0:
            slot = k
        else:
            slot = order[at, k].astype(np.int64)
            order[at, k] = order[at, j]
        np.minimum.at(sig, doc * slots + slot, (np.uint64(j) << np.uint64(56)) | (r >> np.uint64(8)))
        open_docs = (sig.reshape(n_docs, slots) == EMPTY).any(axis=1)
        live = open_docs[doc]
        if not live.any():
            break
        if j == 0:
            order = np.tile(np.arange(slots, dtype=np.uint8), (int(live.sum()), 1))
            order[np.arange(len(order)), k[live]] = 0
        elif not live.all():
            order = order[live]
        h, doc = h[live], doc[live]
    return sig.reshape(n_docs, slots)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, n, d1, d2, s0 to s3, bands): set size, 128-bit digest of the set, two bits of
    each slot, and the band hashes (null for an empty set)."""
    def make():
        def part(ids: list, sets: list[np.ndarray]) -> dict:
            sizes = np.array([len(s) for s in sets])
            doc = np.repeat(np.arange(len(sets)), sizes)
            h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            sig = superminhash(h, doc, len(sets))
            bands = np.zeros((len(sets), BANDS), np.uint64)
            for i in range(ROWS):
                bands = mix(bands + sig[:, i::ROWS] + _STEP)
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * _STEP)
            bits = (mix(sig.ravel()) >> np.uint64(62)).reshape(len(sets), len(SKETCH), -1)
            sketch = _signed((bits << (2 * np.arange(bits.shape[2], dtype=np.uint64))).sum(axis=2, dtype=np.uint64))
            return {"id": ids, "n": sizes.tolist(),
                    "d1": [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets],
                    "d2": [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets],
                    **{c: sketch[:, i].tolist() for i, c in enumerate(SKETCH)},
                    "bands": [b if n else None for b, n in zip(_signed(bands), sizes, strict=True)]}

        def fn(batch):
            ids, raw = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for a, b in by_size(raw, PART_BYTES):
                yield part(ids[a:b], shingle_sets(raw[a:b]))
        return fn

    return map_rows(docs.select(F.col(doc_id).cast("long"), text),
                    "id bigint, n bigint, d1 bigint, d2 bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, "
                    "bands array<bigint>", make)


def possible(x: str, y: str, most: str = "common") -> Column:
    """Whether documents ``x`` and ``y`` (suffixes of columns) can be linked: what they have in
    common is at most the smaller number of shingles that others hold (``most``), and
    their sketches have to agree."""
    low = F.lit(0x5555555555555555)
    differ = F.lit(0)
    for s in SKETCH:
        d = F.col(s + x).bitwiseXOR(F.col(s + y))
        differ = differ + F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(low))
    bound = (100 + LINK) * F.least(most + x, most + y) >= LINK * (F.col("n" + x) + F.col("n" + y))
    return bound & (differ <= SLOTS - AGREE)


def shingles_of(texts: DataFrame) -> DataFrame:
    """(id, gram) of (id, text)."""
    def make():
        def fn(batch):
            ids, raw = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for a, b in by_size(raw, PART_BYTES):
                yield {"id": ids[a:b], "grams": [_signed(x) for x in shingle_sets(raw[a:b])]}
        return fn

    return map_rows(texts, "id bigint, grams array<bigint>", make).select("id", F.explode("grams").alias("gram"))


def rare_pairs(grams: DataFrame, nodes: DataFrame, rare: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of ``nodes`` with different labels that share a shingle at most ``rare``
    of them hold, and (id, n_rare): how many of its shingles are that rare.

    A shingle gives less than ``rare ** 2`` pairs, so their number is linear in the shingles.
    """
    times = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") <= rare)
    scarce = written(grams.join(times, "gram"), "rare")
    shared = scarce.where("times > 1").select("gram", "id").join(nodes, "id")
    x, y = (shared.toDF(*["gram" if c == "gram" else c + s for c in shared.columns]) for s in ("x", "y"))
    pairs = x.join(y, (x["gram"] == y["gram"]) & (F.col("idx") > F.col("idy")) & (F.col("labelx") != F.col("labely"))
                   & possible("x", "y")).select(F.col("idx").alias("a"), F.col("idy").alias("b")).distinct()
    return pairs, scarce.groupBy("id").agg(F.count(F.lit(1)).alias("n_rare"))


def confirmed(pairs: DataFrame, texts: DataFrame, link: int = LINK) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    def make():
        def fn(batch):
            out = {"a": [], "b": []}
            raw = [as_bytes(batch.column(2)), as_bytes(batch.column(3))]
            last: tuple = (None, None)
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if last[0] != b:  # rows come ordered by b out of a sort-merge join
                    last = (b, shingle_sets([raw[1][i]])[0])
                x, y = shingle_sets([raw[0][i]])[0], last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= link * (len(x) + len(y) - both):
                    out["a"].append(a)
                    out["b"].append(b)
            yield out
        return fn

    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))
    return map_rows(both, "a bigint, b bigint", make)


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable, for every id in ``edges`` (a, b).

    Union by smallest label with pointer jumping; each round is written to the
    shared folder, and only a count of changes comes to the driver.
    """
    both = written(edges.union(edges.select("b", "a")).toDF("src", "dst").distinct(), "edges")
    labels = written(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("label"))
                     .withColumn("label", F.least("id", "label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("id").alias("dst"), "label"), "dst")
                .groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near")))
        hooked = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        moved = written(hooked.join(jump, "next").select("id", F.least("next", "far").alias("label"),
                                                         (F.least("next", "far") != F.col("label")).alias("moved")),
                        "labels")
        labels = moved.select("id", "label")
        if moved.where("moved").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n (distinct shingles) and component (the smallest
    id reachable over links, itself included).

    A null or empty text has no shingles and is its own component.  A null id
    gets a null component and is linked with nothing.  Ids should be unique:
    rows that share one are one document, linked through the text of either.
    """
    sigs = written(signatures(docs, doc_id, text), "signatures")
    full = sigs.where("n > 0 AND id IS NOT NULL")
    classes = written(full.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("id"), "n", "d1", "d2"), ["id", "n", "d1", "d2"], "left_semi")
    members = reps.select("id", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    shared = written(members.join(buckets.select("key"), "key", "left_semi"), "shared")
    near = shared.select("id").distinct()
    texts = written(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
                    .join(near, "id", "left_semi"), "texts")
    alone = (shingles_of(texts).groupBy("gram").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("id"))
             .where("times = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone")))
    info = written(reps.join(near, "id", "left_semi").join(alone, "id", "left").select(
        "id", "n", *SKETCH, "bands", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))
        .where(100 * F.col("common") >= LINK * F.col("n")), "info")

    def side(x: str) -> DataFrame:
        return info.toDF(*[c + x for c in info.columns])

    here = written(shared.join(info.select("id", (F.col("n") - F.col("common")).alias("alone")), "id"), "members")
    hubs = here.groupBy("key").agg(F.min(F.struct("alone", "id"))["id"].alias("hub"))
    stars = here.join(hubs, "key").where("id <> hub").select("id", "hub").distinct()
    tested = written(stars.join(side("x"), F.col("id") == F.col("idx"))
                     .join(side("y"), (F.col("hub") == F.col("idy")) & possible("x", "y"))
                     .select(F.col("id").alias("a"), F.col("hub").alias("b")), "pairs")
    links = written(confirmed(tested, texts), "links")
    labels = components(links)
    # the rest: pairs of one bucket that are in different components so far
    now = here.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    split = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    open_members = written(now.join(split, "key", "left_semi").join(info, "id"), "open")
    nodes = open_members.drop("key", "bands").distinct()
    linked_rare, n_rare = rare_pairs(shingles_of(texts.join(nodes.select("id"), "id", "left_semi")), nodes, RARE)
    frequent = open_members.join(n_rare, "id", "left").withColumn(
        "frequent", F.col("n") - F.coalesce("n_rare", F.lit(0))).where(100 * F.col("frequent") >= LINK * F.col("n"))
    x, y = (frequent.toDF(*["key" if c == "key" else c + s for c in frequent.columns]) for s in ("x", "y"))
    first_shared = F.array_min(F.array_intersect("bandsx", "bandsy"))  # each pair comes out of one bucket only
    rest = (x.join(y, (x["key"] == y["key"]) & (F.col("idx") > F.col("idy")) & (F.col("labelx") != F.col("labely"))
                   & possible("x", "y", "frequent") & (x["key"] == first_shared)).select(F.col("idx").alias("a"), F.col("idy").alias("b"))
            .union(linked_rare).distinct())
    both_ways = tested.union(tested.select("b", "a"))
    more = written(rest.join(both_ways, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        found = written(confirmed(more, texts), "links")
        # components of the components: links between their labels
        label_of = labels.select(F.col("id").alias("k"), "label")
        over = (found.join(label_of.select(F.col("k").alias("a"), F.col("label").alias("la")), "a", "left")
                .join(label_of.select(F.col("k").alias("b"), F.col("label").alias("lb")), "b", "left")
                .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
        upper = components(over).select(F.col("id").alias("label"), F.col("label").alias("top"))
        every = labels.select("id", "label").union(upper.select("label", "label")).distinct()
        labels = every.join(upper, "label", "left").select("id", F.coalesce("top", "label").alias("label")) \
            .groupBy("id").agg(F.min("label").alias("label"))
    of_class = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "n", "d1", "d2", F.coalesce("label", "rep").alias("component"))
    return sigs.select("id", "n", "d1", "d2").join(of_class, ["n", "d1", "d2"], "left").select(
        "id", "n", F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component")))
        .otherwise(F.col("id")).alias("component"))
