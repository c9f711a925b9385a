"""Vocabularies and sequence encoding.

Sequences are ``array<string>`` columns.  The vocabulary is a table
``(idx int, token string, freq bigint)``; encoding joins exploded tokens with
it (broadcast only when its row count is under a checked bound), then
regroups per sequence -- a group bounded by the sequence length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexikon.operators.index import with_row_index

DEFAULT_SPECIALS = ("<PAD>", "<UNK>")


def fit_vocab(df: DataFrame, tokens: str, order: list[str], vocab_len: int | None = None,
              specials: tuple[str, ...] = DEFAULT_SPECIALS) -> DataFrame:
    """V1: count tokens, most frequent first, ties by first appearance
    (row ``order``, then position); ids start after the special tokens."""
    ex = df.select(*order, F.posexplode(tokens).alias("pos", "token"))
    first = F.struct(*[F.col(c) for c in order], F.col("pos"))
    counts = ex.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.min(first).alias("first_seen"))
    if vocab_len is not None:
        # a top-k: Spark keeps a bounded heap per partition (TakeOrderedAndProject)
        counts = counts.orderBy(F.desc("freq"), "first_seen").limit(vocab_len)
    ranked = with_row_index(counts, [F.desc("freq"), F.col("first_seen")], "_r")
    words = ranked.select((F.col("_r") + len(specials)).cast("int").alias("idx"), "token",
                          F.col("freq").cast("bigint").alias("freq"))
    spark = df.sparkSession
    sp = spark.createDataFrame([(i, t, 0) for i, t in enumerate(specials)], "idx int, token string, freq bigint")
    return sp.unionByName(words)


def encode(df: DataFrame, keys: list[str], tokens: str, vocab: DataFrame, max_len: int,
           out: str = "ids", pad_id: int = 0, unknown_id: int = 0) -> DataFrame:
    """V2: token -> id (unknown -> ``unknown_id``, 0 as in the reference), cut
    to ``max_len``, padded with ``pad_id``.  Only the first ``max_len``
    positions are exploded and joined."""
    ex = df.select(*keys, F.posexplode(tokens).alias("pos", "token")).where(F.col("pos") < max_len)
    v = vocab.select("token", "idx")
    j = ex.join(v, "token", "left").withColumn("idx", F.coalesce("idx", F.lit(unknown_id)))
    g = j.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "idx"))).alias("_p"))
    ids = F.transform("_p", lambda s: s["idx"])
    padded = F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(max_len) - F.size(ids)))
    base = df.select(*keys).join(g, keys, "left")
    empty = F.array_repeat(F.lit(pad_id), max_len)
    return base.select(*keys, F.coalesce(padded, empty).alias(out))


def attention_mask(tokens: Column, max_len: int) -> Column:
    """V6: 1 for real positions (up to ``max_len``), 0 for padding."""
    n = F.least(F.size(tokens), F.lit(max_len))
    return F.transform(F.sequence(F.lit(1), F.lit(max_len)), lambda i: (i <= n).cast("int"))


def decode(df: DataFrame, keys: list[str], ids: str, vocab: DataFrame, out: str = "tokens",
           drop_token: str = DEFAULT_SPECIALS[0]) -> DataFrame:
    """V3: id -> token, dropping the padding token; an id outside the
    vocabulary becomes ``'0'`` (the reference's lookup default)."""
    ex = df.select(*keys, F.posexplode(ids).alias("pos", "idx"))
    v = vocab.select("idx", "token")
    # padding is most of all positions and goes before any shuffle, so that its id is no hot key
    padding = v.where(F.col("idx").isNotNull()).groupBy("idx").agg(F.bool_and(F.col("token").eqNullSafe(F.lit(drop_token))).alias("_drop"))
    ex = ex.join(F.broadcast(padding.where("_drop").select("idx")), "idx", "left_anti")  # one row a special token
    j = (ex.join(v, "idx", "left").withColumn("token", F.coalesce("token", F.lit("0")))
         .where(F.col("token") != drop_token))
    g = j.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_p"))
    base = df.select(*keys).join(g, keys, "left")
    return base.select(*keys, F.coalesce(F.transform("_p", lambda s: s["token"]),
                                         F.array().cast("array<string>")).alias(out))


def one_hot(ids: Column, num_classes: int) -> Column:
    """V4: every id to a 0/1 vector of ``num_classes``."""
    return F.transform(ids, lambda x: F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)),
                                                  lambda i: (i == x).cast("int")))


def argmax(v: Column) -> Column:
    """V5: index of the largest value, ties to the lowest index."""
    return F.array_position(v, F.array_max(v)).cast("int") - 1


def argmax_decode(vectors: Column) -> Column:
    return F.transform(vectors, argmax)


def frequency_band(df: DataFrame, text: str, lo: int = 20, hi: int = 500) -> DataFrame:
    """V7: space-split words with ``lo <= count <= hi``."""
    w = df.select(F.explode(F.split(F.col(text), " ", -1)).alias("word"))
    c = w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return c.where(F.col("n").between(lo, hi))


def vocab_extent(df: DataFrame, ids: str, labels: str | None = None) -> DataFrame:
    """V8: distinct ids, largest id and (optionally) distinct labels."""
    if not labels:
        e = df.select(F.explode(ids).alias("i"))
        return e.agg(F.count_distinct("i").alias("distinct_ids"), F.max("i").alias("max_id"))
    # ids and labels are parallel arrays: one explode, one aggregate
    e = df.select(F.explode(F.arrays_zip(F.col(ids).alias("i"), F.col(labels).alias("l"))).alias("z"))
    return e.agg(F.count_distinct("z.i").alias("distinct_ids"), F.max("z.i").alias("max_id"),
                 F.count_distinct("z.l").alias("n_labels"))


def label_index(df: DataFrame, label: str, order: str) -> DataFrame:
    """V9: label -> id in order of first appearance (the label table is small:
    one row per distinct label)."""
    firsts = df.groupBy(label).agg(F.min(order).alias("_first"))
    idx = with_row_index(firsts, [F.col("_first"), F.col(label)], "label_id")
    return idx.select(label, F.col("label_id").cast("int").alias("label_id"))


def multihot_to_names(v: Column, names: list[str]) -> Column:
    """Names at the positions holding 1."""
    zipped = F.zip_with(F.array(*[F.lit(n) for n in names]), v, lambda n, x: F.when(x == 1, n))
    return F.filter(zipped, lambda n: n.isNotNull())


def fit_binarizer(df: DataFrame, names: str) -> list[str]:
    """V11 fit: sorted distinct names (binary/code-point order).  The class list
    is bounded by the label vocabulary and is returned to the caller."""
    rows = df.select(F.explode(names).alias("n")).distinct().orderBy("n").collect()
    return [r[0] for r in rows]


def binarize(names: Column, classes: list[str]) -> Column:
    """V11 transform: 0/1 vector in class order; inverse is ``multihot_to_names``."""
    return F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: F.array_contains(names, c).cast("int"))


def remap_ids(v: Column, id_map: list[int], keep_other: bool = False) -> Column:
    """Position i holding 1 becomes ``id_map[i]``; other values become -1
    (or are kept with ``keep_other``)."""
    m = F.array(*[F.lit(x) for x in id_map])
    return F.transform(v, lambda x, i: F.when(x == 1, F.element_at(m, i + 1))
                       .otherwise(x if keep_other else F.lit(-1)))


def sentence_ids(df: DataFrame, order: list[str], name: str = "sentence") -> DataFrame:
    """V13: "sentence 1", "sentence 2", ... over all rows in ``order``."""
    idx = with_row_index(df, order, "_i")
    return idx.withColumn(name, F.concat(F.lit("sentence "), (F.col("_i") + 1).cast("string"))).drop("_i")


def pair_to_columns(pair: Column, names: tuple[str, str] = ("organ", "disease")) -> list[Column]:
    """A two-element label array to two columns."""
    return [F.element_at(pair, 1).alias(names[0]), F.element_at(pair, 2).alias(names[1])]
