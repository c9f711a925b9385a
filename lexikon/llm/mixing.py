"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Every source has a target number of words.  The mixture consists of equal
blocks of ``BLOCK`` words, which go to the sources, and within a source to its
shards, by the highest quotients target / (2 k + 1).  The quota of a shard is
filled in a seeded order of its documents: whole passes, then the first blocks
of one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexikon.llm.common import WORD, written

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
BLOCK = 8
SEED = 17
#: Words and documents of one shard; a source has at most MAX_SHARDS of them, so a hot one is dealt over many tasks.
SHARD_WORDS, SHARD_DOCS, MAX_SHARDS = 1 << 18, 10_000, 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sources`` (source, source_size) with weight and target.

    Weights go round in code point order, null last.  All sizes are shared out by
    weight; a source stops at ``max_repeat`` times its size, and what is over goes
    to the others by weight: with sources in the order of cap by weight, the capped
    ones come first, and one level per weight holds for the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = F.lit(max_repeat) * F.col("source_size") / F.col("weight")
    by_ratio = Window.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (sources.withColumn("rank", F.row_number().over(by_name))
              .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                                 ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
              .withColumn("ratio", ratio))
    total = F.sum("source_size").over(everything)
    level = ((total - F.coalesce(F.sum(max_repeat * F.col("source_size")).over(before), F.lit(0))).cast("double")
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    capped = (ranked.withColumn("level", level).withColumn("capped", F.col("level") > F.col("ratio"))
              .withColumn("common", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)))
    return capped.select("source", "source_size", "weight", F.when(
        F.col("capped"), (max_repeat * F.col("source_size")).cast("double")).otherwise(
        F.col("common") * F.col("weight")).alias("target"))


def apportioned(votes: DataFrame, group: list[str], key: list[str], vote: str, seats: str) -> DataFrame:
    """Sainte-Lague within each ``group``: ``votes`` with the number of seats of each ``key`` as ``quota``.

    The highest quotients vote / (2 k + 1) win.  Rounded shares miss the number
    of seats by some d; only the d quotients on either side of a key's rounded
    share can then change hands, so no more than those are ranked.
    """
    own = Window.partitionBy(*group)
    share = F.try_divide(F.col(vote).cast("double") * F.col(seats), F.sum(vote).over(own))
    start = (votes.withColumn("_start", F.coalesce(F.round(share), F.lit(0)).cast("long"))
             .withColumn("_miss", F.abs(F.col(seats) - F.sum("_start").over(own)))
             .withColumn("_base", F.greatest(F.col("_start") - F.col("_miss"), F.lit(0)))
             .withColumn("_left", F.col(seats) - F.sum("_base").over(own)))
    quotients = (start.where((F.col("_left") > 0) & (F.col(vote) > 0))
                 .withColumn("_k", F.explode(F.sequence(F.col("_base"), F.col("_start") + F.col("_miss"))))
                 .withColumn("_q", F.col(vote) / (2 * F.col("_k") + 1)))
    won = (quotients.withColumn("_r", F.row_number().over(own.orderBy(F.desc("_q"), *key, "_k")))
           .where(F.col("_r") <= F.col("_left")).groupBy(*group, *key).agg(F.count(F.lit(1)).alias("_won")))
    same = None
    for c in dict.fromkeys([*group, *key]):
        one = F.col("v." + c).eqNullSafe(F.col("w." + c))
        same = one if same is None else same & one
    return (start.alias("v").join(won.alias("w"), same, "left")
            .select(*[F.col("v." + c) for c in votes.columns],
                    (F.col("v._base") + F.coalesce(F.col("w._won"), F.lit(0))).alias("quota")))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
                weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK, seed: int = SEED,
                shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: id, source, size, source_size, target (words of its source),
    passes (whole copies in the mixture), part (first words of one more copy) and
    taken (words in all: ``passes * size + part``).

    A null text has size 0 and is never taken; a null source is a source of its
    own, the last one; rows of equal id and size are interchangeable, so a
    repeated run agrees; an empty table gives no rows.
    """
    sizes = written(docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"),
                                n_words(F.col(text)).alias("size")), "sizes")
    by_source = written(targets(sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, max_repeat).join(
        sizes.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n_docs")),
        F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    seats = F.floor(F.sum("source_size").over(Window.partitionBy("all")) / block)
    sources = written(apportioned(
        by_source.withColumn("all", F.lit(0)).withColumn("seats", seats), ["all"], ["source"], "target", "seats")
        .withColumn("n_shards", F.least(F.lit(MAX_SHARDS), F.greatest(
            F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n_docs") / SHARD_DOCS))))
        .select("source", "source_size", "target", F.col("quota").alias("blocks"), "n_shards"), "sources")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(str(seed))))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    dealt = (sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
             .select("d.id", "d.source", "d.size", "s.source_size", "s.target", "s.blocks", "s.n_shards")
             .withColumn("key", key).withColumn("shard", F.pmod(place, F.col("n_shards"))))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    quotas = apportioned(shards, ["source"], ["shard"], "shard_size", "blocks").select(
        F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "shard_size",
        F.least(F.col("quota") * block, F.col("shard_size") * max_repeat).alias("words"))
    laid = dealt.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    line = Window.partitionBy("source", "shard").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    passes = F.coalesce(F.floor(F.try_divide("words", "shard_size")), F.lit(0)).cast("long")
    at = F.coalesce(F.sum("size").over(line), F.lit(0))
    over = F.col("words") - F.col("passes") * F.col("shard_size")
    return (laid.withColumn("passes", passes).withColumn("at", at)
            .withColumn("part", F.greatest(F.lit(0), F.least(over - F.col("at"), F.col("size"))).cast("long"))
            .select(F.col("id").alias(doc_id), F.col("source").alias(source), "size", "source_size", "target", "passes",
                    "part", (F.col("passes") * F.col("size") + F.col("part")).alias("taken")))
