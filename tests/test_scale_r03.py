"""Jobs whose cost once grew with solver steps, shards or copies of the input."""
from pyspark.ml.linalg import VectorUDT, Vectors
from pyspark.sql import functions as F


def test_svd_computes_its_features_once(spark):
    from lexikon.operators.models import truncated_svd
    calls = spark.sparkContext.accumulator(0)

    def vector(i):
        calls.add(1)
        return Vectors.sparse(120, {i % 120: 1.0 + i, (7 * i + 3) % 120: 2.0, (i * i) % 120: 0.5})

    df = spark.range(200).repartition(2).select(F.col("id").alias("k"), F.udf(vector, VectorUDT())("id").alias("v"))
    out = truncated_svd(df, "k", "v", 3).collect()
    assert sorted(r["k"] for r in out) == list(range(200))
    assert all(len(r["components"]) == 3 for r in out)
    assert calls.value == 200


def test_tasks_send_the_sum_of_their_shards(spark, monkeypatch):
    import numpy as np

    from lexikon.operators import linear as L
    monkeypatch.setattr(L, "SHARD_ROWS", 8)
    df = spark.createDataFrame([(i, [f"t{i % 5}", f"t{i % 3}", "the"], [i % 2], [i % 4]) for i in range(160)],
                               "id bigint, tokens array<string>, labels array<int>, folds array<int>")
    rows = L.term_rows(df, "id", "tokens", "labels", "folds", 64)
    assert rows.select("shard").distinct().count() == 20
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < 20

    def sizes(batches):  # every shard is seen whole and once
        found = [t for _, terms, *_ in L._rows(batches) for t in terms]
        term, n = np.unique(found, return_counts=True)
        return term, n[:, None].astype(np.float32)

    terms, sums, n = L._summed(rows, sizes, 1, 64)
    each = rows.select("shard", F.explode(F.array_distinct("terms")).alias("t"))
    want = {r["t"]: (r["n"], r["s"]) for r in each.groupBy("t").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("shard").alias("s")).collect()}
    assert {int(t): (int(v), int(k)) for t, v, k in zip(terms, sums[:, 0], n)} == want


def test_wordpiece_counts_are_kept_up_to_date(spark, monkeypatch):
    """Merges equal a plain trainer's, and all words are counted once, not at every step."""
    from collections import Counter

    from lexikon.operators import subword as W
    freq = {"hugs": 5, "hugging": 4, "pug": 9, "aaaa": 3, "pugs": 2, "bun": 6, "a": 7, "bunbun": 2}
    counted = []
    monkeypatch.setattr(W, "pair_counts", lambda words, plain=W.pair_counts: counted.append(1) or plain(words))
    vocab, merges = W.train_wordpiece(spark.createDataFrame(list(freq.items()), "word string, freq bigint"), 24)
    words = {w: [c if i == 0 else "##" + c for i, c in enumerate(w)] for w in freq}
    want = []
    room = 24 - 1 - len({s for x in words.values() for s in x})
    while len(want) < room:
        pairs, symbols = Counter(), Counter()
        for w, x in words.items():
            for s in x:
                symbols[s] += freq[w]
            for p in zip(x, x[1:]):
                pairs[p] += freq[w]
        found = [(-n / (symbols[a] * symbols[b]), a, b, n) for (a, b), n in pairs.items() if n >= 2]
        if not found:
            break
        _, a, b, n = min(found)
        want.append((a, b, n))
        for w, x in words.items():
            out = []
            for s in x:
                if out and (out[-1], s) == (a, b):
                    out[-1] = a + b.removeprefix("##")
                else:
                    out.append(s)
            words[w] = out
    assert len(want) > 4
    assert [(r["left"], r["right"], r["n"]) for r in merges.orderBy("rank").collect()] == want
    assert len(counted) == 1


def test_unigram_words_are_spread_over_the_cores(spark):
    from lexikon.operators import subword as W
    words = spark.range(9000).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(2).cast("long").alias("freq")).coalesce(1)
    assert W._spread_words(words).rdd.getNumPartitions() == min(9, spark.sparkContext.defaultParallelism)
    assert W._spread_words(words.limit(5)).rdd.getNumPartitions() == 1
