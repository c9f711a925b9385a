"""More properties: rank statistic, macro curve area, round trips, exact batching,
partition invariance."""

import random

from pyspark.sql import functions as F

from lexikon.operators import curves as C
from lexikon.operators import subword as W
from lexikon.operators import vocab as V
from tests.conftest import SF


def _scores(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = [(i, lab, rnd.randint(0, 1), round(rnd.random(), 2)) for i in range(n) for lab in ("a", "b", "c")]
    return spark.createDataFrame(rows, "id int, label string, y_true int, score double")


def test_auc_equals_rank_statistic(spark):
    df = _scores(spark)
    got = {r.label: r.roc_auc for r in C.auc_and_ap(df, ["label"]).collect()}
    for lab in ("a", "b", "c"):
        rows = [(r.y_true, r.score) for r in df.where(F.col("label") == lab).collect()]
        pos = [s for y, s in rows if y == 1]
        neg = [s for y, s in rows if y != 1]
        u = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
        assert abs(got[lab] - u / (len(pos) * len(neg))) < 1e-9


def test_macro_curve_matches_direct_interpolation(spark):
    df = _scores(spark)
    got = {round(r.fpr, 12): r.mean_tpr for r in C.macro_roc_curve(df, rows_per_bucket=50).collect()}
    roc = C.roc_curve(df, ["label"]).collect()
    curves = {}
    for r in roc:
        d = curves.setdefault(r.label, {0.0: 0.0})
        d[r.fpr] = max(d.get(r.fpr, 0.0), r.tpr)
    grid = sorted({x for d in curves.values() for x in d})

    def interp(d, x):
        xs = sorted(d)
        for x0, x1 in zip(xs, xs[1:]):
            if x0 <= x < x1:
                return d[x0] if x == x0 else d[x0] + (d[x1] - d[x0]) * (x - x0) / (x1 - x0)
        return d[xs[-1]]

    for x in grid:
        want = sum(interp(d, x) for d in curves.values()) / len(curves)
        assert abs(got[round(x, 12)] - want) < 1e-12


def test_encode_decode_round_trip(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet").select(
        "conv_id", "turn", F.split("text", " ").alias("tokens"))
    voc = V.fit_vocab(conv, "tokens", ["conv_id", "turn"], vocab_len=300)
    enc = V.encode(conv, ["conv_id", "turn"], "tokens", voc, 12)
    dec = V.decode(enc, ["conv_id", "turn"], "ids", voc)
    known = {r.token for r in voc.collect()} - {"<PAD>"}
    src = {(r.conv_id, r.turn): r.tokens for r in conv.collect()}
    for r in dec.collect():
        assert r.tokens == [t for t in src[(r.conv_id, r.turn)][:12] if t in known]


def test_batched_bpe_equals_single_merges(spark):
    docs = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = W.word_counts(docs, "text").persist()
    v1, m1 = W.train_bpe(words, 90)
    v2, m2 = W.train_bpe(words, 90, batch=False)
    assert [tuple(r) for r in m1.orderBy("rank").collect()] == [tuple(r) for r in m2.orderBy("rank").collect()]
    assert [tuple(r) for r in v1.orderBy("id").collect()] == [tuple(r) for r in v2.orderBy("id").collect()]


def test_partition_invariance(spark):
    import __spark_entry__ as E
    qs = E.queries()
    for name in ["report", "roc_auc", "stratified_kfold", "dedup_text"]:
        base = sorted(map(tuple, qs[name](spark, SF).collect()), key=repr)
        old = spark.conf.get("spark.sql.shuffle.partitions")
        try:
            spark.conf.set("spark.sql.shuffle.partitions", "1")
            one = sorted(map(tuple, qs[name](spark, SF).collect()), key=repr)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        assert base == one, name


def test_unigram_vocabulary_properties(spark):
    docs = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = W.word_counts(docs, "text")
    v = W.train_unigram(words, 120).collect()
    tokens = [r.token for r in v]
    chars = {c for r in words.collect() for c in r.word}
    assert len(tokens) == 120 and len(set(tokens)) == 120 and tokens[0] == "<unk>"
    assert chars <= set(tokens)
    assert all(r.score <= 0 for r in v[1:])


def test_unigram_seeds_are_all_repeated_substrings(spark):
    """A piece outside the most frequent short substrings gets in, and the Spark table gives what the driver does."""
    from lexikon.operators import subword as W
    rare = "qzjxkvwpqyzj"
    rows = [("".join(c), 50) for c in __import__("itertools").product("abcd", repeat=4)]
    words = spark.createDataFrame([*rows, (rare, 40)], "word string, freq long")
    driver = {(r.token, round(r.score, 9)) for r in W.train_unigram(words, 280).collect()}
    assert rare in {t for t, _ in driver}
    table = {(r.token, round(r.score, 9)) for r in W.train_unigram(words, 280, driver_pieces=0).collect()}
    assert table == driver
    pruned = [{r.token for r in W.train_unigram(words, 100, driver_pieces=n).collect()} for n in (0, 10_000)]
    assert pruned[0] == pruned[1] and len(pruned[0]) <= 100
