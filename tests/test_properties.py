"""Properties: partition invariance, multi-range index paths, exact tiled KNN."""

import math

from pyspark.sql import functions as F

from lexikon.operators import datasets as P
from lexikon.operators.index import arithmetic_order, running_sums, with_row_index
from lexikon.operators.neighbors import knn_neighbors
from tests.conftest import SF


def _windowed(df, order, parts, spark):
    df.createOrReplaceTempView("rows_in")
    over = f"PARTITION BY {', '.join(parts)} " if parts else ""
    return spark.sql(f"SELECT id, row_number() OVER ({over}ORDER BY {order}) - 1 AS i FROM rows_in")


def _same_index(spark, df, order, sql_order, parts=None, ranges=37):
    got = with_row_index(df, order, "i", ranges=ranges, partition_by=parts).select("id", "i")
    want = _windowed(df, sql_order, parts, spark)
    assert got.count() == df.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_row_index_equals_row_number_at_many_ranges(spark):
    """300,000 rows; ids past 2 ** 32; null and string keys, null groups, ties on the first key."""
    n = 300_000
    df = spark.range(4_000_000_000, 4_000_000_000 + n).select(
        "id", F.when(F.col("id") % 11 != 0, F.col("id") * 7 % 5003).alias("k"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("s"), F.col("id") % 1000)).alias("s"),
        F.when(F.col("id") % 5 != 0, F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 100).cast("string"))).alias("g")
    ).repartition(7)
    _same_index(spark, df, [arithmetic_order("id", 3), "id"],
                "pmod(pmod(id, 2147483647) * 2654435761 + 3, 2147483647), id")
    _same_index(spark, df, ["k", "id"], "k, id")
    _same_index(spark, df, [F.desc("k"), F.col("s"), F.col("id")], "k DESC, s, id")
    _same_index(spark, df, ["s", "id"], "s, id", ["g"])
    _same_index(spark, df, ["k", "id"], "k, id", ["g"], ranges=300)


def test_folds_and_oversampling_keep_null_labels(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("label"))
    assert P.stratified_kfold(df, "label", ["id"], 4).count() == 100
    over = P.oversample(df, "label", "id")
    sizes = {r.label: r["count"] for r in over.groupBy("label").count().collect()}
    assert set(sizes) == {None, 0, 1, 2} and len(set(sizes.values())) == 1
    assert over.where("copy_no = 0").count() == 100


def test_empty_and_single_rows(spark):
    none = spark.range(0).select("id", F.lit("x").alias("g"))
    assert with_row_index(none, ["id"], partition_by=["g"]).count() == 0
    assert [r.row_idx for r in with_row_index(spark.range(1), ["id"]).collect()] == [0]
    assert P.kfold(spark.range(3), ["id"], 5).select("fold").distinct().count() == 3


def test_stratified_folds_per_label(spark):
    df = spark.range(0, 1000).select("id", (F.col("id") % 3).alias("label"))
    f = P.stratified_kfold(df, "label", ["id"], 4)
    g = f.groupBy("label", "fold").count().collect()
    sizes = {}
    for r in g:
        sizes.setdefault(r.label, []).append(r["count"])
    for v in sizes.values():
        assert max(v) - min(v) <= 1


def test_running_sums_ranges(spark):
    df = spark.range(0, 2000).select((F.col("id") % 2).cast("string").alias("g"), "id", F.lit(1).alias("v"))
    out = running_sums(df, ["g"], F.col("id"), ["v"], ranges=13).collect()
    for r in out:
        assert r.v_cum == r.id // 2 + 1


def test_knn_tiles_equal_brute_force(spark):
    emb = (spark.read.parquet(f"{SF}/embeddings.parquet")
           .select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label"))
    folds = P.kfold(emb, ["id"], 5)
    tiled = knn_neighbors(folds, folds, 5, fold="fold", rows_per_tile=40).collect()
    whole = knn_neighbors(folds, folds, 5, fold="fold", rows_per_tile=10 ** 9).collect()
    key = lambda r: (r.test_id, r.rank)
    a = {key(r): (r.train_id, round(r.dist, 9)) for r in tiled}
    b = {key(r): (r.train_id, round(r.dist, 9)) for r in whole}
    assert a == b and len(a) == 500 * 5
    assert all(math.isfinite(v[1]) for v in a.values())


def test_knn_capped_tiles_with_sub_blocks(spark, monkeypatch):
    import lexikon.operators.neighbors as N
    emb = (spark.read.parquet(f"{SF}/embeddings.parquet")
           .select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label"))
    folds = P.kfold(emb, ["id"], 5)
    whole = {(r.test_id, r.rank): r.train_id for r in N.knn_neighbors(folds, folds, 3, fold="fold",
                                                                       rows_per_tile=10 ** 9).collect()}
    monkeypatch.setattr(N, "MAX_TILES", 3)
    capped = {(r.test_id, r.rank): r.train_id for r in N.knn_neighbors(folds, folds, 3, fold="fold",
                                                                        rows_per_tile=40).collect()}
    assert whole == capped


def test_macro_curve_of_many_points(spark):
    """Against numpy interpolation label by label, 20,000 points and an empty class."""
    import numpy as np
    from lexikon.operators.curves import macro_roc_curve, roc_curve
    df = spark.range(60_000).select("id", (F.col("id") % 3).cast("string").alias("label"),
                                    (F.pmod(F.xxhash64("id"), F.lit(97)) % 2).cast("int").alias("y_true"),
                                    (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)) / 1_000_003).alias("score"))
    df = df.where("label < 2 OR y_true = 1")
    curves = {}
    for r in roc_curve(df, ["label"]).collect():
        own = curves.setdefault(r.label, {0.0: 0.0})
        own[r.fpr] = max(own.get(r.fpr, 0.0), r.tpr)
    grid = np.array(sorted({x for c in curves.values() for x in c}))
    want = np.mean([np.interp(grid, sorted(c), [c[x] for x in sorted(c)]) for c in curves.values()], axis=0)
    got = np.array([(r.fpr, r.mean_tpr) for r in macro_roc_curve(df).orderBy("fpr").collect()])
    assert np.allclose(got[:, 0], grid) and np.allclose(got[:, 1], want, atol=1e-9)


def test_latin1_lines_keep_blank_ones(spark, tmp_path):
    from lexikon.sources.files import read_text_lines
    (tmp_path / "a.txt").write_bytes("äöü\n\n  \nß,\"x\"\n\u00e9".encode("latin-1"))
    got = [r.line for r in read_text_lines(spark, str(tmp_path), encoding="ISO-8859-1").collect()]
    assert got == ["äöü", "", "  ", 'ß,"x"', "é"]


def test_unigram_ends_when_the_alphabet_is_larger_than_the_target(spark):
    from lexikon.operators.subword import train_unigram
    words = spark.createDataFrame([("".join(chr(0x4E00 + i) for i in range(41)), 3)], "word string, freq bigint")
    assert train_unigram(words, 20).count() == 42


def test_checkpoint_folder_has_to_be_given_on_a_cluster():
    import pytest
    from lexikon.session import checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())


def test_plans_do_not_sort_texts_or_shuffle_matches(spark, capsys):
    from lexikon.functions.text import find_all
    from lexikon.operators.dedup import dedup_exact_text, last_write_wins
    df = spark.range(10).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("title"),
                                F.lit("a the b").alias("text"))
    for out in (dedup_exact_text(df), last_write_wins(df, "title")):
        out.explain()
        assert "SortAggregate" not in capsys.readouterr().out
    find_all(df, "ord", "text", "the").explain()
    assert "Exchange" not in capsys.readouterr().out
    assert [(r.start, r.stop) for r in find_all(df.limit(1), "ord", "text", "[at]", regex=True).collect()] == [(0, 1), (2, 3)]
