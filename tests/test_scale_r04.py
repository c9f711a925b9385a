"""Jobs whose tasks once grew with padding, symbols or partitions."""
import pytest
from pyspark.sql import functions as F


def test_decode_drops_padding_before_any_shuffle(spark):
    from lexikon.operators import vocab as V
    vocab = spark.createDataFrame([(0, "<PAD>"), (1, "<UNK>"), (2, "a"), (3, "b")], "idx int, token string")
    df = spark.createDataFrame([(1, [2, 3, 0, 0, 9]), (2, [0, 0]), (3, [3, None, 2])], "k int, ids array<int>")
    out = V.decode(df, ["k"], "ids", vocab)
    assert {r["k"]: r["tokens"] for r in out.collect()} == {1: ["a", "b", "0"], 2: [], 3: ["b", "0", "a"]}
    assert "LeftAnti" in out._jdf.queryExecution().optimizedPlan().toString()


def test_merges_are_replacements_in_whole_words(spark):
    from lexikon.operators import subword as W
    rows = [["a", "b", "a", "b", "c"], ["a", "a", "a"], ["b"], ["c", "d", "ab"], ["x", "a", "y", "b"],
            ["\u0002", "a", "b", "\u0003"], ["a", "\u0003", "\u0002", "b", "a", "b"], ["$", "$1", "a", "b"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, syms array<string>")
    batch = [("a", "b", "ab"), ("c", "d", "cd"), ("$", "$1", "$$1")]

    def plain(syms):
        out = []
        for s in syms:
            hit = {(a, b): ab for a, b, ab in batch}.get((out[-1], s)) if out else None
            out[-1:] = [hit] if hit else [*out[-1:], s]
        return out

    merged = df.select("i", W._merge_expr(batch).alias("m"))
    assert [r["m"] for r in merged.orderBy("i").collect()] == [plain(r) for r in rows]
    assert "replace(" in merged._jdf.queryExecution().optimizedPlan().toString().lower()
    aa = df.where("i = 1").select(W._merge_expr([("a", "a", "aa")]).alias("m")).first()["m"]
    assert aa == ["aa", "a"]


def test_a_fit_of_the_tagger_has_no_more_tasks_than_cores(spark, tmp_path, monkeypatch):
    from lexikon.plans import models as P
    rows = [(c, t, f"Word {c} of turn {t} .") for c in range(40) for t in range(3)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    parts = []

    class Tagger:
        def fit(self, df):
            parts.append((df.rdd.getNumPartitions(), df.count()))
            raise RuntimeError("seen")

    monkeypatch.setattr(P.M, "token_tagger", lambda *a, **k: Tagger())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with pytest.raises(RuntimeError, match="seen"):
            P._tagger_folds(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts and all(n <= spark.sparkContext.defaultParallelism and found for n, found in parts)


def test_sequences_of_several_columns_in_one_shuffle(spark):
    from lexikon.operators.models import sequences_from_tokens
    df = spark.createDataFrame([(1, 1, "b", "y"), (1, 0, "a", "x"), (2, 0, "c", "z"), (1, 1, "a", "z")],
                               "k int, pos int, w string, t string")
    out = sequences_from_tokens(df, ["k"], "w", "t")
    assert {r["k"]: (r["w"], r["t"]) for r in out.collect()} == {1: (["a", "a", "b"], ["x", "y", "z"]), 2: (["c"], ["z"])}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
