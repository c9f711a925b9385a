"""Subword training and encoding: whole sizes, few jobs, no shuffle of tokens, nothing left on disk."""
import os
import random
from collections import Counter

import numpy as np
import pytest


def _words(spark, letters="aabbbcdé#", n=600):
    rnd = random.Random(3)
    freq = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))): rnd.choice([1, 1, 2, 9]) for _ in range(n)}
    freq |= {"a" * 7: 4, "xyxyx": 3, "yxyxy": 2}
    return freq, spark.createDataFrame(list(freq.items()), "word string, freq bigint")


def _plain(freq, mark, room, wordpiece, byte_level=False):
    """One merge after the other, everything counted again for each."""
    words = {w: [f"{c:02X}" for c in w.encode()] if byte_level else [c if i == 0 else mark + c for i, c in enumerate(w)] for w in freq}
    out = []
    while len(out) < room:
        pairs, symbols = Counter(), Counter()
        for w, x in words.items():
            for s in x:
                symbols[s] += freq[w]
            for p in zip(x, x[1:]):
                pairs[p] += freq[w]
        found = [(-n / (symbols[a] * symbols[b]) if wordpiece else -n, a, b, n) for (a, b), n in pairs.items() if n >= 2]
        if not found:
            break
        _, a, b, n = min(found)
        out.append((a, b, n))
        ab = a + (b.removeprefix(mark) if mark else b)
        for w, x in words.items():
            y = []
            for s in x:
                if y and (y[-1], s) == (a, b):
                    y[-1] = ab
                    y.append(None)  # a symbol just made meets no other in this pass
                else:
                    y.append(s)
                if len(y) > 1 and y[-2] is None:
                    del y[-2]
            words[w] = [s for s in y if s is not None]
    return out


def _tables(spark):
    from lexikon.session import scratch_path
    at = scratch_path(spark, "x").removeprefix("file:").rsplit("/", 1)[0]
    return {x for x in os.listdir(at) if os.listdir(f"{at}/{x}")} if os.path.isdir(at) else set()


def _merges(found):
    return [(r["left"], r["right"], r["n"]) for r in found[1].orderBy("rank").collect()]


@pytest.mark.parametrize("held", [1 << 22, 300])
def test_merges_in_rounds_are_those_of_one_at_a_time(spark, monkeypatch, held):
    """Also when the driver may hold a part of the symbols only; 80 merges are far fewer jobs; tables go again."""
    from lexikon.operators import subword as W
    monkeypatch.setattr(W, "DRIVER_SYMBOLS", held)
    freq, words = _words(spark)
    sc, before = spark.sparkContext, _tables(spark)
    for mark, byte_level in ((None, False), ("##", False), (None, True)):
        alphabet = 256 if byte_level else len(W.alphabet(W.initial_symbols(words, mark)))
        sc.setJobGroup("bpe", "bpe")
        try:
            got = W.train_bpe(words, 1 + alphabet + 80, continuation=mark, byte_level=byte_level)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert _merges(got) == _plain(freq, mark or "", 80, False, byte_level)
    assert len(sc.statusTracker().getJobIdsForGroup("bpe")) < (60 if held > 300 else 600)
    alphabet = len(W.alphabet(W.initial_symbols(words, "##")))
    assert _merges(W.train_wordpiece(words, 1 + alphabet + 40)) == _plain(freq, "##", 40, True)
    assert _tables(spark) == before


def test_the_largest_pair_needs_no_words_in_the_driver(spark, monkeypatch):
    from lexikon.operators import subword as W
    monkeypatch.setattr(W, "DRIVER_SYMBOLS", 8)
    freq, words = _words(spark, "ab", 40)
    alphabet = len(W.alphabet(W.initial_symbols(words, "##")))
    assert _merges(W.train_wordpiece(words, 1 + alphabet + 6)) == _plain(freq, "##", 6, True)


def test_tokenizers_are_compared_at_the_size_of_the_reference(spark, monkeypatch, tmp_path):
    """25 merges of WordPiece, 43 of bytes and 300 tokens in all were left."""
    from lexikon.plans import subwords as P
    rows = [(i, f"text {i} of the words and of the numbers {i * i}") for i in range(30)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sizes = {}
    for name in ("bpe", "wordpiece", "unigram"):
        def train(words, size, name=name, plain=getattr(P.W, f"train_{name}"), **options):
            sizes[name + str(options.get("byte_level", ""))] = size
            return plain(words, size, **options)
        monkeypatch.setattr(P.W, f"train_{name}", train)
    found = {r["tokenizer"]: r["texts"] for r in P.tokenizer_compare(spark, str(tmp_path)).collect()}
    assert found == dict.fromkeys(("bpe", "byte", "unigram", "wordpiece"), 30)
    assert sizes == dict.fromkeys(("bpe", "bpeTrue", "unigram", "wordpiece"), 4000)


def test_texts_are_encoded_in_the_row(spark, monkeypatch):
    """No token is shuffled; keys of several rows, or null, go together as they did."""
    from lexikon.operators import subword as W
    monkeypatch.setattr(W, "BATCH_TOKENS", 3)
    rows = [(1, "low lower lowest"), (2, None), (3, ""), (4, "  new low \n"), (5, "x" * 120 + " low")]
    docs = spark.createDataFrame(rows, "id long, text string")
    words = W.word_counts(docs, "text")
    kinds = {"bpe": W.Tokenizer("bpe", *W.train_bpe(words, 30)),
             "byte": W.Tokenizer("byte", *W.train_bpe(W.word_counts(docs, "text", True), 270, byte_level=True))}
    out = W.compare_tokenizers(docs, ["id"], "text", kinds)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["tokenizer"]): r["rebuilt"] for r in out.collect()}
    assert got == {(i, k): (t or "") if k == "byte" else "".join((t or "").split()) for i, t in rows for k in kinds}
    twice = spark.createDataFrame([(1, "low"), (1, "new x"), (None, "low"), (None, None), (7, "low new")], "id long, text string")
    again = {(r["id"], r["tokenizer"]): r["rebuilt"] for r in W.compare_tokenizers(twice, ["id"], "text", kinds).collect()}
    assert again[None, "bpe"] == "low" and again[7, "bpe"] == "lownew" and again[7, "byte"] == "low new"
    assert sorted(again[1, "bpe"]) == sorted("lownewx") and len(again) == 6


def test_unigram_sorts_suffixes_and_leaves_no_table(spark, monkeypatch):
    """Seeds equal counted substrings; chunks and parts of any size, and counts as a table, give one vocabulary."""
    from lexikon.operators import lattice as L
    from lexikon.operators import subword as W
    freq, words = _words(spark, "aabbbcdé\U0001F600")
    before = _tables(spark)
    want = Counter()
    for w, f in freq.items():
        for i in range(len(w)):
            for j in range(i + 2, min(len(w), i + 5) + 1):
                want[w[i:j]] += f
    rows = [(w[i:i + 5], f) for w, f in freq.items() for i in range(len(w) - 1)]
    (first, length, n), held, at = L.repeated_beginnings([s for s, _ in rows], np.array([f for _, f in rows]), 5)
    names = [rows[i][0][:k] for i, k in zip(first, length)]
    assert names == sorted(names) and dict(zip(names, n)) == {p: k for p, k in want.items() if k >= 2}
    assert [names[i] for i in at] == [s[:k] for s, _ in rows for k in range(2, len(s) + 1) if want[s[:k]] >= 2]
    assert list(held) == [sum(want[s[:k]] >= 2 for k in range(2, len(s) + 1)) for s, _ in rows]
    whole = {(r.token, r.score) for r in W.train_unigram(words, 90).collect()}
    monkeypatch.setattr(W, "CHUNK_BITS", 4)
    monkeypatch.setattr(W, "SUFFIXES_PER_TASK", 100)
    assert {(r.token, r.score) for r in W.train_unigram(words, 90).collect()} == whole
    assert _tables(spark) == before
    assert {(r.token, r.score) for r in W.train_unigram(words, 90, driver_pieces=0).collect()} == whole
    assert {x.split("-")[0] for x in _tables(spark) - before} <= {"ranges"}  # of the row index


def test_the_tagger_hashes_its_features_once(spark, tmp_path, monkeypatch):
    from lexikon.plans import models as P
    rows = [(c, t, f"Word {c} of turn {t} .") for c in range(10) for t in range(2)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    seen = []

    class Tagger:
        def fit(self, df):
            seen.append(df)
            raise RuntimeError("seen")

    monkeypatch.setattr(P.M, "token_tagger", lambda *a, **k: Tagger())
    with pytest.raises(RuntimeError, match="seen"):
        P._tagger_folds(spark, str(tmp_path))
    assert "features" in seen[0].columns and "prev" not in seen[0].columns
    assert "InMemoryRelation" in seen[0]._jdf.queryExecution().withCachedData().toString()
