"""Subword training and encoding over ``documents``."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from lexikon.operators import subword as W
from lexikon.plans.common import r6, table
from lexikon.sources.files import scratch_dir
from lexikon.session import keep

BPE_SIZE = 300
WORDPIECE_EXTRA = 25
SWEEP = [100, 150, 200, 250, 300]
#: Tokens of each vocabulary that is compared: the largest size of the reference's comparison (TOK:444, 648).
COMPARE_SIZE = 4000


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def subword_counts(spark, sf_dir):
    return W.word_counts(_docs(spark, sf_dir), "text")


def bpe_pair_counts(spark, sf_dir):
    return W.pair_counts(W.initial_symbols(W.word_counts(_docs(spark, sf_dir), "text")))


def word_level_vocab(spark, sf_dir):
    return W.train_word_level(_docs(spark, sf_dir), "text", ["doc_id"], 1000)


def _bpe(spark, sf_dir):
    return W.train_bpe(W.word_counts(_docs(spark, sf_dir), "text"), BPE_SIZE)


def bpe_merges(spark, sf_dir):
    _, merges = _bpe(spark, sf_dir)
    return merges


def wordpiece_vocab(spark, sf_dir):
    words = W.word_counts(_docs(spark, sf_dir), "text")
    n_alpha = len(W.alphabet(W.initial_symbols(words, W.CONT)))
    vocab, _ = W.train_wordpiece(words, 1 + n_alpha + WORDPIECE_EXTRA)
    return vocab


def unigram_vocab(spark, sf_dir):
    words = keep(W.word_counts(_docs(spark, sf_dir), "text"))
    v = W.train_unigram(words, BPE_SIZE)
    return v.select("id", "token", r6("score").alias("score"))


def vocab_sweep(spark, sf_dir):
    """The vocabulary of every size, cut from the largest one's merge order."""
    vocab, merges = _bpe(spark, sf_dir)
    return W.cut_by_size(vocab, merges, SWEEP)


def _byte_bpe(spark, sf_dir, size=BPE_SIZE):
    vocab, merges = W.train_bpe(W.word_counts(_docs(spark, sf_dir), "text", lossless=True), size, byte_level=True)
    return W.Tokenizer("byte", vocab, merges)


def _side_by_side(spark, sf_dir):
    """Token lists of every document under all four tokenizers."""
    docs = _docs(spark, sf_dir)
    words = keep(W.word_counts(docs, "text"))
    words.count()

    trainings = {"bpe": lambda: W.Tokenizer("bpe", *W.train_bpe(words, COMPARE_SIZE)),
                 "byte": lambda: _byte_bpe(spark, sf_dir, COMPARE_SIZE),
                 "unigram": lambda: W.Tokenizer("unigram", W.train_unigram(words, COMPARE_SIZE), unk="<unk>"),
                 "wordpiece": lambda: W.Tokenizer("wordpiece", *W.train_wordpiece(words, COMPARE_SIZE), W.CONT)}
    with ThreadPoolExecutor(max_workers=len(trainings)) as pool:  # their jobs are small and wait for each other
        tokenizers = dict(zip(trainings, pool.map(lambda train: train(), trainings.values())))
    words.unpersist()
    return W.compare_tokenizers(docs, ["doc_id"], "text", tokenizers)


def tokenizer_compare(spark, sf_dir):
    t = _side_by_side(spark, sf_dir)
    return t.groupBy("tokenizer").agg(r6(F.avg("n_tokens")).alias("avg_tokens"), F.max("n_tokens").alias("max_tokens"),
                                      F.count(F.lit(1)).alias("texts"))


def tokenizer_texts(spark, sf_dir):
    """Four rows a document: what its tokens give back, and whether it has any."""
    t = _side_by_side(spark, sf_dir)
    return t.select("doc_id", "tokenizer", F.sha2("rebuilt", 256).alias("rebuilt_sha256"),
                    (F.col("n_tokens") > 0).alias("has_tokens"))


def byte_roundtrip(spark, sf_dir):
    """W2, byte form: every whole text through a byte-level vocabulary and back."""
    t = W.compare_tokenizers(_docs(spark, sf_dir), ["doc_id"], "text", {"byte": _byte_bpe(spark, sf_dir)})
    return t.select("doc_id", F.col("rebuilt").alias("text"))


def tokenizer_roundtrip(spark, sf_dir):
    """Save both tables, load them, encode the corpus words and decode them again."""
    vocab, merges = _bpe(spark, sf_dir)
    path = scratch_dir(spark, "tokenizer")
    W.save_tokenizer(vocab, merges, path)
    enc = W.encode_words(W.word_counts(_docs(spark, sf_dir), "text"), "bpe", *W.load_tokenizer(spark, path))
    return enc.select("word", W.decode_pieces(F.col("pieces"), "bpe").alias("decoded"))


WORDS = r"""w AS (SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text,
        '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_\s]+')) AS word FROM documents) GROUP BY word)"""

QUERIES = {
    "subword_counts": (subword_counts, "WITH " + WORDS + " SELECT word, freq FROM w"),
    "bpe_pair_counts": (bpe_pair_counts, "WITH " + WORDS + r""",
        c AS (SELECT freq, regexp_extract_all(word, '(?s).') AS s FROM w),
        p AS (SELECT freq, unnest(list_zip(s[1:len(s) - 1], s[2:len(s)])) AS z FROM c WHERE len(s) > 1)
        SELECT z[1] AS a, z[2] AS b, CAST(sum(freq) AS BIGINT) AS n FROM p GROUP BY ALL"""),
    "word_level_vocab": (word_level_vocab, r"""WITH t AS (SELECT doc_id, regexp_extract_all(text,
            '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_\s]+') AS tokens FROM documents),
        ex AS (SELECT doc_id, unnest(tokens) AS token, unnest(generate_series(0, len(tokens) - 1)) AS pos FROM t),
        c AS (SELECT token, count(*) AS freq, arg_min(doc_id, (doc_id, pos)) AS fd, arg_min(pos, (doc_id, pos)) AS fp
              FROM ex GROUP BY token QUALIFY row_number() OVER (ORDER BY freq DESC, fd, fp) <= 999)
        SELECT 0 AS idx, '[UNK]' AS token, CAST(0 AS BIGINT) AS freq
        UNION ALL SELECT CAST(row_number() OVER (ORDER BY freq DESC, fd, fp) AS INTEGER), token, CAST(freq AS BIGINT)
        FROM c"""),
    "bpe_merges": (bpe_merges, None),
    "wordpiece_vocab": (wordpiece_vocab, None),
    "unigram_vocab": (unigram_vocab, None),
    "vocab_sweep": (vocab_sweep, None),
    "tokenizer_compare": (tokenizer_compare, None),
    "tokenizer_texts": (tokenizer_texts, r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
            coalesce(regexp_extract_all(text, '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_\s]+'), []) AS w FROM documents),
        t AS (SELECT doc_id, 'byte' AS tokenizer, text AS rebuilt FROM d
              UNION ALL SELECT doc_id, k, array_to_string(w, '') FROM d, (VALUES ('bpe'), ('unigram')) v(k)
              UNION ALL SELECT doc_id, 'wordpiece', array_to_string(list_transform(w,
                  lambda x: CASE WHEN length(x) > 100 THEN '[UNK]' ELSE x END), '') FROM d)
        SELECT doc_id, tokenizer, sha256(rebuilt) AS rebuilt_sha256, rebuilt <> '' AS has_tokens FROM t"""),
    "byte_roundtrip": (byte_roundtrip, "SELECT doc_id, coalesce(text, '') AS text FROM documents"),
    "tokenizer_roundtrip": (tokenizer_roundtrip, "WITH " + WORDS + " SELECT word, word AS decoded FROM w"),
}
