"""Vocabulary and sequence queries over ``conversations`` (token sequences
with a derived tag per token), ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexikon.functions.text import word_tokens
from lexikon.operators import vocab as V
from lexikon.plans.common import table

MAX_LEN = 100
KEYS = ["conv_id", "turn"]
NAMES = ["quality", "toxic"]


def tag_of(tok):
    return (F.when(tok.rlike(r"^\p{Lu}"), "B-CAP").when(tok.rlike(r"^\p{L}"), "O")
            .when(tok.rlike(r"^\p{Nd}"), "NUM").otherwise("PUNCT"))


def sequences(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(*KEYS, word_tokens("text").alias("tokens"))
    return c.withColumn("tags", F.transform("tokens", tag_of))


def vocab(spark, sf_dir):
    return V.fit_vocab(sequences(spark, sf_dir), "tokens", KEYS)


def vocab_top(spark, sf_dir):
    return V.fit_vocab(sequences(spark, sf_dir), "tokens", KEYS, vocab_len=100)


def _encoded(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return s, V.encode(s, KEYS, "tokens", V.fit_vocab(s, "tokens", KEYS), MAX_LEN)


def encode(spark, sf_dir):
    _, e = _encoded(spark, sf_dir)
    return e.select(*KEYS, F.array_join("ids", ",").alias("ids"))


def decode(spark, sf_dir):
    s = sequences(spark, sf_dir)
    vv = V.fit_vocab(s, "tokens", KEYS)
    e = V.encode(s, KEYS, "tokens", vv, MAX_LEN)
    d = V.decode(e, KEYS, "ids", vv)
    return d.select(*KEYS, F.array_join("tokens", " ").alias("tokens"))


def _tag_ids(spark, sf_dir):
    s = sequences(spark, sf_dir)
    tv = V.fit_vocab(s, "tags", KEYS, specials=("<EMPTY>",))
    return V.encode(s, KEYS, "tags", tv, MAX_LEN, out="tag_ids")


def one_hot(spark, sf_dir):
    t = _tag_ids(spark, sf_dir)
    oh = V.one_hot(F.col("tag_ids"), 5)
    return t.select(*KEYS, F.array_join(F.transform(oh, lambda v: F.array_join(v, "")), " ").alias("one_hot"))


def argmax(spark, sf_dir):
    t = _tag_ids(spark, sf_dir)
    back = V.argmax_decode(V.one_hot(F.col("tag_ids"), 5))
    return t.select(*KEYS, F.array_join(back, ",").alias("tag_ids"))


def mask(spark, sf_dir):
    s, e = _encoded(spark, sf_dir)
    m = s.select(*KEYS, V.attention_mask(F.col("tokens"), MAX_LEN).alias("mask"))
    return e.join(m, KEYS).select(*KEYS, F.array_join("ids", ",").alias("ids"),
                                   F.array_join("mask", "").alias("mask"))


def freq_band(spark, sf_dir):
    return V.frequency_band(table(spark, sf_dir, "documents"), "text")


def extent(spark, sf_dir):
    s = sequences(spark, sf_dir)
    e = V.encode(s, KEYS, "tokens", V.fit_vocab(s, "tokens", KEYS), MAX_LEN)
    t = V.encode(s, KEYS, "tags", V.fit_vocab(s, "tags", KEYS, specials=("<EMPTY>",)), MAX_LEN, out="tag_ids")
    return V.vocab_extent(e.join(t, KEYS), "ids", "tag_ids")


def label_index(spark, sf_dir):
    return V.label_index(table(spark, sf_dir, "documents"), "lang", "doc_id")


def _multihot(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.array("quality", "toxic").alias("v"))


def multihot_names(spark, sf_dir):
    m = _multihot(spark, sf_dir)
    return m.select("doc_id", F.array_join(V.multihot_to_names(F.col("v"), NAMES), ",").alias("names"))


def binarize(spark, sf_dir):
    m = _multihot(spark, sf_dir).select("doc_id", V.multihot_to_names(F.col("v"), NAMES).alias("names"))
    classes = V.fit_binarizer(m, "names")
    return m.select("doc_id", F.array_join(V.binarize(F.col("names"), classes), "").alias("vector"))


def remap(spark, sf_dir):
    m = _multihot(spark, sf_dir)
    return m.select("doc_id", F.array_join(V.remap_ids(F.col("v"), [3, 7]), ",").alias("ids"))


def sentence_ids(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(*KEYS)
    return V.sentence_ids(c, KEYS)


def pair_columns(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("label"))
    return d.select("doc_id", *V.pair_to_columns(F.col("label")))


TOK = r"""tok AS (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_\s]') AS tokens
        FROM conversations),
ex AS (SELECT conv_id, turn, unnest(tokens) AS token, unnest(generate_series(0, len(tokens) - 1)) AS pos FROM tok),
tags AS (SELECT *, CASE WHEN regexp_matches(token, '^\p{Lu}') THEN 'B-CAP' WHEN regexp_matches(token, '^\p{L}') THEN 'O'
         WHEN regexp_matches(token, '^\p{Nd}') THEN 'NUM' ELSE 'PUNCT' END AS tag FROM ex)"""


def _vocab_sql(col: str, specials: list[str], top: int | None = None) -> str:
    lim = f"QUALIFY row_number() OVER (ORDER BY freq DESC, fc, ft, fp) <= {top}" if top else ""
    sp = " UNION ALL ".join(f"SELECT {i} AS idx, '{t}' AS token, CAST(0 AS BIGINT) AS freq"
                            for i, t in enumerate(specials))
    return f"""c_{col} AS (SELECT {col} AS token, count(*) AS freq, arg_min(conv_id, (conv_id, turn, pos)) AS fc,
            arg_min(turn, (conv_id, turn, pos)) AS ft, arg_min(pos, (conv_id, turn, pos)) AS fp FROM tags GROUP BY {col}
            {lim}),
v_{col} AS ({sp} UNION ALL SELECT CAST(row_number() OVER (ORDER BY freq DESC, fc, ft, fp) - 1 + {len(specials)}
            AS INTEGER), token, CAST(freq AS BIGINT) FROM c_{col})"""


VOC = "WITH " + TOK + ", " + _vocab_sql("token", ["<PAD>", "<UNK>"])
ENC = VOC + """,
enc AS (SELECT t.conv_id, t.turn, coalesce(string_agg(CAST(coalesce(v.idx, 0) AS VARCHAR), ',' ORDER BY t.pos)
            FILTER (WHERE t.pos IS NOT NULL), '') AS ids0, count(t.pos) AS n
        FROM tok k LEFT JOIN tags t ON t.conv_id = k.conv_id AND t.turn = k.turn AND t.pos < 100
        LEFT JOIN v_token v ON v.token = t.token GROUP BY ALL),
encp AS (SELECT k.conv_id, k.turn, array_to_string(list_concat(
            CASE WHEN e.n > 0 THEN string_split(e.ids0, ',') ELSE [] END,
            list_transform(range(100 - coalesce(e.n, 0)), lambda x: '0')), ',') AS ids
        FROM tok k LEFT JOIN enc e ON e.conv_id = k.conv_id AND e.turn = k.turn)"""
TAGV = "WITH " + TOK + ", " + _vocab_sql("tag", ["<EMPTY>"]) + """,
tenc AS (SELECT k.conv_id, k.turn, list_concat(coalesce(list(coalesce(v.idx, 0) ORDER BY t.pos)
            FILTER (WHERE t.pos IS NOT NULL), []), list_transform(range(100 - count(t.pos)), lambda x: 0)) AS ids
        FROM tok k LEFT JOIN tags t ON t.conv_id = k.conv_id AND t.turn = k.turn AND t.pos < 100
        LEFT JOIN v_tag v ON v.token = t.tag GROUP BY ALL)"""
LAB = "WITH m AS (SELECT doc_id, quality, toxic FROM labels)"

QUERIES = {
    "vocab": (vocab, VOC + " SELECT idx, token, freq FROM v_token"),
    "vocab_top": (vocab_top, "WITH " + TOK + ", " + _vocab_sql("token", ["<PAD>", "<UNK>"], 100)
                  + " SELECT idx, token, freq FROM v_token"),
    "encode": (encode, ENC + " SELECT conv_id, turn, ids FROM encp"),
    "decode": (decode, VOC + """ SELECT k.conv_id, k.turn, coalesce(string_agg(v.token, ' ' ORDER BY t.pos)
            FILTER (WHERE v.token IS NOT NULL), '') AS tokens
        FROM tok k LEFT JOIN tags t ON t.conv_id = k.conv_id AND t.turn = k.turn AND t.pos < 100
        LEFT JOIN v_token v ON v.token = t.token GROUP BY ALL"""),
    "one_hot": (one_hot, TAGV + """ SELECT conv_id, turn, array_to_string(list_transform(ids, lambda x:
        array_to_string(list_transform(range(5), lambda i: CASE WHEN i = x THEN '1' ELSE '0' END), '')), ' ')
        AS one_hot FROM tenc"""),
    "argmax": (argmax, TAGV + " SELECT conv_id, turn, array_to_string(ids, ',') AS tag_ids FROM tenc"),
    "mask": (mask, ENC + """ SELECT p.conv_id, p.turn, p.ids, array_to_string(list_transform(range(1, 101),
        lambda i: CASE WHEN i <= least(len(k.tokens), 100) THEN '1' ELSE '0' END), '') AS mask
        FROM encp p JOIN tok k USING (conv_id, turn)"""),
    "freq_band": (freq_band, """SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word
        FROM documents) GROUP BY word HAVING count(*) BETWEEN 20 AND 500"""),
    "extent": (extent, "WITH " + TOK + ", " + _vocab_sql("token", ["<PAD>", "<UNK>"]) + ", "
               + _vocab_sql("tag", ["<EMPTY>"]) + """,
        f AS (SELECT t.pos, v.idx AS i, w.idx AS l FROM tags t JOIN v_token v ON v.token = t.token
              JOIN v_tag w ON w.token = t.tag WHERE t.pos < 100),
        pad AS (SELECT bool_or(len(tokens) < 100) AS p FROM tok)
        SELECT CAST(count(DISTINCT i) + CASE WHEN any_value(p) THEN 1 ELSE 0 END AS BIGINT) AS distinct_ids,
            CAST(max(i) AS INTEGER) AS max_id,
            CAST(count(DISTINCT l) + CASE WHEN any_value(p) THEN 1 ELSE 0 END AS BIGINT) AS n_labels
        FROM f, pad"""),
    "label_index": (label_index, """SELECT lang, CAST(row_number() OVER (ORDER BY min(doc_id), lang) - 1 AS INTEGER)
        AS label_id FROM documents GROUP BY lang"""),
    "multihot_names": (multihot_names, LAB + """ SELECT doc_id, concat_ws(',', CASE WHEN quality = 1 THEN 'quality' END,
        CASE WHEN toxic = 1 THEN 'toxic' END) AS names FROM m"""),
    "binarize": (binarize, LAB + """ SELECT doc_id, CAST(CASE WHEN quality = 1 THEN 1 ELSE 0 END AS VARCHAR)
        || CAST(CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS VARCHAR) AS vector FROM m"""),
    "remap": (remap, LAB + """ SELECT doc_id, CAST(CASE WHEN quality = 1 THEN 3 ELSE -1 END AS VARCHAR) || ','
        || CAST(CASE WHEN toxic = 1 THEN 7 ELSE -1 END AS VARCHAR) AS ids FROM m"""),
    "sentence_ids": (sentence_ids, """SELECT conv_id, turn, 'sentence ' || CAST(row_number() OVER (ORDER BY conv_id, turn)
        AS VARCHAR) AS sentence FROM conversations"""),
    "pair_columns": (pair_columns, "SELECT doc_id, lang AS organ, source AS disease FROM documents"),
}
