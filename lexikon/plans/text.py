"""Scalar text functions over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexikon.functions import text as T
from lexikon.plans.common import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def repair_mojibake(spark, sf_dir):
    """Damage every text (UTF-8 bytes read as Latin-1), repair it again."""
    d = _docs(spark, sf_dir).withColumn("damaged", T.damage_as_latin1("text"))
    return d.select("doc_id", (F.col("damaged") != F.col("text")).alias("changed"),
                    F.md5(T.repair_mojibake("damaged")).alias("text_md5"))


def _doubled_words(c):
    words = F.regexp_extract_all(c, F.lit(r"\p{L}+"), 0)
    return F.array_join(F.flatten(F.transform(
        words, lambda w, i: F.when(i % 3 == 0, F.array(w, F.lower(w))).otherwise(F.array(w)))), " ")


def collapse_repeats(spark, sf_dir):
    """Every third word is doubled (second copy lower-cased); collapsing must
    give back each run of case-insensitively equal neighbours once."""
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.md5(T.collapse_repeats(_doubled_words(F.col("text")))).alias("text_md5"))


def strip_signature(spark, sf_dir):
    d = _docs(spark, sf_dir)
    composed = F.concat("text", F.lit(" Mit freundlichen Grüßen "), "source", F.lit("\n"), "lang",
                        F.lit(" Prof. Dr. "), F.col("doc_id").cast("string"))
    return d.select("doc_id", F.md5(T.strip_signature(composed)).alias("text_md5"))


def normalise_punct(spark, sf_dir):
    d = _docs(spark, sf_dir)
    composed = F.concat("text", F.lit("...--,,\r\n\n\r\n"), "lang")
    return d.select("doc_id", F.md5(T.normalise_punct(composed)).alias("text_md5"))


def lowercase(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.lower("text")).alias("text_md5"))


def token_lengths(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("n_tok", F.size(T.space_tokens("text")))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.max("n_tok").cast("bigint").alias("max_tokens"),
                                 F.sum("n_tok").cast("bigint").alias("tokens"))


def path_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", T.base_name("url").alias("base_name"), T.parent_dir("url").alias("parent"),
                    T.clean_path("url").alias("clean_path"), T.title_of("url").alias("title"))


def padded_id(spark, sf_dir):
    from lexikon.operators.index import with_row_index
    p = with_row_index(table(spark, sf_dir, "pages").select("page_id"), ["page_id"], "i")
    return p.select("page_id", T.padded_id(F.col("i") + 1).alias("left_name"),
                    T.padded_id(F.col("i") + 1, left=False).alias("right_name"))


def slices(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", T.slice_text("text", 0, 40).alias("head"), T.slice_text("text", -30).alias("tail"),
                    F.md5(T.slice_text("text", 10, -10)).alias("middle_md5"))


def find_all(spark, sf_dir):
    return T.find_all(_docs(spark, sf_dir), "doc_id", "text", "the")


def word_tokenize(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("tok", T.word_tokens("text"))
    return d.select("doc_id", F.size("tok").cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join("tok", " ")).alias("tokens_md5"))


def pre_tokenize(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("tok", T.pre_tokens("text"))
    return d.select("doc_id", F.size("tok").cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join("tok", " ")).alias("tokens_md5"))


QUERIES = {
    "repair_mojibake": (repair_mojibake, """SELECT doc_id, regexp_matches(text, '[^\\x00-\\x7F]') AS changed,
        md5(text) AS text_md5 FROM documents"""),
    "collapse_repeats": (collapse_repeats, """WITH w AS (SELECT doc_id, flatten(list_transform(
            regexp_extract_all(text, '\\p{L}+'), lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN [x, lower(x)] ELSE [x] END)) AS ws
            FROM documents)
        SELECT doc_id, md5(array_to_string(list_filter(ws, lambda x, i: i = 1 OR lower(x) <> lower(ws[i - 1])), ' '))
            AS text_md5 FROM w"""),
    "strip_signature": (strip_signature, """SELECT doc_id, md5(regexp_replace(regexp_replace(
        text || ' Mit freundlichen Grüßen ' || source || chr(10) || lang || ' Prof. Dr. ' || CAST(doc_id AS VARCHAR),
        'Mit freundlich[^\\n]*', '', 'g'), 'Prof\\.[^\\n]*', '', 'g')) AS text_md5 FROM documents"""),
    "normalise_punct": (normalise_punct, """SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(
        replace(replace(text || '...--,,' || chr(13) || chr(10) || chr(10) || chr(13) || chr(10) || lang,
                        chr(10) || chr(13) || chr(10), ''), chr(13), ''),
        '\\.+', '.', 'g'), '-+', '-', 'g'), ',+', '', 'g')) AS text_md5 FROM documents"""),
    "lowercase": (lowercase, "SELECT doc_id, md5(lower(text)) AS text_md5 FROM documents"),
    "token_lengths": (token_lengths, """SELECT lang, count(*) AS texts, max(len(string_split(text, ' '))) AS max_tokens,
        CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS tokens FROM documents GROUP BY lang"""),
    "path_parts": (path_parts, """SELECT page_id, string_split(url, '/')[-1] AS base_name,
        regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, replace(replace(url, 'reports', 'clean'), 'Nr', '#')
        AS clean_path, right(url, 16) AS title FROM pages"""),
    "padded_id": (padded_id, """SELECT page_id,
        'textNr' || CASE WHEN length(CAST(i AS VARCHAR)) >= 6 THEN CAST(i AS VARCHAR) ELSE lpad(CAST(i AS VARCHAR), 6, '0') END AS left_name,
        'textNr' || CASE WHEN length(CAST(i AS VARCHAR)) >= 6 THEN CAST(i AS VARCHAR) ELSE rpad(CAST(i AS VARCHAR), 6, '0') END AS right_name
        FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS i FROM pages)"""),
    "slices": (slices, """SELECT doc_id, substring(text, 1, 40) AS head,
        CASE WHEN length(text) > 30 THEN substring(text, length(text) - 29, 30) ELSE text END AS tail,
        md5(CASE WHEN length(text) - 10 > 10 THEN substring(text, 11, length(text) - 20) ELSE '' END) AS middle_md5
        FROM documents"""),
    "find_all": (find_all, """WITH p AS (SELECT doc_id, unnest(string_split(text, 'the')) AS piece,
            unnest(range(len(string_split(text, 'the')))) AS n, len(string_split(text, 'the')) AS m FROM documents),
        s AS (SELECT doc_id, n, m, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY n
              ROWS UNBOUNDED PRECEDING) + n * 3 AS start FROM p)
        SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(start AS BIGINT) AS start, CAST(start + 3 AS BIGINT) AS stop
        FROM s WHERE n < m - 1"""),
    "word_tokenize": (word_tokenize, """SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
        FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{Nd}_]+|[^\\p{L}\\p{Nd}_\\s]') AS t FROM documents)"""),
    "pre_tokenize": (pre_tokenize, """SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
        FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{Nd}_]+|[^\\p{L}\\p{Nd}_\\s]+') AS t FROM documents)"""),
}
