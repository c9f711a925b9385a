"""The registered queries of the operators: thin, digest columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexikon.llm.common import table


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexikon.llm.neardup import near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                        F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
NEARDUP_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS g
       FROM w, unnest(range(1, greatest(2, len(w) - 3))) AS t(i) WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
       GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 75 * (x.n + y.n - common)),
 r AS (SELECT doc_id AS f, doc_id AS t FROM documents UNION SELECT r.f, l.b FROM r JOIN l ON r.t = l.a),
 c AS (SELECT f AS doc_id, min(t) AS component_id FROM r GROUP BY f)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexikon.llm.mixing import mix_sources
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The shards of more than one per source come out of the same digits as in Spark.
MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17') AS key FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs,
              row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
 w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size / ((rank - 1) % 3 + 1) AS ratio FROM s),
 v AS (SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(3 * source_size) OVER b, 0) AS DOUBLE)
              / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
       FROM w WINDOW b AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT *, CASE WHEN level > ratio THEN CAST(3 * source_size AS DOUBLE)
              ELSE max(CASE WHEN level > ratio THEN NULL ELSE level END) OVER () * weight END AS target FROM v),
 q AS (SELECT *, CAST(floor(sum(source_size) OVER () / 8) AS BIGINT) AS seats FROM t),
 k AS (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source, k) AS r, seats
       FROM q, unnest(range(0, CAST(ceil(target / 8) AS BIGINT) + 2)) AS u(k)),
 b AS (SELECT source, count(*) AS blocks FROM k WHERE r <= seats GROUP BY source),
 e AS (SELECT q.*, coalesce(blocks, 0) AS blocks,
              least(4096, greatest(1, ceil(source_size / 262144), ceil(n_docs / 10000))) AS n_shards
       FROM q LEFT JOIN b ON q.source IS NOT DISTINCT FROM b.source),
 x AS (SELECT d.*, e.source_size, e.target, e.blocks,
              CAST('0x' || substr(key, 1, 8) AS BIGINT) % CAST(n_shards AS BIGINT) AS shard
       FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
 h AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(blocks) AS blocks FROM x GROUP BY ALL),
 i AS (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS r,
              blocks FROM h, unnest(range(0, CAST(blocks AS BIGINT))) AS u(k)),
 j AS (SELECT source, shard, count(*) AS quota FROM i WHERE r <= blocks GROUP BY ALL),
 m AS (SELECT h.*, least(coalesce(quota, 0) * 8, 3 * shard_size) AS words FROM h LEFT JOIN j
       ON h.source IS NOT DISTINCT FROM j.source AND h.shard = j.shard),
 o AS (SELECT x.*, m.words, m.shard_size, CASE WHEN m.shard_size > 0 THEN m.words // m.shard_size ELSE 0 END AS passes,
              coalesce(sum(size) OVER (PARTITION BY x.source, x.shard ORDER BY key, doc_id, size
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
       FROM x JOIN m ON x.source IS NOT DISTINCT FROM m.source AND x.shard = m.shard)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(passes * size + greatest(0, least(words - passes * shard_size - pos, size)) AS BIGINT) AS taken FROM o"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexikon.llm.quality import score_quality
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexikon.llm.repeats import remove_repeats
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", sha256(F.col("kept")).alias("kept_sha256"))


REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
 m AS (SELECT g, min(doc_id) AS keeper FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
 r AS (SELECT DISTINCT doc_id, i + o AS i FROM g JOIN m USING (g), unnest(range(0, 50)) AS t(o) WHERE keeper < doc_id),
 w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
 k AS (SELECT doc_id, count(*) FILTER (WHERE r.i IS NOT NULL) AS n_removed,
              string_agg(word, ' ' ORDER BY w.i) FILTER (WHERE r.i IS NULL) AS kept
       FROM w LEFT JOIN r USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


CHAT_SCHEMAS = {
    "ask": {"text": {"type": "string", "required": True, "min": 1, "max": 400}, "turn": {"type": "integer", "min": 0}},
    "instruct": {"text": {"type": "string", "required": True, "min": 20}, "turn": {"type": "integer", "max": 0}},
}


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexikon.llm.chat import link_calls, turns_as_calls
    calls, results = turns_as_calls(table(spark, sf_dir, "conversations"))
    return link_calls(calls, results, CHAT_SCHEMAS).select(
        "conv_id", "call_id", "status", "depth", "name", "valid", F.array_join("errors", "; ").alias("errors"), "json")


#: The turns of a conversation are unique in the tables, so no call is a duplicate here.
CHAT_SQL = r"""
WITH m AS (SELECT DISTINCT conv_id, turn, role, text, coalesce(role IN ('user', 'system'), false) AS is_call FROM conversations),
 i AS (SELECT *, conv_id || ':' || (CASE WHEN is_call THEN turn ELSE turn - 1 END) AS call_id FROM m),
 c AS (SELECT a.*, b.call_id AS after FROM i a LEFT JOIN i b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.is_call),
 d AS (SELECT c.*, (SELECT count(*) FROM c p WHERE p.conv_id = c.conv_id AND p.turn < c.turn) AS depth FROM c),
 r AS (SELECT call_id, conv_id, text AS content FROM i WHERE NOT is_call),
 l AS (SELECT coalesce(d.conv_id, r.conv_id) AS conv_id, coalesce(d.call_id, r.call_id) AS call_id,
              CASE WHEN d.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
              depth, CASE role WHEN 'user' THEN 'ask' WHEN 'system' THEN 'instruct' END AS name, text, turn, content
       FROM d FULL JOIN r ON d.call_id = r.call_id),
 e AS (SELECT *, CASE WHEN status = 'orphan' THEN [] ELSE list_filter([
         CASE WHEN text IS NULL THEN 'text: missing' END,
         CASE WHEN length(text) < (CASE name WHEN 'ask' THEN 1 ELSE 20 END)
              THEN 'text: below ' || (CASE name WHEN 'ask' THEN 1 ELSE 20 END) END,
         CASE WHEN name = 'ask' AND length(text) > 400 THEN 'text: above 400' END,
         CASE WHEN name = 'ask' AND turn < 0 THEN 'turn: below 0' END,
         CASE WHEN name = 'instruct' AND turn > 0 THEN 'turn: above 0' END], lambda x: x IS NOT NULL) END AS errors FROM l)
SELECT conv_id, call_id, status, depth, name, len(errors) = 0 AS valid, array_to_string(errors, '; ') AS errors,
       '{"arguments":' || (CASE WHEN status = 'orphan' THEN 'null' ELSE to_json({'text': text, 'turn': turn}) END)
       || ',"content":' || coalesce(to_json(content), 'null') || ',"depth":' || coalesce(CAST(depth AS VARCHAR), 'null')
       || ',"errors":' || to_json(errors) || ',"id":' || to_json(call_id) || ',"name":' || coalesce(to_json(name), 'null')
       || ',"status":' || to_json(status) || '}' AS json FROM e"""


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexikon.llm.langid import identify
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    training = docs.where(~F.coalesce(held_out, F.lit(False))).select("lang", "text")
    return identify(docs.select("doc_id", "text"), training).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexikon.llm.secrets import find_secrets
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        sha256(joined(F.filter("spans", lambda s: s["kind"] != "random"))).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexikon.llm.decontam import decontaminate
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        sha256(F.array_join("hit_items", ",")).alias("items_sha256"), "contaminated")


DECONTAM_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 bw AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g
        FROM b, unnest(range(1, greatest(2, len(w) - 11))) AS t(i) WHERE len(w) > 0),
 ks AS (SELECT DISTINCT k FROM bw),
 dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
 hits AS (SELECT DISTINCT doc_id, dw.k, i, item FROM dw JOIN bw USING (k, g)),
 hw AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM hits, unnest(range(0, k)) AS t(o) GROUP BY doc_id),
 hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexikon.llm.hosts import host_rules
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return host_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                   "base_failed", "kept")


def _hosts_sql() -> str:
    from lexikon.llm.hosts import BASE, LIMIT, RULES
    agg = ", ".join(f"sum(CAST({r} AS BIGINT)) AS {k}" for k, r in RULES.items())
    mean = ", ".join(f"sum({k}) / sum(n) AS m_{k}" for k in RULES)
    spread = ", ".join(f"sum(n * pow({k} / n - m_{k}, 2)) / sum(n) AS v_{k}" for k in RULES)
    weight = "least(greatest(coalesce(m_{k} * (1 - m_{k}) / nullif(v_{k}, 0.0) - 1, 1e6), 1.0), 1e6)"
    bad = ", ".join(f"({k} + m_{k} * {weight.format(k=k)}) / (n + {weight.format(k=k)}) > {LIMIT} AS bad_{k}" for k in RULES)
    ok = " AND ".join(f"NOT (({r}) AND coalesce(bad_{k}, false))" for k, r in RULES.items())
    return rf"""
WITH d AS (SELECT doc_id, lower(coalesce(nullif(regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1), ''),
                  source)) AS host, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
 g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
 t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
 r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM t, unnest([0, 1, 2]) AS u(o) WHERE n > 1 GROUP BY doc_id),
 m AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
              CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
              CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
              CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
 f AS (SELECT host, count(*) AS n, {agg} FROM m WHERE host IS NOT NULL GROUP BY host),
 a AS (SELECT {mean} FROM f), s AS (SELECT {spread} FROM f, a),
 b AS (SELECT host, {bad} FROM f, a, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE} AS base_failed,
       NOT ({BASE}) AND {ok} AS kept
FROM m LEFT JOIN b USING (host)"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexikon.llm.lines import dedup_lines
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped",
                                    sha256(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


LINES_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
 k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 h AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key),
 j AS (SELECT k.*, keeper IS NULL OR keeper = doc_id AS stays FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256
FROM j GROUP BY doc_id"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexikon.llm.trie import conversations, prefix_trie, with_openings
    conv = F.col("conv")
    shared = F.crc32(conv.cast("string").cast("binary")) % 6
    return prefix_trie(with_openings(conversations(table(spark, sf_dir, "conversations")), conv - conv % 100, shared, 5))


#: A node is the MD5 chain of its turns; h is the CRC-32 of the decimal id, bit by bit.
TRIE_SQL = r"""
WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS size,
                  md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
           FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT conv_id, list(key ORDER BY turn NULLS FIRST, key) AS keys, list(size ORDER BY turn NULLS FIRST, key) AS sizes,
              xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                lambda a, b: list_reduce(CAST(range(8) AS BIGINT[]),
                  lambda x, _: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)), xor(a, b)), CAST(4294967295 AS BIGINT)),
                CAST(4294967295 AS BIGINT)) % 6 AS h
       FROM t GROUP BY conv_id),
 r AS (SELECT o.conv_id, coalesce(b.keys, [])[1:o.h] || o.keys[o.h + 1:] AS keys,
              coalesce(b.sizes, [])[1:o.h] || o.sizes[o.h + 1:] AS sizes
       FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100),
 m AS (SELECT conv_id, unnest(range(0, len(keys) + 1)) AS depth, keys, sizes FROM r),
 k AS (SELECT conv_id, depth, md5(array_to_string(keys[1:depth], ',')) AS node, depth = len(keys) AS ends,
              md5(array_to_string(keys[1:depth - 1], ',')) AS above, coalesce(sizes[depth], 0) AS size FROM m),
 n AS (SELECT depth, node, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
              sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
       FROM k GROUP BY depth, node),
 c AS (SELECT depth - 1 AS depth, above AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
 v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (depth, node)),
 s AS (SELECT k.depth, k.node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * v.size) AS saved
       FROM v JOIN k ON k.conv_id = v.conv_id AND k.depth <= v.depth GROUP BY k.depth, k.node)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (depth, node) LEFT JOIN n p ON p.depth = v.depth - 1 AND p.node = v.above"""


def op12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexikon.llm.fingerprint import DIGITS, fingerprints

    def digits(sketch: str) -> Column:
        return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")), "")

    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_chars", sha256(F.col("edited")).alias("edited_sha256"), digits("sketch").alias("fingerprint"),
        digits("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next", F.col("next_id").alias("next_doc_id"))


FINGERPRINT_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  lead(coalesce(text, '')) OVER w AS after, first_value(coalesce(text, '')) OVER w AS first,
                  lead(doc_id) OVER w AS after_id, first_value(doc_id) OVER w AS first_id FROM documents WINDOW w AS (ORDER BY doc_id)),
 e AS (SELECT doc_id, n, t, CASE WHEN after_id IS NULL THEN first ELSE after END AS x, coalesce(after_id, first_id) AS next_doc_id
       FROM d),
 f AS (SELECT *, substr(t, 1, n - n // 2) || substr(x, 1, n // 2) AS edited FROM e),
 v AS (SELECT doc_id, unnest([t, edited, x]) AS v, unnest([1, 2, 3]) AS kind FROM f),
 w AS (SELECT doc_id, kind, regexp_extract_all(translate(v, {LOWER}), '[^\x20\x09-\x0D]+') AS w FROM v),
 s AS (SELECT doc_id, kind, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1,
         greatest(2, len(w) - 3)), lambda i: substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 15))))[1:128] END AS s FROM w),
 p AS (SELECT a.doc_id, a.s AS a, b.s AS b, c.s AS c, list_sort(list_distinct(a.s || b.s))[1:128] AS ab,
              list_sort(list_distinct(a.s || c.s))[1:128] AS ac
       FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.kind = 1 AND b.kind = 2 JOIN s c ON a.doc_id = c.doc_id AND c.kind = 3)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint,
       array_to_string(b, '') AS edited_fingerprint,
       CASE WHEN len(ab) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect(ab, a), b)) / len(ab) END AS near_edited,
       CASE WHEN len(ac) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect(ac, a), c)) / len(ac) END AS near_next,
       next_doc_id
FROM f JOIN p USING (doc_id)"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexikon.llm.negatives import mine_negatives
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.select("vec_id", "embedding", moved.alias("label")), "id % 50 = 0")


NEGATIVES_SQL = r"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
       FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
 p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3"""


QUERIES = {
    "op1_neardup": (op1_neardup, NEARDUP_SQL),
    "op2_mixing": (op2_mixing, MIXING_SQL),
    "op7_secrets": (op7_secrets, None),
    "op8_decontam": (op8_decontam, DECONTAM_SQL),
    "op3_quality": (op3_quality, None),
    "op4_repeats": (op4_repeats, REPEATS_SQL),
    "op5_chat": (op5_chat, CHAT_SQL),
    "op6_langid": (op6_langid, None),
    "op9_host_rules": (op9_host_rules, _hosts_sql()),
    "op10_line_dedup": (op10_line_dedup, LINES_SQL),
    "op11_prefix_trie": (op11_prefix_trie, TRIE_SQL),
    "op12_fingerprint": (op12_fingerprint, FINGERPRINT_SQL),
    "op13_hard_negatives": (op13_hard_negatives, NEGATIVES_SQL),
}
