"""Prefix trie, fingerprints and hard negatives: brute force and edge cases."""
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- prefix trie ------------------------------------------------------------------

def plain_conversations(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            key = hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), key, (r, t)))
    return {c: [x[2] for x in sorted(v)] for c, v in own.items()}


def plain_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs:
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    below = defaultdict(list)
    for p in nodes:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    children = defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    out = []
    for p, members in nodes.items():
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p],
                    sum(not children[q] for q in below[p]),
                    sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below[p] if q),
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(out, key=repr)


def turns_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for c in ("conv", "turns", "path", "range", "key", "size", "base", "shared", "skeleton"):
        df = df.withColumn(c, F.lit("mine"))
    return df.repartition(3)


def found_trie(spark, rows, ranges, rebuild=False):
    from lexikon.llm.trie import conversations, prefix_trie, with_openings
    convs = conversations(turns_of(spark, rows))
    if rebuild:
        c = F.col("conv")
        convs = with_openings(convs, c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, 5)
    return sorted([tuple(r) for r in prefix_trie(convs, ranges).collect()], key=repr)


def test_trie_against_plain(spark, monkeypatch):
    from lexikon.llm import trie
    monkeypatch.setattr(trie, "IDS", 3)
    monkeypatch.setattr(trie, "NODES", 2)
    rnd = random.Random(3)
    rows = [(c, t, "user", rnd.choice("aäb")) for c in range(120) for t in range(rnd.randrange(5))]
    rows += [(c, t, "hot", "same") for c in range(300, 380) for t in range(3)]
    convs = list(plain_conversations(rows).items())
    for ranges in (1, 7):
        assert found_trie(spark, rows, ranges) == plain_trie(convs)


def test_trie_of_rebuilt_conversations(spark):
    rnd = random.Random(8)
    rows = [(c, t, rnd.choice(["user", None]), rnd.choice(["x", "yy", None]))
            for c in [*range(0, 30), *range(95, 130), *range(402, 430), -5, -100] for t in range(rnd.randrange(1, 8))]
    rows += [(700, None, "system", "first"), (700, 0, "user", "then"), (700, 0, "user", "then"), (700, -4, "b", None),
             (701, 1, "only", "one"), (None, 1, "nobody", "x"), (702, 0, "long", "l" * 200_000)]
    assert found_trie(spark, rows, 5, rebuild=True) == plain_trie(list(plain_rebuilt(plain_conversations(rows)).items()))


def test_trie_of_a_long_conversation_and_copies(spark):
    from lexikon.llm.trie import prefix_trie
    long = [(str(i), "t" * (i % 3)) for i in range(1500)]
    convs = [(i, long) for i in range(5)] + [(9, long[:700]), (9, long[:700]), (10, []), (11, long[:1200] + [("z", "z")])]
    df = spark.createDataFrame(
        [(c, [(hashlib.md5(r.encode()).hexdigest(), len(t)) for r, t in turns]) for c, turns in convs],
        "conv bigint, turns array<struct<key: string, size: bigint>>")
    assert sorted([tuple(r) for r in prefix_trie(df, 4).collect()], key=repr) == plain_trie(convs)


def test_trie_without_conversations(spark):
    assert found_trie(spark, [], 2) == [] == found_trie(spark, [(None, 1, "a", "b")], 2, rebuild=True)


def test_skeleton_holds_shared_prefixes_only():
    from lexikon.llm.trie import KEY, Skeleton
    a, b, c = ("a" * KEY, "b" * KEY, "c" * KEY)
    s = Skeleton()
    s.add(a + b, a + b + c, [1, 2, 3])
    s.add(a + b + c, a + c, [1, 7])
    assert s.parent == [-1, 0, 1] and s.size == [0, 1, 2] and s.depth == [0, 1, 2]


# ---- fingerprints -----------------------------------------------------------------

def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_sketch(text, k=128):
    return sorted(int(hashlib.md5(s.encode()).hexdigest()[:15], 16) for s in shingles(text))[:k]


def plain_near(a, b, k=128):
    both = sorted({*a, *b})[:k]
    return len([x for x in both if x in a and x in b]) / len(both) if both else 1.0


def plain_fingerprints(rows):
    """For unique, non-null ids."""
    rows = sorted(rows)
    out = {}
    for (i, t), (j, x) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, x = t or "", x or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + x[:half]
        out[i] = (len(t), edited, j, plain_sketch(t), plain_sketch(edited),
                  plain_near(plain_sketch(t), plain_sketch(edited)), plain_near(plain_sketch(t), plain_sketch(x)))
    return out


COLUMNS = ("n_chars", "edited", "next_id", "sketch", "edited_sketch", "near_edited", "near_next")


def with_names(df):
    for c in ("sketch", "edited", "words", "h1", "h2", "rest", "head", "id", "p1", "next_id", "at", "total"):
        df = df.withColumn(c, F.lit("mine"))
    return df


def test_fingerprints_against_plain(docs_of):
    from lexikon.llm.fingerprint import fingerprints
    rnd = random.Random(2)
    words = ["The", "of", "ÄÖ", "çé", "x", "\U0001F600y"]
    rows = [(3 * i, " ".join(rnd.choices(words, k=rnd.randrange(60)))) for i in range(60)]
    rows += [(1, None), (2, ""), (4, " \n\t"), (5, "one"), (7, "a b c d e f"), (200, "w%d " * 40_000 % tuple(range(40_000))),
             (201, "w%d " * 40_000 % tuple(range(40_000))), (202, "x" * 100_000)]
    want = plain_fingerprints(rows)
    df = fingerprints(with_names(docs_of(rows)))
    got = {r["doc_id"]: r for r in df.collect()}
    assert len(got) == len(rows)
    text = dict(rows)
    for i, w in want.items():
        assert tuple(got[i][c] for c in COLUMNS) == w and got[i]["text"] == text[i]
        assert got[i]["words"] == got[i]["h1"] == got[i]["p1"] == "mine"
    plain = fingerprints(docs_of(rows).select("doc_id", "text"))
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in plain.collect()} == want


def test_fingerprints_of_odd_rows(docs_of):
    from lexikon.llm.fingerprint import fingerprints
    assert fingerprints(docs_of([])).count() == 0
    one = fingerprints(docs_of([(5, "a b c d e f g h")])).first()
    assert (one["edited"], one["next_id"], one["near_next"]) == ("a b c d a b c d", 5, 1.0)
    rows = [(1, "same row twice"), (1, "same row twice"), (2, "p"), (2, "q"), (None, "none"), (None, None)]
    got = fingerprints(docs_of(rows)).collect()
    assert len(got) == 6
    twice = [r for r in got if r["doc_id"] == 1]
    assert twice[0] == twice[1] and twice[0]["next_id"] == 2
    assert sum(r["next_id"] is None for r in got) == 2 and sum(r["next_id"] == 1 for r in got) == 1


def test_sketch_estimates_and_merging(spark):
    from lexikon.llm.fingerprint import containment, distinct_shingles, merge_sketches, merged, resemblance, sketched
    text = ["w%d" % i for i in range(6000)]
    whole, first, last = " ".join(text), " ".join(text[:4000]), " ".join(text[3996:])
    rows = spark.createDataFrame([(1, "whole", whole), (1, "first", first), (1, "last", last)], "g int, name string, text string")
    got = {r["name"]: r["sketch"] for r in sketched(rows).collect()}
    pair = spark.createDataFrame([(got["whole"], got["first"], got["last"])], "w array<bigint>, f array<bigint>, l array<bigint>")
    r = pair.select(resemblance(F.col("w"), F.col("f")).alias("near"), containment(F.col("f"), F.col("w")).alias("inside"),
                    containment(F.col("w"), F.col("f")).alias("outside"), distinct_shingles(F.col("w")).alias("n"),
                    merged(F.col("f"), F.col("l")).alias("both")).first()
    assert abs(r["near"] - 2 / 3) < 0.15 and r["inside"] > 0.75 and abs(r["outside"] - 2 / 3) < 0.2
    assert abs(r["n"] / 5996 - 1) < 0.3 and r["both"] == got["whole"]
    parts = sketched(rows.where("name <> 'whole'")).drop("text").unionByName(
        spark.createDataFrame([(None, "x", []), (2, "y", None)], "g int, name string, sketch array<bigint>"))
    out = {x["g"]: x["sketch"] for x in merge_sketches(parts, ["g"], "sketch").collect()}
    assert out == {1: got["whole"], None: [], 2: []}


def test_fingerprints_stay_in_the_jvm(docs_of):
    from lexikon.llm.fingerprint import fingerprints
    plan = fingerprints(docs_of([(1, "a"), (2, "b")]).select("doc_id", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- hard negatives ---------------------------------------------------------------

def plain_negatives(rows, positives=5, negatives=3):
    usable = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None
                               and all(x is not None and math.isfinite(x) for x in r[1])),
                              key=lambda r: (r[0], r[2], [math.floor(256 * x) for x in r[1]])):
        usable.setdefault(i, ([math.floor(256 * x) for x in v], label))
    out = []

    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    for a, (va, la) in usable.items():
        if a % 50:
            continue
        all_ = sorted((-score(va, v), i, label) for i, (v, label) in usable.items() if i != a)
        for s, p, _ in [x for x in all_ if x[2] == la][:positives]:
            fit = [x for x in all_ if x[2] != la and -50 * s <= -100 * x[0] <= -95 * s][:negatives]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(fit)]
    return sorted(out)


def vectors_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    for c in ("id", "vector", "r", "a", "score", "rank", "positives"):
        df = df.withColumn(c, F.lit("mine"))
    return df.repartition(3)


def mined(spark, rows, **sizes):
    from lexikon.llm.negatives import mine_negatives
    return sorted(tuple(r) for r in mine_negatives(vectors_of(spark, rows), "id % 50 = 0", **sizes).collect())


def as_float32(v):
    return [float(np.float32(x)) for x in v]


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_negatives_against_plain(spark, spread):
    rnd = np.random.default_rng(4)
    centre = rnd.normal(size=(4, 20))
    rows = [(i, as_float32((centre[i % 4] + spread * rnd.normal(size=20)) / 4), i % 3) for i in range(400)]
    rows += [(i, as_float32(centre[0] / 4), 1) for i in range(400, 520)]  # a crowd of ties
    want = plain_negatives(rows)
    assert want
    for sizes in ({}, {"block_rows": 60, "block_anchors": 4}, {"block_rows": 7, "block_anchors": 100}):
        assert mined(spark, rows, **sizes) == want


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 1.0, 9.0], 1), (2, [0.6], 2), (3, [0.5, nan], 2), (4, [inf, 1.0], 2), (5, None, 2),
            (6, [None, 1.0], 2), (7, [0.9, 0.9], None), (None, [0.9, 0.9], 2), (8, [0.9, 0.9], 2), (8, [0.9, 0.9], 2),
            (9, [], 2), (50, [], 3), (51, [], 3), (52, [5.0], 4), (100, [-1.0, -1.0], 7), (101, [1.0, 1.0], 7), (150, [1.0], 9)]
    want = plain_negatives(rows)
    assert {r[0] for r in want} == {0, 50}  # a score of zero has negatives of zero
    assert mined(spark, rows) == want == mined(spark, rows, block_rows=2, block_anchors=1)
    assert mined(spark, []) == [] == mined(spark, [(50, [1.0], 1)]) == mined(spark, [(1, [1.0], 1)])


def test_negatives_of_large_components(spark):
    rows = [(0, [30000.0] * 3, 0), (1, [30000.0, 30000.0, 29999.0], 0), (2, [20000.0, 25000.0, 30000.0], 1), (3, [1e30] * 3, 5)]
    got = mined(spark, rows)
    assert got == plain_negatives(rows[:3])
    most = 1 << 24
    both = [(0, [1e30], 0), (1, [-1e30], 1), (2, [1e30], 0)]
    assert mined(spark, [*both, (3, [60000.0], 1)]) == [(0, 2, 1, 3, most * most, most * 256 * 60000)]


def test_index_omits_entries_and_keeps_every_pair():
    from lexikon.llm.negatives import SuffixIndex, pairs
    rnd = np.random.default_rng(6)
    v = np.floor(256 * rnd.normal(size=(300, 40)) / np.arange(1, 41)).astype(float)
    q = np.floor(256 * rnd.normal(size=(90, 40)) / np.arange(1, 41)).astype(float)
    scores = q @ v.T
    for share in (0.5, 0.2, 0.0, -0.5):
        least = share * np.sqrt((q ** 2).sum(axis=1)) * 300
        who, row, score = pairs(q, v, least)
        want = np.nonzero(scores >= least[:, None])
        assert sorted(zip(who.tolist(), row.tolist(), strict=True)) == list(zip(*map(list, map(np.ndarray.tolist, want)), strict=True))
        assert (score == scores[who, row]).all()
    index = SuffixIndex(v, float(np.sqrt((q ** 2).sum(axis=1)).max()), 1e5)
    assert index.begin.max() > 0 and (index.norms[np.arange(300), index.begin] < 1e5).all()
