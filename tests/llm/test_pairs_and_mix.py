"""Near duplicates, substring dedup, mixing, chat, quality and the pipeline."""
import json
import random
import re

import numpy as np
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- near duplicates ------------------------------------------------------------

def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows):
    """Smallest id reachable by links, for rows of unique ids."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                r, s = sorted((root(a), root(b)))
                label[s] = r
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_superminhash_is_the_sequential_algorithm():
    """Against the signature element by element without early stopping; and unbiased."""
    from lexikon.llm.common import mix
    from lexikon.llm.neardup import superminhash
    rnd = np.random.default_rng(1)
    sets = [rnd.integers(1, 1 << 62, n).astype(np.uint64) for n in (1, 3, 40, 700)]
    m = 16
    doc = np.repeat(np.arange(4), [len(s) for s in sets])
    got = superminhash(np.concatenate(sets), doc, 4, m)
    for d, s in enumerate(sets):
        want = [None] * m
        for h in s:
            p = list(range(m))
            for j in range(m):
                r = int(mix(np.array([(int(h) + 0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])
                k = j + (((r & 0xFFFFFFFF) * (m - j)) >> 32)
                p[j], p[k] = p[k], p[j]
                v = (j << 56) | (r >> 8)
                if want[p[j]] is None or v < want[p[j]]:
                    want[p[j]] = v
        assert got[d].tolist() == want
    base = rnd.integers(1, 1 << 62, 1000).astype(np.uint64)
    a, b = base[:800], base[200:]
    sig = superminhash(np.concatenate([a, b]), np.repeat([0, 1], 800), 2, 128)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15


def test_near_duplicates_against_plain(docs_of):
    from lexikon.llm.neardup import near_duplicates
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for group in range(12):
        base = rnd.choices(words, k=rnd.choice([6, 30, 120]))
        for _ in range(rnd.randrange(1, 9)):
            copy = list(base)
            for _ in range(rnd.randrange(0, max(2, len(base) // 18))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((n, " ".join(copy).title() if rnd.random() < 0.3 else "  ".join(copy)))
            n += 1
    chain = rnd.choices(words, k=400)  # neighbours are linked, the ends are not
    rows += [(n + k, " ".join(chain[12 * k:12 * k + 200])) for k in range(15)]
    n += 15
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one two"), (n + 4, "ONE two"), (n + 5, "two one"),
             (n + 6, "long " * 150_000), (n + 7, "long " * 149_000)]
    rnd.shuffle(rows)
    got = {r.id: (r.n, r.component) for r in near_duplicates(docs_of(rows)).collect()}
    assert got == plain_components(rows)


def test_near_duplicates_of_edited_copies(docs_of):
    """A large group whose members are mostly unlike each other, and texts that only share a passage."""
    from lexikon.llm.neardup import near_duplicates
    rnd = random.Random(21)
    fresh = lambda k: [f"{rnd.randrange(10**6):x}" for _ in range(k)]
    base, passage, rows = fresh(150), fresh(60), []
    for i in range(250):
        copy = list(base)
        for _ in range(rnd.randrange(1, 9)):
            copy[rnd.randrange(150)] = fresh(1)[0]
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(passage + fresh(rnd.randrange(2, 60)))) for i in range(150)]
    rnd.shuffle(rows)
    got = {r.id: (r.n, r.component) for r in near_duplicates(docs_of(rows)).collect()}
    assert got == plain_components(rows)


def test_near_duplicates_edges(docs_of):
    from lexikon.llm.neardup import near_duplicates
    assert near_duplicates(docs_of([])).count() == 0
    assert near_duplicates(docs_of([(1, None), (2, "")])).count() == 2
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    got = sorted([tuple(r) for r in near_duplicates(docs_of(rows)).collect()], key=repr)
    assert got == sorted([(4, 2, 4), (4, 2, 4), (9, 2, 4), (None, 2, None), (None, 0, None)], key=repr)


def test_components_of_a_long_chain(spark):
    from lexikon.llm.neardup import components
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 300), (300, 400)], "a bigint, b bigint")
    got = {r.id: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 300: 300, 400: 300, 500: 300}


# ---- substring dedup ------------------------------------------------------------

def plain_repeats(rows, width=50):
    order = lambda i: (i is None, i or 0)
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - width + 1):
            k = tuple(w[s:s + width])
            if k not in first or order(i) < order(first[k]):
                first[k] = i
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - width + 1):
            if order(first[tuple(w[s:s + width])]) < order(i):
                gone.update(range(s, s + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_repeats_against_plain(docs_of):
    from lexikon.llm.repeats import remove_repeats
    rnd = random.Random(11)
    fresh = lambda k: [f"{rnd.randrange(10**9):x}" for _ in range(k)]
    passages = [fresh(k) for k in (49, 50, 51, 75, 130)]
    rows = []
    for i in range(60):
        w = fresh(rnd.randrange(0, 90))
        for p in rnd.sample(passages, rnd.randrange(0, 4)):
            a = rnd.randrange(0, 3)
            at = rnd.randrange(len(w) + 1)
            w[at:at] = p[a:]
        rows.append((i * 3 % 61, rnd.choice([" ", "\n", "\t "]).join(w)))
    whole = " ".join(fresh(300))
    rows += [(100, whole), (101, whole.upper()), (102, whole), (103, None), (104, ""), (None, whole), (105, "a " * 60), (106, "a " * 49),
             (107, "a " * 200_000), (102, whole)]
    want = plain_repeats(rows)
    for chunk, bucket in ((1 << 22, 1 << 18), (1500, 200)):
        df = remove_repeats(docs_of(rows), chunk_bytes=chunk, bucket_words=bucket)
        assert sorted([tuple(r) for r in df.select("id", "n_words", "n_removed", "kept").collect()], key=repr) == want
    for r in df.collect():
        assert sum(x.end - x.start for x in r.removed) == r.n_removed
    assert remove_repeats(docs_of([])).count() == 0


def test_anchors_inside_a_chunk():
    """Only windows around anchors are compared, and no repeat at any offset to the blocks is missed."""
    from lexikon.llm.common import Words, windows
    from lexikon.llm.repeats import BLOCK, WINDOW, _around, _starts, inner_anchors
    rng = random.Random(12)
    fresh = (f"w{i}" for i in range(10**6))

    def text(*parts):
        return " ".join(w for p in parts for w in (p if isinstance(p, list) else [next(fresh) for _ in range(p)])).encode()

    alone = Words([text(300), None, text(49), text(700)])
    assert not len(inner_anchors(alone, alone.hashes()))
    within = [next(fresh) for _ in range(60)]  # a passage twice in one document is no anchor
    one = Words([text(10, within, 7, within), text(200)])
    assert not len(inner_anchors(one, one.hashes()))
    for shift in range(2 * BLOCK):
        shared = [next(fresh) for _ in range(WINDOW)]
        words = Words([text(shift, shared, 90), text(rng.randrange(80), shared, 30), text(400)])
        h = words.hashes()
        doc, start = _starts(words, WINDOW)
        near = _around(words, inner_anchors(words, h), start)
        key = windows(h, WINDOW)[start]
        twice = [i for i in range(len(key)) if (key == key[i]).sum() > 1]
        assert len(twice) == 2 and near[twice].all() and near.sum() < 4 * WINDOW and not near[doc == 2].any()


# ---- mixing ---------------------------------------------------------------------

def plain_targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped) or 1
        t = {s: 3 * sizes[s] if s in capped else left * w[s] / free for s in order}
        over = {s for s in order if t[s] > 3 * sizes[s] + 1e-9 and s not in capped}
        if not over:
            return t
        capped |= over


def test_mixing_targets_and_quotas(docs_of):
    from lexikon.llm.mixing import BLOCK, mix_sources
    rnd = random.Random(4)
    rows = [(i, " ".join(["x"] * rnd.randrange(0, 80)), None, rnd.choice(["hot"] * 6 + ["b", "Ä", "z", None]))
            for i in range(400)]
    rows += [(1000, None, None, "hot"), (1001, "", None, "empty source"), (1002, "one", None, "tiny"), (1003, "x " * 50_000, None, "b"),
             (1003, "x " * 50_000, None, "b"), (None, "null id", None, "z")]
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    for shard in (1 << 18, 500):  # one shard each, and many
        a = mix_sources(docs_of(rows), shard_words=shard).collect()
        taken, shards = {}, {}
        for r in a:
            assert 0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[r.source]
            assert abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
            taken[r.source] = taken.get(r.source, 0) + r.taken
        for s, t in taken.items():
            n_shards = max(1, -(-sizes[s] // shard))
            assert abs(t - want[s]) <= 2 * BLOCK * n_shards + 1, (s, t, want[s])
        b = mix_sources(docs_of(rows).repartition(5), shard_words=shard).collect()
        key = lambda r: repr((r.doc_id, r["size"], r.taken))
        assert sorted(map(key, a)) == sorted(map(key, b))
    assert mix_sources(docs_of([])).count() == 0
    assert [r.taken for r in mix_sources(docs_of([(1, None), (2, "")])).collect()] == [0, 0]


def test_apportionment_is_sainte_lague(spark):
    from lexikon.llm.mixing import apportioned
    rnd = random.Random(8)
    for seats in (1, 7, 50, 333):
        votes = {f"k{i}": rnd.choice([1, 3, 10, 1000]) * rnd.randrange(1, 50) for i in range(13)}
        won = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = min(votes, key=lambda k: (-votes[k] / (2 * won[k] + 1), k))
            won[best] += 1
        df = spark.createDataFrame([("g", k, v, seats) for k, v in votes.items()], "g string, k string, v bigint, n bigint")
        assert {r.k: r.quota for r in apportioned(df, ["g"], ["k"], "v", "n").collect()} == won


# ---- chat -----------------------------------------------------------------------

SCHEMAS = {"add": {"x": {"type": "number", "required": True, "min": 0, "max": 10}, "note": {"type": "string", "min": 2}}}


def test_calls_are_linked_and_judged(spark):
    from lexikon.llm.chat import link_calls
    calls = spark.createDataFrame([
        (1, "a", None, "add", '{"x": 1, "note": "ok"}'), (1, "b", "a", "add", '{"x": "1"}'), (1, "c", "b", "mul", "{}"),
        (1, "d", "gone", "add", "nope"), (1, "e", "f", "add", None), (1, "f", "e", "add", '{"x": 11, "note": "n"}'),
        (2, "a", None, "add", '{"note": "ok", "x": 1}'), (2, "a", None, "add", '{"note": "ok", "x": 2}'),
        (2, "a", None, "add", '{"note": "ok", "x": 1}'), (None, "z", None, "add", "[]"), (2, None, None, "add", "{}"),
        (3, "q", "q", "add", '{"x": 2}'),
    ], "conv_id bigint, call_id string, after string, name string, arguments string")
    results = spark.createDataFrame([(1, "a", "ré"), (1, "a", "ré"), (1, "a", None), (2, "a", ""), (9, "a", "lost"),
                                     (None, "z", "no")], "conv_id bigint, call_id string, content string")
    rows = link_calls(calls, results, SCHEMAS).collect()
    by = {}
    for r in rows:
        by.setdefault((r.conv_id, r.call_id, r.status), []).append(r)
    assert len(by[1, "a", "answered"]) == 2 and by[1, "a", "answered"][0].depth == 0
    assert by[1, "b", "unanswered"][0].depth == 1 and by[1, "c", "unanswered"][0].depth == 2
    assert by[1, "b", "unanswered"][0].errors == ["x: not of type number"]
    assert by[1, "c", "unanswered"][0].errors == ["unknown tool"]
    assert by[1, "d", "unanswered"][0].errors == ["arguments: not an object"] and by[1, "d", "unanswered"][0].depth == 0
    assert by[1, "e", "unanswered"][0].depth is None and by[3, "q", "unanswered"][0].depth is None
    assert by[1, "f", "unanswered"][0].errors == ["x: above 10", "note: below 2"]
    assert len(by[2, "a", "answered"]) == len(by[2, "a", "duplicate"]) == 1
    assert by[9, "a", "orphan"][0].valid and (None, "z", "orphan") in by and (None, "z", "unanswered") in by
    assert by[2, None, "unanswered"][0].errors == ["x: missing"]
    for r in rows:
        parsed = json.loads(r.json)
        assert r.json == json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert parsed["id"] == r.call_id and parsed["status"] == r.status


def test_depth_of_a_long_chain(spark):
    from lexikon.llm.chat import depths
    n = 300
    calls = spark.createDataFrame([(1, f"c{i}", f"c{i - 1}" if i else None) for i in range(n)],
                                  "conv_id bigint, call_id string, after string")
    assert {r.call_id: r.depth for r in depths(calls).collect()} == {f"c{i}": i for i in range(n)}


def test_chat_empty(spark):
    from lexikon.llm.chat import link_calls, turns_as_calls
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert link_calls(*turns_as_calls(turns), SCHEMAS).count() == 0
    odd = spark.createDataFrame([(1, None, "user", "x"), (None, 0, None, None), (1, 0, "assistant", "early"), (1, 5, "user", None)],
                                "conv_id bigint, turn bigint, role string, text string")
    assert sorted(r.status for r in link_calls(*turns_as_calls(odd), SCHEMAS).collect()) == [
        "orphan", "orphan", "unanswered", "unanswered"]


# ---- quality --------------------------------------------------------------------

def test_em_finds_the_accuracies():
    """Patterns drawn from known labellers: posteriors match Bayes' rule with the true rates."""
    from lexikon.llm.quality import posteriors
    rng = np.random.default_rng(0)
    truth = rng.random(40_000) < 0.8
    votes = np.full((len(truth), 5), -1)
    for j, (hit, false) in enumerate(((0.6, 0.01), (0.5, 0.02), (0.5, 0.005))):
        votes[:, j] = np.where(rng.random(len(truth)) < np.where(truth, false, hit), 0, -1)
    votes[:, 3] = np.where(rng.random(len(truth)) < np.where(truth, 0.9, 0.1), 1, -1)
    votes[:, 4] = np.where(rng.random(len(truth)) < 0.3, np.where(rng.random(len(truth)) < 0.97, truth, ~truth), -1)
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = posteriors(patterns, counts.astype(float))
    assert ((p[which.ravel()] > 0.5) == truth).mean() > 0.97


def test_quality_on_the_tables(spark):
    from lexikon.llm.quality import score_quality
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    # people's labels of every other document only: the rest is held out
    got = score_quality(docs.select("doc_id", "text"), labels.where("doc_id % 4 != 0")).join(labels, "doc_id")
    rest = got.where("doc_id % 4 = 0")
    junk, clean = rest.where("quality = 0"), rest.where("quality = 1 AND toxic = 0")
    assert junk.where("quality_kept").count() <= 0.1 * junk.count()
    assert clean.where("NOT quality_kept").count() <= 0.03 * clean.count()


def test_quality_catches_toxic_documents(spark):
    """Labelled and held-out ones; clean documents stay."""
    from lexikon.llm.quality import score_quality
    for sf in ("sf0.01", "sf0.1"):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        for seen, held in (("true", "true"), ("doc_id % 4 <> 0", "doc_id % 4 = 0")):
            got = score_quality(docs.select("doc_id", "text"), labels.where(seen)).join(labels, "doc_id").where(held)
            n = {(r[0], r[1]): r[2] for r in got.groupBy(F.expr(
                "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'junk' ELSE 'clean' END"), "quality_kept").count().collect()}
            share = {k: n.get((k, True), 0) / (n.get((k, True), 0) + n.get((k, False), 0)) for k in ("toxic", "junk", "clean")}
            assert share["toxic"] <= (0.1 if held == "true" else 0.15) and share["junk"] <= 0.05 and share["clean"] >= 0.99, (sf, share)


def test_quality_keeps_columns_of_its_own_names(spark, docs_of):
    from lexikon.llm.quality import score_quality
    names = ("_votes", "_features", "_raw", "_probability", "_prediction", "_tokens", "_label_id", "_vote_id", "p", "rest", "text2")
    docs = docs_of([(1, "some words of a text"), (2, None)])
    for c in names:
        docs = docs.withColumn(c, F.lit("mine"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    for r in score_quality(docs, labels).collect():
        assert all(r[c] == "mine" for c in names) and r["quality_kept"]


def test_word_filter_and_entries():
    from lexikon.llm.quality import Entries, _passes
    found = Entries([b"Alpha beta, ALPHABET alpha", None, b"", b"beta"])
    first = found.first()
    got = sorted((int(found.doc[i]), found.bytes_of(i), int(found.at[i])) for i in first)
    assert got == [(0, b"alpha", 0), (0, b"alphab*", 2), (0, b"alphabet", 2), (0, b"beta", 1), (3, b"beta", 4)]
    context = found.contexts()
    assert context[4] != context[1] and len(set(context.tolist())) == 5
    assert not _passes(np.zeros(16, np.uint64), found.hash).any()


def test_quality_edges(spark, docs_of):
    from lexikon.llm.quality import score_quality
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, None, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    none = labels.where("false")
    ordinary = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "### *** " * 40), (2, ordinary), (3, None), (4, ""), (None, ordinary), (5, ordinary + " x" * 100_000), (2, ordinary),
            (6, "JUNK JUNK " * 40), (7, "$$$ %%% " * 40)] + [(10 + i, ordinary + f" {i}") for i in range(20)]
    for own in (labels, none):
        got = {}
        for r in score_quality(docs_of(rows), own).collect():
            assert 0 <= r.quality_score <= 1 and r.quality_kept == (r.quality_score >= 0.5)
            got[r.doc_id] = r.quality_kept
        assert got[3] and got[4] and got[2] and got[15] and not got[1] and not got[7] and not got[6]
    assert score_quality(docs_of([]), labels).count() == 0
    assert {r.quality_kept for r in score_quality(docs_of(rows[1:5]), none).collect()} == {True}


def test_abusive_words_from_all_labelled(spark):
    """A word that only labelled documents with the largest id hashes hold is learned."""
    from lexikon.llm.quality import abusive_words, judged
    ids = spark.range(60_000).select(F.col("id").alias("doc_id"))
    last = [r[0] for r in ids.orderBy(F.xxhash64("doc_id").desc(), F.desc("doc_id")).limit(40).collect()]
    docs = ids.withColumn("text", F.when(F.col("doc_id").isin(last), F.format_string("a%d zorgle b%d", "doc_id", "doc_id"))
                          .otherwise(F.format_string("plain c%d text", "doc_id")))
    labels = ids.select("doc_id", F.lit(1).alias("quality"), F.col("doc_id").isin(last).cast("int").alias("toxic"))
    assert b"zorgle" in abusive_words(docs, judged(labels, "doc_id", "quality", "toxic"), "doc_id", "text")


# ---- pipeline -------------------------------------------------------------------

def test_pipeline_stages_against_plain(spark):
    """Each stage on what the one before kept, held against a plain version of its decision."""
    import sys
    sys.path.insert(0, ".")
    import corpus_pipeline as P
    from tests.llm.test_text_operators import plain_contamination, plain_lines
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("component", F.lit(1)).withColumn("n_words", F.lit("x"))
    columns = docs.columns
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert len(P.STAGES) == 5
    for name, stage in P.STAGES[:-1]:
        before, out = rows(docs), stage(spark, docs, sf).cache()
        after = rows(out)
        assert out.columns == columns and {r.n_words for r in out.collect()} == {"x"}
        if name == "quality classifier":
            assert 0.6 * len(before) < len(after) < len(before) and set(after) <= set(before)
        elif name == "line dedup":
            assert sorted(after, key=repr) == sorted([(i, t) for i, t, _, _ in plain_lines(before)], key=repr)
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "MinHash near-dedup":
            keep = {i for i, (_, c) in plain_components(before).items() if i == c}
            assert {i for i, _ in after} == keep
        else:
            bad = {i for i, _, _, _, c in plain_contamination(before, bench) if c}
            assert {i for i, _ in after} == {i for i, _ in before} - bad
        docs = out
    assert P.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_pipeline_on_odd_rows(spark, docs_of, tmp_path):
    import corpus_pipeline as P
    sf = str(tmp_path)
    docs_of([(1, None), (2, ""), (None, "a b"), (3, "same text of few words"), (4, "same text of few words"), (4, "same text of few words")]
            ).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert {r.doc_id for r in P.run(spark, sf).collect()} == {1, 2, None, 3, 4}
    docs_of([]).write.parquet(f"{sf}/e/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{sf}/e/{t}.parquet")
    assert P.run(spark, f"{sf}/e").count() == 0
