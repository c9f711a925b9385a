"""Classifiers fitted together: each as if alone, blind to its held-out rows; stored metric tables."""
import math
import random

from pyspark.sql import functions as F

SCHEMA = "id bigint, tokens array<string>, labels array<int>, folds array<int>"


def rows_of(n=160, folds=4):
    rnd = random.Random(7)
    out = []
    for i in range(n):
        a, b = i % 3, rnd.randrange(2)
        tokens = [f"a{a}x{rnd.randrange(4)}" for _ in range(6)] + [f"b{b}x{rnd.randrange(4)}" for _ in range(6)] + ["the"] * 3
        rnd.shuffle(tokens)
        out.append((i, tokens if i % 40 else [], [a, None if i % 5 == 0 else b], [i % folds, None if i % 5 == 0 else (i // 2) % folds]))
    return out


def predicted(spark, rows, classes, epochs=3, num_features=1 << 10):
    from lexikon.operators.linear import joint_cross_validation
    df = joint_cross_validation(spark.createDataFrame(rows, SCHEMA), classes, 4, epochs=epochs, num_features=num_features)
    return {(r["label_set"], r["id"]): (r["fold"], r["y_true"], r["y_pred"]) for r in df.collect()}


def test_label_sets_fitted_together_are_fitted_alone(spark):
    rows = rows_of()
    both = predicted(spark, rows, [[0, 1, 2], [0, 1]])
    assert len(both) == 160 + 128
    right = [y == p for _, y, p in both.values()]
    assert sum(right) >= 0.95 * len(right)
    for s, classes in enumerate([[0, 1, 2], [0, 1]]):
        alone = predicted(spark, [(i, t, [own[s]], [f[s]]) for i, t, own, f in rows], [classes])
        assert alone == {(0, i): v for (k, i), v in both.items() if k == s}


def test_held_out_labels_do_not_matter(spark):
    rows = [(i, t, own[:1], f[:1]) for i, t, own, f in rows_of()]
    before = predicted(spark, rows, [[0, 1, 2]])
    changed = [(i, t, [(own[0] + 1) % 3] if f[0] == 2 else own, f) for i, t, own, f in rows]
    after = predicted(spark, changed, [[0, 1, 2]])
    assert {k: v[2] for k, v in before.items() if v[0] == 2} == {k: v[2] for k, v in after.items() if v[0] == 2}


def test_idf_of_training_rows(spark):
    """Against counts row by row."""
    from lexikon.operators.linear import Task, fold_idf, term_rows
    rows = rows_of(40)
    task, size = Task([[0, 1, 2], [0, 1]], 4), 1 << 12
    dealt = term_rows(spark.createDataFrame(rows, SCHEMA), "id", "tokens", "labels", "folds", size)
    idf = fold_idf(dealt, task, size)
    terms = {r["id"]: set(r["terms"]) for r in dealt.collect()}
    for s in range(2):
        for f in range(4):
            train = [i for i, _, own, held in rows if own[s] is not None and held[s] != f]
            for t in {x for i in range(1, 6) for x in terms[i]}:
                want = math.log((1 + len(train)) / (1 + sum(t in terms[i] for i in train))) + 1
                assert abs(idf[t, s * 4 + f] - want) < 1e-4


def test_many_shards(spark, monkeypatch):
    from lexikon.operators import linear
    monkeypatch.setattr(linear, "SHARD_ROWS", 40)
    got = predicted(spark, rows_of(), [[0, 1, 2], [0, 1]], epochs=6)
    right = [y == p for _, y, p in got.values()]
    assert sum(right) >= 0.95 * len(right)


def test_stored_metric_tables(spark, tmp_path):
    from lexikon.sources.logs import MetricTables
    first = MetricTables(spark, str(tmp_path))
    assert first.read("KMeans") is None and first.read_all().count() == 0
    first.upsert("KMeans", "cls accuracy", 0.5)  # no table: nothing happens
    assert first.read("KMeans") is None
    first.create("KMeans", [("purity", 0.25)])
    first.upsert("KMeans", "cls accuracy", 0.5)
    again = MetricTables(spark, str(tmp_path))  # another run goes on from what is stored
    again.upsert("KMeans", "cls accuracy", 0.75)
    again.create("d2v", [("purity", 1.0)])
    assert {tuple(r) for r in first.read_all().collect()} == {
        ("purity", 0.25, "kmeans_Diagnosis"), ("cls accuracy", 0.75, "kmeans_Diagnosis"), ("purity", 1.0, "doc2vec_Diagnosis")}
    assert {r.metric for r in again.read("d2v").select(F.col("metric")).collect()} == {"purity"}


def test_running_sums_and_many_matches(spark):
    """Against a plain loop for every number of values around a block; 100,000 matches in one text."""
    from itertools import accumulate

    from lexikon.functions.sections import keyword_starts
    from lexikon.functions.text import find_all, sums_before
    lists = [(n, [(7 * i) % 13 for i in range(n)]) for n in (0, 1, 2, 15, 16, 17, 31, 32, 33, 255, 256, 257, 4097)]
    df = spark.createDataFrame(lists, "n int, v array<bigint>")
    for levels in (0, 1, 5):
        got = {r[0]: r[1] for r in df.where("n < 300 OR %d > 0" % levels).select("n", sums_before(F.col("v"), levels)).collect()}
        assert all(got[n] == [0, *accumulate(v)][:n] for n, v in lists if n in got)
    text = spark.createDataFrame([(1, "é: x" * 100_000)], "k int, t string")
    r = find_all(text, "k", "t", "é:").agg(F.count("*"), F.max("start"), F.max("n"), F.sum(F.col("stop") - F.col("start"))).first()
    assert tuple(r) == (100_000, 399_996, 99_999, 200_000)
    starts = text.select(keyword_starts(F.col("t"), F.lit("é:"), ["é:"])).first()[0]
    assert starts == list(range(1, 400_000, 4))


def noisy_rows(n=1200, seed=3):
    """A label whose odds two words show by degrees, beside words of the row's own that a fit can learn by heart."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = rnd.randrange(11)
        y = int(rnd.random() < 1 / (1 + math.exp(5 - k)))
        out.append((i, ["s1"] * k + ["s0"] * (10 - k) + [f"own{i}_{j}" for j in range(2)] + [f"w{rnd.randrange(50)}"], y))
    return out


def calibration_error(pairs, bins=8):
    """Mean distance of a bin's mean probability from its share of ones, weighted by rows."""
    held = [[] for _ in range(bins)]
    for p, y in pairs:
        held[min(int(p * bins), bins - 1)].append((p, y))
    return sum(abs(sum(p for p, _ in b) - sum(y for _, y in b)) for b in held) / len(pairs)


def test_probabilities_are_calibrated_on_unseen_margins(spark, tmp_path):
    from lexikon.operators.linear import SvmProba, platt_scaling
    schema = "id bigint, tokens array<string>, label int"
    seen = spark.createDataFrame(noisy_rows(), schema)
    fresh = spark.createDataFrame([(i + 10**6, t, y) for i, t, y in noisy_rows(seed=4)], schema)
    model = SvmProba.fit(seen, "id")
    model.save(spark, str(tmp_path))
    model = SvmProba.load(spark, str(tmp_path))
    got = [(r.probability, r.label) for r in model.transform(fresh).select("probability", "label").collect()]
    # the same SVM, its curve through the margins of its own training rows
    model.slope, model.offset = platt_scaling(model.transform(seen).select(F.col("label").alias("y_true"), "margin"))
    own = [(r.probability, r.label) for r in model.transform(fresh).select("probability", "label").collect()]
    right = sum((p >= 0.5) == (y == 1) for p, y in got) / len(got)
    assert right > 0.75
    assert calibration_error(got) < 0.08 < calibration_error(own)


def test_platt_scaling_minimises_the_loss(spark):
    from lexikon.operators.linear import platt_scaling
    rnd = random.Random(1)
    for rows in ([(int(rnd.random() < 1 / (1 + math.exp(-1.5 * m - 0.5))), m) for m in [rnd.gauss(0, 2) for _ in range(400)]],
                 [(int(m > 0), float(m)) for m in range(-20, 20)], [(1, 0.5)] * 8, [(0, 0.0)]):
        a, b = platt_scaling(spark.createDataFrame(rows, "y_true int, margin double"))
        ones = sum(y for y, _ in rows)
        target = {1: (ones + 1) / (ones + 2), 0: 1 / (len(rows) - ones + 2)}
        slope = [sum((1 / (1 + math.exp(-a * m - b)) - target[y]) * x for y, m in rows for x in [m if k else 1]) for k in (0, 1)]
        assert max(map(abs, slope)) < 1e-5 * len(rows)
    assert platt_scaling(spark.createDataFrame([], "y_true int, margin double")) == (0.0, 0.0)


def test_svm_proba_edges(spark):
    from lexikon.operators.linear import SvmProba
    schema = "id bigint, tokens array<string>, label int, margin string"
    rows = [(i, ["a"] if i % 2 else ["b"], i % 2, "x") for i in range(40)] + [(50, None, None, "x"), (51, [], 1, "x"), (None, ["a"], 1, "x")]
    model = SvmProba.fit(spark.createDataFrame(rows, schema), "id", num_features=64)
    p = {r.id: r.probability for r in model.transform(spark.createDataFrame(rows, schema)).collect()}
    assert len(p) == 43 and p[1] > 0.8 > 0.2 > p[0] and p[50] == p[51]
    empty = SvmProba.fit(spark.createDataFrame([], schema), "id", num_features=64)
    assert [r.probability for r in empty.transform(spark.createDataFrame(rows[:1], schema)).collect()] == [0.5]
