"""Golden values from the reference's inline examples (FIXTURES.md)."""

import math

import pytest
from pyspark.sql import functions as F

from lexikon.functions import text as T
from lexikon.functions.sections import report_sections, with_report_sections
from lexikon.operators import datasets as P
from lexikon.operators import metrics as E
from lexikon.operators import vocab as V
from lexikon.operators.curves import threshold_grid

REPORT_1 = (
    "Klinische Angaben: Jejunocolische Anastomose; Colitis Ulcerosa (cw) Eingesandt wurde: 1 (Darm): "
    "Fragmentiertes, zusammengelegt yy x yy x yy cm großes Weichgewebe. Exemplarische Schnitte. Technik: "
    "HE-Färbung Histologie: 1: Darmwandanteile mit einem ausgedehnten, ulcerösen, oberflächlich deutlich eitrig, "
    "chronisch-granulierenden Defekt in der Schleimhaut. Dieser reicht bis an die Tunica muscularis heran. Daneben "
    "entzündlich-alterierte Dickdarmschleimhaut und architektonisch auffällige, kolonisierte Dünndarmschleimhaut. "
    "Beurteilung: 1: Resektat von einer jejunocolischen Anastomose mit einer bis an die Tunica muscularis "
    "reichenden, flächenhaften Ulzeration mit chronisch granulierender sowie eitriger Entzündung. Kein Anhalt für "
    "Malignität. Mit freundlichen Grüßen Prof. Dr. med. xx Dr. med. xx, M.Sc. (Tel.: xxxxx) ")


def test_metrics_fixture(spark):
    df = spark.createDataFrame(list(zip(range(6), [0, 1, 0, 1, 0, 2], [1, 1, 0, 1, 0, 2])),
                               "id int, y_true int, y_pred int")
    conf = E.confusion_counts(df, [])
    s = E.summary_scores(conf, []).first()
    assert s.accuracy == pytest.approx(5 / 6)
    assert s.precision == pytest.approx(0.888889, abs=1e-6)
    assert s.recall == pytest.approx(0.833333, abs=1e-6)
    assert s.f1 == pytest.approx(0.833333, abs=1e-6)
    assert s.cohen_kappa == pytest.approx(17 / 23)
    cs = {r.cls: r for r in E.class_stats(conf, []).collect()}
    assert (cs[0].precision, cs[0].recall, cs[0].f1, cs[0].support) == pytest.approx((1, 2 / 3, 0.8, 3))
    assert (cs[1].precision, cs[1].recall, cs[1].f1, cs[1].support) == pytest.approx((2 / 3, 1, 0.8, 2))
    m = {(r.y_true, r.y_pred): r.value for r in E.confusion_matrix(conf, [], [0, 1, 2]).collect()}
    assert [m[(0, j)] for j in range(3)] == [0.67, 0.33, 0.0]
    assert [m[(1, j)] for j in range(3)] == [0.0, 1.0, 0.0]


def test_sections_fixture(spark):
    rows = [(1, REPORT_1),
            (3, "Eingesandt wurde: A Histologie: B Beurteilung: C Nachbericht: D Beurteilung: E Prof. X"),
            (4, "Klinische Angaben: nur das hier")]
    df = spark.createDataFrame(rows, "id int, text string")
    a = {r.id: r for r in with_report_sections(df, "text", "s").select("id", "s.*").collect()}
    b = {r.id: r for r in df.select("id", report_sections("text").alias("s")).select("id", "s.*").collect()}
    assert a == b
    r1 = a[1]
    assert [len(x) for x in r1[1:]] == [68, 139, 316, 222, 75]
    assert r1.clinical_infos.endswith("(cw) ") and r1.sample_infos.endswith("HE-Färbung ")
    assert r1.conclusion.endswith("Malignität. ")
    r3 = a[3]
    assert r3.clinical_infos is None and r3.sample_infos == "Eingesandt wurde: A "
    assert r3.description == "Histologie: B Nachbericht: Nachbericht: D "
    assert r3.conclusion == "Beurteilung: C Beurteilung: E " and r3.greetings == "Prof. X"
    assert all(x is None for x in a[4][1:])


def test_text_cleaning_fixture(spark):
    damaged = "Grüße".encode("utf-8").decode("latin-1")
    df = spark.createDataFrame([(damaged,), ("Grüße",), ("a€b",), ("plain",)], "t string")
    assert [r[0] for r in df.select(T.repair_mojibake("t")).collect()] == ["Grüße", "Grüße", "a€b", "plain"]
    one = lambda expr, v: spark.createDataFrame([(v,)], "t string").select(expr).first()[0]
    assert one(T.collapse_repeats("t"), "der Der Größe größe größe war") == "der Größe war"
    assert one(T.strip_signature("t"), "Text Mit freundlichen Grüßen X") == "Text "
    assert one(T.normalise_punct("t"), "a...b--c,,d\r") == "a.b-cd"
    ids = spark.createDataFrame([(1,)], "n int")
    assert ids.select(T.padded_id("n"), T.padded_id("n", left=False)).first() == ("textNr000001", "textNr100000")
    ck = spark.createDataFrame([("Labels-epoch=08-val_loss=0.27-train_loss=0.24.ckpt",)], "t string")
    assert tuple(ck.select(*T.parse_checkpoint_name("t")).first()) == (8, 0.27, 0.24)


def test_sequence_encoder_fixture(spark):
    df = spark.createDataFrame([(0, ["a", "b", "a"]), (1, ["b", "a", "c"])], "id int, tokens array<string>")
    voc = V.fit_vocab(df, "tokens", ["id"])
    assert sorted((r.idx, r.token) for r in voc.collect()) == [(0, "<PAD>"), (1, "<UNK>"), (2, "a"), (3, "b"),
                                                               (4, "c")]
    x = spark.createDataFrame([(9, ["a", "z", "c"])], "id int, tokens array<string>")
    enc = V.encode(x, ["id"], "tokens", voc, 5)
    assert enc.first().ids == [2, 0, 4, 0, 0]
    assert V.decode(enc, ["id"], "ids", voc).first().tokens == ["a", "c"]


def test_label_fixtures(spark):
    s = spark.createDataFrame([("3",), (" 4 ",), ("3.7",), (None,), ("x",), ("-1",)], "l string")
    assert [r[0] for r in s.select(P.cast_label("l", "string")).collect()] == [3, 4, -1, -1, -1, -1]
    d = spark.createDataFrame([(3.7,), (float("nan"),)], "l double")
    assert [r[0] for r in d.select(P.cast_label("l", "double")).collect()] == [3, -1]
    m = spark.createDataFrame([(i,) for i in range(5)], "l int")
    assert [r[0] for r in m.select(P.merge_classes("l", [(0, 1), (2, 3, 4)])).collect()] == [0, 0, 2, 2, 2]


def test_kfold_and_oversample(spark):
    ten = spark.range(10).withColumnRenamed("id", "i")
    f = P.kfold(ten, ["i"], 3).groupBy("fold").agg(F.count("*").alias("n"), F.min("i").alias("lo"))
    assert sorted((r.fold, r.n, r.lo) for r in f.collect()) == [(0, 4, 0), (1, 3, 4), (2, 3, 7)]
    rows = [(i, 0) for i in range(4)] + [(10 + i, 1) for i in range(2)] + [(20, 2)]
    o = P.oversample(spark.createDataFrame(rows, "id int, label int"), "label", "id")
    assert sorted((r.label, r["count"]) for r in o.groupBy("label").count().collect()) == [(0, 4), (1, 4), (2, 4)]


def test_threshold_grid():
    g = threshold_grid()
    assert len(g) == 31 and g[21] == 0.41 and g[0] == 0.2 and g[-1] == 0.5
    assert not math.isclose(g[21], 0.4100000000000002, rel_tol=0, abs_tol=0)


def test_find_all_matches_python(spark):
    import re
    texts = [(1, "the cat and the hat; there they go"), (2, "nothing here"), (3, "thththe")]
    df = spark.createDataFrame(texts, "id int, text string")
    for kw, regex in [("the", False), ("th[a-z]", True), ("a.d", True)]:
        got = sorted((r.id, r.start, r.stop) for r in T.find_all(df, "id", "text", kw, regex=regex).collect())
        pat = kw if regex else re.escape(kw)
        want = sorted((i, m.start(), m.end()) for i, t in texts for m in re.finditer(pat, t))
        assert got == want, kw
