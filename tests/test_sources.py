"""CoNLL reading (FIXTURES §4), bad lines, CRLF files; byte-level BPE symbols;
confusion-matrix name fallback."""

import os
import tempfile

from pyspark.sql import functions as F

from lexikon.operators import metrics as E
from lexikon.operators import subword as W
from lexikon.sources.conll import read_conll_dir

CONLL = "Das O\nGericht B-GRT\n\nin O\nKassel B-ST\n"


def _dir(files):
    d = tempfile.mkdtemp(prefix="lexikon-conll-")
    for name, text in files.items():
        with open(os.path.join(d, name), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return d


def _rows(df):
    return sorted((r.file, r.sent_no, r.predictors, r.labels) for r in df.collect())


def test_conll_fixture(spark):
    d = _dir({"bgh.v1.conll": CONLL, "notes.txt": "x y\n"})
    assert _rows(read_conll_dir(spark, d)) == [("bgh", 0, ["Das", "Gericht"], ["O", "B-GRT"]),
                                               ("bgh", 1, ["in", "Kassel"], ["O", "B-ST"])]


def test_conll_bad_lines_and_blank_runs(spark):
    d = _dir({"a.conll": "x O\n\n\n\nbad line here\ny O\n\nz B-X\n"})
    good, bad = read_conll_dir(spark, d, keep_bad=True)
    assert _rows(good) == [("a", 0, ["x"], ["O"]), ("a", 1, ["z"], ["B-X"])]
    assert [r.body for r in bad.collect()] == ["bad line here\ny O"]


def test_conll_crlf(spark):
    d = _dir({"bgh.v1.conll": CONLL.replace("\n", "\r\n")})
    assert _rows(read_conll_dir(spark, d, crlf=True)) == [("bgh", 0, ["Das", "Gericht"], ["O", "B-GRT"]),
                                                          ("bgh", 1, ["in", "Kassel"], ["O", "B-ST"])]


def test_byte_level_symbols(spark):
    w = spark.createDataFrame([("Grüße", 3)], "word string, freq long")
    syms = W.initial_symbols(w, byte_level=True).first().syms
    assert syms == [format(b, "02X") for b in "Grüße".encode("utf-8")]


def test_confusion_name_fallback(spark):
    df = spark.createDataFrame([("class0", "class1"), ("class1", "class1")], "y_true string, y_pred string")
    m = {(r.y_true, r.y_pred): r.value for r in E.confusion_matrix(E.confusion_counts(df, []), [], [0, 1]).collect()}
    assert m[("class0", "class1")] == 1.0 and m[("class1", "class1")] == 1.0


def test_run_folders(spark):
    """S11 over ``root/<run>/<file>.json``: entries of each run with its configuration and results; a run missing a file is skipped."""
    import json

    from lexikon.sources.logs import read_training_runs
    root = tempfile.mkdtemp()
    files = {"trainer_state": {"best_metric": 0.1, "log_history": [{"epoch": 0.5, "loss": 1.25, "step": 5}, {"epoch": 1.0, "eval_loss": 0.75, "step": 10}]},
             "config": {"_name_or_path": "base/model", "vocab_size": 100, "other": [1]},
             "all_results": {"train_loss": 0.5, "eval_loss": 0.75, "epoch": 1.0}}
    for run, kinds in (("run-a", files), ("run b", files), ("lost", ["config", "all_results"])):
        os.makedirs(f"{root}/{run}")
        for kind in kinds:
            with open(f"{root}/{run}/{kind}.json", "w") as f:
                json.dump(files[kind], f, indent=2)
    found = read_training_runs(spark, root)
    rows = sorted(tuple(r) for r in found.select(
        "run", "_pos", "epoch", "loss", "eval_loss", "step", "_name_or_path", "vocab_size", "final_train_loss").collect())
    assert rows == [(run, pos, *entry, "base/model", 100, 0.5) for run in ("run b", "run-a")
                    for pos, entry in enumerate([(0.5, 1.25, None, 5), (1.0, None, 0.75, 10)])]


def test_remap_keeps_others(spark):
    from lexikon.operators.vocab import remap_ids
    df = spark.createDataFrame([([1, 0, 1, 7],), ([],), (None,)], "v array<int>")
    got = df.select(remap_ids(F.col("v"), [30, 20, 10, 0]).alias("a"), remap_ids(F.col("v"), [30, 20, 10, 0], True).alias("b")).collect()
    assert [tuple(r) for r in got] == [([30, -1, 10, -1], [30, 0, 10, 7]), ([], []), (None, None)]


def test_sequences_to_tokens_and_fold_split(spark):
    from lexikon.operators.datasets import fold_split
    from lexikon.operators.metrics import flatten_sequences
    df = spark.createDataFrame([(0, ["O", "B"], ["O", "O"]), (1, ["B"], ["B"]), (2, [], [])], "fold int, t array<string>, p array<string>")
    tokens = flatten_sequences(df, ["fold"], "t", "p")
    assert sorted(map(tuple, tokens.collect())) == [(0, "B", "O"), (0, "O", "O"), (1, "B", "B")]
    rest, test = fold_split(df, "fold", 1)
    assert sorted(r.fold for r in rest.collect()) == [0, 2] and [r.fold for r in test.collect()] == [1]


def test_both_text_modes_name_files_alike(spark):
    from lexikon.sources.files import read_text_dir, read_text_lines
    names = ["a b.txt", "a+b.txt", "100%.txt", "Grüße.txt"]
    d = _dir({name: "Gr\xfc\xdfe\nzwei" for name in names})
    whole = {r.path.split("/")[-1]: r.text for r in read_text_dir(spark, d, encoding="UTF-8").collect()}
    lines = read_text_lines(spark, d).collect()
    assert sorted(whole) == sorted(names) and {r.path.split("/")[-1] for r in lines} == set(names)
    assert sorted(r.line for r in lines) == ["Gr\xfc\xdfe"] * 4 + ["zwei"] * 4
