"""Run folders, of which there are as many as runs."""
import os
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

USERS = 45


def _events(spark):
    rows = [(100 * u + i, u, datetime(2024, 1, 1) + timedelta(minutes=i)) for u in range(USERS) for i in range(u % 7 + 1)]
    d = tempfile.mkdtemp()
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").write.parquet(f"{d}/events.parquet")
    return d


def test_training_runs_lists_folders_in_few_tasks_and_makes_one_file_each(spark, monkeypatch):
    from lexikon.plans import runs
    root = tempfile.mkdtemp()
    monkeypatch.setattr(runs, "scratch_dir", lambda spark, name: f"file:{root}/{name}")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    sc, d, before = spark.sparkContext, _events(spark), spark.conf.get(key)
    sc.setJobGroup("run folders", "run folders")
    try:
        found = runs.training_runs(spark, d).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    expected = {}
    for u in range(USERS):
        n, k = u % 7, u % 3 + 2
        vocab = [1000, 8000, 16000, 32000][u // 4 % 4]
        run = f"{'clm' if u % 2 else 'mlm'}_{['bpe', 'wordpiece', 'unigram', 'wordlevel'][u % 4]}_{vocab}_u{u}_{u % 9 + 1:02}"
        expected[run] = (n + 1, vocab, f"tokenizers/{run}", round(n // k + n % k / k, 9))
    assert len(found) == USERS
    assert {r.run: (r.entries, r.vocab_size, r.name_or_path, round(r.final_epoch, 9)) for r in found} == expected
    for kind in ("trainer_state", "config", "all_results"):
        folders = {x for x in os.listdir(f"{root}/runs/{kind}") if not x.startswith(("_", "."))}
        assert folders == {f"run={run}" for run in expected}
        assert all(len(os.listdir(f"{root}/runs/{kind}/{x}")) == 1 for x in folders)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("run folders") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= 4 * sc.defaultParallelism < USERS
    assert spark.conf.get(key) == before


def test_written_run_folders_are_what_sparks_writer_makes(spark):
    from lexikon.sources.logs import write_run_folders
    names = ["a", "b c", "100%", "x=1/y:2", "Grüße", 'q"\'#*?{[]}^\\', None]
    rows = [(run, i, None if i % 2 else f"ä\n{run}") for run in names for i in range(5)]
    df = spark.createDataFrame(rows, "run string, i int, t string")
    root = tempfile.mkdtemp()
    df.repartition("run").write.partitionBy("run").json(f"{root}/plain")
    for _ in range(2):  # an attempt that is made again replaces what is there
        write_run_folders(df, f"file:{root}/own")
    with open(f"{root}/own/run=a/_left", "w") as f:  # by an attempt that failed
        f.write('{"i": 99}\n')
    folders = [{x for x in os.listdir(f"{root}/{d}") if x.startswith("run=")} for d in ("plain", "own")]
    assert folders[0] == folders[1]
    back = [sorted(map(str, spark.read.schema("i int, t string, run string").json(f"{root}/{d}").collect())) for d in ("plain", "own")]
    assert back[0] == back[1] and len(back[1]) == len(rows)


def test_no_run_at_all_is_an_empty_folder(spark):
    from lexikon.sources.logs import write_run_folders
    root = tempfile.mkdtemp()
    write_run_folders(spark.createDataFrame([], "run string, i int"), f"file:{root}/own")
    assert spark.read.schema("i int, run string").json(f"{root}/own").agg(F.count(F.lit(1))).first()[0] == 0
