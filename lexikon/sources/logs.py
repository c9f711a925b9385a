"""Score logs, metric tables and training-run folders."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lexikon.sources.files import file_path


def _read_or_none(spark: SparkSession, path: str, fmt: str = "json", schema: str | None = None):
    try:
        r = spark.read.format(fmt)
        if schema:
            r = r.schema(schema)
        return r.load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def dedupe_names(new: DataFrame, existing: DataFrame | None, name: str = "name") -> DataFrame:
    """S9 naming: a new name contained (as a substring) in n > 0 logged names
    becomes ``name_<n+1>``.  The substrings of a logged name that have the length
    of some new name are exploded, so the match is an equi-join."""
    if existing is None:
        return new
    names = existing.select(F.col(name).alias("_old")).where(F.col("_old").isNotNull())
    wanted = new.select(F.col(name).alias("_new")).where(F.col(name).isNotNull()).distinct()
    lengths = [r[0] for r in wanted.select(F.length("_new")).distinct().collect()]  # at most the longest name
    n = F.length("_old")

    def pieces(k: int):
        at = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
        return F.when(n >= k, F.transform(at, lambda i: F.substring(F.col("_old"), i, F.lit(k))))

    parts = [pieces(k) for k in lengths]
    inside = F.array_distinct(F.flatten(F.array_compact(F.array(*parts)))) if parts else F.array().cast("array<string>")
    hits = (names.select(F.explode(inside).alias("_new")).groupBy("_new").agg(F.count(F.lit(1)).alias("_same"))
            .join(wanted, "_new", "left_semi"))
    out = new.join(hits, new[name] == hits["_new"], "left")
    renamed = F.when(F.col("_same") > 0, F.concat(F.col(name), F.lit("_"), (F.col("_same") + 1).cast("string"))) \
        .otherwise(F.col(name))
    return out.withColumn(name, renamed).drop("_new", "_same")


def append_scores(spark: SparkSession, scores: DataFrame, log_path: str, schema: str) -> DataFrame:
    """Append one JSON line per model to the score log, renaming names
    that already occur; returns the rows written."""
    existing = _read_or_none(spark, log_path, "json", schema)
    out = dedupe_names(scores, existing)
    out.write.mode("append").json(log_path)
    return out


def metric_file_name(label_set: str) -> str:
    """S10 naming: ``<set>_Diagnosis`` with ``KMeans -> kmeans``, ``d2v -> doc2vec``."""
    return (label_set + "_Diagnosis").replace("KMeans", "kmeans").replace("d2v", "doc2vec")


def upsert_metric(table: DataFrame | None, metric: str, value, key: str = "metric",
                  value_col: str = "value") -> DataFrame | None:
    """Set row ``metric`` of a (metric, value) table -- replaced if present,
    appended otherwise; a missing table stays missing (no-op)."""
    if table is None:
        return None
    spark = table.sparkSession
    new = spark.createDataFrame([(metric, float(value))], f"{key} string, {value_col} double")
    return table.where(F.col(key) != metric).unionByName(new)


class MetricTables:
    """S10, stored: one (metric, value) table for each label set, below ``root``.

    A change writes the whole table as a new version and then points to it with one
    small file, which Spark writes under a name of its own; the newest pointer holds, so
    a change that fails halfway leaves the table as it was and the next one goes on
    from what is stored.
    """

    SCHEMA = "metric string, value double"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        spark.createDataFrame([], "table string, version long, path string").write.mode("append").parquet(f"{root}/current")

    def _current(self) -> DataFrame:
        now = self.spark.read.schema("table string, version long, path string").parquet(f"{self.root}/current")
        return now.groupBy("table").agg(F.max(F.struct("version", "path")).alias("at")).select("table", "at.version", "at.path")

    def _put(self, name: str, version: int, rows: DataFrame) -> None:
        path = f"{self.root}/versions/{name}-{version}-{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(path)
        self.spark.createDataFrame([(name, version, path)], "table string, version long, path string") \
            .coalesce(1).write.mode("append").parquet(f"{self.root}/current")

    def create(self, label_set: str, rows: list[tuple[str, float]]) -> None:
        self._put(metric_file_name(label_set), 0, self.spark.createDataFrame(rows, self.SCHEMA))

    def read(self, label_set: str) -> DataFrame | None:
        """The table as it stands, or None if there is none."""
        at = self._current().where(F.col("table") == metric_file_name(label_set)).first()
        return at and self.spark.read.schema(self.SCHEMA).parquet(at["path"])

    def upsert(self, label_set: str, metric: str, value: float) -> None:
        """Replaces or adds a row; without a table nothing happens."""
        name = metric_file_name(label_set)
        at = self._current().where(F.col("table") == name).first()
        if at:
            stored = self.spark.read.schema(self.SCHEMA).parquet(at["path"])
            self._put(name, at["version"] + 1, upsert_metric(stored, metric, value))

    def read_all(self) -> DataFrame:
        """(metric, value, table) of all tables as they stand."""
        out = self.spark.createDataFrame([], self.SCHEMA + ", table string")
        for at in self._current().orderBy("table").collect():  # one row a label set
            out = out.unionByName(self.spark.read.schema(self.SCHEMA).parquet(at["path"]).withColumn("table", F.lit(at["table"])))
        return out


def _folder(run: str | None) -> str:
    """``run=<name>`` as Spark names partition folders."""
    if not run:
        return "run=__HIVE_DEFAULT_PARTITION__"
    return "run=" + re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", run)


def write_run_folders(df: DataFrame, path: str) -> None:
    """S11, the partitioned layout: all columns but ``run`` as JSON lines in ``path/run=<run>/part-*.json``.

    Hadoop's local file system starts a process for the permissions of every file it makes, so in a mounted
    folder (``file:``) the tasks make the files themselves, each under a name of the attempt that becomes the
    file's own when it is whole; any other file system gets Spark's writer."""
    placed = df.repartition("run")  # one file per run folder
    if not path.startswith("file:"):
        placed.write.partitionBy("run").json(path)
        return
    root = "/" + path.removeprefix("file:").lstrip("/")
    os.makedirs(root, exist_ok=True)
    line = F.to_json(F.struct(*[c for c in df.columns if c != "run"]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, out, at = f"_{uuid.uuid4().hex}", None, None
        for b in batches:
            for run, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None or _folder(run) != at:
                    if out is not None:
                        out.close()
                        os.replace(f"{root}/{at}/{attempt}", f"{root}/{at}/part-00000.json")
                    at = _folder(run)
                    os.makedirs(f"{root}/{at}", exist_ok=True)
                    out = open(f"{root}/{at}/{attempt}", "w", encoding="utf-8", newline="\n")
                out.write(text + "\n")
        if out is not None:
            out.close()
            os.replace(f"{root}/{at}/{attempt}", f"{root}/{at}/part-00000.json")
        yield from ()

    placed.select("run", line.alias("line")).sortWithinPartitions("run").mapInArrow(write, "none int").count()


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed in four tasks a core: with the default of up to 10,000, each of a few folders,
    starting a task takes many times longer than listing them."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_training_runs(spark: SparkSession, root: str, layout: str = "folders") -> DataFrame:
    """``trainer_state.json``, ``config.json`` and ``all_results.json`` per
    run folder, joined on the run folder; runs missing a file are skipped.

    ``layout="folders"``: ``root/<run>/<file>.json`` (multi-line documents).
    ``layout="partitioned"``: ``root/<file>/run=<run>/*.json`` as Spark writes
    it (JSON lines; a trainer state may be split over several lines)."""
    def load(kind: str, schema: str) -> DataFrame:
        if layout == "folders":
            df = (spark.read.option("multiLine", True).schema(schema)
                  .json(f"{root}/*/{kind}.json")
                  .withColumn("run", F.element_at(F.split(file_path(), "/"), -2)))
        else:
            with _few_listing_tasks(spark):
                df = spark.read.schema(schema + ", run string").json(f"{root}/{kind}")
        return df

    state = load("trainer_state", "log_history array<struct<epoch:double,loss:double,eval_loss:double,"
                                  "learning_rate:double,step:bigint>>")
    config = load("config", "_name_or_path string, vocab_size bigint")
    results = load("all_results", "train_loss double, eval_loss double, epoch double")
    entries = state.select("run", F.posexplode("log_history").alias("_pos", "e"))
    log = entries.select("run", F.col("e.*"), F.col("_pos"), file_path().alias("_file")) \
        if layout == "folders" else entries.select("run", "e.*", "_pos")
    runs = config.select("run", "_name_or_path", "vocab_size").join(
        results.select("run", F.col("train_loss").alias("final_train_loss"),
                       F.col("eval_loss").alias("final_eval_loss"), F.col("epoch").alias("final_epoch")), "run")
    return log.join(runs, "run")


def best_checkpoint_entries(log: DataFrame, best: str = "best_epoch", entry: str = "entry_no") -> DataFrame:
    """E26 selection for every run: entries whose floored epoch equals the
    best epoch; 3 -> first two, >= 4 -> last two, 2 -> both, otherwise the
    last two of the epoch before.  Groups are (run, epoch): bounded by the
    entries logged per epoch."""
    e = log.withColumn("_ep", F.floor("epoch").cast("int"))
    per = e.groupBy("run", "_ep").agg(F.count(F.lit(1)).alias("_cnt"))
    runs = e.select("run", best).distinct()
    sizes = runs.join(per.withColumnRenamed("_ep", best), ["run", best], "left").fillna(0, ["_cnt"])
    target = sizes.select("run", F.when(F.col("_cnt") >= 2, F.col(best)).otherwise(F.col(best) - 1).alias("_t"),
                          F.col("_cnt").alias("_bc"))
    sel = e.join(target, (e["run"] == target["run"]) & (e["_ep"] == target["_t"])).drop(target["run"])
    w = Window.partitionBy("run", "_ep")
    sel = (sel.withColumn("_a", F.row_number().over(w.orderBy(entry)))
           .withColumn("_d", F.row_number().over(w.orderBy(F.desc(entry)))))
    keep = (F.when(F.col("_bc") == 3, F.col("_a") <= 2).when(F.col("_bc") >= 4, F.col("_d") <= 2)
            .when(F.col("_bc") == 2, F.lit(True)).otherwise(F.col("_d") <= 2))
    return sel.where(keep).drop("_a", "_d", "_bc", "_t")


def merge_entries(sel: DataFrame, fields: list[str], entry: str = "entry_no") -> DataFrame:
    """E26 merge: the kept entries of a run become one row; a field takes the
    value of the latest entry that has it; epoch is floored."""
    aggs = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(entry))).alias(f) for f in fields]
    return sel.groupBy("run").agg(F.max("_ep").alias("epoch"), *aggs)
