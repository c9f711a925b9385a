"""Training-run logs derived from ``events``: run names, checkpoint names,
best-epoch loss table, top runs, run folders and CSV export."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexikon.functions.text import compose_label, parse_checkpoint_name, parse_run_name
from lexikon.operators.index import with_row_index
from lexikon.plans.common import r6, table
from lexikon.sources import logs as L
from lexikon.sources.files import scratch_dir, write_csv

TOKENIZERS = ["bpe", "wordpiece", "unigram", "wordlevel"]
VOCABS = [1000, 8000, 16000, 32000]


def run_log(spark, sf_dir):
    """One log entry per event: run from the user, 2-4 entries per epoch,
    train entries carry ``loss``, eval entries ``eval_loss``."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    u = F.col("user_id")
    training = F.when(u % 2 == 0, "mlm").otherwise("clm")
    tok = F.element_at(F.array(*[F.lit(t) for t in TOKENIZERS]), (u % 4 + 1).cast("int"))
    vocab = F.element_at(F.array(*[F.lit(v) for v in VOCABS]), (F.floor(u / 4) % 4 + 1).cast("int"))
    best = (u % 9 + 1).cast("int")
    run = F.concat_ws("_", training, tok, vocab.cast("string"), F.concat(F.lit("u"), u.cast("string")),
                      F.lpad(best.cast("string"), 2, "0"))
    ev = ev.select("event_id", "user_id", run.alias("run"), vocab.cast("bigint").alias("vocab_size"),
                   F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"))
    idx = with_row_index(ev, ["_t", "event_id"], "entry_no", partition_by=["user_id"])
    k = (F.col("user_id") % 3 + 2)
    n = F.col("entry_no")
    return idx.select(
        "run", "user_id", "vocab_size", "entry_no",
        (F.floor(n / k) + (n % k) / k).cast("double").alias("epoch"),
        F.when(n % 2 == 0, (F.col("event_id") % 89) / 100.0).alias("loss"),
        F.when(n % 2 == 1, (F.col("event_id") % 97) / 100.0).alias("eval_loss"),
        (n + 1).alias("step"))


def run_names(spark, sf_dir):
    runs = run_log(spark, sf_dir).select("run", "vocab_size").distinct()
    p = runs.select("run", "vocab_size", *parse_run_name(F.concat(F.lit("/runs/"), "run", F.lit("/"))))
    return p.select("run", "best_epoch", "training_type", "tokenizer_type",
                    compose_label("tokenizer_type", "training_type", F.col("vocab_size").cast("string"))
                    .alias("label"))


def run_loss_table(spark, sf_dir):
    log = run_log(spark, sf_dir)
    parsed = log.withColumn("best_epoch", F.right("run", F.lit(2)).cast("int"))
    sel = L.best_checkpoint_entries(parsed)
    m = L.merge_entries(sel, ["loss", "eval_loss", "step", "vocab_size"])
    return m.select("run", F.col("epoch").cast("int").alias("epoch"), r6("loss").alias("loss"),
                    r6("eval_loss").alias("eval_loss"), "step", "vocab_size")


def _checkpoints(spark, sf_dir):
    log = run_log(spark, sf_dir).withColumn("ep", F.floor("epoch").cast("int"))
    per = log.groupBy("run", "ep").agg(F.max("eval_loss").alias("v"), F.max("loss").alias("t"))
    per = per.where(F.col("v").isNotNull() & F.col("t").isNotNull())
    name = F.concat(F.lit("Labels-epoch="), F.lpad(F.col("ep").cast("string"), 2, "0"),
                    F.lit("-val_loss="), F.format_string("%.2f", "v"),
                    F.lit("-train_loss="), F.format_string("%.2f", "t"), F.lit(".ckpt"))
    return per.select("run", name.alias("name"))


def checkpoint_names(spark, sf_dir):
    c = _checkpoints(spark, sf_dir)
    return c.select("run", "name", *parse_checkpoint_name("name"))


def top_runs(spark, sf_dir):
    c = checkpoint_names(spark, sf_dir)
    return c.orderBy("val_loss", "run", "name").limit(10).select("run", "name", "val_loss")


def training_runs(spark, sf_dir):
    """Write run folders the way Spark partitions them, read them back."""
    root = scratch_dir(spark, "runs")
    log = run_log(spark, sf_dir).withColumn("ep", F.floor("epoch").cast("int"))
    entry = F.struct("epoch", "loss", "eval_loss", F.lit(None).cast("double").alias("learning_rate"),
                     F.col("step").cast("bigint").alias("step"))
    # one trainer-state line per (run, epoch): a group bounded by the entries of one epoch
    state = log.groupBy("run", "ep").agg(F.array_sort(F.collect_list(F.struct("entry_no", entry.alias("e")))).alias("_l"))
    L.write_run_folders(state.select("run", F.transform("_l", lambda x: x["e"]).alias("log_history")), f"{root}/trainer_state")
    runs = log.groupBy("run").agg(F.first("vocab_size").alias("vocab_size"), F.avg("loss").alias("train_loss"),
                                  F.avg("eval_loss").alias("eval_loss"), F.max("epoch").alias("epoch"))
    runs = runs.repartition("run").persist()
    L.write_run_folders(runs.select("run", F.concat(F.lit("tokenizers/"), "run").alias("_name_or_path"), "vocab_size"),
                        f"{root}/config")
    L.write_run_folders(runs.select("run", "train_loss", "eval_loss", "epoch"), f"{root}/all_results")
    r = L.read_training_runs(spark, root, layout="partitioned")
    return r.groupBy("run").agg(F.count(F.lit(1)).alias("entries"), F.first("vocab_size").alias("vocab_size"),
                                F.first("_name_or_path").alias("name_or_path"),
                                F.max("final_epoch").alias("final_epoch"))


def loss_csv(spark, sf_dir):
    path = scratch_dir(spark, "loss_csv")
    write_csv(run_loss_table(spark, sf_dir), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("run", F.col("epoch").cast("int"), F.col("loss").cast("double"),
                       F.col("eval_loss").cast("double"), F.col("step").cast("bigint"),
                       F.col("vocab_size").cast("bigint"))


LOG = """lg AS (SELECT e.event_id, e.user_id,
        CASE WHEN user_id % 2 = 0 THEN 'mlm' ELSE 'clm' END || '_' || ['bpe','wordpiece','unigram','wordlevel'][user_id % 4 + 1]
        || '_' || CAST([1000, 8000, 16000, 32000][(user_id // 4) % 4 + 1] AS VARCHAR) || '_u' || CAST(user_id AS VARCHAR) || '_' || lpad(CAST(user_id % 9 + 1 AS VARCHAR), 2, '0') AS run,
        CAST([1000, 8000, 16000, 32000][(user_id // 4) % 4 + 1] AS BIGINT) AS vocab_size,
        CAST(user_id % 9 + 1 AS INTEGER) AS best_epoch, user_id % 3 + 2 AS k,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events e),
log AS (SELECT run, user_id, vocab_size, best_epoch, n AS entry_no, CAST(floor(n / k) + (n % k) / k AS DOUBLE) AS epoch,
        CASE WHEN n % 2 = 0 THEN (event_id % 89) / 100.0 END AS loss,
        CASE WHEN n % 2 = 1 THEN (event_id % 97) / 100.0 END AS eval_loss, n + 1 AS step FROM lg)"""

RLT = "WITH " + LOG + """,
e AS (SELECT *, CAST(floor(epoch) AS INTEGER) AS ep FROM log),
per AS (SELECT run, ep, count(*) AS cnt FROM e GROUP BY ALL),
runs AS (SELECT DISTINCT run, best_epoch FROM e),
tgt AS (SELECT r.run, CASE WHEN coalesce(p.cnt, 0) >= 2 THEN r.best_epoch ELSE r.best_epoch - 1 END AS t,
        coalesce(p.cnt, 0) AS bc FROM runs r LEFT JOIN per p ON p.run = r.run AND p.ep = r.best_epoch),
sel AS (SELECT e.*, bc, row_number() OVER (PARTITION BY e.run, e.ep ORDER BY entry_no) AS a,
        row_number() OVER (PARTITION BY e.run, e.ep ORDER BY entry_no DESC) AS d
        FROM e JOIN tgt ON e.run = tgt.run AND e.ep = tgt.t),
kept AS (SELECT * FROM sel WHERE CASE WHEN bc = 3 THEN a <= 2 WHEN bc >= 4 THEN d <= 2 WHEN bc = 2 THEN true
         ELSE d <= 2 END),
m AS (SELECT run, max(ep) AS epoch, arg_max(loss, entry_no) FILTER (WHERE loss IS NOT NULL) AS loss,
      arg_max(eval_loss, entry_no) FILTER (WHERE eval_loss IS NOT NULL) AS eval_loss, max(step) AS step,
      max(vocab_size) AS vocab_size FROM kept GROUP BY run)
SELECT run, CAST(epoch AS INTEGER) AS epoch, round(loss, 6) AS loss, round(eval_loss, 6) AS eval_loss,
       CAST(step AS BIGINT) AS step, vocab_size FROM m"""

CKPT = "WITH " + LOG + """,
per AS (SELECT run, CAST(floor(epoch) AS INTEGER) AS ep, max(eval_loss) AS v, max(loss) AS t FROM log GROUP BY ALL),
c AS (SELECT run, 'Labels-epoch=' || lpad(CAST(ep AS VARCHAR), 2, '0') || '-val_loss=' || printf('%.2f', v)
      || '-train_loss=' || printf('%.2f', t) || '.ckpt' AS name, ep AS epoch, v, t FROM per
      WHERE v IS NOT NULL AND t IS NOT NULL)"""

QUERIES = {
    "run_names": (run_names, "WITH " + LOG + """ SELECT DISTINCT run, CAST(right(run, 2) AS INTEGER) AS best_epoch,
        split_part(run, '_', 1) AS training_type, split_part(run, '_', 2) AS tokenizer_type,
        split_part(run, '_', 2) || '_' || split_part(run, '_', 1) || '_' || CAST(vocab_size AS VARCHAR) AS label FROM lg"""),
    "run_loss_table": (run_loss_table, RLT),
    "checkpoint_names": (checkpoint_names, CKPT + """ SELECT run, name, CAST(epoch AS INTEGER) AS epoch,
        CAST(printf('%.2f', v) AS DOUBLE) AS val_loss, CAST(printf('%.2f', t) AS DOUBLE) AS train_loss FROM c"""),
    "top_runs": (top_runs, CKPT + """ SELECT run, name, CAST(printf('%.2f', v) AS DOUBLE) AS val_loss FROM c
        ORDER BY val_loss, run, name LIMIT 10"""),
    "training_runs": (training_runs, "WITH " + LOG + """ SELECT run, count(*) AS entries, any_value(vocab_size) AS vocab_size,
        'tokenizers/' || run AS name_or_path, max(epoch) AS final_epoch FROM log GROUP BY run"""),
    "loss_csv": (loss_csv, RLT),
}
