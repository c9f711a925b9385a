"""CoNLL token/label files.

One Spark record per sentence: the text source splits on blank lines
(``lineSep = "\\n\\n"``), so large files stay splittable and a sentence is
never cut (the record reader finishes a record across a split end).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexikon.operators.index import with_row_index


def read_conll_dir(spark: SparkSession, path: str, glob: str = "*.conll", recursive: bool = False,
                   keep_bad: bool = False, crlf: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """``(file, sent_no, predictors, labels)`` for every sentence of every
    matching file; ``file`` is the name up to the first dot (or a partition
    column ``file`` when the folder is partitioned so).  A line that is not
    exactly ``token SP label`` makes its sentence go to the bad output
    (returned with ``keep_bad``) instead of failing the job."""
    if crlf:
        raw = _read_crlf(spark, path, glob, recursive)
    else:
        reader = spark.read.option("lineSep", "\n\n").option("pathGlobFilter", glob)
        if recursive:
            reader = reader.option("recursiveFileLookup", "true")
        raw = reader.text(path)
    if crlf:
        recs = raw
    else:
        file_col = F.col("file") if "file" in raw.columns else F.split_part(
            F.col("_metadata.file_name"), F.lit("."), F.lit(1))
        recs = raw.select(file_col.alias("file"), F.col("_metadata.file_path").alias("_path"),
                          F.col("_metadata.file_block_start").alias("_blk"),
                          F.monotonically_increasing_id().alias("_mid"), "value")
    recs = recs.select("file", "_path", "_blk", "_mid",
                      F.regexp_replace(F.col("value"), r"^[\r\n]+|[\r\n]+$", "").alias("body"))
    recs = recs.where(F.length("body") > 0)
    lines = F.split(F.col("body"), r"\r?\n", -1)
    parts = F.transform(lines, lambda ln: F.split(ln, " ", -1))
    ok = F.forall(parts, lambda p: F.size(p) == 2)
    parsed = recs.select("file", "_path", "_blk", "_mid", ok.alias("_ok"),
                         F.transform(parts, lambda p: F.trim(p[0])).alias("predictors"),
                         F.transform(parts, lambda p: F.trim(F.regexp_replace(p[1], r"\s+$", ""))).alias("labels"),
                         "body")
    good = parsed.where("_ok")
    indexed = _index(good)
    out = indexed.select("file", F.col("sent_no").cast("int"), "predictors", "labels")
    if keep_bad:
        return out, parsed.where(~F.col("_ok")).select("file", "body")
    return out


def _read_crlf(spark: SparkSession, path: str, glob: str, recursive: bool) -> DataFrame:
    """Files with CRLF line ends: whole files through ``binaryFile`` (one row
    per file), line ends normalised, then one row per sentence with its
    position in the file."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    files = r.load(path).select("path", F.replace(F.decode("content", "UTF-8"), F.lit("\r\n"), F.lit("\n"))
                                .alias("t"))
    sents = files.select("path", F.posexplode(F.split("t", "\n\n", -1)).alias("_mid", "value"))
    name = F.element_at(F.split("path", "/"), -1)
    return sents.select(F.split_part(name, F.lit("."), F.lit(1)).alias("file"), F.col("path").alias("_path"),
                        F.lit(0).cast("long").alias("_blk"), F.col("_mid").cast("long"), "value")


def _index(good: DataFrame) -> DataFrame:
    """Sentence number inside ``file`` in (path, split start, position) order.

    Rows are numbered per (file, path) with the split start as range key, so
    a big file is numbered in many tasks; the per-path offsets are one row
    per file path (small, broadcast)."""
    idx = with_row_index(good, [F.col("_blk"), F.col("_mid")], "_i", partition_by=["file", "_path"],
                         count_name="_n")
    paths = idx.groupBy("file", "_path").agg(F.first("_n").alias("_n"))
    w = Window.partitionBy("file").orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    offs = paths.select("file", "_path", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (idx.join(offs, ["file", "_path"])
            .withColumn("sent_no", F.col("_i") + F.col("_off")).drop("_i", "_n", "_off"))


def sentences_to_conll_text(df: DataFrame, tokens: str, labels: str) -> DataFrame:
    """The inverse: one text record per sentence, ``token SP label`` lines and
    a blank line after the sentence (for ``DataFrame.write.text``)."""
    lines = F.zip_with(F.col(tokens), F.col(labels), lambda t, lab: F.concat(t, F.lit(" "), lab))
    return df.select(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value"), *[
        c for c in df.columns if c not in (tokens, labels)])
