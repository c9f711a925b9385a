"""Text folders, JSON datasets, CSV and Parquet sinks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexikon.session import checkpoint_dir

LATIN1 = "ISO-8859-1"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder (never machine-local
    on a cluster), one per call."""
    return os.path.join(checkpoint_dir(spark), "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def read_text_dir(spark: SparkSession, path: str, glob: str = "*.txt", encoding: str = LATIN1,
                  recursive: bool = True) -> DataFrame:
    """S3: one row per file ``(path, text)``, decoded with ``encoding``."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.load(path).select("path", F.decode(F.col("content"), encoding).alias("text"))


def file_path() -> Column:
    """Path of the file a row was read from, as it is named: the metadata column holds an encoded URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_text_lines(spark: SparkSession, path: str, glob: str = "*.txt", encoding: str = "UTF-8",
                    recursive: bool = True) -> DataFrame:
    """S3, line mode (tokenizer corpora): one row per line, splittable files.
    The text source keeps a line's bytes as they are; any encoding whose line
    end is the byte 0x0A (UTF-8, Latin-1 and their kin) is decoded after it.
    Blank lines stay, whatever the encoding."""
    r = spark.read.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    line = F.col("value")
    if encoding.upper().replace("-", "") != "UTF8":
        line = F.decode(line.cast("binary"), encoding)
    return r.text(path).select(file_path().alias("path"), line.alias("line"))


def write_text_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``(new_path, text)`` kept as a Parquet table (the cluster-friendly
    form of one small file per text)."""
    df.write.mode(mode).parquet(path)


def read_labeled_json(spark: SparkSession, path: str, schema: StructType | str,
                      wrapped: bool = False) -> DataFrame:
    """JSON lines ``{text, label}``; with ``wrapped`` every record is a
    ``{"data": [...]}`` object whose items become rows."""
    if not wrapped:
        return spark.read.schema(schema).json(path)
    item = schema if isinstance(schema, str) else schema.simpleString()
    w = spark.read.schema(f"data array<{_struct(item)}>").json(path)
    return w.select(F.explode("data").alias("d")).select("d.*")


def read_double_json(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """Every line is a JSON *string* that holds a ``{"data": [...]}``
    document; decode twice and explode."""
    raw = spark.read.text(path)
    # a top-level JSON string is decoded as the only element of a JSON array
    inner = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<string>")[0]
    doc = F.from_json(inner, f"data array<{_struct(item_schema)}>")
    return raw.select(F.explode(doc["data"]).alias("d")).select("d.*")


def _struct(s: str) -> str:
    """``'text string, label array<int>'`` -> ``struct<text:string,label:array<int>>``."""
    s = s.strip()
    if s.startswith("struct<"):
        return s
    fields, depth, cur = [], 0, ""
    for ch in s:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            fields.append(cur)
            cur = ""
        else:
            cur += ch
    fields.append(cur)
    return "struct<" + ",".join(":".join(f.strip().split(None, 1)) for f in fields) + ">"


def write_labeled_dataset(df: DataFrame, path: str, overwrite: bool = True, lower: bool = False,
                          text_cols: tuple[str, ...] = ("text", "diagnose")) -> DataFrame:
    """Write ``(text[, diagnose], label)``; an existing dataset is kept
    unless ``overwrite`` (Spark ``ignore`` mode), texts optionally lower-cased."""
    out = df.select(*[F.lower(c).alias(c) if (lower and c in text_cols) else F.col(c) for c in df.columns])
    out.write.mode("overwrite" if overwrite else "ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, no index column."""
    df.write.mode("overwrite").option("header", True).csv(path)
