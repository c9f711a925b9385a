"""The corpus pipeline: documents through five of the operators of ``lexikon.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexikon.llm.common import aside, table, written
from lexikon.llm.decontam import decontaminate
from lexikon.llm.lines import dedup_lines
from lexikon.llm.mixing import mix_sources
from lexikon.llm.neardup import near_duplicates
from lexikon.llm.quality import score_quality

USED = ("doc_id", "text")


def _through(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operator`` over id and text; all other columns travel in a struct, so that none
    can clash with what it adds, and come out as they were."""
    rest = [c for c in docs.columns if c not in USED]
    held = docs.select(*USED, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest")) if rest else docs.select(*USED)
    out = operator(held)
    return out.select(*[F.col(c) if c in USED else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = table(spark, sf_dir, "labels")
    return _through(docs, lambda d: score_quality(d, labels).where("quality_kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document stays, with what is left of its text (and n_chars to match)."""
    out = _through(docs, dedup_lines)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays; a null id always does."""
    found = near_duplicates(docs.select(*USED))
    gone = found.where("id <> component").select(F.col("id").alias("gone")).distinct()
    return aside(docs, dict(zip(USED, USED, strict=True)), lambda d: d.join(gone, d["doc_id"] == gone["gone"], "left_anti"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    bench = table(spark, sf_dir, "benchmark")
    return _through(docs, lambda d: decontaminate(d, bench).where("NOT contaminated"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mixture takes."""
    return mix_sources(docs.select("doc_id", "source", "text"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", source_mixing),
]

#: The classifier's training cannot be written in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
