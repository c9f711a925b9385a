import pytest


@pytest.fixture()
def docs_of(spark):
    """A documents table from (doc_id, text[, lang, source]) rows, with columns that clash with results."""
    def make(rows, clash=True):
        full = [(*r, *([None] * (4 - len(r)))) for r in rows]
        df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string")
        if clash:
            from pyspark.sql import functions as F
            for c in ("n_words", "contaminated", "n_lines", "n_dropped", "spans", "kept", "id", "component", "size", "host",
                      "quality_score", "lang_pred", "_rest"):
                df = df.withColumn(c, F.lit("mine"))
        return df.repartition(3)
    return make
