"""Operators of a large training-data pipeline; nothing else in the library imports them."""


def registry() -> dict:
    """Query name -> (builder, DuckDB SQL or None)."""
    import corpus_pipeline
    from lexikon.llm.queries import QUERIES
    return {**QUERIES, "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)}
