"""Registered queries over the driver tables.

Each module exposes ``QUERIES``: name -> (builder(spark, sf_dir) -> DataFrame,
DuckDB SQL or None).  ``registry()`` merges them for ``__spark_entry__``.
"""

from __future__ import annotations

import importlib

_MODULES = ["knn", "splits", "labels", "evaluation", "curves", "text", "sections", "dedup",
            "vocab", "subwords", "sources", "models", "runs"]


def registry() -> dict:
    out: dict = {}
    for m in _MODULES:
        try:
            mod = importlib.import_module(f"lexikon.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name == f"lexikon.plans.{m}":
                continue
            raise
        for k, v in mod.QUERIES.items():
            assert k not in out, f"duplicate query {k}"
            out[k] = v
    return out
