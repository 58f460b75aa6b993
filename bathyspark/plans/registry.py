"""All registered queries: name -> (spark callable, DuckDB oracle SQL or None).

Each area module exposes ``QUERIES`` (name -> fn(spark, sf_dir) -> DataFrame)
and ``ORACLE`` (name -> SQL text run by DuckDB over the raw tables).
"""

from __future__ import annotations

from importlib import import_module

AREAS = [
    "bathyspark.plans.q_sources",
    "bathyspark.plans.q_filters",
    "bathyspark.plans.q_stats",
    "bathyspark.plans.q_shape",
    "bathyspark.plans.q_ingest",
    "bathyspark.plans.q_questions",
    "bathyspark.plans.q_vectors",
]


def _modules():
    return [import_module(name) for name in AREAS]


def queries() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.ORACLE)
    return out
