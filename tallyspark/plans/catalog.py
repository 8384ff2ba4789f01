"""All registered queries: a callable for Spark and, where SQL can say it, DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a callable ``(spark, sf_dir)`` under its name, and its SQL."""

    def put(run):
        key = name or run.__name__
        assert key not in QUERIES, key
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = oracle
        return run

    return put


def load() -> None:
    """Import the modules that register queries."""
    from . import adjudication_queries, alignment_queries, corpus_queries, evidence_queries, metric_queries, record_queries, text_queries  # noqa: F401
