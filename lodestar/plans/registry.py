"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the DuckDB SQL that
computes the same table from the same Parquet files (the oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    from lodestar.plans import (  # noqa: F401
        evaluation, jsonq, relational, retrieval, scale, security, textq, changes, streams,
    )
