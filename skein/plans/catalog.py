"""Registry of named queries (``spark, sf_dir -> DataFrame``) and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn`` under ``name``; ``oracle`` is equivalent DuckDB SQL over
    the input tables (omitted for operators SQL cannot express)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def load_all() -> None:
    from . import (q_json, q_memory, q_prompts, q_sampling, q_sources, q_stats,  # noqa: F401
                   q_streaming, q_text, q_tokens)
