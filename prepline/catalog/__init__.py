"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus the DuckDB SQL that must
return the same rows. Query modules register themselves on import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    from prepline.catalog import (  # noqa: F401
        q_eval,
        q_features,
        q_flow,
        q_intent,
        q_io,
        q_models,
        q_plots,
        q_profile,
        q_rules,
        q_series,
    )
