"""Named queries (Spark DataFrame builders) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir) -> DataFrame` under `name`, with optional oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so that its queries register."""
    from textloom.plans import (  # noqa: F401
        bag_plans,
        bayes_plans,
        embed_plans,
        encode_plans,
        eval_plans,
        feature_plans,
        history_plans,
        ml_plans,
        profile_plans,
        split_plans,
        submit_plans,
        text_plans,
    )
