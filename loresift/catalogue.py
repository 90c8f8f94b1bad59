"""Every query of the engine with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loresift.plans import activity, coverage, evaluation, maintenance, parsing, search

_PLANS = (search, evaluation, maintenance, activity, parsing, coverage)


def _wide(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Ranks and places as 64-bit numbers, as SQL gives them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: df[c].cast("long") for c in ("rank", "place") if c in df.columns})

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to a function of (session, folder of the tables)."""
    return {name: _wide(f) for plan in _PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
