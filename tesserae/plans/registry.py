"""Pairs each catalogued query with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with optional SQL."""

    def __init__(self) -> None:
        self.plans: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(plan: Query) -> Query:
            if name in self.plans:
                raise ValueError(f"query {name} is registered twice")
            self.plans[name] = plan
            if sql:
                self.sql[name] = sql
            return plan

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
