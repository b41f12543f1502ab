"""Registered queries: a Spark plan over the given tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship, spread, tune

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

_MARK = re.compile(r"\{(" + "|".join(TABLES) + r")\}")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one folder, as attributes, and inputs derived from them with SQL."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder.rstrip("/")
        ship(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def derive(self, text: str) -> DataFrame:
        """Run an input query; ``{table}`` marks stand for the given tables."""
        used = set(_MARK.findall(text))
        return self.spark.sql(text, **{name: spread(getattr(self, name)) for name in used})


def oracle_text(text: str) -> str:
    return _MARK.sub(r"\1", text)


def query(name: str, sql: str | None = None):
    """Register a plan ``f(tables)`` under a name, with its SQL."""

    def register(plan: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle_text(sql)
        return plan

    return register
