"""Registered queries: a Spark callable and, where SQL can say it, the same question for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Access to given tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, reads: list[str], oracle: str | None = None):
    """Register `fn(inputs) -> DataFrame`; `oracle` may use the tables and views in `reads`."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = with_views(reads, oracle)
        return fn

    return wrap
