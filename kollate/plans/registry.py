"""Named queries with the SQL that an independent engine checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kollate.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def works(self) -> DataFrame:
        return table(self.spark, self.folder, "era_research_outputs_canonical")

    @property
    def raw(self) -> DataFrame:
        return table(self.spark, self.folder, "era_research_outputs_raw")

    @property
    def index(self) -> DataFrame:
        return table(self.spark, self.folder, "scopus_shard")

    @property
    def trove(self) -> DataFrame:
        return table(self.spark, self.folder, "trove_title_candidates")


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its oracle."""

    def register(function):
        QUERIES[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register
