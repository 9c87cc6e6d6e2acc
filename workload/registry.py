"""Where the workload modules put their queries and check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens import load

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder, loaded on first use: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return load(self.spark, self.path(name), view=None)


def query(sql: str | None = None, as_double: tuple[str, ...] = ()):
    """Register a function of ``Tables``; its check SQL runs on the same tables.

    Integer columns with nulls are named in ``as_double``: data frames of the
    two engines would hold them in different types otherwise.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(Tables(spark, folder))
            return out.withColumns({c: F.col(c).cast("double") for c in as_double}) if as_double else out

        QUERIES[fn.__name__] = run
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in as_double)
            ORACLES[fn.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return fn

    return register
