"""Registry of the runnable queries: each with its check SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.testdata import Tables, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = (),
          recursive: bool = False):
    """Register a function of `Tables` under a name; `sql` is its check."""
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = duck(sql, *tables, recursive=recursive)
        return build
    return register


def text(c: str, alias: str | None = None) -> Column:
    """A date as text, which every engine prints alike."""
    return F.col(c).cast("string").alias(alias or c)


def micros(c: str, alias: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")).alias(alias)


def load_all() -> None:
    from tidemark.plans import (  # noqa: F401
        catalog_ingest, catalog_metrics, catalog_state, catalog_streams, catalog_telemetry,
    )
