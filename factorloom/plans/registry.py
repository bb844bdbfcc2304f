"""The queries of the factor-risk operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.plans import sql as views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, select: str | None = None, ctes: str = "", floats: str = "", digits: int = 6, dates: str = "", markets: bool = False, series: str = "") -> Callable[[Query], Query]:
    """Register a query, and the SQL for its rows where there is any.

    `floats` are the columns rounded to `digits` on both sides: sums of floating-point numbers differ
    in their last bits with the order of the rows. `dates` are given as text on both sides. With `markets` the
    statement's series are the markets, with `series` those that it defines.
    """
    names = floats.split()

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            shown = {c: F.round(F.col(c).cast("double"), digits) for c in names} | {c: F.col(c).cast("string") for c in dates.split()}
            return df.withColumns(shown) if shown else df

        QUERIES[name] = run
        if select is not None:
            ORACLES[name] = views.statement(select, ctes, names, digits, dates.split(), markets, series)
        return fn

    return add
