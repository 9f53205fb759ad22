"""The test tables as DataFrames, and what a flow record is in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flow_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All received records, copies included."""
    return table(spark, sf_dir, "flow_records")


def present(*fields: str) -> Column:
    """True where each address has both halves and is not all zero."""
    return reduce(
        Column.__and__,
        [
            F.col(f"{x}_hi").isNotNull() & F.col(f"{x}_lo").isNotNull() & ((F.col(f"{x}_hi") != 0) | (F.col(f"{x}_lo") != 0))
            for x in fields
        ],
    )


def distinct_flows(records: DataFrame, *columns: str) -> DataFrame:
    """One row per flow record with the columns named.

    Copies of a record agree in everything but arrival, so equal rows of identity and
    columns are copies.  One shuffle; without an explicit partitioning beneath it the rows
    spread by all columns, that is, evenly however skewed any single column is.
    """
    return records.select("flow_id", *columns).distinct()


def floor_div(x: Column, by: int) -> Column:
    """Integer division that rounds down, negative values too; ``div`` rounds toward zero."""
    by = F.lit(by).cast("long")
    return F.call_function("div", x, by) - F.when(F.pmod(x, by) != F.call_function("mod", x, by), 1).otherwise(0)


def day() -> Column:
    """Days since 1970-01-01, rounded down (null for records without a start)."""
    return floor_div(F.col("first"), DAY_MS)
