"""Parquet base tables, read with only the columns the plans use.

The fixture tables store dates as midnight ``TIMESTAMP_NTZ``; plans compare
and output ``DATE``. Selecting columns here (not ``*``) lets Catalyst prune
the Parquet ``ReadSchema``. Date filters are written against the raw
timestamp column (``ts_lit``) so that they reach the scan as
``PushedFilters``; the cast to DATE is only applied in the projection.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def ts_lit(d: _dt.date) -> Column:
    """Midnight of ``d`` as TIMESTAMP_NTZ, to compare raw fixture columns.

    ``cast(ts as date) > d`` is the same as ``ts >= d + 1 day`` for midnight
    timestamps, and ``cast(ts as date) < d`` is ``ts < d``; written this way
    the predicate reaches the Parquet reader.
    """
    return F.lit(_dt.datetime(d.year, d.month, d.day)).cast("timestamp_ntz")


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate"
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_discount", "l_shipdate"
    )
