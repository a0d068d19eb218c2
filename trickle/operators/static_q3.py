"""Q3 over the base tables (no changes): the minimum end-to-end slice."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trickle.functions.measures import revenue, to_double
from trickle.plans.spec import Q3, Q3Spec
from trickle.sources import tables


def q3_static(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    """l_orderkey, o_orderdate, o_shippriority, revenue over the base tables.

    Filters are written on the raw timestamp columns so they reach the Parquet
    scan. Customer only decides whether an order qualifies, so it enters as a
    semi-join (the key set is never materialised on the driver); it becomes a
    broadcast only when Catalyst's size estimate or AQE's runtime measurement
    is below the broadcast threshold.
    """
    d = spec.as_date
    cust = tables.customer(spark, sf_dir).where(F.col("c_mktsegment") == spec.segment)
    ords = tables.orders(spark, sf_dir).where(F.col("o_orderdate") < tables.ts_lit(d))
    items = tables.lineitem(spark, sf_dir).where(
        F.col("l_shipdate") >= tables.ts_lit(d + _dt.timedelta(days=1))
    )
    live = ords.join(cust, ords.o_custkey == cust.c_custkey, "left_semi").select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
        F.lit(0).alias("o_shippriority"),
    )
    return (
        items.join(live, items.l_orderkey == live.o_orderkey)
        .groupBy("l_orderkey", "o_orderdate", "o_shippriority")
        .agg(to_double(F.sum(revenue("l_extendedprice", "l_discount"))).alias("revenue"))
    )
