"""Recompute mode (M1): net each change table, then evaluate Q3 on the net
tables. The truth the incremental modes are tested against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trickle.functions.measures import amount_sql, weighted_sql


def net(changes: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose net multiplicity ``m`` (sum of signs) is positive.

    Grouping on the whole row spreads even a hot key over many groups, and
    partial aggregation nets inserts and deletes map-side."""
    return (
        changes.groupBy(*cols)
        .agg(F.sum("sgn").alias("m"))
        .where(F.col("m") > 0)
    )


LI_ROW = ["l_orderkey", "line", "l_extendedprice", "l_discount", "l_shipdate", "l_price_far", "l_discount_far"]
OD_ROW = ["o_orderkey", "o_custkey", "o_orderdate", "o_shippriority"]
CU_ROW = ["c_custkey", "c_mktsegment"]


def net_tables(li: DataFrame, od: DataFrame, cu: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return net(li, LI_ROW), net(od, OD_ROW), net(cu, CU_ROW)


def live_orders(od: DataFrame, cu: DataFrame) -> DataFrame:
    """Order keys whose net order row has a net customer (semi-join)."""
    nod, ncu = net(od, OD_ROW), net(cu, CU_ROW)
    return nod.join(ncu, nod.o_custkey == ncu.c_custkey, "left_semi").select("o_orderkey")


def recompute_view(li: DataFrame, od: DataFrame, cu: DataFrame) -> DataFrame:
    """Q3 over the net tables; multiplicities multiply (all are 1 on a
    well-formed feed)."""
    nli, nod, ncu = net_tables(li, od, cu)
    c = ncu.select("c_custkey", F.col("m").alias("mc"))
    o = nod.join(c, nod.o_custkey == c.c_custkey).select(
        "o_orderkey", "o_orderdate", "o_shippriority", (F.col("m") * F.col("mc")).alias("mo")
    )
    j = nli.join(o, nli.l_orderkey == o.o_orderkey).withColumn("mult", F.col("m") * F.col("mo"))
    exact, far = weighted_sql("mult")
    group = ["l_orderkey", "o_orderdate", "o_shippriority"]
    sums = j.groupBy(*group).agg(
        F.expr(f"sum({exact})").alias("v"), F.expr(f"sum({far})").alias("f"), F.sum("mult").cast("bigint").alias("n")
    )
    return sums.where("n > 0").selectExpr(*group, f"{amount_sql('v', 'f')} AS revenue", "n")
