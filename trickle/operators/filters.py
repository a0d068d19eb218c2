"""Q3's three selections, applied to change rows by the values they carry
(a delete record is filtered by its own columns, as in the reference)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trickle.plans.spec import Q3Spec


def filter_lineitem(li: DataFrame, spec: Q3Spec) -> DataFrame:
    """Strictly after the date."""
    return li.where(f"l_shipdate > DATE '{spec.date}'")


def filter_orders(od: DataFrame, spec: Q3Spec) -> DataFrame:
    """Strictly before the date."""
    return od.where(f"o_orderdate < DATE '{spec.date}'")


def filter_customer(cu: DataFrame, spec: Q3Spec) -> DataFrame:
    """Case-sensitive segment equality."""
    return cu.where(F.col("c_mktsegment") == F.lit(spec.segment))  # a value, not SQL text


def selections(spec: Q3Spec) -> dict[str, Column]:
    """The three selections by table tag, for change rows of all tables in
    one DataFrame."""
    return {
        "LI": F.expr(f"l_shipdate > DATE '{spec.date}'"),
        "OR": F.expr(f"o_orderdate < DATE '{spec.date}'"),
        "CU": F.col("c_mktsegment") == F.lit(spec.segment),
    }
