"""Data-quality reports for ill-formed change sequences.

The reference assumes every delete follows its insert and that a key is
never inserted twice while alive. When that fails it silently drifts:
a delete without insert still emits a negative delta, a second insert
double counts. These reports find such rows instead: per base row, the
running multiplicity in ``seq`` order must stay within 0..1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trickle.operators.scan import running_sums


def _base_rows(li: DataFrame, od: DataFrame, cu: DataFrame) -> DataFrame:
    """tbl, key, line, seq, sgn for every change, keyed by base row."""
    return (
        li.select(F.lit("LI").alias("tbl"), F.col("l_orderkey").alias("key"), "line", "seq", "sgn")
        .unionByName(od.select(F.lit("OR").alias("tbl"), F.col("o_orderkey").alias("key"),
                               F.lit(0).alias("line"), "seq", "sgn"))
        .unionByName(cu.select(F.lit("CU").alias("tbl"), F.col("c_custkey").alias("key"),
                               F.lit(0).alias("line"), "seq", "sgn"))
    )


def _prefix(li: DataFrame, od: DataFrame, cu: DataFrame) -> DataFrame:
    """Running multiplicity ``m`` of every base row in seq order. A base row
    has a handful of changes on a sane feed; one changed very often is
    scanned in ordered chunks over several tasks (``operators.scan``)."""
    return running_sums(_base_rows(li, od, cu), ["tbl", "key", "line"], ["seq"], {"m": "sgn"})


def phantom_deletes(li: DataFrame, od: DataFrame, cu: DataFrame) -> DataFrame:
    """tbl, key, line, n: rows whose multiplicity goes negative (n = lowest)."""
    return (
        _prefix(li, od, cu)
        .groupBy("tbl", "key", "line")
        .agg(F.min("m").cast("bigint").alias("n"))
        .where(F.col("n") < 0)
    )


def double_inserts(li: DataFrame, od: DataFrame, cu: DataFrame) -> DataFrame:
    """tbl, key, line, n: rows inserted again while alive (n = highest)."""
    return (
        _prefix(li, od, cu)
        .groupBy("tbl", "key", "line")
        .agg(F.max("m").cast("bigint").alias("n"))
        .where(F.col("n") > 1)
    )


def dead_letter_counts(dead: DataFrame) -> DataFrame:
    return dead.groupBy("reason").agg(F.count("*").cast("bigint").alias("n"))
