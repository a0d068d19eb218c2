"""Result sinks and the reference's text line format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the reference's result line, Order{orderKey=.., orderDate=..,
# shipPriority=.., revenue=..}.
LINE_PATTERN = (
    r"^Order\{orderKey=(-?[0-9]+), orderDate=([0-9]{4}-[0-9]{2}-[0-9]{2}), "
    r"shipPriority=(-?[0-9]+), revenue=([^}]*)\}$"
)


def render_line(df: DataFrame, with_revenue: bool = True) -> Column:
    """One result row as the reference prints it. ``revenue`` is printed with
    Spark's double-to-string, which follows Java's ``Double.toString``."""
    parts = [
        F.lit("Order{orderKey="), F.col("l_orderkey").cast("string"),
        F.lit(", orderDate="), F.col("o_orderdate").cast("string"),
        F.lit(", shipPriority="), F.col("o_shippriority").cast("string"),
    ]
    if with_revenue:
        parts += [F.lit(", revenue="), F.col("revenue").cast("string")]
    parts.append(F.lit("}"))
    return F.concat(*parts)


def write_text(df: DataFrame, path: str) -> None:
    """Text sink that replaces earlier output (overwrite = delete then write)."""
    df.select(render_line(df).alias("value")).write.mode("overwrite").text(path)


def read_text_result(spark: SparkSession, path: str) -> DataFrame:
    """Parse result lines written by ``write_text`` back into columns; any
    other line is an error."""
    v = F.col("value")
    bad = F.raise_error(F.concat(F.lit("not a result line: "), v))

    def g(i: int) -> Column:
        return F.when(v.rlike(LINE_PATTERN), F.regexp_extract(v, LINE_PATTERN, i)).otherwise(bad)

    return spark.read.text(path).select(
        g(1).cast("bigint").alias("l_orderkey"),
        g(2).cast("date").alias("o_orderdate"),
        g(3).cast("int").alias("o_shippriority"),
        g(4).cast("double").alias("revenue"),
    )


def debug_line(df: DataFrame) -> DataFrame:
    """One JSON line per row of any change or delta DataFrame (the
    reference's debug printing of its row objects)."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


# The line each kind of record prints as in the reference.
# ``insertion`` is the change's sign, dates are ISO, doubles as Java prints them.
_ORDER_COLS = "', orderDate=', o_orderdate, ', shipPriority=', o_shippriority"
_FACTORS = (
    "', extendedPrice=', coalesce(l_price_far, CAST(l_extendedprice AS DOUBLE)), "
    "', discount=', coalesce(l_discount_far, CAST(l_discount AS DOUBLE))"
)
RECORD_LINES = {
    "lineitem": ("sgn", "LineItem", f"', orderKey=', l_orderkey, {_FACTORS}, "
                 "', shipDate=', l_shipdate, ', lineNumber=', line"),
    "orders": ("sgn", "Order", f"', orderKey=', o_orderkey, ', custKey=', o_custkey, {_ORDER_COLS}"),
    "customer": ("sgn", "Customer", r"', custKey=', c_custkey, ', mktSegment=\'', c_mktsegment, '\''"),
    "join1": ("w", "Order", f"', orderKey=', o_orderkey, {_ORDER_COLS}"),
    "join2": ("w", "Joint_LineItem_Order", f"', orderKey=', l_orderkey, {_ORDER_COLS}, {_FACTORS}"),
}


def record_line(df: DataFrame, kind: str) -> DataFrame:
    """``seq``, ``kind`` and ``line`` of change rows (``lineitem``, ``orders``,
    ``customer``) or delta rows (``join1``; ``join2`` with its factors), as the
    reference prints its row objects. A delta of weight w stands for |w| rows
    and has as many lines. Strict casts have left no null in any field."""
    sign, name, fields = RECORD_LINES[kind]
    text = f"concat('{name}{{insertion=', CAST({sign} > 0 AS STRING), {fields}, '}}')"
    return df.selectExpr("seq", f"'{kind}' AS kind", f"explode(array_repeat({text}, int(abs({sign})))) AS line")
