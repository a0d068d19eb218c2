"""Expressions that decode one change-log line.

A record is ``<op><TAG><f0>|<f1>|...``: the op char (``+`` inserts, anything
else deletes), a two-letter table tag, then ``|``-separated fields read by
fixed index. Everything here is a built-in Spark SQL expression (given as SQL
text, so a whole projection is one call into the JVM), so decoding runs in
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags and the fields read from each record (0-based index).
TAG_LINEITEM = "LI"
TAG_ORDERS = "OR"
TAG_CUSTOMER = "CU"
TAGS = (TAG_LINEITEM, TAG_ORDERS, TAG_CUSTOMER)

LINEITEM_FIELDS = {"l_orderkey": 0, "line": 3, "l_extendedprice": 5, "l_discount": 6, "l_shipdate": 10}
ORDERS_FIELDS = {"o_orderkey": 0, "o_custkey": 1, "o_orderdate": 4, "o_shippriority": 7}
CUSTOMER_FIELDS = {"c_custkey": 0, "c_mktsegment": 6}

FIELDS = {TAG_LINEITEM: LINEITEM_FIELDS, TAG_ORDERS: ORDERS_FIELDS, TAG_CUSTOMER: CUSTOMER_FIELDS}

# SQL text of the decoding expressions, over a line column ``value``.
OP_SQL = "substring(value, 1, 1)"
TAG_SQL = "substring(value, 2, 2)"
# '\\|' is the escaped single char that Java's split takes without a regex
# engine; -1 keeps empty trailing fields.
FIELDS_SQL = "split(substring(value, 4), '\\\\|', -1)"
SIGN_SQL = "CASE WHEN {op} = '+' THEN 1 ELSE -1 END"


def field_sql(arr: str, i: int) -> str:
    """Field ``i`` or NULL when the record is too short."""
    return f"get({arr}, {i})"


def int_sql(s: str, kind: str = "bigint") -> str:
    """Integer text: optional sign and digits (a fraction, exponent or other
    text gives NULL). Unlike ``Integer.parseInt`` surrounding blanks are
    tolerated; a regex check would cost as much as the whole parse."""
    return f"try_cast({s} AS {kind})"


def money_sql(s: str, kind: str) -> str:
    """A number as ``kind``, a decimal with eight places, where that stands for
    the same double; NULL for other texts and for numbers that need more.
    Texts of the usual form are seen to have eight places or less by their
    length."""
    short = f"(instr({s}, '.') = 0 OR length({s}) - instr({s}, '.') <= 8) AND instr(lower({s}), 'e') = 0"
    narrow = f"try_cast({s} AS {kind})"
    return (
        f"CASE WHEN {short} THEN {narrow} "
        f"WHEN CAST({narrow} AS DOUBLE) = try_cast({s} AS DOUBLE) THEN {narrow} END"
    )


def double_sql(s: str) -> str:
    """A number of any size and precision, as the reference reads it."""
    return f"try_cast({s} AS DOUBLE)"


def date_sql(s: str) -> str:
    """Strict ``yyyy-MM-dd`` (ISO local date); anything else is NULL.

    A plain cast also takes ``1995-3-1`` or a trailing time part; fixing the
    length and the two dashes leaves exactly the ISO form."""
    return (
        f"CASE WHEN length({s}) = 10 AND substring({s}, 5, 1) = '-' AND substring({s}, 8, 1) = '-'"
        f" THEN try_cast({s} AS DATE) END"
    )


# Column forms, for DataFrame code.


def op_char(value: Column) -> Column:
    return F.substring(value, 1, 1)


def tag(value: Column) -> Column:
    """Characters 2-3 of the line."""
    return F.substring(value, 2, 2)


def sign(op: Column) -> Column:
    """+1 for '+', -1 for any other op char (the reference's rule)."""
    return F.when(op == "+", F.lit(1)).otherwise(F.lit(-1))


def fields(value: Column) -> Column:
    """Array of the ``|``-separated fields after op char and tag."""
    return F.split(F.substring(value, 4, 1 << 30), r"\|", -1)


def seq_of(value: Column) -> Column:
    """The trailing ``seq`` field as BIGINT."""
    return F.element_at(fields(value), -1).try_cast("bigint")
