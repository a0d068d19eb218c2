"""Delta propagation as signed-multiset algebra (the batch engine, M2).

Q3 is linear in each table. With change rows carrying ``sgn`` (+1 insert,
-1 delete), the maintained view is

    revenue(g) = sum over joining (l, o, c) change triples in group g of
                 l.sgn * o.sgn * c.sgn * price * (1 - discount)
    n(g)       = sum of the same sign products;   g is live iff n(g) > 0

which needs neither state nor arrival order. The reference's incremental
joins emit, at event ``s``, exactly the triples whose latest member has
``seq = s``; grouping the sign products by ``greatest(seq)`` reproduces its
delta stream (``join1_deltas``, ``join2_deltas``) and, with a running sum,
its output changelog.

The deltas are made without pairing all changes of a key: each change meets
the *live rows* of the other side at its time, found by one ordered sweep per
join (``operators.sweep``) whose work follows changes plus deltas. ``seq``
identifies a change.

Partitioning: join 1 sweeps ``custkey``, join 2 ``orderkey``, in ordered
chunks that cut through a hot key. The joins on (key, rank) have plain
shuffles as inputs, so AQE can split the many rows that one change meets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trickle.functions.measures import amount_sql, weighted_sql
from trickle.operators.scan import running_sums
from trickle.operators.sweep import meetings, met, side
from trickle.session import written

J1_COLS = ["o_orderkey", "o_orderdate", "o_shippriority"]
ITEM_COLS = ["l_orderkey", "line", "l_extendedprice", "l_discount", "l_price_far", "l_discount_far"]
# What tells the rows of each side apart in the reference's keyed state.
KEYS = {
    "customers": ["c_custkey"],
    "orders": ["o_custkey", "o_orderkey"],
    "joined": ["o_orderkey"],
    "items": ["l_orderkey", "line"],
}


# --------------------------------------------------------------------------
# Join 1: orders x customer on custkey (N:1); only the order columns survive
# --------------------------------------------------------------------------


def join1_deltas(od: DataFrame, cu: DataFrame, od_before: DataFrame | None = None,
                 cu_before: DataFrame | None = None, present: bool = False) -> DataFrame:
    """seq, o_orderkey, o_orderdate, o_shippriority, w: what join 1 emits.

    An order change meets the customers that are there at its time; a customer
    change meets the orders that are live at its time. ``od_before`` and
    ``cu_before`` are changes (or net rows with an earlier ``seq``) that count
    as state but emit nothing. With ``present`` a row is there or not, as in
    the reference's keyed state: the last change of the key decides, an insert
    replaces what was there. On a well-formed feed that is the same."""
    keys = KEYS if present else {}
    orders = side(od, "o_custkey", ["o_custkey", *J1_COLS], "sgn", keys.get("orders"), od_before)
    customers = side(cu, "c_custkey", ["c_custkey", "c_mktsegment"], "sgn", keys.get("customers"), cu_before)
    return meetings(orders, customers).selectExpr("seq", *J1_COLS, "CAST(w * net AS INT) AS w")


def customer_weight(cu: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Net signed multiplicity per customer row (custkey, segment): one row
    per key, as the segment is fixed by the filter."""
    out = cu.groupBy("c_custkey", "c_mktsegment").agg(F.expr("sum(sgn) AS wc"))
    return out if keep_empty else out.where("wc <> 0")


def order_weight(od: DataFrame, cu: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Net multiplicity of each join-1 row (o_orderkey, date, priority).

    The customer side is first reduced to one row per customer row (partial
    aggregation collapses a hot key map-side), so the join is N:1 exactly
    even when one customer's row is changed very often. Being grouped on
    (custkey, segment), it reaches the join on custkey through a plain
    shuffle of its few rows; AQE splits a skewed join partition only when
    both inputs are plain shuffles, and so spreads a customer with very many
    orders over several tasks.
    """
    cw = customer_weight(cu, keep_empty)
    out = (
        od.join(cw, od.o_custkey == cw.c_custkey)
        .selectExpr(*J1_COLS, "sgn * wc AS w")
        .groupBy(*J1_COLS)
        .agg(F.expr("sum(w) AS wo"))
    )
    return out if keep_empty else out.where("wo <> 0")


def join1_final(od: DataFrame, cu: DataFrame) -> DataFrame:
    """Join-1 rows alive at the end of the feed."""
    return order_weight(od, cu).where("wo > 0").select(*J1_COLS)


# --------------------------------------------------------------------------
# Join 2: lineitem x join-1 on orderkey (N:1), and the sum
# --------------------------------------------------------------------------


def lineitem_value(li: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Per order key: signed revenue and signed count of its lineitem changes.

    Eager aggregation below the join: partial aggregation folds the lineitem
    changes of a key map-side, so even an order key holding a large share of
    all rows reaches the join as one row per map task.
    """
    exact, far = weighted_sql("sgn")
    out = li.groupBy("l_orderkey").agg(
        F.expr(f"sum({exact}) AS v"), F.expr(f"sum({far}) AS vf"), F.expr("sum(sgn) AS nl")
    )
    return out if keep_empty else out.where("nl <> 0")


def final_view(li: DataFrame, od: DataFrame, cu: DataFrame, keep_empty: bool = False) -> DataFrame:
    """l_orderkey, o_orderdate, o_shippriority, revenue (DOUBLE), n (BIGINT).

    Uses distributivity of the sum over the N:1 joins:
    sum_l sum_o w_l w_o v_l = (sum_o w_o) * (sum_l w_l v_l) per order key.

    ``keep_empty`` keeps the groups whose rows have all gone (n = 0): every
    group for which changes of all three tables join.
    """
    lv = lineitem_value(li, keep_empty)
    ow = order_weight(od, cu, keep_empty)
    out = lv.join(ow, lv.l_orderkey == ow.o_orderkey).selectExpr(
        "l_orderkey",
        "o_orderdate",
        "o_shippriority",
        f"{amount_sql('wo * v', 'wo * vf')} AS revenue",
        "CAST(wo * nl AS BIGINT) AS n",
    )
    return out if keep_empty else out.where("n > 0")


def join2_deltas(li: DataFrame, j1: DataFrame, li_before: DataFrame | None = None,
                 j1_before: DataFrame | None = None, present: bool = False,
                 stored: bool = False, factors: bool = False) -> DataFrame:
    """seq, l_orderkey, line, o_orderdate, o_shippriority, w, dv, df: what
    join 2 emits, one row per (event, lineitem); with ``factors`` also the
    item's price and discount.

    A lineitem change meets the order's rows that are there at its time; a
    join-1 delta meets the lineitem rows that are live at its time. ``dv`` and
    ``df`` are the exact and the far part of the revenue delta
    (w * price * (1 - discount), ``functions.measures``). The join-1
    deltas are read twice, so they are written once (unless ``stored``).
    ``li_before`` and ``j1_before`` and ``present`` as in ``join1_deltas``."""
    j1 = j1 if stored else written(j1, "join1-deltas")
    keys = KEYS if present else {}
    items = side(li, "l_orderkey", ITEM_COLS, "sgn", keys.get("items"), li_before)
    orders = side(j1, "o_orderkey", J1_COLS, "w", keys.get("joined"), j1_before)
    exact, far = weighted_sql("w")
    return meetings(items, orders).withColumn("w", F.expr("CAST(w * net AS INT)")).selectExpr(
        "seq", "l_orderkey", "line", "o_orderdate", "o_shippriority", "w", f"{exact} AS dv", f"{far} AS df",
        *(ITEM_COLS[2:] if factors else []))


def changelog(deltas: DataFrame, chunks: int | None = None, before: DataFrame | None = None) -> DataFrame:
    """The reference's output stream: after every delta, the running revenue
    and count of its order key, in (seq, line) order. ``before`` (seq,
    l_orderkey, dv, df, w) are sums at an earlier seq, which emit nothing.

    A running sum per order key (``operators.scan``) over ordered chunks, so
    the deltas of one order key are spread over as many tasks as they fill."""
    rows = deltas.withColumn("emit", F.lit(True))
    if before is not None:
        rows = rows.unionByName(before.withColumn("emit", F.lit(False)), allowMissingColumns=True)
    r = running_sums(rows, ["l_orderkey"], ["seq", "line"], {"_rev": "dv", "_far": "df", "_n": "w"}, chunks)
    return r.where("emit").selectExpr(
        "seq", "l_orderkey", "line", "o_orderdate", "o_shippriority",
        f"{amount_sql('_rev', '_far')} AS revenue", "CAST(_n AS BIGINT) AS n",
    )


def latest(li: DataFrame, od: DataFrame, cu: DataFrame) -> DataFrame:
    """Last running value per group: every group ever emitted, empty ones
    (n = 0) kept, as a consumer of the changelog sees it.

    The sums are those of ``final_view`` with its partial aggregation below
    the joins. A group that is not empty at the end was emitted; of the empty
    ones, those whose order and items were ever live together were. Only the
    changes of their keys are swept, and join 2 is not made: ``sweep.met``
    counts live items where the join would list them."""
    groups = written(final_view(li, od, cu, keep_empty=True), "groups")
    empty = groups.where("n = 0")
    keys = empty.select("l_orderkey").distinct()
    orders = od.join(keys, od.o_orderkey == keys.l_orderkey, "left_semi")
    customers = cu.join(orders, cu.c_custkey == orders.o_custkey, "left_semi")
    joined = written(join1_deltas(orders, customers), "join1-deltas")
    items = li.join(keys, "l_orderkey", "left_semi")
    emitted = met(side(items, "l_orderkey", ITEM_COLS, "sgn"), side(joined, "o_orderkey", J1_COLS, "w"))
    same = emitted.selectExpr("o_orderkey AS l_orderkey", "o_orderdate", "o_shippriority")
    return groups.where("n <> 0").unionAll(empty.join(same, same.columns, "left_semi").select(groups.columns))


def cascade(deltas: DataFrame, cu: DataFrame) -> DataFrame:
    """Deltas caused by customer deletes (customer -> orders -> lineitem)."""
    deletes = cu.where(F.col("sgn") < 0).select("seq")
    return deltas.join(deletes, "seq", "left_semi").select("seq", "l_orderkey", "line", "w")
