"""DuckDB oracle SQL for every registered query.

The oracle builds the change feed straight from the tables (the CTEs of
FIXTURES.md section 3), never through the text rendering, so it also checks
rendering, decoding and parsing. Money is summed as DECIMAL(15,2) factors and
cast to DOUBLE at the end, like the Spark side.
"""

from __future__ import annotations

from trickle.plans.spec import Q3, Q3_1998, Q3Spec

FEED_CTES = """
li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line
  FROM lineitem),
ph AS (SELECT 0 AS phase, 1 AS sgn UNION ALL SELECT 1, -1 UNION ALL SELECT 2, 1),
cu AS (
  SELECT ph.phase, ph.sgn, c_custkey, c_mktsegment,
    ph.phase*10000000000000 + ((c_custkey*48271)%1000003)*1000000 + 1000 AS seq
  FROM customer, ph
  WHERE phase=0 OR (phase=1 AND c_custkey%10=3) OR (phase=2 AND c_custkey%20=3)),
od AS (
  SELECT ph.phase, ph.sgn, o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate,
    0 AS o_shippriority,
    ph.phase*10000000000000 + ((o_orderkey*48271)%1000003)*1000000 + 2000 AS seq
  FROM orders, ph
  WHERE phase=0 OR (phase=1 AND o_orderkey%7=2) OR (phase=2 AND o_orderkey%14=2)),
lc AS (
  SELECT ph.phase, ph.sgn, l_orderkey, CAST(line AS INTEGER) AS line,
    CAST(l_extendedprice AS DECIMAL(15,2)) AS l_extendedprice,
    CAST(l_discount AS DECIMAL(15,2)) AS l_discount,
    CAST(l_shipdate AS DATE) AS l_shipdate,
    ph.phase*10000000000000 + ((l_orderkey*48271)%1000003)*1000000 + 3000 + line AS seq
  FROM li, ph
  WHERE phase=0 OR (phase=1 AND (l_orderkey+line)%5=1) OR (phase=2 AND (l_orderkey+line)%15=1))
"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([FEED_CTES.strip(), *ctes]) + "\n"


def _triples(spec: Q3Spec) -> str:
    return f"""
t AS (
  SELECT greatest(lc.seq, od.seq, cu.seq) AS seq, l_orderkey, line, o_orderdate, o_shippriority,
    lc.sgn*od.sgn*cu.sgn AS s,
    lc.sgn*od.sgn*cu.sgn * (l_extendedprice * (1 - l_discount)) AS sv
  FROM lc JOIN od ON l_orderkey = o_orderkey JOIN cu ON o_custkey = c_custkey
  WHERE c_mktsegment = '{spec.segment}' AND o_orderdate < DATE '{spec.date}'
    AND l_shipdate > DATE '{spec.date}')"""


def _deltas(spec: Q3Spec) -> list[str]:
    return [
        _triples(spec),
        """
d AS (
  SELECT seq, l_orderkey, line, o_orderdate, o_shippriority, SUM(s) AS w, SUM(sv) AS dv
  FROM t GROUP BY 1, 2, 3, 4, 5 HAVING SUM(s) <> 0)""",
    ]


def q3_static(spec: Q3Spec = Q3) -> str:
    return f"""
SELECT l_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, 0 AS o_shippriority,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))))
       AS DOUBLE) AS revenue
FROM customer, orders, lineitem
WHERE c_mktsegment = '{spec.segment}' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
  AND CAST(o_orderdate AS DATE) < DATE '{spec.date}' AND CAST(l_shipdate AS DATE) > DATE '{spec.date}'
GROUP BY 1, 2, 3"""


SCAN_FEED = _with() + """
SELECT 'CU' AS tbl, sgn, count(*) AS n FROM cu GROUP BY sgn
UNION ALL SELECT 'OR', sgn, count(*) FROM od GROUP BY sgn
UNION ALL SELECT 'LI', sgn, count(*) FROM lc GROUP BY sgn"""

DECODE_TAG = _with() + """
SELECT 'CU' AS tbl, count(*) AS n FROM cu
UNION ALL SELECT 'OR', count(*) FROM od
UNION ALL SELECT 'LI', count(*) FROM lc"""

DECODE_OP = _with() + """
SELECT sgn, count(*) AS n FROM (
  SELECT sgn FROM cu UNION ALL SELECT sgn FROM od UNION ALL SELECT sgn FROM lc) GROUP BY sgn"""

ROUTE_COUNTS = _with() + """
SELECT 'CU' AS tbl, count(*) AS n, min(c_custkey) AS min_key, max(c_custkey) AS max_key FROM cu
UNION ALL SELECT 'OR', count(*), min(o_orderkey), max(o_orderkey) FROM od
UNION ALL SELECT 'LI', count(*), min(l_orderkey), max(l_orderkey) FROM lc"""

DEAD_LETTER = _with() + """
SELECT 'unknown_tag' AS reason, count(*) AS n FROM customer WHERE c_custkey % 97 = 5 HAVING count(*) > 0
UNION ALL SELECT 'bad_op', count(*) FROM customer WHERE c_custkey % 89 = 7 HAVING count(*) > 0
UNION ALL SELECT 'short_line', count(*) FROM orders WHERE o_orderkey % 101 = 7 HAVING count(*) > 0
UNION ALL SELECT 'bad_number', count(*) FROM orders WHERE o_orderkey % 103 = 9 HAVING count(*) > 0
UNION ALL SELECT 'bad_date', count(*) FROM lc WHERE phase = 0 AND l_orderkey % 107 = 11 AND line = 1
  HAVING count(*) > 0"""

PARSE_LINEITEM = _with() + """
SELECT seq, sgn, l_orderkey, line, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice,
  CAST(l_discount AS DOUBLE) AS l_discount, l_shipdate FROM lc"""

PARSE_ORDERS = _with() + """
SELECT seq, sgn, o_orderkey, o_custkey, o_orderdate, o_shippriority FROM od"""

PARSE_CUSTOMER = _with() + """
SELECT seq, sgn, c_custkey, c_mktsegment FROM cu"""


def filter_lineitem(spec: Q3Spec = Q3) -> str:
    return PARSE_LINEITEM + f"\nWHERE l_shipdate > DATE '{spec.date}'"


def filter_orders(spec: Q3Spec = Q3) -> str:
    return PARSE_ORDERS + f"\nWHERE o_orderdate < DATE '{spec.date}'"


def filter_customer(spec: Q3Spec = Q3) -> str:
    return PARSE_CUSTOMER + f"\nWHERE c_mktsegment = '{spec.segment}'"


REVENUE_EXPR = _with() + """
SELECT seq, l_orderkey, line,
  CAST(sgn * (l_extendedprice * (1 - l_discount)) AS DOUBLE) AS signed_revenue FROM lc"""


def _j1(spec: Q3Spec) -> str:
    return f"""
j1 AS (
  SELECT greatest(od.seq, cu.seq) AS seq, o_orderkey, o_orderdate, o_shippriority,
    od.sgn*cu.sgn AS s
  FROM od JOIN cu ON o_custkey = c_custkey
  WHERE c_mktsegment = '{spec.segment}' AND o_orderdate < DATE '{spec.date}')"""


def join1_deltas(spec: Q3Spec = Q3) -> str:
    return _with(_j1(spec)) + """
SELECT seq, o_orderkey, o_orderdate, o_shippriority, CAST(SUM(s) AS INTEGER) AS w
FROM j1 GROUP BY 1, 2, 3, 4 HAVING SUM(s) <> 0"""


def join1_final(spec: Q3Spec = Q3) -> str:
    return _with(_j1(spec)) + """
SELECT o_orderkey, o_orderdate, o_shippriority FROM j1 GROUP BY 1, 2, 3 HAVING SUM(s) > 0"""


def live_orders(spec: Q3Spec = Q3) -> str:
    return _with(
        f"""
nod AS (SELECT o_orderkey, o_custkey FROM od WHERE o_orderdate < DATE '{spec.date}'
        GROUP BY o_orderkey, o_custkey, o_orderdate, o_shippriority HAVING SUM(sgn) > 0)""",
        f"""
ncu AS (SELECT c_custkey FROM cu WHERE c_mktsegment = '{spec.segment}'
        GROUP BY c_custkey, c_mktsegment HAVING SUM(sgn) > 0)""",
    ) + """
SELECT o_orderkey FROM nod WHERE o_custkey IN (SELECT c_custkey FROM ncu)"""


def join2_deltas(spec: Q3Spec = Q3) -> str:
    return _with(*_deltas(spec)) + """
SELECT seq, l_orderkey, line, CAST(w AS INTEGER) AS w, CAST(dv AS DOUBLE) AS signed_revenue FROM d"""


def cascade_delete(spec: Q3Spec = Q3) -> str:
    return _with(*_deltas(spec)) + """
SELECT seq, l_orderkey, line, CAST(w AS INTEGER) AS w FROM d
WHERE seq IN (SELECT seq FROM cu WHERE sgn = -1)"""


def ivm_q3_final(spec: Q3Spec = Q3) -> str:
    return _with(_triples(spec)) + """
SELECT l_orderkey, o_orderdate, o_shippriority, CAST(SUM(sv) AS DOUBLE) AS revenue,
  CAST(SUM(s) AS BIGINT) AS n
FROM t GROUP BY 1, 2, 3 HAVING SUM(s) > 0"""


def ivm_q3_changelog(spec: Q3Spec = Q3) -> str:
    return _with(*_deltas(spec)) + """
SELECT seq, l_orderkey, line, o_orderdate, o_shippriority,
  CAST(SUM(dv) OVER w AS DOUBLE) AS revenue, CAST(SUM(w) OVER w AS BIGINT) AS n
FROM d WINDOW w AS (PARTITION BY l_orderkey ORDER BY seq, line
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def ivm_q3_latest(spec: Q3Spec = Q3) -> str:
    return _with(*_deltas(spec)) + """
SELECT l_orderkey, o_orderdate, o_shippriority, CAST(SUM(dv) AS DOUBLE) AS revenue,
  CAST(SUM(w) AS BIGINT) AS n
FROM d GROUP BY 1, 2, 3"""


def debug_lines(spec: Q3Spec = Q3) -> str:
    order = "', orderDate=' || o_orderdate || ', shipPriority=' || o_shippriority"
    factors = ("', extendedPrice=' || CAST(l_extendedprice AS DOUBLE)"
               " || ', discount=' || CAST(l_discount AS DOUBLE)")
    items = f"SELECT * FROM lc WHERE l_shipdate > DATE '{spec.date}'"
    return _with(*_deltas(spec), _j1(spec)) + f"""
SELECT seq, 'lineitem' AS kind, 'LineItem{{insertion=' || (sgn > 0) || ', orderKey=' || l_orderkey || {factors}
  || ', shipDate=' || l_shipdate || ', lineNumber=' || line || '}}' AS line FROM ({items})
UNION ALL SELECT seq, 'orders', 'Order{{insertion=' || (sgn > 0) || ', orderKey=' || o_orderkey
  || ', custKey=' || o_custkey || {order} || '}}' FROM od WHERE o_orderdate < DATE '{spec.date}'
UNION ALL SELECT seq, 'customer', 'Customer{{insertion=' || (sgn > 0) || ', custKey=' || c_custkey
  || ', mktSegment=''' || c_mktsegment || '''}}' FROM cu WHERE c_mktsegment = '{spec.segment}'
UNION ALL SELECT seq, 'join1', 'Order{{insertion=' || (SUM(s) > 0) || ', orderKey=' || o_orderkey
  || {order} || '}}' FROM j1 GROUP BY seq, o_orderkey, o_orderdate, o_shippriority HAVING SUM(s) <> 0
UNION ALL SELECT d.seq, 'join2', 'Joint_LineItem_Order{{insertion=' || (w > 0) || ', orderKey=' || l_orderkey
  || {order} || {factors} || '}}'
  FROM d JOIN (SELECT l_orderkey, line, l_extendedprice, l_discount FROM lc WHERE phase = 0) USING (l_orderkey, line)"""


def render_result(spec: Q3Spec = Q3) -> str:
    return f"""
SELECT 'Order{{orderKey=' || CAST(l_orderkey AS VARCHAR) || ', orderDate='
  || CAST(o_orderdate AS VARCHAR) || ', shipPriority=' || CAST(o_shippriority AS VARCHAR)
  || '}}' AS line
FROM ({ivm_q3_final(spec)})"""


def sink_roundtrip(spec: Q3Spec = Q3) -> str:
    return f"""
SELECT l_orderkey, o_orderdate, o_shippriority, revenue FROM ({ivm_q3_final(spec)})"""


# Fixed values of the anomaly rules (see trickle.sources.feed.ANOMALY_RULES).
_QUALITY = _with(
    """
base AS (
  SELECT 'LI' AS tbl, l_orderkey AS key, line, seq, sgn FROM lc
  UNION ALL SELECT 'OR', o_orderkey, 0, seq, sgn FROM od
  UNION ALL SELECT 'CU', c_custkey, 0, seq, sgn FROM cu
  UNION ALL SELECT 'LI', l_orderkey + 1000000000, line, seq - 500, -1 FROM lc
    WHERE phase = 0 AND l_orderkey % 109 = 13 AND line = 1
  UNION ALL SELECT 'OR', o_orderkey, 0, seq + 1, 1 FROM od
    WHERE phase = 0 AND o_orderkey % 113 = 17)""",
    """
p AS (
  SELECT tbl, key, line, SUM(sgn) OVER (PARTITION BY tbl, key, line ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM base)""",
)

DQ_PHANTOM_DELETE = _QUALITY + """
SELECT tbl, key, line, CAST(MIN(m) AS BIGINT) AS n FROM p GROUP BY 1, 2, 3 HAVING MIN(m) < 0"""

DQ_DOUBLE_INSERT = _QUALITY + """
SELECT tbl, key, line, CAST(MAX(m) AS BIGINT) AS n FROM p GROUP BY 1, 2, 3 HAVING MAX(m) > 1"""


def all_oracles() -> dict[str, str]:
    return {
        "q3_static": q3_static(),
        "q3_static_1998": q3_static(Q3_1998),
        "scan_feed": SCAN_FEED,
        "decode_tag": DECODE_TAG,
        "decode_op": DECODE_OP,
        "route_counts": ROUTE_COUNTS,
        "dead_letter": DEAD_LETTER,
        "parse_lineitem": PARSE_LINEITEM,
        "parse_orders": PARSE_ORDERS,
        "parse_customer": PARSE_CUSTOMER,
        "filter_lineitem": filter_lineitem(),
        "filter_orders": filter_orders(),
        "filter_customer": filter_customer(),
        "revenue_expr": REVENUE_EXPR,
        "join1_deltas": join1_deltas(),
        "join1_deltas_1998": join1_deltas(Q3_1998),
        "join1_final": join1_final(),
        "live_orders": live_orders(),
        "join2_deltas": join2_deltas(),
        "join2_deltas_1998": join2_deltas(Q3_1998),
        "cascade_delete": cascade_delete(),
        "cascade_delete_1998": cascade_delete(Q3_1998),
        "ivm_q3_final": ivm_q3_final(),
        "ivm_q3_final_1998": ivm_q3_final(Q3_1998),
        "ivm_q3_final_positional": ivm_q3_final(),
        "ivm_q3_final_positional_1998": ivm_q3_final(Q3_1998),
        "ivm_q3_recompute": ivm_q3_final(),
        "ivm_q3_recompute_1998": ivm_q3_final(Q3_1998),
        "ivm_q3_changelog": ivm_q3_changelog(),
        "ivm_q3_changelog_1998": ivm_q3_changelog(Q3_1998),
        "ivm_q3_latest": ivm_q3_latest(),
        "ivm_q3_latest_1998": ivm_q3_latest(Q3_1998),
        "render_result": render_result(),
        "sink_roundtrip": sink_roundtrip(),
        "debug_lines": debug_lines(),
        "dq_phantom_delete": DQ_PHANTOM_DELETE,
        "dq_double_insert": DQ_DOUBLE_INSERT,
        "stream_q3": ivm_q3_final(),
        "stream_q3_changelog": ivm_q3_changelog(),
    }
