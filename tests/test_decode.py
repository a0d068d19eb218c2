"""Decode, route, parse and the dead letter, on hand-written records."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from trickle.operators.route import route

EXAMPLE = [
    "+CU1|n|a|1|p|1.0|AUTOMOBILE|c|1",
    "+OR10|1|O|1.0|1995-01-02|5|clk|0|c|2",
    "+LI10|1|1|1|1.0|100.0|0.1|0.0|N|O|1995-04-01|3",
    "-LI10|1|1|1|1.0|100.0|0.1|0.0|N|O|1995-04-01|4",
    "+XX1|z",
    "+LI10|1|1|2|1.0|200.0|0.1|0.0|N|O|1995-04-01|5",
]


def test_route_and_parse(lines_df):
    r = route(lines_df(EXAMPLE))
    li = sorted(r.lineitem.collect(), key=lambda x: x.seq)
    assert [(x.seq, x.sgn, x.l_orderkey, x.line) for x in li] == [(3, 1, 10, 1), (4, -1, 10, 1), (5, 1, 10, 2)]
    assert li[0].l_extendedprice == Decimal("100.00") and li[0].l_discount == Decimal("0.10")
    assert li[0].l_shipdate == dt.date(1995, 4, 1)
    (o,) = r.orders.collect()
    assert (o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_shippriority) == (10, 1, dt.date(1995, 1, 2), 0)
    (c,) = r.customer.collect()
    assert (c.c_custkey, c.c_mktsegment, c.sgn) == (1, "AUTOMOBILE", 1)
    dead = r.dead_letter.collect()
    assert [(d.value, d.reason) for d in dead] == [("+XX1|z", "unknown_tag")]


def test_any_other_op_is_delete(lines_df):
    r = route(lines_df(["*CU1|n|a|1|p|1.0|AUTOMOBILE|c|1"]))
    assert r.customer.collect()[0].sgn == -1


def test_strict_op_dead_letters(lines_df):
    r = route(lines_df(["*CU1|n|a|1|p|1.0|AUTOMOBILE|c|1"]), on_error="dead_letter", strict_op=True)
    assert r.customer.count() == 0
    assert [d.reason for d in r.dead_letter.collect()] == ["bad_op"]


@pytest.mark.parametrize(
    "line,reason",
    [
        ("+OR10|1|O|1.0|1995-01-02", "short_line"),
        ("+ORx|1|O|1.0|1995-01-02|5|clk|0|c|2", "bad_number"),
        ("+OR10|1|O|1.0|1995-1-02|5|clk|0|c|2", "bad_date"),
        ("+OR10|1|O|1.0|1995/01/02|5|clk|0|c|2", "bad_date"),
        ("+OR10|1|O|1.0|1995-01-02 10:00|5|clk|0|c|2", "bad_date"),
        ("+OR10|1|O|1.0|1995-01-02|5|clk|0|c|", "bad_seq"),
        ("+LI10|1|1|1|1.0|1.5x|0.1|0.0|N|O|1995-04-01|3", "bad_number"),
        ("+L", "short_line"),
    ],
)
def test_dead_letter_reasons(lines_df, line, reason):
    r = route(lines_df([line]), on_error="dead_letter")
    assert [d.reason for d in r.dead_letter.collect()] == [reason]
    assert r.orders.count() == 0 and r.lineitem.count() == 0


def test_fail_mode_raises_on_malformed(lines_df):
    r = route(lines_df(["+ORx|1|O|1.0|1995-01-02|5|clk|0|c|2"]))
    with pytest.raises(Exception, match="malformed change record"):
        r.orders.collect()


def test_unknown_tag_dropped_in_fail_mode(lines_df):
    r = route(lines_df(EXAMPLE))
    assert r.lineitem.count() == 3  # the XX line neither fails nor lands in a table


def test_position_seq_follows_file_order(spark, tmp_path):
    """Reference-format lines (no seq field): seq comes from file position."""
    body = [x.rsplit("|", 1)[0] for x in EXAMPLE]
    for i, chunk in enumerate((body[:3], body[3:])):
        (tmp_path / f"part-{i}.txt").write_text("\n".join(chunk) + "\n")
    r = route(spark.read.text(str(tmp_path)), seq_mode="position")
    li = sorted(r.lineitem.collect(), key=lambda x: x.seq)
    assert [(x.sgn, x.line) for x in li] == [(1, 1), (-1, 1), (1, 2)]
    c, o = r.customer.first(), r.orders.first()
    assert c.seq < o.seq < li[0].seq


def test_stage_routes_once_to_parquet(spark, lines_df, tmp_path):
    """One-pass staging: parsed tables and dead letter written as Parquet,
    read back with the same content as the lazy route."""
    from trickle.operators.route import stage

    lines = lines_df(EXAMPLE + ["+ORx|1|O|1.0|1995-01-02|5|clk|0|c|9"])
    staged = stage(spark, lines, str(tmp_path / "staged"))
    lazy = route(lines, on_error="dead_letter")
    for name in ("lineitem", "orders", "customer", "dead_letter"):
        a = sorted(map(tuple, getattr(staged, name).collect()))
        b = sorted(map(tuple, getattr(lazy, name).collect()))
        assert a == b, name
    assert sorted(r.reason for r in staged.dead_letter.collect()) == ["bad_number", "unknown_tag"]


def test_debug_line(lines_df):
    import json

    from trickle.sources.sink import debug_line

    (row,) = debug_line(route(lines_df(EXAMPLE)).customer).collect()
    assert json.loads(row.value) == {"seq": 1, "sgn": 1, "c_custkey": 1, "c_mktsegment": "AUTOMOBILE"}


def test_record_lines(lines_df):
    """The five formats; far money is printed as the double it is; a delta of
    weight 2 (an order inserted twice) is two lines."""
    from trickle.operators import signed
    from trickle.plans import ivm
    from trickle.sources.sink import record_line

    lines = [
        "+CU1|n||1||1.00|AUTOMOBILE||1",
        "+OR10|1|O|1.00|1995-01-02|1-URGENT||0||2",
        "+OR10|1|O|1.00|1995-01-02|1-URGENT||0||3",
        "+LI10|1|1|4|1.00|1e30|0.10|0.00|N|O|1995-06-01|4",
        "-CU1|n||1||1.00|AUTOMOBILE||5",
    ]
    li, od, cu = ivm.changes(lines_df(lines))
    j1 = signed.join1_deltas(od, cu)
    j2 = signed.join2_deltas(li, j1, factors=True)
    got = {k: sorted((r.seq, r.line) for r in record_line(df, k).collect())
           for k, df in {"lineitem": li, "orders": od, "customer": cu, "join1": j1, "join2": j2}.items()}
    order = "orderDate=1995-01-02, shipPriority=0"
    joined = f"Joint_LineItem_Order{{insertion=%s, orderKey=10, {order}, extendedPrice=1.0E30, discount=0.1}}"
    assert got["lineitem"] == [(4, "LineItem{insertion=true, orderKey=10, extendedPrice=1.0E30, discount=0.1, "
                                   "shipDate=1995-06-01, lineNumber=4}")]
    assert got["orders"] == [(s, f"Order{{insertion=true, orderKey=10, custKey=1, {order}}}") for s in (2, 3)]
    assert got["customer"] == [(s, f"Customer{{insertion={i}, custKey=1, mktSegment='AUTOMOBILE'}}")
                               for s, i in ((1, "true"), (5, "false"))]
    inserted, deleted = (f"Order{{insertion={i}, orderKey=10, {order}}}" for i in ("true", "false"))
    assert got["join1"] == [(2, inserted), (3, inserted), (5, deleted), (5, deleted)]
    # the item meets one row of weight two; each deletion takes it twice
    assert {(s, x) for s, x in got["join2"]} == {(4, joined % "true"), (5, joined % "false")}
    assert [s for s, _ in got["join2"]] == [4, 4, 5, 5]


def test_command_line_job(spark, tmp_path):
    """The job reads reference-format files and writes the running values in
    the reference's line format, replacing earlier output."""
    from trickle.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "changes.txt").write_text("\n".join(x.rsplit("|", 1)[0] for x in EXAMPLE) + "\n")
    out = tmp_path / "out"
    out.mkdir()
    (out / "stale.txt").write_text("old output\n")
    main([str(tmp_path / "in"), str(out)])
    lines = sorted(r.value for r in spark.read.text(str(out)).collect())
    assert lines == [
        "Order{orderKey=10, orderDate=1995-01-02, shipPriority=0, revenue=0.0}",
        "Order{orderKey=10, orderDate=1995-01-02, shipPriority=0, revenue=180.0}",
        "Order{orderKey=10, orderDate=1995-01-02, shipPriority=0, revenue=90.0}",
    ]
    main([str(tmp_path / "in"), str(out), "--emit", "final", "--mode", "recompute"])
    assert [r.value for r in spark.read.text(str(out)).collect()] == [
        "Order{orderKey=10, orderDate=1995-01-02, shipPriority=0, revenue=180.0}"
    ]
