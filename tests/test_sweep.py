"""The ordered sweep against all pairs, in any number of chunks, and its work
on keys that change very often."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from trickle.operators import signed
from trickle.operators.sweep import meetings, met, side
from trickle.plans import ivm


def feed(seed: int, n: int, keys: int, rows: int):
    """Random changes of both sides: (seq, key, row, weight), of one seq one
    change each at most; phantom deletes and double inserts among them."""
    rng = random.Random(seed)
    a, b = [], []
    for seq in range(1, n + 1):
        key = 0 if rng.random() < 0.5 else rng.randrange(keys)
        if rng.random() < 0.6:
            a.append((seq, key, rng.randrange(rows), rng.choice([1, 1, -1])))
        if rng.random() < 0.5:
            b.append((seq, key, rng.randrange(rows), rng.choice([1, 1, -1])))
    return a, b


def all_pairs(a, b, same: bool, start: int):
    """(seq, key, a's row, b's row, w * net) by replaying the changes; those
    up to ``start`` are state."""

    def states(changes, key, until, own):
        at: dict = {}
        for s, k, row, w in changes:
            if k == key and (s < until or (s == until and own)):
                if same:
                    at.pop(next((r for r in at if r // 2 == row // 2), None), None)
                    at[row] = 1 if w > 0 else 0
                else:
                    at[row] = at.get(row, 0) + w
        return {r: x for r, x in at.items() if x}

    out = Counter()
    for s, k, row, w in a:
        if s > start:
            for other, net in states(b, k, s, True).items():
                out[s, k, row, other, w * net] += 1
    for s, k, row, w in b:
        if s > start:
            for other, net in states(a, k, s, False).items():
                out[s, k, other, row, w * net] += 1
    return out


@pytest.mark.parametrize("chunks", [1, 6, 50])
@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("start", [0, 60])
def test_sweep_equals_all_pairs(spark, chunks, same, start):
    a, b = feed(chunks + start, 150, 4, 6)

    def table(changes, name):
        rows = [(s, k, r, r // 2, w) for s, k, r, w in changes]
        return spark.createDataFrame(rows, f"seq long, k{name} long, r{name} int, id{name} int, w int")

    def of(changes, name):
        new = [c for c in changes if c[0] > start]
        old = [c for c in changes if c[0] <= start]
        ids = [f"k{name}", f"id{name}"] if same else None
        return side(table(new, name), f"k{name}", [f"k{name}", f"r{name}", f"id{name}"], "w", ids,
                    table(old, name) if start else None)

    got = meetings(of(a, "a"), of(b, "b"), chunks)
    rows = Counter((r.seq, r.ka, r.ra, r.rb, r.w * r.net) for r in got.collect())
    assert rows == all_pairs(a, b, same, start) and len(rows) > 50


@pytest.mark.parametrize("chunks", [1, 6])
@pytest.mark.parametrize("start", [0, 15])
def test_met_is_what_meets(spark, chunks, start):
    """The rows of b with a meeting, of many keys and rows with few changes."""
    a, b = feed(chunks + start, 50, 20, 12)

    def of(changes, name):
        rows = spark.createDataFrame(changes, f"seq long, k{name} long, r{name} int, w int")
        return side(rows.where(f"seq > {start}"), f"k{name}", [f"k{name}", f"r{name}"], "w", None,
                    rows.where(f"seq <= {start}") if start else None)

    got = [(r.kb, r.rb) for r in met(of(a, "a"), of(b, "b"), chunks).collect()]
    want = {(key, row) for _, key, _, row, _ in all_pairs(a, b, False, start)}
    assert len(got) == len(set(got)) and set(got) == want
    assert 0 < len(want) < len({(k, r) for _, k, r, _ in b})


def random_feed(seed: int, n: int) -> list[str]:
    """Changes of few rows in any order: orders and items without customer,
    phantom deletes, rows that come after their partners have gone."""
    rng = random.Random(seed)
    rows = [f"CU{c}|n||1||1.00|AUTOMOBILE||" for c in (1, 2)]
    rows += [f"OR{o}|{o % 3 + 1}|O|1.00|1995-01-0{d}|1-URGENT||0||" for o in range(10, 18) for d in (1, 2)]
    rows += [f"LI{o}|1|1|{i}|1.00|{100 + o}.25|0.10|0.00|N|O|1995-06-01|" for o in range(10, 18) for i in (1, 2)]
    return [f"{rng.choice('++-')}{rng.choice(rows)}{seq}" for seq in range(1, n + 1)]


@pytest.mark.parametrize("seed", range(4))
def test_latest_is_the_sum_of_the_deltas(lines_df, seed):
    """Every group with a delta, once, with the sum of its deltas."""
    li, od, cu = ivm.changes(lines_df(random_feed(seed, 90)))
    want: Counter = Counter()
    sums: Counter = Counter()
    for r in signed.join2_deltas(li, signed.join1_deltas(od, cu)).collect():
        group = (r.l_orderkey, r.o_orderdate, r.o_shippriority)
        want[group] += r.w
        sums[group] += int(r.dv)
    got = signed.latest(li, od, cu).collect()
    assert len(got) == len(want) > 3 and any(r.n == 0 for r in got)
    for r in got:
        group = (r.l_orderkey, r.o_orderdate, r.o_shippriority)
        assert r.n == want[group] and r.revenue == pytest.approx(sums[group] / 1e16, abs=1e-9)


def test_latest_of_pairs_that_never_met(lines_df):
    """The item has gone before the order comes: the changes of all three
    tables join, but there never was a row."""
    cu, order = "CU1|n||1||1.00|AUTOMOBILE||", "OR10|1|O|1.00|1995-01-02|1-URGENT||0||"
    item = "LI10|1|1|1|1.00|100.00|0.10|0.00|N|O|1995-06-01|"
    lines = [f"+{cu}1", f"+{item}2", f"-{item}3", f"+{order}4"]
    assert len(ivm.view(lines_df(lines), keep_empty=True).collect()) == 1
    assert ivm.latest(lines_df(lines)).collect() == []
    assert [(r.revenue, r.n) for r in ivm.latest(lines_df([*lines, f"+{item}5"])).collect()] == [(90.0, 1)]


def test_latest_makes_no_deltas_of_a_hot_order(spark, lines_df):
    """One order that flips 2,000 times over 2,000 items has 4 * 10^6 deltas;
    its latest value is found in time that follows the changes."""
    n = 2_000
    lines = lines_df(["+CU1|n||1||1.00|AUTOMOBILE||1"]).unionAll(spark.range(n).selectExpr(
        "concat('+LI10|1|1|', id, '|1.00|100.00|0.10|0.00|N|O|1995-06-01|', id + 2) AS value")
    ).unionAll(spark.range(n).selectExpr(
        f"concat(IF(id % 2 = 0, '+', '-'), 'OR10|1|O|1.00|1995-01-02|1-URGENT||0||', id + {n} + 2) AS value"))
    got = ivm.latest(lines)
    assert [(r.revenue, r.n) for r in got.collect()] == [(0.0, 0)]
    assert made(got) < 10 * n


def made(df) -> int:
    """Rows that come out of the joins and generators of an executed plan."""
    total, names = 0, ("Generate", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin")
    to_list = df.sparkSession._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            nodes.append(node.plan())
        if name.startswith(names):
            total += node.metrics().apply("numOutputRows").value()
        nodes += list(to_list(node.children()))
    return total


@pytest.mark.parametrize("join", [1, 2])
def test_hot_key_that_flips(spark, lines_df, join):
    """One key, 20,000 changes of either side: the joins and generators give
    out rows in proportion to changes and deltas, not pairs (4 * 10^8)."""
    n = 20_000
    order = "OR10|1|O|1.00|1995-01-02|1-URGENT||0||"
    first = "CU1|n||1||1.00|AUTOMOBILE||" if join == 1 else order
    then = order if join == 1 else "LI10|1|1|1|1.00|100.00|0.10|0.00|N|O|1995-06-01|"
    lines = spark.range(2 * n).selectExpr(
        f"concat(IF((id div 2) % 2 = 0, '+', '-'), IF(id % 2 = 0, '{first}', '{then}'), id + 2) AS value")
    if join == 2:
        lines = lines.unionAll(lines_df(["+CU1|n||1||1.00|AUTOMOBILE||1"]))
    li, od, cu = ivm.changes(lines)
    deltas = signed.join1_deltas(od, cu)
    if join == 2:
        deltas = signed.join2_deltas(li, deltas)
    rows = deltas.collect()
    # of four changes (+a, +b, -a, -b) b comes while a is there and a goes while b is there
    assert len(rows) == n
    assert made(deltas) <= 4 * len(rows)


def test_hot_row_is_cut_into_chunks(spark):
    """One base row with 200,000 changes: its intervals are made per chunk."""
    n = 200_000
    a = spark.range(n).selectExpr(
        "2 * id AS seq", "1L AS ka", "1 AS ra", "IF(id % 2 = 0, 1, -1) AS w")
    b = spark.range(1000).selectExpr("id * 400 + 1 AS seq", "1L AS kb", "1 AS rb", "IF(id % 2 = 0, 1, -1) AS w")
    got = meetings(side(a, "ka", ["ka", "ra"], "w"), side(b, "kb", ["kb", "rb"], "w"), 16)
    assert got.where("w * net > 0").count() + got.where("w * net < 0").count() == got.count()
    by_b = got.where("seq % 2 = 1").count()
    by_a = got.where("seq % 2 = 0").count()
    # b's changes come at a seq after an insert of a; b is there half of the time
    assert by_b == 1000 and by_a == n // 2
