"""A customer holding most orders: the customer -> orders join is split by
AQE's skew handling (not run in one task), and results do not change."""

from __future__ import annotations

import contextlib

import pytest

from trickle.operators import recompute, signed
from trickle.plans import ivm

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot_feed(spark):
    lines, seq = [], 0
    for c in range(1, 201):
        seq += 1
        lines.append(f"+CU{c}|n||1||1.00|AUTOMOBILE||{seq}")
    for o in range(1, 20001):
        c = 1 if o <= 15000 else 2 + o % 199  # customer 1 holds 3/4 of all orders
        seq += 1
        lines.append(f"+OR{o}|{c}|O|1.00|1995-01-02|1-URGENT||0||{seq}")
        seq += 1
        lines.append(f"+LI{o}|1|1|1|1.00|{o % 1000}.25|0.05|0.00|N|O|1995-06-01|{seq}")
    seq += 1
    lines.append(f"-CU1|n||1||1.00|AUTOMOBILE||{seq}")  # cascades to 15000 orders
    return spark.createDataFrame([(x,) for x in lines], "value string").repartition(8)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("which", ["deltas", "final", "recompute"])
def test_hot_customer_join_is_split(spark, hot_feed, which):
    def build():
        li, od, cu = ivm.changes(hot_feed)
        if which == "deltas":
            return signed.join1_deltas(od, cu)
        if which == "recompute":
            return recompute.recompute_view(li, od, cu)
        return signed.final_view(li, od, cu, keep_empty=True)

    plain = sorted(map(tuple, build().collect()))
    with conf(spark, SKEW_CONF):
        df = build()
        plan = final_plan(df)
        split = sorted(map(tuple, df.collect()))
    assert "SortMergeJoin(skew=true)" in plan
    assert split == plain


def test_changelog_split_path_equals_plain_window(spark):
    """Dealing the running sum into any number of chunks gives the same
    changelog."""
    from conftest import SF001

    from trickle.plans import queries as Q
    from trickle.plans.spec import Q3_1998

    d = Q.deltas(spark, SF001, Q3_1998)
    plain = sorted(map(tuple, signed.changelog(d, chunks=1).collect()))
    split = sorted(map(tuple, signed.changelog(d, chunks=37).collect()))
    assert plain == split and len(plain) == 376


def test_changelog_hot_order_is_spread(spark, lines_df):
    """One order key with many deltas: its running sum is computed in several
    chunks and still equals the sequential running sum."""
    from decimal import Decimal

    lines = ["+CU1|n||1||1.00|AUTOMOBILE||1", "+OR10|1|O|1.00|1995-01-02|1-URGENT||0||2"]
    seq = 2
    for line in range(1, 401):
        seq += 1
        lines.append(f"+LI10|1|1|{line}|1.00|{line}.50|0.10|0.00|N|O|1995-06-01|{seq}")
        if line % 3 == 0:
            seq += 1
            lines.append(f"-LI10|1|1|{line}|1.00|{line}.50|0.10|0.00|N|O|1995-06-01|{seq}")
    d = ivm.deltas(lines_df(lines))
    got = [(r.seq, r.revenue, r.n) for r in signed.changelog(d, chunks=8).orderBy("seq").collect()]
    total, n, want = Decimal(0), 0, []
    for x in lines[2:]:
        f = x.split("|")
        w = 1 if x[0] == "+" else -1
        total += w * Decimal(f[5]) * (1 - Decimal(f[6]))
        n += w
        want.append((int(f[-1]), float(total), n))
    assert got == want


def test_hot_order_join2_is_spread(spark, lines_df):
    """One order holding most lineitem changes: join 2 meets its items by
    (order, rank), so no join key is hot, with the same deltas in any settings."""
    lines = ["+CU1|n||1||1.00|AUTOMOBILE||1"]
    seq = 1
    for o in range(1, 301):
        seq += 1
        lines.append(f"+OR{o}|1|O|1.00|1995-01-02|1-URGENT||0||{seq}")
    for line in range(1, 6001):
        o = 7 if line <= 5000 else 1 + line % 300  # order 7 holds 5/6 of all lineitems
        seq += 1
        lines.append(f"+LI{o}|1|1|{line}|1.00|{line % 97}.25|0.05|0.00|N|O|1995-06-01|{seq}")
    df = lines_df(lines).repartition(8)
    plain = sorted(map(tuple, ivm.deltas(df).collect()))
    with conf(spark, SKEW_CONF):
        d = ivm.deltas(df)
        plan = final_plan(d)
        split = sorted(map(tuple, d.collect()))
    (join,) = [x for x in plan.split("== Initial Plan ==")[0].splitlines() if "SortMergeJoin" in x]
    assert "rank" in join
    assert split == plain and len(plain) == 6000


def test_quality_prefix_split_equals_plain(spark):
    """The data-quality scans give the same sums in any number of chunks."""
    from conftest import SF001

    from trickle.operators import quality, scan
    from trickle.plans import queries as Q

    r = Q.routed(spark, SF001, variant="dirty", on_error="dead_letter", strict_op=True)
    base = quality._base_rows(r.lineitem, r.orders, r.customer)
    plain = sorted(map(tuple, scan.running_sums(base, ["tbl", "key", "line"], ["seq"], {"m": "sgn"}, chunks=1).collect()))
    split = sorted(map(tuple, scan.running_sums(base, ["tbl", "key", "line"], ["seq"], {"m": "sgn"},
                                                chunks=41).collect()))
    assert plain == split


def test_cluster_settings_bounds():
    """Sizing grows with the input but keeps the shuffle partition count
    bounded (map x reduce blocks) and at least three per core."""
    from trickle.session import cluster_settings

    tb = 1 << 40
    big = cluster_settings(100 * tb, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 200_000
    assert int(big["spark.sql.files.maxPartitionBytes"]) == 1 << 30
    small = cluster_settings(1 << 30, 64)
    assert int(small["spark.sql.shuffle.partitions"]) == 192
