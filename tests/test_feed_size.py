"""The rendering of the feed: little to write and to exchange, in shares that
do not grow with the tables, and the same line numbers on every path."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest import SF01  # noqa: E402

from trickle.session import scratch_folder  # noqa: E402
from trickle.sources import feed  # noqa: E402


def size_of(path: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def test_feed_is_no_larger_than_its_tables(spark, tmp_path):
    base = sum(os.path.getsize(f"{SF01}/{t}.parquet") for t in ("customer", "orders", "lineitem"))
    with scratch_folder(str(tmp_path)):
        for variant in ("clean", "dirty", "reference"):
            assert size_of(feed.materialize_feed(spark, SF01, variant)) < 1.5 * base


def test_clean_feed_exchanges_no_rendered_lines(spark):
    plan = feed.feed_lines(spark, SF01, 16)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange " in x]
    assert len(exchanges) == 1 and "hashpartitioning(l_orderkey" in exchanges[0]


def test_partitions_follow_the_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "PART_BYTES", 20_000)
    with scratch_folder(str(tmp_path)):
        path = feed.materialize_feed(spark, SF01, "reference")
    base = sum(os.path.getsize(f"{SF01}/{t}.parquet") for t in ("customer", "orders", "lineitem"))
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) > 0.9 * base / 20_000


def test_large_orders_get_the_same_lines(spark, tmp_path, monkeypatch):
    """Orders numbered by the scan and orders numbered at once agree, for an
    order key that is null too."""
    li = spark.read.parquet(f"{SF01}/lineitem.parquet").where("l_orderkey < 300")
    li = li.unionByName(li.where("l_orderkey % 10 = 1").withColumn("l_orderkey", li.l_orderkey * 0 + 7))
    li = li.unionByName(li.limit(50).selectExpr("* EXCEPT (l_orderkey)", "CAST(NULL AS BIGINT) AS l_orderkey"))
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "line", "phase", "seq"]

    def lines():
        return sorted(map(str, feed.lineitem_changes(spark, str(tmp_path), 4).select(cols).collect()))

    plain = lines()
    monkeypatch.setattr(feed, "HOT_ROWS", 5)
    assert lines() == plain and len(plain) > 300
