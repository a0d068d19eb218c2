"""Continuous mode: same answers as the batch engine, across micro-batch
splits and restarts."""

from __future__ import annotations

import model
import pytest
from conftest import SF001

from trickle.plans import ivm
from trickle.plans import queries as Q
from trickle.plans.spec import Q3_1998
from trickle.session import scratch_path
from trickle.streaming import q3_stream
from test_handlers import CASES


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_stream_matches_batch_at_sf0001(spark):
    lines = Q.feed_text(spark, SF001)
    batch_final = rows(Q.ivm_q3_final(spark, SF001, Q3_1998))
    batch_log = rows(Q.ivm_q3_changelog(spark, SF001, Q3_1998))
    for parts in (1, 4):
        base = scratch_path(spark, "test-stream", unique=True)
        assert rows(q3_stream.run_lines(spark, lines, Q3_1998, "final", parts, base)) == batch_final
        assert rows(q3_stream.read_changelog(spark, f"{base}/out")) == batch_log


def test_stream_handlers_match_model(spark, lines_df):
    # two hand-written cases in one feed, seq kept unique
    lines = CASES["customer_delete_cascades"] + [
        x.rsplit("|", 1)[0] + f"|{100 + i}" for i, x in enumerate(CASES["order_delete"])
    ]
    got = q3_stream.run_lines(spark, lines_df(lines), kind="changelog", parts=2)
    have = sorted((r.seq, r.l_orderkey, r.line, round(r.revenue, 4), r.n) for r in got.collect())
    want = sorted((s, k, ln, round(v, 4), n) for s, k, ln, d, p, v, n in model.run(lines))
    assert have == want


def test_restart_resumes_from_checkpoint(spark):
    """Stop after part of the feed, start a new query on the same checkpoint,
    feed the rest: same result as one uninterrupted run."""
    lines = Q.feed_text(spark, SF001)
    chunks = q3_stream.feed_in_order(spark, lines, 3)
    base = scratch_path(spark, "test-restart", unique=True)
    in_path, ckpt, out = f"{base}/in", f"{base}/ckpt", f"{base}/out"
    for chunk in chunks:
        chunk.write.mode("append").text(in_path)
        q = q3_stream.start(spark, in_path, ckpt, out, Q3_1998)
        q.awaitTermination()
        q.stop()
    assert rows(q3_stream.latest_view(spark, out)) == rows(Q.ivm_q3_final(spark, SF001, Q3_1998))


def test_state_shrinks_to_nothing_after_deleting_everything(spark, lines_df):
    """Insert rows, then delete all of them: no net row is left in the state
    (it is bounded by the live rows)."""
    ins = CASES["customer_delete_cascades"][:-1]  # customer, two orders, two lineitems
    seq = 100
    dels = []
    for x in reversed(ins):
        seq += 1
        dels.append("-" + x[1:].rsplit("|", 1)[0] + f"|{seq}")
    base = scratch_path(spark, "test-shrink", unique=True)
    in_path, ckpt, out = f"{base}/in", f"{base}/ckpt", f"{base}/out"
    sizes = []
    for chunk in (ins, dels):
        lines_df(chunk).coalesce(1).write.mode("append").text(in_path)
        q = q3_stream.start(spark, in_path, ckpt, out)
        q.awaitTermination()
        kept = [q3_stream.kept_rows(spark, out, t) for t in q3_stream.tables(True)]
        sizes.append([0 if k is None else k.count() for k in kept])
    assert sizes == [[1, 2, 2, 2, 2], [0, 0, 0, 0, 0]]
    assert q3_stream.latest_view(spark, out).collect() == []


def test_late_file(spark, lines_df):
    """A customer delete and a lineitem arrive one batch late, with earlier
    seqs: an error where the order decides; with net state the view is that
    of the whole feed."""
    feed = CASES["customer_delete_cascades"][:-1]
    late = ["-CU1|n||1||1.00|AUTOMOBILE||2", "+LI10|1|1|9|1.00|7.00|0.00|0.00|N|O|1995-04-01|3"]
    later = ["+CU1|n||1||1.00|AUTOMOBILE||50"]
    on_time = [x.rsplit("|", 1)[0] + f"|{10 + i}" for i, x in enumerate(feed)]
    base = scratch_path(spark, "test-late", unique=True)
    for chunk in (on_time, late, later):
        lines_df(chunk).coalesce(1).write.mode("append").text(f"{base}/in")
        q3_stream.start(
            spark, f"{base}/in", f"{base}/ckpt", f"{base}/out", state="net").awaitTermination()
    assert rows(q3_stream.latest_view(spark, f"{base}/out")) == rows(ivm.view(lines_df(on_time + late + later)))

    base = scratch_path(spark, "test-late", unique=True)
    with pytest.raises(Exception, match="late change"):
        for chunk in (on_time, late):
            lines_df(chunk).coalesce(1).write.mode("append").text(f"{base}/in")
            q3_stream.start(spark, f"{base}/in", f"{base}/ckpt", f"{base}/out").awaitTermination()


def test_stream_reads_the_reference_format(spark, lines_df):
    """Files without seq, by position; result lines in the reference's form."""
    lines = [x.rsplit("|", 1)[0] for x in CASES["customer_delete_cascades"]]
    base = scratch_path(spark, "test-position", unique=True)
    for i in (0, 3):
        lines_df(lines[i : i + 3]).coalesce(1).write.mode("append").text(f"{base}/in")
        q3_stream.start(
            spark, f"{base}/in", f"{base}/ckpt", f"{base}/out", seq_mode="position", text=True
        ).awaitTermination()
    log = q3_stream.read_changelog(spark, f"{base}/out").collect()
    want = model.run(CASES["customer_delete_cascades"])
    assert sorted((r.l_orderkey, r.line, r.revenue, r.n) for r in log) == sorted(
        (k, ln, v, n) for _, k, ln, _, _, v, n in want
    )
    assert spark.read.text(f"{base}/out/lines").where("value LIKE 'Order{orderKey=%'").count() == len(want)


def test_batch_run_again_gives_the_same(spark, lines_df):
    """A batch repeated after a failure reads and writes what it did."""
    base = scratch_path(spark, "test-again", unique=True)
    parts = [CASES["customer_delete_cascades"][:4], CASES["customer_delete_cascades"][4:]]
    job = q3_stream._batch_job(f"{base}/out")
    job(lines_df(parts[0]), 0)
    job(lines_df(parts[1]), 1)
    once = rows(q3_stream.read_changelog(spark, f"{base}/out"))
    job(lines_df(parts[1]), 1)
    assert rows(q3_stream.read_changelog(spark, f"{base}/out")) == once


def test_stream_fails_on_a_bad_line(spark, lines_df):
    bad = CASES["order_delete"][2].replace("1995-04-01", "1995/04/01")
    with pytest.raises(Exception, match="malformed change record"):
        q3_stream.run_lines(spark, lines_df([*CASES["order_delete"], bad]), parts=1)
    kept = q3_stream.run_lines(
        spark, lines_df([*CASES["order_delete"], bad]), kind="changelog", parts=1, on_error="dead_letter"
    )
    assert kept.count() == len(model.run(CASES["order_delete"]))


def stored(spark, path):
    """(folders, bytes) below a path."""
    from trickle.session import _hadoop

    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return 0, 0
    summary = fs.getContentSummary(p)
    return summary.getDirectoryCount(), summary.getLength()


def test_a_batch_writes_and_reads_what_it_touches(spark, lines_df):
    """A million live lineitems, then ten lines: the second batch writes a few
    files and reads the buckets of its keys only."""
    from trickle.streaming.state import State, bucket_of
    from pyspark.sql import functions as F

    base = scratch_path(spark, "test-touch", unique=True)
    job = q3_stream._batch_job(f"{base}/out", buckets=64)
    first = spark.range(1_000_000).selectExpr(
        "concat('+LI', id div 4, '|1|1|', id % 4, '|1.00|100.00|0.10|0.00|N|O|1995-06-01|', id + 1) AS value")
    job(first, 0)
    _, before = stored(spark, f"{base}/out/state")
    job(lines_df(["+CU1|n||1||1.00|AUTOMOBILE||2000001"] + [
        f"+OR{k}|1|O|1.00|1995-01-02|1-URGENT||0||{2000002 + k}" for k in range(9)]), 1)
    assert [(r.l_orderkey, r.n) for r in q3_stream.latest_view(spark, f"{base}/out").orderBy("l_orderkey").collect()
            ] == [(k, 4) for k in range(9)]
    written = sum(stored(spark, f"{base}/out/state/{t}/v=1")[1] for t in q3_stream.tables(True))
    assert 0 < written < before / 50
    state = State(spark, f"{base}/out/state", q3_stream.tables(True), 64)
    touched = {r.b for r in spark.range(9).select(bucket_of(F.col("id"), 64).alias("b")).collect()}
    rows = state.read(state.manifest(), "items", None, touched)
    read = {f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}
    assert read == {str(b) for b in touched} and len(read) < 10


def test_folders_do_not_grow(spark, lines_df):
    """Batches of changes to few keys: versions are merged, what no manifest
    lists and the batches' own files go."""
    from trickle.session import names
    from trickle.streaming.state import State

    base = scratch_path(spark, "test-folders", unique=True)
    job = q3_stream._batch_job(f"{base}/out", buckets=2, on_error="dead_letter")
    lines, n = [], 9
    for k in range(n):
        op = "+" if k % 2 == 0 else "-"
        seq = 10 * k
        some = [f"{op}CU1|n||1||1.00|AUTOMOBILE||{seq + 1}", f"+LI{k}|1|1|1|1.00|{k}.00|0.10|0.00|N|O|1995-06-01|{seq + 2}",
                f"+OR{k}|1|O|1.00|1995-01-02|1-URGENT||0||{seq + 3}"]
        if k == 0:
            some.append("+LIbad|line")
        lines += some
        job(lines_df(some), k)
    path = f"{base}/out/state"
    state = State(spark, path, q3_stream.tables(True), 2)
    assert names(spark, f"{path}/manifest") == [f"{k:09d}.json" for k in (n - 2, n - 1)]
    listed = set()
    for k in (n - 2, n - 1):
        for t, buckets in state.manifest(k).tables.items():
            for b, versions in buckets.items():
                assert len(versions) <= 2 + sum(x for _, x in versions).bit_length()
                listed |= {(t, f"v={v}", f"bucket={b}") for v, _ in versions}
    there = {
        (t, v, b) for t in q3_stream.tables(True) for v in names(spark, f"{path}/{t}")
        for b in names(spark, f"{path}/{t}/{v}") if b.startswith("bucket=")
    }
    assert there == listed and len({v for _, v, _ in there}) < n
    assert names(spark, f"{base}/out/work") == []
    # the bad line of the first batch is still there, and so is all of the log
    dead = q3_stream.read_dead_letter(spark, f"{base}/out").collect()
    assert [(r.batch_id, r.value) for r in dead] == [(0, "+LIbad|line")]
    good = [x for x in lines if "bad" not in x]
    have = sorted((r.seq, r.l_orderkey, r.line, round(r.revenue, 4), r.n)
                  for r in q3_stream.read_changelog(spark, f"{base}/out").collect())
    assert have == sorted((s, k, ln, round(v, 4), n) for s, k, ln, d, p, v, n in model.run(good))
