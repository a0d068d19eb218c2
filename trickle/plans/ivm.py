"""Public entry points: maintain Q3 over a DataFrame of change-log lines.

    lines = spark.read.text("hdfs://.../changes/")        # one record per line
    view = ivm.view(lines)                                 # the maintained result
    log = ivm.changelog(lines)                             # every running value

All three modes give the same final view on a well-formed feed:
``signed`` (default; no state, order-free), ``recompute`` (net the tables,
then plain Q3) and the continuous query in ``trickle.streaming.q3_stream``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from trickle.operators import filters, recompute, signed
from trickle.operators.route import SEQ_FIELD, Routed, stage
from trickle.plans.spec import Q3, Q3Spec
from trickle.session import scratch_path


def changes(lines: DataFrame, spec: Q3Spec = Q3, on_error: str = "fail",
            seq_mode: str = SEQ_FIELD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed and filtered change tables (lineitem, orders, customer).
    ``seq_mode="position"`` reads the reference's format (no seq field);
    ``on_error="dead_letter"`` leaves malformed records out instead of failing
    (``staged(...).dead_letter`` gives them with their reasons)."""
    r = staged(lines, spec, on_error, seq_mode)
    return r.lineitem, r.orders, r.customer


def staged(lines: DataFrame, spec: Q3Spec = Q3, on_error: str = "fail",
           seq_mode: str = SEQ_FIELD) -> Routed:
    """The change tables after the three selections, and the dead letter: the
    text is read once, and what the query needs of it is written as Parquet
    by table in the shared folder."""
    spark = lines.sparkSession
    path = scratch_path(spark, "changes", unique=True)
    return stage(spark, lines, path, on_error=on_error, seq_mode=seq_mode, keep=filters.selections(spec))


def view(lines: DataFrame, spec: Q3Spec = Q3, mode: str = "signed", keep_empty: bool = False,
         seq_mode: str = SEQ_FIELD, on_error: str = "fail") -> DataFrame:
    """l_orderkey, o_orderdate, o_shippriority, revenue, n after the whole feed."""
    li, od, cu = changes(lines, spec, on_error, seq_mode)
    if mode == "signed":
        return signed.final_view(li, od, cu, keep_empty=keep_empty)
    if mode == "recompute":
        return recompute.recompute_view(li, od, cu)
    raise ValueError(f"unknown mode {mode!r}")


def deltas(lines: DataFrame, spec: Q3Spec = Q3, seq_mode: str = SEQ_FIELD,
           on_error: str = "fail") -> DataFrame:
    """What join 2 emits: seq, l_orderkey, line, o_orderdate, o_shippriority, w, dv."""
    li, od, cu = changes(lines, spec, on_error, seq_mode)
    return signed.join2_deltas(li, signed.join1_deltas(od, cu))


def changelog(lines: DataFrame, spec: Q3Spec = Q3, seq_mode: str = SEQ_FIELD,
              on_error: str = "fail") -> DataFrame:
    """The reference's output: the running value after every delta."""
    return signed.changelog(deltas(lines, spec, seq_mode, on_error))


def latest(lines: DataFrame, spec: Q3Spec = Q3, seq_mode: str = SEQ_FIELD,
           on_error: str = "fail") -> DataFrame:
    """Last running value of every group ever emitted (empty ones kept)."""
    return signed.latest(*changes(lines, spec, on_error, seq_mode))
