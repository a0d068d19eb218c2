"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Queries marked (F) in the survey run over the change feed: the feed is
rendered from the tables as change-log text in the shared folder (once per
session) and read back with ``spark.read.text``, so the whole ingest path
(text scan, decode, route, parse) runs in every one of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trickle.functions import decode as D
from trickle.functions.measures import amount_sql, weighted_sql
from trickle.operators import filters, quality, recompute, signed
from trickle.operators.route import FAR_COLS, Routed, decoded_changes, route
from trickle.plans import ivm
from trickle.operators.static_q3 import q3_static
from trickle.plans.spec import Q3, Q3_1998, Q3Spec
from trickle.session import scratch_path, written
from trickle.sources import sink
from trickle.sources.feed import materialize_feed

Query = Callable[[SparkSession, str], DataFrame]


# --------------------------------------------------------------------------
# Building blocks
# --------------------------------------------------------------------------


def feed_text(spark: SparkSession, sf_dir: str, variant: str = "clean") -> DataFrame:
    """A1: the change log as text lines (``value``)."""
    return spark.read.text(materialize_feed(spark, sf_dir, variant))


def routed(spark: SparkSession, sf_dir: str, variant: str = "clean", on_error: str = "fail",
           strict_op: bool = False) -> Routed:
    return route(feed_text(spark, sf_dir, variant), on_error=on_error, strict_op=strict_op)


def filtered(spark: SparkSession, sf_dir: str, spec: Q3Spec) -> tuple[DataFrame, DataFrame, DataFrame]:
    return ivm.changes(feed_text(spark, sf_dir), spec)


def _money_out(df: DataFrame) -> DataFrame:
    """Money leaves as DOUBLE (the reference's output type)."""
    far = FAR_COLS.items()
    return df.withColumns({x: F.coalesce(f, F.col(x).cast("double")) for f, x in far}).drop(*FAR_COLS)


def deltas(spark: SparkSession, sf_dir: str, spec: Q3Spec) -> DataFrame:
    li, od, cu = filtered(spark, sf_dir, spec)
    return signed.join2_deltas(li, signed.join1_deltas(od, cu))


# --------------------------------------------------------------------------
# Queries
# --------------------------------------------------------------------------


def scan_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return (
        feed_text(spark, sf_dir)
        .select(D.tag(v).alias("tbl"), D.sign(D.op_char(v)).alias("sgn"))
        .groupBy("tbl", "sgn")
        .agg(F.count("*").alias("n"))
    )


def decode_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        feed_text(spark, sf_dir)
        .select(D.tag(F.col("value")).alias("tbl"))
        .groupBy("tbl")
        .agg(F.count("*").alias("n"))
    )


def decode_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        feed_text(spark, sf_dir)
        .select(D.sign(D.op_char(F.col("value"))).alias("sgn"))
        .groupBy("sgn")
        .agg(F.count("*").alias("n"))
    )


def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the text: every record is decoded with its own table's
    columns, of which it has one key."""
    key = F.coalesce("l_orderkey", "o_orderkey", "c_custkey")
    return (
        decoded_changes(feed_text(spark, sf_dir))
        .groupBy(F.col("part").alias("tbl"))
        .agg(F.count("*").alias("n"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))
    )


def dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routed(spark, sf_dir, variant="dirty", on_error="dead_letter", strict_op=True)
    return quality.dead_letter_counts(r.dead_letter)


def parse_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money_out(routed(spark, sf_dir).lineitem)


def parse_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).orders


def parse_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).customer


def filter_lineitem(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    return _money_out(filters.filter_lineitem(routed(spark, sf_dir).lineitem, spec))


def filter_orders(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    return filters.filter_orders(routed(spark, sf_dir).orders, spec)


def filter_customer(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    return filters.filter_customer(routed(spark, sf_dir).customer, spec)


def revenue_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact, far = weighted_sql("sgn")
    return routed(spark, sf_dir).lineitem.selectExpr(
        "seq", "l_orderkey", "line", f"{amount_sql(exact, far)} AS signed_revenue")


def join1_deltas(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    _, od, cu = filtered(spark, sf_dir, spec)
    return signed.join1_deltas(od, cu)


def join1_final(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    _, od, cu = filtered(spark, sf_dir, spec)
    return signed.join1_final(od, cu)


def live_orders(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    _, od, cu = filtered(spark, sf_dir, spec)
    return recompute.live_orders(od, cu)


def join2_deltas(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    return deltas(spark, sf_dir, spec).selectExpr(
        "seq", "l_orderkey", "line", "w", f"{amount_sql('dv', 'df')} AS signed_revenue")


def cascade_delete(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    li, od, cu = filtered(spark, sf_dir, spec)
    return signed.cascade(signed.join2_deltas(li, signed.join1_deltas(od, cu)), cu)


def ivm_q3_final(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    """Flagship (M2): the maintained Q3 view after the whole feed."""
    li, od, cu = filtered(spark, sf_dir, spec)
    return signed.final_view(li, od, cu)


def ivm_q3_final_positional(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    """The flagship over the feed in the reference's own format: no seq
    field, the order of the feed is the order of the lines."""
    li, od, cu = ivm.changes(feed_text(spark, sf_dir, "reference"), spec, seq_mode="position")
    return signed.final_view(li, od, cu)


def ivm_q3_recompute(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    li, od, cu = filtered(spark, sf_dir, spec)
    return recompute.recompute_view(li, od, cu)


def ivm_q3_changelog(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    return signed.changelog(deltas(spark, sf_dir, spec))


def ivm_q3_latest(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    return signed.latest(*filtered(spark, sf_dir, spec))


def render_result(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    view = ivm_q3_final(spark, sf_dir, spec)
    return view.select(sink.render_line(view, with_revenue=False).alias("line"))


def sink_roundtrip(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    """Write the view twice to the same text path (the second replaces the
    first) and read the lines back."""
    path = scratch_path(spark, "sink", unique=True)
    view = ivm_q3_final(spark, sf_dir, spec)
    sink.write_text(view.where(F.col("n") > 1), path)  # a different first result
    sink.write_text(view, path)
    return sink.read_text_result(spark, path)


def debug_lines(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
    """A5: every record between the operators as the reference prints it: the
    filtered changes of the three tables and the deltas of both joins."""
    li, od, cu = filtered(spark, sf_dir, spec)
    j1 = written(signed.join1_deltas(od, cu), "join1-deltas")
    records = {"lineitem": li, "orders": od, "customer": cu, "join1": j1,
               "join2": signed.join2_deltas(li, j1, stored=True, factors=True)}
    return reduce(DataFrame.unionAll, [sink.record_line(df, kind) for kind, df in records.items()])


def dq_phantom_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routed(spark, sf_dir, variant="dirty", on_error="dead_letter", strict_op=True)
    return quality.phantom_deletes(r.lineitem, r.orders, r.customer)


def dq_double_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routed(spark, sf_dir, variant="dirty", on_error="dead_letter", strict_op=True)
    return quality.double_inserts(r.lineitem, r.orders, r.customer)


def _stream(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3) -> DataFrame:
        from trickle.streaming import q3_stream  # streaming needs the state store conf

        return q3_stream.run_stream(spark, sf_dir, spec, kind)

    run.__name__ = f"stream_q3_{kind}"
    return run


stream_q3 = _stream("final")
stream_q3_changelog = _stream("changelog")


def all_queries() -> dict[str, Query]:
    return {
        "q3_static": q3_static,
        "q3_static_1998": partial(q3_static, spec=Q3_1998),
        "scan_feed": scan_feed,
        "decode_tag": decode_tag,
        "decode_op": decode_op,
        "route_counts": route_counts,
        "dead_letter": dead_letter,
        "parse_lineitem": parse_lineitem,
        "parse_orders": parse_orders,
        "parse_customer": parse_customer,
        "filter_lineitem": filter_lineitem,
        "filter_orders": filter_orders,
        "filter_customer": filter_customer,
        "revenue_expr": revenue_expr,
        "join1_deltas": join1_deltas,
        "join1_deltas_1998": partial(join1_deltas, spec=Q3_1998),
        "join1_final": join1_final,
        "live_orders": live_orders,
        "join2_deltas": join2_deltas,
        "join2_deltas_1998": partial(join2_deltas, spec=Q3_1998),
        "cascade_delete": cascade_delete,
        "cascade_delete_1998": partial(cascade_delete, spec=Q3_1998),
        "ivm_q3_final": ivm_q3_final,
        "ivm_q3_final_1998": partial(ivm_q3_final, spec=Q3_1998),
        "ivm_q3_final_positional": ivm_q3_final_positional,
        "ivm_q3_final_positional_1998": partial(ivm_q3_final_positional, spec=Q3_1998),
        "ivm_q3_recompute": ivm_q3_recompute,
        "ivm_q3_recompute_1998": partial(ivm_q3_recompute, spec=Q3_1998),
        "ivm_q3_changelog": ivm_q3_changelog,
        "ivm_q3_changelog_1998": partial(ivm_q3_changelog, spec=Q3_1998),
        "ivm_q3_latest": ivm_q3_latest,
        "ivm_q3_latest_1998": partial(ivm_q3_latest, spec=Q3_1998),
        "render_result": render_result,
        "sink_roundtrip": sink_roundtrip,
        "debug_lines": debug_lines,
        "dq_phantom_delete": dq_phantom_delete,
        "dq_double_insert": dq_double_insert,
        "stream_q3": stream_q3,
        "stream_q3_changelog": stream_q3_changelog,
    }
