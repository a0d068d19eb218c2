"""The change feed: signed change rows derived from the base tables, and their
rendering as change-log text lines.

The reference reads a text file of change records produced by an external
generator that does not ship with it. The feed here is the one described in
FIXTURES.md section 3: every base row is inserted (phase 0); a rule-chosen
part of them is deleted (phase 1); part of those is inserted again
(phase 2). ``seq`` orders the whole feed and is unique.

Phases are produced per row with ``explode`` over a per-row array, so no join
(and no cross join) is involved: the feed grows linearly with the tables.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trickle.functions.measures import money
from trickle.operators.scan import running_sums
from trickle.sources import tables
from trickle.session import scratch_path

# Fixed values of the feed rule (must equal the oracle SQL).
PHASE_STRIDE = 10_000_000_000_000
HASH_MULT = 48271
HASH_MOD = 1_000_003
SLOT = 1_000_000
TABLE_OFFSET = {"CU": 1000, "OR": 2000, "LI": 3000}

FEED_VERSION = "v4"

HOT_ROWS = 200_000  # rows of one order from which on several tasks number them
PART_BYTES = 8 << 20  # of the base tables' files, for each partition of the feed


def _phases(delete_cond: Column, reinsert_cond: Column) -> Column:
    """Array of the phases a base row takes part in: 0 always, 1 if deleted,
    2 if inserted again."""
    return F.array_compact(
        F.array(
            F.lit(0),
            F.when(delete_cond, F.lit(1)),
            F.when(reinsert_cond, F.lit(2)),
        )
    )


def _seq(phase: Column, key: Column, offset: Column | int) -> Column:
    return (
        phase.cast("bigint") * F.lit(PHASE_STRIDE)
        + ((key * F.lit(HASH_MULT)) % F.lit(HASH_MOD)) * F.lit(SLOT)
        + offset
    )


def _sgn(phase: Column) -> Column:
    return F.when(phase == 1, F.lit(-1)).otherwise(F.lit(1))


def customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phase, sgn, seq and the customer row (all its columns)."""
    c = tables.read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return (
        c.withColumn("phase", F.explode(_phases(k % 10 == 3, k % 20 == 3)))
        .withColumn("sgn", _sgn(F.col("phase")))
        .withColumn("seq", _seq(F.col("phase"), k, TABLE_OFFSET["CU"]))
    )


def orders_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phase, sgn, seq and the order row; o_orderdate as DATE, o_shippriority 0
    (the fixture table has no ship priority)."""
    o = tables.read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return (
        o.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
        .withColumn("o_shippriority", F.lit(0))
        .withColumn("phase", F.explode(_phases(k % 7 == 2, k % 14 == 2)))
        .withColumn("sgn", _sgn(F.col("phase")))
        .withColumn("seq", _seq(F.col("phase"), k, TABLE_OFFSET["OR"]))
    )


def _dealt(li: DataFrame, parts: int | None) -> DataFrame:
    return li.repartition(parts, "l_orderkey") if parts else li


def lineitem_changes(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """phase, sgn, seq, the lineitem row and ``line``.

    ``(l_orderkey, l_linenumber)`` is not unique in the fixture tables, but
    the reference keys lineitem state by line number within an order. ``line``
    numbers the rows of an order by all their columns; it is what the rendered
    record carries in the line-number position.

    The rows are exchanged once, by order, into ``parts`` partitions (default:
    the session's). Only orders of more than HOT_ROWS rows, if there are any,
    are numbered by the scan, which spreads them over several tasks.
    """
    li = tables.read_table(spark, sf_dir, "lineitem")
    order = [
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ]
    # at most one key per HOT_ROWS rows
    sizes = li.groupBy("l_orderkey").count().where((F.col("count") > HOT_ROWS) & F.col("l_orderkey").isNotNull())
    hot = sizes.select("l_orderkey").collect()
    by = Window.partitionBy("l_orderkey").orderBy(*order)
    number = F.row_number().over(by).alias("line")
    if not hot:
        numbered = _dealt(li, parts).select("*", number)
    else:
        keys = F.broadcast(spark.createDataFrame(hot, li.select("l_orderkey").schema))
        many = li.join(keys, "l_orderkey", "left_semi").withColumn("_one", F.lit(1))
        numbered = _dealt(li.join(keys, "l_orderkey", "left_anti"), parts).select("*", number).unionByName(
            running_sums(many, ["l_orderkey"], order, {"line": "_one"}).drop("_one"))
    k = F.col("l_orderkey")
    line = F.col("line")
    return (
        numbered.withColumn("line", line.cast("int"))
        .withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
        .withColumn("phase", F.explode(_phases((k + line) % 5 == 1, (k + line) % 15 == 1)))
        .withColumn("sgn", _sgn(F.col("phase")))
        .withColumn("seq", _seq(F.col("phase"), k, F.lit(TABLE_OFFSET["LI"]) + line))
    )


# --------------------------------------------------------------------------
# Rendering as change-log lines: op char, 2-letter tag, '|'-separated fields
# in TPC-H column order, and ``seq`` as one extra last field (readers by fixed
# index ignore it).
# --------------------------------------------------------------------------


def _op(sgn: Column) -> Column:
    return F.when(sgn > 0, F.lit("+")).otherwise(F.lit("-"))


def _s(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def _line(tag: str, fields: list[Column], with_seq: bool) -> Column:
    if with_seq:
        fields = [*fields, _s("seq")]
    return F.concat(_op(F.col("sgn")), F.lit(tag), F.concat_ws("|", *fields))


def render_customer(cu: DataFrame, with_seq: bool = True) -> DataFrame:
    # c_custkey|c_name|c_address|c_nationkey|c_phone|c_acctbal|c_mktsegment|c_comment[|seq]
    fields = [
        _s("c_custkey"), _s("c_name"), F.lit(""), _s("c_nationkey"), F.lit(""),
        _s(money("c_acctbal")), _s("c_mktsegment"), F.lit(""),
    ]
    return cu.select(_line("CU", fields, with_seq).alias("value"), "seq")


def render_orders(od: DataFrame, with_seq: bool = True) -> DataFrame:
    # o_orderkey|o_custkey|o_orderstatus|o_totalprice|o_orderdate|o_orderpriority|o_clerk|o_shippriority|o_comment[|seq]
    fields = [
        _s("o_orderkey"), _s("o_custkey"), _s("o_orderstatus"), _s(money("o_totalprice")),
        _s("o_orderdate"), _s("o_orderpriority"), F.lit(""), _s("o_shippriority"), F.lit(""),
    ]
    return od.select(_line("OR", fields, with_seq).alias("value"), "seq")


def render_lineitem(lc: DataFrame, with_seq: bool = True) -> DataFrame:
    # l_orderkey|l_partkey|l_suppkey|line|l_quantity|l_extendedprice|l_discount|l_tax|l_returnflag|l_linestatus|l_shipdate[|seq]
    fields = [
        _s("l_orderkey"), _s("l_partkey"), _s("l_suppkey"), _s("line"),
        _s(money("l_quantity")), _s(money("l_extendedprice")), _s(money("l_discount")),
        _s(money("l_tax")), _s("l_returnflag"), _s("l_linestatus"), _s("l_shipdate"),
    ]
    return lc.select(_line("LI", fields, with_seq).alias("value"), "seq")


def feed_records(spark: SparkSession, sf_dir: str, with_seq: bool = True, parts: int | None = None) -> DataFrame:
    """All change records of the feed: ``value`` (the line) and ``seq``."""
    return (
        render_customer(customer_changes(spark, sf_dir), with_seq)
        .unionByName(render_orders(orders_changes(spark, sf_dir), with_seq))
        .unionByName(render_lineitem(lineitem_changes(spark, sf_dir, parts), with_seq))
    )


def feed_lines(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """All change records of the feed as one ``value`` column."""
    return feed_records(spark, sf_dir, parts=parts).select("value")


# --------------------------------------------------------------------------
# Anomalous records, derived from the tables by rule, for the dead-letter and
# data-quality outputs. Each rule picks base rows by key and emits one extra
# record per picked row.
# --------------------------------------------------------------------------

# Fixed values of the anomaly rules (must equal the oracle SQL).
ANOMALY_RULES = {
    # dead letter
    "unknown_tag": "customer c_custkey % 97 = 5 -> tag XX",
    "bad_op": "customer c_custkey % 89 = 7 -> op '*'",
    "short_line": "orders o_orderkey % 101 = 7 -> first 5 fields only",
    "bad_number": "orders o_orderkey % 103 = 9 -> o_custkey 'x'",
    "bad_date": "lineitem l_orderkey % 107 = 11 and line = 1 -> shipdate as yyyy/MM/dd",
    # data quality
    "phantom_delete": "lineitem l_orderkey % 109 = 13 and line = 1 -> delete of key + 1,000,000,000 (never inserted), seq - 500",
    "double_insert": "orders o_orderkey % 113 = 17 -> second insert of a live order, seq + 1",
}


def anomaly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra records that must end in the dead letter or a quality report."""
    cu = customer_changes(spark, sf_dir).where("phase = 0")
    od = orders_changes(spark, sf_dir).where("phase = 0")
    lc = lineitem_changes(spark, sf_dir).where("phase = 0")
    ck, ok, lk = F.col("c_custkey"), F.col("o_orderkey"), F.col("l_orderkey")

    unknown = render_customer(cu.where(ck % 97 == 5)).select(
        F.concat(F.lit("+XX"), F.substring("value", 4, 1 << 30)).alias("value"))
    bad_op = render_customer(cu.where(ck % 89 == 7)).select(
        F.concat(F.lit("*"), F.substring("value", 2, 1 << 30)).alias("value"))
    short = render_orders(od.where(ok % 101 == 7)).select(
        F.concat_ws("|", F.slice(F.split("value", r"\|"), 1, 5)).alias("value"))
    bad_num = render_orders(
        od.where(ok % 103 == 9).withColumn("o_custkey", F.lit("x")))
    bad_date = render_lineitem(
        lc.where((lk % 107 == 11) & (F.col("line") == 1)).withColumn(
            "l_shipdate", F.date_format("l_shipdate", "yyyy/MM/dd")))
    phantom = render_lineitem(
        lc.where((lk % 109 == 13) & (F.col("line") == 1))
        .withColumn("l_orderkey", lk + F.lit(1_000_000_000))
        .withColumn("seq", F.col("seq") - 500)
        .withColumn("sgn", F.lit(-1)))
    double_ins = render_orders(od.where(ok % 113 == 17).withColumn("seq", F.col("seq") + 1))
    parts = [unknown, bad_op, short, bad_num, bad_date, phantom, double_ins]
    out = parts[0].select("value")
    for p in parts[1:]:
        out = out.unionByName(p.select("value"))
    return out


# --------------------------------------------------------------------------
# Materialising a feed as text files in the shared folder, once per session.
# --------------------------------------------------------------------------

_MATERIALISED: dict[tuple[str, str, str], str] = {}


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return len(spark.read.text(path).inputFiles()) > 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def _table_state(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the files of the base tables: a feed of
    tables that have been replaced since is not used again."""
    names = [f"{sf_dir}/{t}.parquet" for t in ("customer", "orders", "lineitem")]
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(names)
        .select("path", "length", "modificationTime")
    )
    digest = files.agg(
        F.count("*"), F.sum(F.col("length")), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))
    ).first()
    return "|".join(map(str, digest))


def materialize_feed(spark: SparkSession, sf_dir: str, variant: str = "clean") -> str:
    """Write the feed of ``sf_dir`` as change-log text files (gzip, which Spark's
    text readers read as they are); return the folder.

    ``variant`` is ``clean`` (the feed), ``dirty`` (feed plus anomaly
    records) or ``reference`` (the feed without seq fields, lines in feed
    order, as the reference reads it). The folder is keyed by the input path, the state of its files and
    the feed version, and is written once: a marker dataset is written after the data, and a folder
    with its marker is reused.
    """
    root = scratch_path(spark)
    state = _table_state(spark, sf_dir)
    key = (root, sf_dir, f"{variant}|{state}")
    if key in _MATERIALISED:
        return _MATERIALISED[key]
    digest = hashlib.sha1(f"{sf_dir}|{variant}|{FEED_VERSION}|{state}".encode()).hexdigest()[:16]
    path = f"{root}/feeds/{variant}-{digest}"
    marker = f"{path}.done"
    if not _exists(spark, marker):
        # Lineitem's files are of even size, a multiple of the cores; their number
        # follows the tables, so that no task's share (or sort) grows with them.
        parts = max(2 * spark.sparkContext.defaultParallelism, -(-int(state.split("|")[1]) // PART_BYTES))
        if variant == "reference":
            # The reference's own format: no seq field; the order of the feed
            # is the order of the lines (files in name order). A range sort on
            # seq writes part files in seq order.
            lines = feed_records(spark, sf_dir, False, parts).repartitionByRange(parts, "seq")
            lines = lines.sortWithinPartitions("seq").select("value")
        else:
            # seq orders these: they are written where they are made
            lines = feed_lines(spark, sf_dir, parts)
            if variant == "dirty":
                lines = lines.unionByName(anomaly_lines(spark, sf_dir))
            elif variant != "clean":
                raise ValueError(f"unknown feed variant {variant!r}")
        lines.write.mode("overwrite").option("compression", "gzip").text(path)
        spark.range(1).select(F.lit(path).alias("value")).write.mode("overwrite").text(marker)
    _MATERIALISED[key] = path
    return path
