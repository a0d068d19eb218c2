"""Continuous Q3 (M3): Structured Streaming over change-log text files.

    readStream.text -> foreachBatch: decode/route/parse and filter in one pass
      -> join-1 deltas, join-2 deltas, running sums (operators.signed)
         against the rows kept from earlier batches
      -> changelog rows, dead letters, the new versions of the state

A micro-batch is a batch of DataFrame work: its changes meet each other in
``seq`` order, and the kept rows as changes that came before. All of it runs in
the JVM, hot keys are split as in the batch mode, and no state is held in
Python.

State (``streaming.state``): four tables of rows (customers and orders by
customer key, join-1 rows and lineitems by order key) and the view by order
key, as log-structured Parquet in hash buckets. A batch reads the buckets of
its keys, of their rows those with its keys, and writes its own changes. The
manifest of batch k is put in place last; a batch that is run again after a
failure reads manifest k - 1 and replaces what it wrote. Versions no manifest
needs and the batch's intermediate files are deleted.

Sinks, append-only by batch id and replaced by the same rows when a batch is
run again: ``log/batch_id=k`` (changelog), ``lines/batch_id=k`` (as text), and
``dead/batch_id=k`` (malformed records with their reasons).

``state="present"`` keeps rows as the reference's keyed state does (the last
change of a key decides). That needs the feed's order, so a micro-batch with a
``seq`` not beyond all earlier ones is an error. ``state="net"`` keeps signed
weights: the view is a sum of sign products and does not depend on the order
of batches, so late files are taken, and change the running values from then
on. The two agree on well-formed feeds.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trickle.functions import decode as D
from trickle.functions.measures import amount_sql
from trickle.operators import filters, signed
from trickle.operators.route import SEQ_FIELD, SEQ_POSITION, stage
from trickle.plans.spec import Q3, Q3Spec
from trickle.session import exists, remove, scratch_folder, scratch_path, written
from trickle.sources import sink
from trickle.sources.feed import materialize_feed
from trickle.streaming.state import Manifest, State, Table, bucket_of

BUCKETS = 32  # of a new stream; about the cores that work on a batch, or more
VIEW = ["l_orderkey", "o_orderdate", "o_shippriority"]
VIEW_SCHEMA = "l_orderkey bigint, o_orderdate date, o_shippriority int, rev decimal(38,0), far double, n bigint"


def tables(present: bool) -> dict[str, Table]:
    def last(name: str) -> list[str] | None:
        return signed.KEYS[name] if present else None

    return {
        "customers": Table("c_custkey", ["c_custkey", "c_mktsegment"], ["w"], last("customers")),
        "orders": Table("o_custkey", ["o_custkey", *signed.J1_COLS], ["w"], last("orders")),
        "joined": Table("o_orderkey", signed.J1_COLS, ["w"], last("joined")),
        "items": Table("l_orderkey", signed.ITEM_COLS, ["w"], last("items")),
        "view": Table("l_orderkey", VIEW, ["rev", "far", "n"]),
    }


def _earlier(seq_mode: str) -> Column:
    """The ``seq`` of a kept row: before any change, in the order of versions."""
    v = F.col("v")
    if seq_mode == SEQ_FIELD:
        return F.lit(-(1 << 63)) + v
    return F.struct(F.lit("").alias("file"), F.lit(-1).cast("bigint").alias("block"), v.alias("row"))


def _counts(changes: dict[str, DataFrame], keys: dict[str, str], buckets: int, order: bool):
    """Rows per table and bucket, and the least and greatest ``seq``, in one
    job; tables x buckets rows reach the driver."""
    all_of = None
    for name, c in changes.items():
        seq = F.col("seq") if order else F.lit(None).cast("bigint").alias("seq")
        part = c.select(F.lit(name).alias("name"), bucket_of(F.col(keys[name]), buckets).alias("b"), seq)
        all_of = part if all_of is None else all_of.unionAll(part)
    rows = all_of.groupBy("name", "b").agg(
        F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).collect()
    counts: dict[str, dict[int, int]] = {name: {} for name in changes}
    for r in rows:
        counts[r.name][r.b] = r.n
    low = min((r.low for r in rows if r.low is not None), default=None)
    high = max((r.high for r in rows if r.high is not None), default=None)
    return counts, low, high


def _batch_job(out_path: str, spec: Q3Spec = Q3, seq_mode: str = SEQ_FIELD, on_error: str = "fail",
               text: bool = False, state: str = "present", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    if state not in ("present", "net"):
        raise ValueError(f"unknown state {state!r}")
    present = state == "present"
    layout = tables(present)
    keys = {name: t.key for name, t in layout.items()}

    def run(batch: DataFrame, batch_id: int) -> None:
        work = f"{out_path}/work/batch={batch_id}"
        remove(batch.sparkSession, work)  # of a try that failed
        if batch_id == 0:  # a new stream replaces what an earlier one left
            for name in ("state", "log", "lines", "dead"):
                remove(batch.sparkSession, f"{out_path}/{name}")
        with scratch_folder(work):
            one_batch(batch, batch_id, work)
        remove(batch.sparkSession, work)

    def one_batch(batch: DataFrame, batch_id: int, work: str) -> None:
        spark = batch.sparkSession
        kept = State(spark, f"{out_path}/state", layout, buckets)
        old = kept.manifest(batch_id - 1)
        kept.buckets = old.buckets
        lines = batch
        if seq_mode == SEQ_POSITION:
            lines = batch.select(
                "value", F.struct("file", "block", F.monotonically_increasing_id().alias("row")).alias("_pos_seq")
            )
        r = stage(spark, lines, f"{work}/changes", on_error=on_error, seq_mode=seq_mode,
                  keep=filters.selections(spec))
        if on_error == "dead_letter":
            r.dead_letter.write.mode("overwrite").parquet(f"{out_path}/dead/batch_id={batch_id}")
        changes = {"customers": r.customer, "orders": r.orders, "items": r.lineitem}
        changes = {name: c.withColumnRenamed("sgn", "w") for name, c in changes.items()}
        by_order = present and seq_mode == SEQ_FIELD
        counts, low, high = _counts(changes, keys, kept.buckets, by_order)
        if by_order and low is not None and old.last_seq is not None and low <= old.last_seq:
            raise ValueError(f"late change: seq {low} arrived after {old.last_seq}; "
                             "feed files in order, or use state='net'")
        last_seq = max((x for x in (old.last_seq, high) if x is not None), default=None)

        def schema_of(name: str, like: DataFrame) -> str:
            t = layout[name]
            types = {f.name: f.dataType.simpleString() for f in like.schema.fields}
            return ", ".join([f"{c} {types[c]}" for c in t.row] + ["w bigint"])

        schemas = {name: schema_of(name, c) for name, c in changes.items()}
        schemas["view"] = VIEW_SCHEMA

        def before(name: str, met: str) -> DataFrame | None:
            """Kept rows whose key has changes in table ``met`` of this batch."""
            rows = kept.read(old, name, schemas[name], set(counts[met]))
            if rows is None:
                return None
            own = changes[met].select(F.col(keys[met]).alias("_met"))
            rows = rows.join(own, F.col(keys[name]) == F.col("_met"), "left_semi")
            return rows.select(_earlier(seq_mode).alias("seq"), *layout[name].row, *layout[name].sums)

        sgn = {name: c.withColumnRenamed("w", "sgn") for name, c in changes.items()}
        earlier = {name: before(name, met) for name, met in (("customers", "orders"), ("orders", "customers"))}
        earlier = {n: d if d is None else d.withColumnRenamed("w", "sgn") for n, d in earlier.items()}
        j1 = written(
            signed.join1_deltas(sgn["orders"], sgn["customers"], earlier["orders"], earlier["customers"], present),
            "join1-batch",
        )
        changes["joined"] = j1
        schemas["joined"] = schema_of("joined", j1)
        counts |= _counts({"joined": j1}, keys, kept.buckets, False)[0]
        items = before("items", "joined")
        deltas = written(
            signed.join2_deltas(
                sgn["items"], j1, items if items is None else items.withColumnRenamed("w", "sgn"),
                before("joined", "items"), present, stored=True),
            "deltas-batch",
        )
        changes["view"] = deltas.selectExpr(
            "seq", *VIEW, "dv AS rev", "df AS far", "CAST(w AS BIGINT) AS n")
        counts |= _counts({"view": changes["view"]}, keys, kept.buckets, False)[0]

        base = before("view", "view")
        if base is not None:
            base = base.selectExpr("seq", "l_orderkey", "rev AS dv", "far AS df", "CAST(n AS INT) AS w")
        log = signed.changelog(deltas, before=base)
        log.write.mode("overwrite").parquet(f"{out_path}/log/batch_id={batch_id}")
        if text:
            done = spark.read.schema(log.schema).parquet(f"{out_path}/log/batch_id={batch_id}")
            sink.write_text(done, f"{out_path}/lines/batch_id={batch_id}")

        def add(name: str):
            t = layout[name]
            cols = [c for c in changes[name].columns if c in (*t.row, *t.sums)]
            if t.last_by is None:
                net = changes[name].groupBy(*t.row).agg(
                    *[F.sum(c).cast("decimal(38,0)" if c == "rev" else "double" if c == "far" else "bigint").alias(c)
                      for c in t.sums])
            else:
                last = changes[name].groupBy(*t.last_by).agg(F.max_by(F.struct(*cols), "seq").alias("_r"))
                net = last.select(*[F.col(f"_r.{c}") for c in t.row], F.col("_r.w").cast("bigint").alias("w"))
            return kept.add(old, batch_id, name, net, counts[name], schemas[name])

        with ThreadPoolExecutor(len(layout)) as pool:  # small writes, side by side
            new = dict(zip(layout, pool.map(add, layout)))
        kept.commit(Manifest(batch_id, last_seq, kept.buckets, new))

    return run


def start(spark: SparkSession, in_path: str, ckpt: str, out_path: str, spec: Q3Spec = Q3,
          available_now: bool = True, max_files: int | None = None, seq_mode: str = SEQ_FIELD,
          on_error: str = "fail", text: bool = False, state: str = "present", buckets: int = BUCKETS):
    """Start the continuous query over the text files arriving in ``in_path``;
    on a checkpoint that has been used it goes on where it stopped. ``text``
    also writes the changelog as result lines (``lines/``). ``buckets`` cut the
    state of a new stream; size them so that a bucket fits a task."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    lines = reader.load(in_path)
    if seq_mode == SEQ_POSITION:  # the reference's format
        lines = lines.select(
            "value", F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
    w = (
        lines.writeStream.foreachBatch(_batch_job(out_path, spec, seq_mode, on_error, text, state, buckets))
        .option("checkpointLocation", ckpt)
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    return w.start()


def feed_in_order(spark: SparkSession, lines: DataFrame, parts: int) -> list[DataFrame]:
    """Split a feed into ``parts`` consecutive seq ranges (boundaries from
    approximate quantiles: a handful of numbers reach the driver)."""
    seq = D.seq_of(F.col("value"))
    keyed = lines.withColumn("_seq", seq)
    if parts <= 1:
        return [lines]
    qs = keyed.approxQuantile("_seq", [i / parts for i in range(1, parts)], 0.001)
    bounds = [None, *sorted(set(qs)), None]
    out = []
    for lo, hi in zip(bounds, bounds[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col("_seq") >= lo)
        if hi is not None:
            cond = cond & (F.col("_seq") < hi)
        out.append(keyed.where(cond).select("value"))
    return out


def read_changelog(spark: SparkSession, out_path: str) -> DataFrame:
    """The stream's changelog rows in the batch twin's columns."""
    return spark.read.parquet(f"{out_path}/log").select(
        "seq", "l_orderkey", "line", "o_orderdate", "o_shippriority", "revenue", "n"
    )


def read_dead_letter(spark: SparkSession, out_path: str) -> DataFrame:
    """batch_id, value, tbl, reason of every malformed record so far."""
    schema = "value string, tbl string, reason string, batch_id int"
    if not exists(spark, f"{out_path}/dead"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out_path}/dead").select("batch_id", "value", "tbl", "reason")


def kept_rows(spark: SparkSession, out_path: str, name: str, present: bool = True) -> DataFrame | None:
    """A state table's live rows after the last completed batch; None where
    nothing was kept."""
    state = State(spark, f"{out_path}/state", tables(present), BUCKETS)
    versions = state.read(state.manifest(), name)
    return None if versions is None else state.fold(name, versions, True).drop("bucket")


def latest_view(spark: SparkSession, out_path: str) -> DataFrame:
    """The maintained view after the last completed batch."""
    view = kept_rows(spark, out_path, "view")
    view = spark.createDataFrame([], VIEW_SCHEMA) if view is None else view
    return view.where("n > 0").selectExpr(*VIEW, f"{amount_sql('rev', 'far')} AS revenue", "n")


def run_lines(spark: SparkSession, lines: DataFrame, spec: Q3Spec = Q3, kind: str = "final",
              parts: int = 3, base: str | None = None, on_error: str = "fail") -> DataFrame:
    """Feed ``lines`` to the continuous query in ``parts`` seq-ordered steps
    (each one an ``availableNow`` run that resumes from the checkpoint of the
    one before, as after a restart) and return its result: the ``final`` view
    or the full ``changelog``."""
    base = base or scratch_path(spark, "stream", unique=True)
    in_path, ckpt, out_path = f"{base}/in", f"{base}/ckpt", f"{base}/out"
    for chunk in feed_in_order(spark, lines, parts):
        chunk.write.mode("append").text(in_path)
        q = start(spark, in_path, ckpt, out_path, spec, on_error=on_error)
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(f"stream failed: {q.exception()}")
    if kind == "changelog":
        return read_changelog(spark, out_path)
    if kind == "final":
        return latest_view(spark, out_path)
    raise ValueError(f"unknown kind {kind!r}")


def run_stream(spark: SparkSession, sf_dir: str, spec: Q3Spec = Q3, kind: str = "final",
               parts: int = 2) -> DataFrame:
    """The continuous query over the change feed of ``sf_dir``, delivered in
    ``parts`` seq-ordered steps (state carries over between them)."""
    lines = spark.read.text(materialize_feed(spark, sf_dir))
    return run_lines(spark, lines, spec, kind, parts)
