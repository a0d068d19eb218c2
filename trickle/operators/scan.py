"""Running sums per key that never put one hot key into one task.

Rows are range-partitioned once on (key, order) into ordered chunks and
written to the shared folder with their chunk id, so every later step reads
the same rows in the same chunk (a second range exchange would sample other
boundaries). Each chunk runs its own window per key. Only an *open* key, one
that goes on from one chunk into the next, needs the totals of its other
chunks; there is at most one such key per boundary, so the open keys and the
table of carries have at most as many rows as there are chunks, however many
rows a key has.

There is no size switch: all keys take the same path (the carries of no open
key are left out of the plan).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trickle.session import written


class Chunks(NamedTuple):
    """Rows in ordered chunks (column ``_chunk``); the open keys, None without any."""

    rows: DataFrame
    open_keys: DataFrame | None


def ordered_chunks(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> Chunks:
    """``df`` dealt into ``chunks`` ranges of (keys, order) and written
    (default: the session's shuffle partitions, of which AQE coalesces small
    neighbours)."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(*([chunks] if chunks else []), *keys, *order)
    rows = written(ranged.withColumn("_chunk", F.spark_partition_id()), "running-sums")
    # one row per chunk, one open key per boundary at most
    key = F.struct(*keys)
    ends = rows.groupBy("_chunk").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()
    ends.sort(key=lambda r: r["_chunk"])
    some = list(dict.fromkeys(tuple(x.last) for x, y in zip(ends, ends[1:]) if x.last == y.first))
    return Chunks(rows, spark.createDataFrame(some, rows.select(*keys).schema) if some else None)


def chunk_sums(c: Chunks, keys: list[str], order: list[str], sums: dict[str, str],
               backwards: bool = False) -> DataFrame:
    """The chunks' rows plus, for each ``name: column`` of ``sums``, the
    running sum of ``column`` over ``keys`` in ``order`` (current row
    included); ``backwards`` sums from the last row to the current one."""
    cols = c.rows.columns
    by = [F.col(o).desc() if backwards else F.col(o) for o in order]
    within = (
        Window.partitionBy(*keys, "_chunk").orderBy(*by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = c.rows.select(*cols, *[F.sum(x).over(within).alias(f"_w_{n}") for n, x in sums.items()])
    if c.open_keys is None:
        return summed.select(*cols, *[F.col(f"_w_{n}").alias(n) for n in sums])
    # one row per chunk of each open key: twice the chunks at most
    totals = (
        c.rows.join(F.broadcast(c.open_keys), keys)
        .groupBy(*keys, "_chunk").agg(*[F.sum(x).alias(n) for n, x in sums.items()])
    )
    carries = c.rows.sparkSession.createDataFrame(
        _carries(totals.collect(), len(keys), len(sums), backwards), totals.schema
    ).withColumnsRenamed({n: f"_c_{n}" for n in sums})
    carried = summed.join(F.broadcast(carries), [*keys, "_chunk"], "left")
    return carried.select(*cols, *[F.expr(f"_w_{n} + coalesce(_c_{n}, 0)").alias(n) for n in sums])


def _carries(totals: list, keys: int, sums: int, backwards: bool) -> list[tuple]:
    """Rows (key, chunk, totals) -> (key, chunk, totals of the chunks before)."""
    out, so_far = [], {}
    for r in sorted(totals, key=lambda r: r[keys], reverse=backwards):
        before = so_far.get(tuple(r[:keys]), [None] * sums)
        out.append((*r[: keys + 1], *before))
        so_far[tuple(r[:keys])] = [
            y if x is None else x if y is None else x + y for x, y in zip(before, r[keys + 1 :])
        ]
    return out


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, str],
    chunks: int | None = None,
) -> DataFrame:
    """``df`` plus the running sums of ``chunk_sums``."""
    return chunk_sums(ordered_chunks(df, keys, order, chunks), keys, order, sums).drop("_chunk")
