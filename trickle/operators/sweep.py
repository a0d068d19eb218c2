"""Which changes of two tables meet, by one ordered sweep per key.

Two sides, a and b, change over ``seq``. A change of one side meets every row
of the other that is live at its time: an as-of join with fan-out. An equi-join
on the key with a test on time would compare all changes of a hot key with all
of the other side. Here time becomes a *rank*:

1. Both sides' changes go into one order per key (``seq``; of one seq, b's
   first) and every change gets the number of each side's changes from there
   to the end of its key (``scan``: ordered chunks, so a hot key is spread).
2. The changes of one base row cut time into intervals of constant net weight.
   With the other side's counts at both ends, an interval *is* a range of
   ranks of the changes it meets.
3. Ranges are written out as (key, rank) and joined with the changes by
   equality, each match being one row of the result.

So the work follows changes plus results, however often a key or a row
changes. A base row's changes are taken per chunk, and those of open keys (one
per chunk boundary at most) are tied together by per-chunk summaries.

``emit`` = 0 marks rows that are there but are no changes (kept from earlier).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trickle.operators.scan import Chunks, chunk_sums, ordered_chunks
from trickle.session import written

RANKS = 1 << 16  # ranks listed at once


class Side(NamedTuple):
    """Changes of one table: ``_key``, ``seq``, ``emit``, ``w`` and the ``row``
    columns; ``same``: the columns that make two changes changes of one row, of
    which the last decides; None where the whole row does and weights add up."""

    changes: DataFrame
    row: list[str]
    same: list[str] | None


def side(changes: DataFrame, key: str, row: list[str], weight: str, same: list[str] | None = None,
         before: DataFrame | None = None) -> Side:
    def form(df: DataFrame, emit: int) -> DataFrame:
        return df.select(F.col(key).alias("_key"), "seq", F.lit(emit).alias("emit"),
                         F.col(weight).cast("bigint").alias("w"), *row)

    all_of = form(changes, 1)
    return Side(all_of if before is None else form(before, 0).unionAll(all_of), row, same)


def _ranked(cut: Chunks, a: Side, b: Side) -> DataFrame:
    """The ordered changes plus: ``rank``, the number of the own side's changes
    from here to the key's end; ``high``, that of the other side's; ``net``,
    the row's weight from here to its next change; ``low``, ``high`` there."""
    counts = {"na": "_ea", "nb": "_eb"}
    t = chunk_sums(cut, ["_key"], ["seq", "side"], counts, backwards=True).selectExpr(
        "* EXCEPT (na, nb, _ea, _eb)",
        "IF(side = 1, na, nb) AS rank", "IF(side = 1, nb, na) AS high",
        f"IF(side = 1, {str(bool(a.same)).lower()}, {str(bool(b.same)).lower()}) AS last_decides",
    )
    # one row of either side: the columns of the other side are null
    names = ["_key", "side", *(a.same or a.row), *(b.same or b.row)]
    by = Window.partitionBy(*names, "_chunk").orderBy("seq")
    total = F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = t.select(
        "*", F.when(F.col("last_decides"), (F.col("w") > 0).cast("bigint")).otherwise(total).alias("net"),
        F.lead("high").over(by).alias("low"),
    )
    if cut.open_keys is None:
        return out
    # rows of open keys: their changes in earlier chunks, and the next chunk's first
    chunk = t.join(F.broadcast(cut.open_keys), "_key").groupBy(*names, "_chunk", "last_decides").agg(
        F.sum("w").alias("_t"), F.max("high").alias("_first"))
    order = Window.partitionBy(*names).orderBy("_chunk")
    earlier = F.sum("_t").over(order.rowsBetween(Window.unboundedPreceding, -1))
    carry = chunk.select(
        *[F.col(n).alias(f"_c_{n}") for n in [*names, "_chunk"]],
        F.when(~F.col("last_decides"), earlier).alias("_before"), F.lead("_first").over(order).alias("_next"),
    )
    match = F.lit(True)
    for n in [*names, "_chunk"]:
        match = match & F.col(n).eqNullSafe(F.col(f"_c_{n}"))
    return out.join(carry, match, "left").select(
        *t.columns, F.expr("net + coalesce(_before, 0) AS net"), F.coalesce("low", "_next").alias("low"))


def _both(a: Side, b: Side) -> DataFrame:
    """The changes of both sides; rows of a whose key b never has meet nothing."""
    known = a.changes.join(b.changes.select("_key"), "_key", "left_semi")
    types = {f.name: f.dataType for s in (a, b) for f in s.changes.schema.fields}
    none = lambda s: [F.lit(None).cast(types[c]).alias(c) for c in s.row]
    head = ["_key", "seq", "emit", "w"]
    return known.select(*head, F.lit(1).alias("side"), *a.row, *none(b)).unionAll(
        b.changes.select(*head, F.lit(0), *none(a), *b.row)
    ).selectExpr("*", "emit * side AS _ea", "emit * (1 - side) AS _eb")


def meetings(a: Side, b: Side, chunks: int | None = None) -> DataFrame:
    """``seq``, ``w`` of a change, ``net`` of a row of the other side that is
    live at its time, and the columns of both. Changes of a see b's change of
    their own seq, changes of b not a's. The sides' row columns have different
    names."""
    t = written(_ranked(ordered_chunks(_both(a, b), ["_key"], ["seq", "side"], chunks), a, b), "ranks")

    cols = [*a.row, *b.row]
    lists = t.where("net <> 0 AND high > coalesce(low, 0)").select(
        "_key", "side", "net", *cols, "high", F.expr("coalesce(low, 0L) AS low")
    ).select("*", F.explode(F.expr(f"sequence(0L, (high - low - 1) div {RANKS})")).alias("_part"))
    live = lists.select(
        "_key", "net", F.expr("1 - side AS side"), *[F.col(c).alias(f"_live_{c}") for c in cols],
        F.explode(F.expr(
            f"sequence(low + 1 + _part * {RANKS}, least(high, low + (_part + 1) * {RANKS}))")).alias("rank"),
    )
    events = t.where("emit = 1").select("_key", "side", "rank", "seq", "w", *cols)
    mine = lambda s, of: [
        F.expr(f"IF(side = {of}, {c}, _live_{c}) AS {c}") for c in s.row]
    return live.join(events, ["_key", "side", "rank"]).select("seq", "w", "net", *mine(a, 1), *mine(b, 0))


def met(a: Side, b: Side, chunks: int | None = None) -> DataFrame:
    """The distinct rows of b (``_key`` and its columns) that some change ever
    meets or that meet some change: what ``meetings`` has rows for, found
    without the joins. Work follows the changes, not the meetings.

    A row of b is in a meeting if a change of a falls into one of its
    intervals (a range of ranks that is not empty), or if one of its own
    changes comes while some row of a is live (a running count per key).
    For sides whose weights add up (``same`` None)."""
    if a.same or b.same:
        raise ValueError("met() counts rows whose weights add up")
    cut = ordered_chunks(_both(a, b), ["_key"], ["seq", "side"], chunks)
    # a change moves its row into the live ones, out of them, or neither
    t = written(_ranked(cut, a, b).select(
        "_key", "seq", "emit", "side", "_chunk", "net", "high", "low", *b.row,
        F.expr("side * (int(net <> 0) - int(net - w <> 0))").alias("_step")), "steps")
    live = chunk_sums(Chunks(t, cut.open_keys), ["_key"], ["seq", "side"], {"_live": "_step"})
    return live.where(
        "side = 0 AND ((emit = 1 AND _live > 0) OR (net <> 0 AND high > coalesce(low, 0)))"
    ).select("_key", *b.row).distinct()
