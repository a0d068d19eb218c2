"""Mixing sources to target weights with a low-discrepancy slot schedule.

Each source's documents stand in a shuffled order (by hash) and their words
are cut into blocks of equal length (BLOCK_WORDS; small sources have shorter
ones). Slot t of the mix goes to the source
whose share of [0, 1) holds the golden-ratio point frac(t * phi); the slots
of a source are ranked, and rank r takes its block r mod (number of blocks).
So after any number of slots each source is within a few blocks of its
share, and documents are repeated evenly.

Native throughout. Ranks and word positions are prefix sums in two levels
(about sqrt(n) buckets), so no task sees all rows of a source.

Defined cases: null text has size 0; null sources form one source, the last;
documents without words take nothing; repeated rows are separate documents;
an empty table gives no rows; very long texts are counted whole and may span
many blocks; documents of one hash stand by doc_id; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trickle.llm.common import SPACE_CHARS, WORD, stage

PHI = 0.6180339887498949  # fractional part of the golden ratio
# Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
# Words to a block, at every size of the corpus. A source that would have fewer
# than MIN_BLOCKS blocks is cut into that many instead, so that whole blocks
# bring it near its target.
BLOCK_WORDS = 256
MIN_BLOCKS = 256
# Cells of [0, 1) by which slots meet the sources whose shares touch them.
CELLS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, rows: int, name: str) -> DataFrame:
    """``df`` plus ``name``: the sum of ``value`` over the earlier rows of
    ``group``. The first column of ``order`` must be a bucket number; a
    window then spans one bucket, and the buckets' totals are summed apart."""
    bucket = order[0]
    totals = stage(df.groupBy(group, bucket).agg(F.sum(value).alias("_total")), "bucket-totals")
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        group, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return (
        inner.join(starts, [group, bucket])
        .withColumn(name, F.col("_start") + F.col("_within"))
        .drop("_start", "_within")
    )


def target_table(sizes: DataFrame) -> DataFrame:
    """One row per source: source, sidx, source_size, target, and the length
    and number of its blocks. Targets share all words by weight, stop at
    MAX_EPOCHS times the source's size, and what is over is shared anew:
    target = min(cap, level * weight), at the level that gives the total.

    ``sizes`` has source and size. The windows here see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (nth % len(WEIGHTS) + 1).cast("int"))
    cap = MAX_EPOCHS * F.col("source_size")
    t = per.select(
        "source", "source_size", nth.alias("sidx"), weight.cast("double").alias("weight"),
        F.sum("source_size").over(everything).alias("total"),
    )
    by_ratio = Window.orderBy(cap / F.col("weight"), "sidx")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        F.row_number().over(by_ratio).alias("k"),
        (
            (F.col("total") - F.coalesce(F.sum(cap).over(earlier), F.lit(0)))
            / F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        ).alias("level"),
    )
    open_ = cap / F.col("weight") >= F.col("level")
    level = F.min_by(F.when(open_, F.col("level")), F.when(open_, F.col("k"))).over(everything)
    return t.select(
        "source", "sidx", "source_size",
        F.least(cap.cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"),
        F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("source_size") / MIN_BLOCKS)))
        .cast("long").alias("block_words"),
    ).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))


def schedule(sources: DataFrame) -> DataFrame:
    """The mix in order: slot, sidx, rank (of the slot within its source),
    block (of the source, from 0) and epoch (times it was taken before).
    ``sources`` as made by target_table."""
    spark = sources.sparkSession
    want = F.col("target") / F.col("block_words")
    n_slots = math.ceil(sources.agg(F.sum(want)).first()[0] or 0.0)
    upto = Window.orderBy("sidx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    share = sources.where("target > 0").select(
        "sidx", "n_blocks",
        (F.sum(want).over(upto) / F.sum(want).over(everything)).alias("hi"),
        F.max("sidx").over(everything).alias("last"),
    )
    hi = F.when(F.col("sidx") == F.col("last"), 2.0).otherwise(F.col("hi"))
    share = share.select(
        "sidx", "n_blocks", hi.alias("hi"),
        F.coalesce(F.lag("hi").over(Window.orderBy("sidx")), F.lit(0.0)).alias("lo"),
    ).withColumn(
        "cell",
        F.explode(
            F.sequence(
                F.floor(F.col("lo") * CELLS),
                F.greatest(F.floor(F.col("lo") * CELLS), F.floor(F.least(F.col("hi"), F.lit(1.0)) * CELLS)),
            )
        ),
    )
    buckets = max(1, math.isqrt(n_slots))
    point = F.col("slot") * PHI - F.floor(F.col("slot") * PHI)
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("u"))
    slots = (
        slots.withColumn("cell", F.floor(F.col("u") * CELLS))
        .join(share, "cell")
        .where("u >= lo AND u < hi")
        .select(
            "slot", "sidx", "n_blocks", F.lit(1).alias("one"),
            F.floor(F.col("slot") * buckets / max(1, n_slots)).alias("bucket"),
        )
    )
    ranked = prefix_sums(slots, "sidx", ["bucket", "slot"], "one", n_slots, "rank")
    return ranked.where(F.col("rank") < MAX_EPOCHS * F.col("n_blocks")).select(
        "slot", "sidx", "rank",
        (F.col("rank") % F.col("n_blocks")).alias("block"),
        F.floor(F.col("rank") / F.col("n_blocks")).alias("epoch"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """How many words the mix takes of every document: doc_id, text_hash,
    size, source, source_size, target, taken. ``docs`` has doc_id, text and
    source; text_hash tells documents of one doc_id apart."""
    sizes = stage(
        docs.select(
            "doc_id", "source", n_words(F.col("text")).alias("size"),
            F.xxhash64("doc_id", "text").alias("text_hash"),
        ),
        "sizes",
    )
    sources = stage(target_table(sizes), "sources")
    placed = sizes.join(
        sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    result = ["doc_id", "text_hash", "size", "source", "source_size", "target"]
    idle = placed.where("size = 0").select(*result, F.lit(0).cast("long").alias("taken"))

    rows = sizes.count()
    buckets = max(1, math.isqrt(rows))
    # the shuffled order: by bucket, then by another part of the hash
    shuffled = placed.where("size > 0").withColumn("bucket", F.pmod("text_hash", F.lit(buckets)))
    at = prefix_sums(shuffled, "sidx", ["bucket", "text_hash", "doc_id"], "size", rows, "begin")
    length = F.col("block_words")
    parts = at.select(
        *result, "sidx", "begin", "block_words",
        F.explode(
            F.sequence(
                F.floor(F.col("begin") / length),
                F.floor((F.col("begin") + F.col("size") - 1) / length),
            )
        ).alias("block"),
    )
    takes = stage(schedule(sources).groupBy("sidx", "block").agg(F.count("*").alias("times")), "takes")
    overlap = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * length) - F.greatest(
        F.col("begin"), F.col("block") * length
    )
    taken = (
        parts.join(takes, ["sidx", "block"], "left")
        .groupBy(*result, "sidx", "begin")
        .agg(F.sum(overlap * F.coalesce(F.col("times"), F.lit(0))).cast("long").alias("taken"))
        .select(*result, "taken")
    )
    return taken.unionByName(idle)


def draw(docs: DataFrame) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a document is
    repeated as often as the mix takes it whole, and once more cut to its
    first words where the mix takes a part of it. Of rows with one doc_id and
    text every one takes an equal part of their words, and what is left over
    goes to the one of the smallest hash."""
    columns = docs.columns
    counts = stage(
        mix(docs.select("doc_id", "text", "source"))
        .groupBy(F.struct("doc_id", "text_hash").alias("_key"))
        .agg(F.sum("taken").alias("_sum"), F.count("*").alias("_rows"), F.max("size").alias("_size"))
        .where("_sum > 0").selectExpr("_key", "_sum div _rows AS _each", "_sum % _rows AS _over", "_size"),
        "drawn",
    )
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]))
    key = F.struct("doc_id", F.xxhash64("doc_id", "text").alias("text_hash"))
    keyed = docs.select(row.alias("_row"), key.alias("_k2"), F.xxhash64(others).alias("_order"))
    same = F.col("_k2").eqNullSafe(F.col("_key"))
    each = keyed.join(counts.where("_each > 0"), same).selectExpr("_row", "_each AS _taken", "_size")
    over = (
        keyed.join(counts.where("_over > 0"), same)
        .groupBy("_key", "_over", "_size").agg(F.min_by("_row", "_order").alias("_row"))
        .selectExpr("_row", "_over AS _taken", "_size")
    )
    times = F.ceil(F.col("_taken") / F.col("_size"))
    out = each.unionAll(over).select(
        "_row", "_taken", "_size", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("_n")
    )
    left = F.least(F.col("_size"), F.col("_taken") - (F.col("_n") - 1) * F.col("_size")).cast("int")
    words = F.split(F.trim(F.col("_row.text"), F.lit(SPACE_CHARS)), r"[\x20\x09-\x0D]+")
    text = F.when(left >= F.col("_size"), F.col("_row.text")).otherwise(
        F.concat_ws(" ", F.slice(words, 1, left))
    )
    named = {c: F.col(f"_row.`{c}`") for c in columns}
    named["text"] = text
    if "n_chars" in columns:
        named["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.where(left > 0).select(*[v.alias(c) for c, v in named.items()])
