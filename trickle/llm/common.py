"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trickle.session import scratch_path

# The ASCII white space that separates words everywhere in this package:
# a word is a maximal run of [^\x20\x09-\x0D].
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    Cuts the lineage with files every executor can reach, so a lost executor
    costs only its running tasks and later plans start from a plain scan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm", name, unique=True)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_hash(id_col: Column) -> Column:
    """crc32 of the decimal text of an id, as the hold-out rules use it."""
    return F.crc32(id_col.cast("string").cast("binary"))


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """True where crc32(id as text) mod ``modulus`` is ``remainder``; a null
    id is not held out."""
    return F.coalesce(doc_hash(id_col) % modulus == remainder, F.lit(False))


def fresh(columns: list[str], name: str) -> str:
    """``name``, prefixed until no column of ``columns`` is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that a piece holds about ``max_bytes`` of the
    string or binary ``column`` (one row at least): bounds what the Python
    objects made from a piece take."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(length.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop
