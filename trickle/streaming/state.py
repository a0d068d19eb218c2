"""Keyed state of the continuous query: log-structured Parquet in hash buckets.

A table is cut by a hash of its join key into a fixed number of buckets. A
batch adds one *version* to each bucket it touches: its own changes, not the
bucket (``<table>/v=<batch>/bucket=<b>``). What a bucket holds is the fold of
its versions in order: sums of weights per row, or the last change per key. So
what a batch writes follows the batch, and it reads the buckets of its keys.

Versions are merged as in a size-tiered log: a new version takes in those
before it that are not larger than what is merged so far. So a bucket has at
most about log2(its rows) versions and a row is rewritten that often, a few
rows at a time for small batches. A merge down to the first version drops the
rows that have gone.

The *manifest* of a batch (one small JSON file, put in place last) lists each
bucket's versions. Batch k reads manifest k - 1 and the versions in it, and
writes only ``v=k``: a batch run again after a failure reads what it read and
replaces what it wrote. Versions that neither of the last two manifests lists
are deleted, so the folders are bounded by buckets and versions, not by the
number of batches. The manifest is bounded likewise and lives on the driver.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trickle.session import exists, names, put_text, remove

KEEP = 2  # manifests kept: the last one and the one its batch read


class Table(NamedTuple):
    key: str  # the join key that decides the bucket
    row: list[str]  # columns of a row
    sums: list[str]  # columns that add up over versions
    last_by: list[str] | None = None  # or: of one key the last version decides, there while sums[0] > 0


Versions = dict[int, list[list[int]]]  # bucket -> [[version, rows at most], ...] in order


class Manifest(NamedTuple):
    batch: int
    last_seq: int | None
    buckets: int
    tables: dict[str, Versions]

    def text(self) -> str:
        return json.dumps(self._asdict())

    @staticmethod
    def of(text: str) -> Manifest:
        d = json.loads(text)
        tables = {t: {int(b): v for b, v in versions.items()} for t, versions in d.pop("tables").items()}
        return Manifest(**d, tables=tables)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class State:
    """The tables below ``path`` as of a batch's manifest."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table], buckets: int):
        self.spark, self.path, self.tables, self.buckets = spark, path, tables, buckets

    def _file(self, batch: int) -> str:
        return f"{self.path}/manifest/{batch:09d}.json"

    def manifest(self, batch: int | None = None) -> Manifest:
        """Of a batch, or the last one; an empty one before the first."""
        if batch is None:
            there = [n for n in names(self.spark, f"{self.path}/manifest") if n.endswith(".json")]
            batch = int(there[-1][:-5]) if there else -1
        if batch < 0:
            return Manifest(-1, None, self.buckets, {t: {} for t in self.tables})
        if not exists(self.spark, self._file(batch)):
            raise FileNotFoundError(f"no manifest of batch {batch} in {self.path}")
        return Manifest.of(self.spark.read.text(self._file(batch), wholetext=True).first().value)

    def _read(self, name: str, versions: Versions, schema: str | None) -> DataFrame | None:
        paths = [f"{self.path}/{name}/v={v}/bucket={b}" for b, vs in sorted(versions.items()) for v, _ in vs]
        if not paths:
            return None
        reader = self.spark.read if schema is None else self.spark.read.schema(f"{schema}, v long, bucket int")
        return reader.option("basePath", f"{self.path}/{name}").parquet(*paths)

    def read(self, m: Manifest, name: str, schema: str | None = None, buckets: set[int] | None = None) -> DataFrame | None:
        """All versions (column ``v``) of the ``buckets`` asked for, and of no
        others; None when there are none."""
        mine = m.tables[name]
        return self._read(name, mine if buckets is None else {b: mine[b] for b in buckets if b in mine}, schema)

    def fold(self, name: str, versions: DataFrame, whole: bool) -> DataFrame:
        """One version out of several: ``bucket``, row, sums. ``whole``: from
        the first version on, so rows that have gone can go."""
        t = self.tables[name]
        if t.last_by is None:
            out = versions.groupBy("bucket", *t.row).agg(*[F.sum(c).alias(c) for c in t.sums])
            return out.where(" OR ".join(f"{c} <> 0" for c in t.sums))
        last = versions.groupBy("bucket", *t.last_by).agg(F.max_by(F.struct(*t.row, *t.sums), "v").alias("_r"))
        out = last.select("bucket", *[F.col(f"_r.{c}") for c in [*t.row, *t.sums]])
        return out.where(f"{t.sums[0]} > 0") if whole else out

    def add(self, old: Manifest, batch: int, name: str, changes: DataFrame, counts: dict[int, int],
            schema: str) -> Versions:
        """Write version ``batch`` of a table: ``changes`` (row and sums, one
        per row or key) of the buckets in ``counts``, merged with the earlier
        versions that are not larger. Returns the table's versions."""
        path = f"{self.path}/{name}/v={batch}"
        versions = {b: list(v) for b, v in old.tables[name].items()}
        if not counts:
            return versions
        merged: Versions = {}
        for b, n in counts.items():
            mine, total = versions.setdefault(b, []), n
            while mine and mine[-1][1] <= total:
                total += mine[-1][1]
                merged.setdefault(b, []).insert(0, mine.pop())
        t = self.tables[name]
        cols = [*t.row, *t.sums]
        new = changes.select(F.lit(batch).cast("long").alias("v"),
                             bucket_of(F.col(t.key), self.buckets).alias("bucket"), *cols)
        parts = [self._part(name, new, {}, schema, set(counts) - set(merged), versions)]
        parts.append(self._part(name, new, merged, schema, set(merged), versions))
        out = None
        for p in parts:
            if p is not None:
                out = p if out is None else out.unionByName(p)
        # AQE splits a large bucket and joins small ones
        out.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        # rows at most: what cancelled out is not counted again
        for b in (int(n[len("bucket="):]) for n in names(self.spark, path) if n.startswith("bucket=")):
            versions[b].append([batch, counts[b] + sum(n for _, n in merged.get(b, []))])
        return {b: v for b, v in versions.items() if v}

    def _part(self, name: str, new: DataFrame, merged: Versions, schema: str, buckets: set[int],
              left: Versions) -> DataFrame | None:
        if not buckets:
            return None
        mine = new.where(F.col("bucket").isin(sorted(buckets)))
        if not merged:
            return mine.drop("v")
        both = mine.unionByName(self._read(name, merged, schema).select(mine.columns))
        whole = sorted(b for b in buckets if not left[b])
        if self.tables[name].last_by is None or len(whole) in (0, len(buckets)):
            return self.fold(name, both, bool(whole))
        first = F.col("bucket").isin(whole)
        return self.fold(name, both.where(first), True).unionByName(self.fold(name, both.where(~first), False))

    def commit(self, new: Manifest) -> None:
        """Put the manifest in place, then delete what the manifests kept do
        not list."""
        older = [self.manifest(b) for b in range(new.batch - KEEP, new.batch)
                 if b >= 0 and exists(self.spark, self._file(b))]
        put_text(self.spark, self._file(new.batch), new.text())
        kept = [m for m in older if m.batch > new.batch - KEEP] + [new]
        live = {(t, v, b) for m in kept for t, vs in m.tables.items() for b, x in vs.items() for v, _ in x}
        for m in older:
            if m.batch > new.batch - KEEP:
                continue
            for t, vs in m.tables.items():
                for b, x in vs.items():
                    for v, _ in x:
                        if (t, v, b) not in live:
                            remove(self.spark, f"{self.path}/{t}/v={v}/bucket={b}")
                for v in {v for x in vs.values() for v, _ in x}:
                    if not any((t, v) == key[:2] for key in live):
                        remove(self.spark, f"{self.path}/{t}/v={v}")
            remove(self.spark, self._file(m.batch))
