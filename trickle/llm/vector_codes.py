"""Vector code compression: product codes over per-dimension value dictionaries.

Every component becomes the integer floor(scale * x); a vector is cut into
equal consecutive parts and each part is written as the index of the nearest
entry of its position's codebook. The codebooks start as the parts of the rows
with the smallest ids and are refined by a fixed number of rounds (assign, then
componentwise floor of the mean). All distances and means are exact integers.

Distances are not computed per row. Rows are written once as *blocks*: per
dimension the sorted dictionary of the distinct integers in the block, and per
row the dictionary codes. A round tabulates, for each dimension, the squared
difference of every dictionary value to all entries; a part's distances to all
entries are then gathers of table rows by code, added over the part's
dimensions. The sums of a round come from the same codes: a histogram of
(entry, code) times the dictionary.

Scale: a block holds ``BLOCK`` rows at most, so tables are bounded by
BLOCK x entries per dimension. A task adds up all its blocks before anything is
shuffled; a round brings entries x (dimensions + parts) numbers to the driver,
however many rows there are. Only the codebooks (entries x dimensions) go out
with the tasks. Label totals are aggregated map-side and written, so the join
back to the rows is a plain one which AQE broadcasts or splits.

Defined results:

- A null vector, or one with a null, NaN or infinite component, gives no row.
- Vectors whose length is not the most frequent one (ties: the shorter) keep
  their row, with null ``code`` and ``error``; they take no part in codebooks.
- A length that the parts do not divide: part p holds components
  [p * d // parts, (p + 1) * d // parts).
- Ties of distance go to the lower entry; rows with one id are ordered by
  their vector where the codebooks start, a null id comes last.
- Fewer rows than entries: as many entries as rows.
- Values of any size are exact (integers beyond 64 bits where they are
  needed); an ``error`` or ``label_error`` beyond a long is null.
- Repeated rows are rows of their own; an empty table gives an empty result.
- Extra columns are not read. There is no text, so no long text either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trickle.llm.common import stage

BLOCK = 4096  # rows of a block
LONG_MAX = (1 << 63) - 1
LIMB = 40  # bits of a limb of a sum on its way through Spark

BLOCKS = "vec_id array<bigint>, label array<string>, sizes array<int>, dictionary binary, codes binary"
SUMS = "part int, entry int, position int, limb int, total bigint"
CODED = "vec_id bigint, label string, code string, error bigint"


def bounds(d: int, parts: int) -> list[tuple[int, int]]:
    """Where each part starts and ends in a vector of ``d`` components."""
    return [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) / scale, a double without rounding for a scale that is
    a power of two (values too large for a fraction are their own floor)."""
    x = x.astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * x) / scale
    return np.where(np.isfinite(scaled), scaled, x)


def integers(u: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """The integers scale * u: int64, or Python's own where ``wide``."""
    if not wide:
        return (u * scale).astype(np.int64)
    out = np.empty(len(u), dtype=object)
    for i, value in enumerate(u.tolist()):
        top, bottom = value.as_integer_ratio()
        out[i] = scale * top // bottom
    return out


def needs_wide(u: np.ndarray, largest_entry: int, scale: int, d: int) -> bool:
    """Whether a squared distance of these values could leave 62 bits."""
    largest = max(scale * (int(np.abs(u).max(initial=0.0)) + 1), largest_entry)
    return 4 * largest * largest * max(d, 1) >= 1 << 62


class Block:
    """The rows of one block, as dictionary and codes."""

    def __init__(self, sizes: list[int], dictionary: bytes, codes: bytes):
        self.sizes = sizes
        ends = np.cumsum([0, *sizes])
        values = np.frombuffer(dictionary, np.float64)
        self.values = [values[a:b] for a, b in zip(ends, ends[1:])]
        self.all = values
        self.codes = np.frombuffer(codes, np.uint16).reshape(len(sizes), -1) if sizes else None

    def assign(self, books: list[np.ndarray], rows: int, scale: int, largest: int):
        """Per part: nearest entry and its squared distance, for all rows;
        and the integers of the dictionary."""
        d = len(self.sizes)
        wide = needs_wide(self.all, largest, scale, d)
        kind = object if wide else np.int64
        ints = [integers(v, scale, wide) for v in self.values]
        nearest, least = [], []
        for book, (a, b) in zip(books, bounds(d, len(books))):
            entries = book.astype(kind)
            total = np.zeros((rows, len(entries)), dtype=kind)
            for dim in range(a, b):
                table = ints[dim][:, None] - entries[None, :, dim - a]
                table = table * table
                total += table[self.codes[dim]]
            near = total.argmin(axis=1)
            nearest.append(near)
            least.append(total[np.arange(rows), near])
        return nearest, least, ints


def _encode(scale: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("vec_id", pa.list_(pa.int64())), ("label", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())),
            ("dictionary", pa.binary()), ("codes", pa.binary()),
        ])
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(start, BLOCK)
                n = rows.num_rows
                x = rows.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                u = floors(x, scale)
                values, codes = [], []
                for dim in range(u.shape[1]):
                    distinct, code = np.unique(u[:, dim], return_inverse=True)
                    values.append(distinct)
                    codes.append(code.astype(np.uint16))
                yield pa.record_batch([
                    pa.array([rows.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([rows.column("label").to_pylist()], pa.list_(pa.string())),
                    pa.array([[len(v) for v in values]], pa.list_(pa.int32())),
                    pa.array([b"".join(v.tobytes() for v in values)], pa.binary()),
                    pa.array([b"".join(c.tobytes() for c in codes)], pa.binary()),
                ], schema=schema)

    return encode


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, Block(row["sizes"], row["dictionary"], row["codes"])


def _sums(books: list[np.ndarray], scale: int, largest: int):
    """One round's sums and counts (position -1) of a task's blocks, in limbs."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        totals = [np.zeros(b.shape, dtype=object) for b in books]
        for row, block in _blocks(batches):
            nearest, _, ints = block.assign(books, len(row["vec_id"]), scale, largest)
            for p, (a, b) in enumerate(bounds(len(ints), len(books))):
                k = len(books[p])
                counts[p] += np.bincount(nearest[p], minlength=k)
                for dim in range(a, b):
                    size = len(ints[dim])
                    seen = np.bincount(nearest[p] * size + block.codes[dim], minlength=k * size).reshape(k, size)
                    totals[p][:, dim - a] += seen.astype(ints[dim].dtype).dot(ints[dim]).astype(object)
        out = []
        for p in range(len(books)):
            for e in np.flatnonzero(counts[p]).tolist():
                out.append((p, e, -1, 0, int(counts[p][e])))
                for i, total in enumerate(totals[p][e].tolist()):
                    sign, rest, limb = (-1 if total < 0 else 1), abs(int(total)), 0
                    while rest:
                        out.append((p, e, i, limb, sign * (rest & ((1 << LIMB) - 1))))
                        rest, limb = rest >> LIMB, limb + 1
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.int32()] * 4 + [pa.int64()]
        yield pa.record_batch(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["part", "entry", "position", "limb", "total"],
        )

    return sums


def _code(books: list[np.ndarray], scale: int, largest: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _blocks(batches):
            nearest, least, _ = block.assign(books, len(row["vec_id"]), scale, largest)
            digits = np.stack(nearest, axis=1).astype(np.uint8).tobytes().hex()
            width = 2 * len(books)
            errors = [int(e) for e in sum(least)]
            yield pa.record_batch([
                pa.array(row["vec_id"], pa.int64()),
                pa.array(row["label"], pa.string()),
                pa.array([digits[i : i + width] for i in range(0, len(digits), width)], pa.string()),
                pa.array([e if e <= LONG_MAX else None for e in errors], pa.int64()),
            ], names=["vec_id", "label", "code", "error"])

    return code


def _refine(blocks: DataFrame, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """One round: every entry becomes the floor of its rows' mean."""
    sums = blocks.mapInArrow(_sums(books, scale, _largest(books)), SUMS)
    rows = sums.groupBy("part", "entry", "position", "limb").agg(F.sum("total").alias("total")).collect()
    counts = {(r.part, r.entry): r.total for r in rows if r.position < 0}
    totals: dict[tuple[int, int, int], int] = {}
    for r in rows:
        if r.position >= 0:
            at = (r.part, r.entry, r.position)
            totals[at] = totals.get(at, 0) + (r.total << (LIMB * r.limb) if r.total >= 0
                                              else -(-r.total << (LIMB * r.limb)))
    out = []
    for p, book in enumerate(books):
        new = book.copy()
        for e in range(len(book)):
            if (p, e) in counts:
                new[e] = [totals.get((p, e, i), 0) // counts[p, e] for i in range(book.shape[1])]
        out.append(new)
    return out


def _largest(books: list[np.ndarray]) -> int:
    return max((abs(int(x)) for book in books for x in book.flat), default=0)


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components by part, entry, position."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.flat).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2,
             scale: int = 256) -> tuple[DataFrame, list[np.ndarray]]:
    """``vectors`` (vec_id, embedding, label) -> (vec_id, label, code, error),
    and the codebooks, one (entries x components) array of Python integers per
    part. ``entries`` is 256 at most: a code is two hex digits a part."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = vectors.sparkSession
    valid = vectors.where(
        "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    ).select(F.col("vec_id").cast("bigint").alias("vec_id"),
             F.col("embedding").cast("array<double>").alias("embedding"),
             F.col("label").cast("string").alias("label"))
    usual = valid.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], CODED), []
    d = usual.d
    regular = valid.where(F.size("embedding") == d)
    seeds = regular.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    first = [integers(floors(np.array(s.embedding, dtype=np.float64), scale), scale, True) for s in seeds]
    books = [
        np.array([[v[i] for i in range(a, b)] for v in first], dtype=object).reshape(len(first), b - a)
        for a, b in bounds(d, parts)
    ]
    blocks = stage(regular.mapInArrow(_encode(scale), BLOCKS), "vector-blocks")
    for _ in range(rounds):
        books = _refine(blocks, books, scale)
    coded = blocks.mapInArrow(_code(books, scale, _largest(books)), CODED)
    other = valid.where(F.size("embedding") != d).selectExpr(
        "vec_id", "label", "CAST(NULL AS STRING) AS code", "CAST(NULL AS BIGINT) AS error")
    return coded.unionAll(other), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` plus label_error: the errors of all rows of its label, nulls
    together; null where it does not fit a long or an error of the label
    does not."""
    coded = stage(coded, "vector-codes")
    totals = stage(
        coded.groupBy("label").agg(
            F.expr(
                "CASE WHEN count_if(error IS NULL AND code IS NOT NULL) = 0 "
                "THEN try_cast(coalesce(sum(CAST(error AS DECIMAL(38,0))), 0) AS BIGINT) END"
            ).alias("label_error")
        ).withColumnRenamed("label", "_label"),
        "label-errors",
    )
    return coded.join(totals, coded.label.eqNullSafe(totals["_label"]), "left").drop("_label")
