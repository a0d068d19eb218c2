"""Best-fit packing of token sequences with large-item matching.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.
Only the *lengths* matter to the packing, and there are at most ``capacity``
different ones, so the packing is planned on the histogram of lengths:

* pieces above a third of the capacity go at most two to a bin: the longest
  piece left is matched with the longest large piece that still fits;
* shorter pieces, longest first, go to the bin with the least gap that holds
  them (best fit); a new bin is opened when no gap does.

All bins of equal gap are handled at once, so the plan has a bounded number
of steps whatever the number of rows (each step ends a length or a group of
bins, and a gap at least halves each time its bins are visited). A plan step
says "ranks r0 to r1 of length s go t to a bin, from bin b0, at offset base";
every piece finds its own step by its rank among the pieces of its length.
Ranks come from per-task counters plus prefix sums over tasks, so a length
shared by most rows is never gathered anywhere.

Defined cases: null or empty text is the end token alone; a null id is
carried; repeated rows are packed once each; very long texts are tokenised
whole and cut into full pieces and a last one; pieces of one length are
interchangeable, and stand as their tasks count them; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trickle.llm.common import slices, stage

# Distinct words whose ids a worker keeps; it starts afresh beyond that.
WORD_CACHE = 600_000
# Bytes of text whose ids a worker makes at once.
SLICE = 4 << 20
# Where the ids themselves go on, a worker holds them besides: less of both.
WORD_CACHE_WITH_IDS, SLICE_WITH_IDS = 200_000, 1 << 20
# Ranks within a length stay below this (plan lookups use length * RANKS + rank).
RANKS = 1 << 42


@dataclass(frozen=True)
class Step:
    """Ranks [rank, rank + count) of ``length``: ``per_bin`` to a bin, from
    ``bin`` on, the first of each bin at ``base``."""

    length: int
    rank: int
    count: int
    bin: int
    per_bin: int
    base: int


class _Gaps:
    """Groups of bins by the room left in them."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if gap <= 0 or count <= 0:
            return
        if gap not in self.bins:
            insort(self.sizes, gap)
            self.bins[gap] = []
        self.bins[gap].append((first, count))

    def best(self, size: int) -> tuple[int, int, int] | None:
        """Take out bins with the least gap of ``size`` or more."""
        at = bisect_left(self.sizes, size)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        first, count = self.bins[gap].pop()
        if not self.bins[gap]:
            del self.bins[gap]
            del self.sizes[at]
        return gap, first, count


def plan_packing(histogram: dict[int, int], capacity: int) -> tuple[list[Step], int]:
    """Steps that place every piece of ``histogram`` (length -> count), and
    the number of bins."""
    left = {s: n for s, n in histogram.items() if n > 0}
    rank = dict.fromkeys(left, 0)
    steps: list[Step] = []
    gaps = _Gaps()
    bins = 0

    def put(size: int, count: int, first: int, per_bin: int, base: int) -> None:
        steps.append(Step(size, rank[size], count, first, per_bin, base))
        rank[size] += count
        left[size] -= count

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        big = large[-1]
        if not left[big]:
            large.pop()
            continue
        at = bisect_left(large, capacity - big + 1) - 1
        while at >= 0 and (not left[large[at]] or (large[at] == big and left[big] < 2)):
            if not left[large[at]]:
                del large[at]
            at -= 1
        mate = large[at] if at >= 0 else None
        if mate is None:
            n = left[big]
            put(big, n, bins, 1, 0)
            gaps.add(capacity - big, bins, n)
        elif mate == big:
            n = left[big] // 2
            put(big, 2 * n, bins, 2, 0)
            gaps.add(capacity - 2 * big, bins, n)
        else:
            n = min(left[big], left[mate])
            put(big, n, bins, 1, 0)
            put(mate, n, bins, 1, big)
            gaps.add(capacity - big - mate, bins, n)
        bins += n

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            found = gaps.best(size)
            if found is None:
                n = -(-left[size] // (capacity // size))
                found = (capacity, bins, n)
                bins += n
            gap, first, count = found
            per_bin = gap // size
            take = min(left[size], count * per_bin)
            full, rest = divmod(take, per_bin)
            if full:
                put(size, full * per_bin, first, per_bin, capacity - gap)
                gaps.add(gap - per_bin * size, first, full)
            if rest:
                put(size, rest, first + full, per_bin, capacity - gap)
                gaps.add(gap - rest * size, first + full, 1)
            used = full + (rest > 0)
            gaps.add(gap, first + used, count - used)
    return steps, bins


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


LETTERS = _table("abcdefghijklmnopqrstuvwxyz")
MARKS = _table("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


class WordIds:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    The tokenizer lower-cases, drops white space, and never joins letters and
    other marks or anything across white space. So a text's ids are those of
    its units in turn: lower-cased, cut at spaces, new lines, and between a
    letter a-z and a mark (but the apostrophe, which may begin a token with
    letters). Ids of units are kept between texts; new units are encoded many
    at once and told apart by their places.
    """

    def __init__(self, path: str, cache: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = cache
        self.known: dict[bytes, bytes] = {b"": b""}

    @staticmethod
    def units(text: str) -> list[bytes]:
        raw = text.encode()
        if b"<|" not in raw:  # the names of special tokens stay as they are
            raw = raw.lower().replace(b"\n", b" ")
            data = np.frombuffer(raw, np.uint8)
            cuts = np.flatnonzero(LETTERS[data[:-1]] & MARKS[data[1:]])
            if len(cuts):
                raw = np.insert(data, cuts + 1, 32).tobytes()
        return raw.split(b" ")

    def learn(self, units: list[bytes]) -> None:
        for at in range(0, len(units), 20_000):
            some = [u.decode() for u in units[at : at + 20_000]]
            starts = np.cumsum([0] + [len(u) + 1 for u in some[:-1]])
            coded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(coded.ids, "<u4")
            place = np.fromiter((a for a, _ in coded.offsets), np.int64, len(ids))
            ends = np.searchsorted(np.searchsorted(starts, place, "right"), np.arange(len(some)) + 1, "right")
            data = ids.tobytes()
            first = 0
            for u, end in zip(units[at : at + 20_000], (4 * ends).tolist()):
                self.known[u] = data[first:end]
                first = end

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        split = [self.units(t) if t else [] for t in texts]
        known = self.known
        asked = set().union(*split)
        new = [u for u in asked if u not in known]
        if len(known) + len(new) > self.cache:
            # what these texts ask for stays: the frequent units among them
            kept = {u: known[u] for u in asked if u in known}
            known.clear()
            known.update(kept)
            known[b""] = b""
        self.learn(new)
        return [b"".join([known[u] for u in units]) for units in split]


_workers: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, cache: int) -> WordIds:
    """The worker's own ``WordIds`` of a tokenizer, with what earlier tasks of
    the worker learned (bounded by ``cache``)."""
    if (path, cache) not in _workers:
        _workers[path, cache] = WordIds(path, cache)
    return _workers[path, cache]


PIECES = (
    "doc_id {id}, piece int, start long, length long, ids_crc32 long, "
    "part int, local_rank long{ids}"
)


def cut_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool = False
) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in
    its task (``part``, ``local_rank``)."""

    cache, at_once = (WORD_CACHE_WITH_IDS, SLICE_WITH_IDS) if with_ids else (WORD_CACHE, SLICE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path, cache)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for whole in batches:
            for batch in slices(whole, "text", at_once):
                row: list[int] = []
                out: list[tuple[int, int, int, int, int, int]] = []
                ids: list[np.ndarray] = []
                for at, data in enumerate(words.encode_all(batch.column("text").to_pylist())):
                    data += end
                    total = len(data) // 4
                    for piece, start in enumerate(range(0, total, capacity)):
                        length = min(capacity, total - start)
                        body = data[4 * start : 4 * (start + length)]
                        r = seen.get(length, 0)
                        seen[length] = r + 1
                        row.append(at)
                        out.append((piece, start, length, zlib.crc32(body), part, r))
                        if with_ids:
                            ids.append(np.frombuffer(body, "<i4"))
                piece, start, length, crc, parts, local = np.array(out, np.int64).T
                cols = [
                    batch.column("doc_id").take(pa.array(row, pa.int64())),
                    pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array(crc), pa.array(parts.astype(np.int32)), pa.array(local),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(offsets, np.concatenate(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        pa.default_memory_pool().release_unused()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = PIECES.format(id=kind, ids=", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset and, with ``with_ids``, the token ids themselves.
    """
    if not 0 < capacity < 1 << 20:
        raise ValueError("capacity must be between 1 and 2^20 tokens")
    pieces = stage(cut_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")

    per_task = stage(
        pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths"
    )
    # one row per length, at most ``capacity``
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps, _ = plan_packing(histogram, capacity)
    steps.sort(key=lambda s: (s.length, s.rank))
    table = np.array(
        [(s.length * RANKS + s.rank, s.rank, s.bin, s.per_bin, s.base) for s in steps], np.int64
    ).reshape(-1, 5)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )

    shared = docs.sparkSession.sparkContext.broadcast(table)

    # only the two numbers go through Python: the ids stay in their rows
    @F.arrow_udf("sequence_id long, offset long")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        key, first, bin0, per_bin, base = shared.value.T
        length, rank = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        at = np.searchsorted(key, length * RANKS + rank, "right") - 1
        nth = rank - first[at]
        found = [pa.array(bin0[at] + nth // per_bin[at]), pa.array(base[at] + nth % per_bin[at] * length)]
        return pa.StructArray.from_arrays(found, ["sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    rank = F.col("before") + F.col("local_rank")
    ranked = pieces.join(offsets, ["length", "part"]).select(*kept, place("length", rank).alias("_at"))
    return ranked.select(*kept, "_at.sequence_id", "_at.offset")
