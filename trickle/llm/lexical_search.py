"""Ranked lexical search: hybrid TAAT-DAAT over a segmented inverted index.

A segment is the inverted index of a bounded run of documents: the postings of
every query term, in document order. An item is answered in each segment in
two phases:

1. *Term at a time.* Its short posting lists are summed into accumulators, a
   sorted list of (document, partial score). The k-th largest partial score is
   a first threshold: that many documents reach it.
2. *Document at a time.* The accumulators are one more iterator, with a bound
   (its largest sum per block of documents) like the long lists have. Blocks
   whose bounds add up to less than the threshold are skipped without touching
   a list. In a live block iterators go in by falling bound; once those left
   cannot lift an unseen document over the threshold, only the documents seen
   are looked up in them, less those that can no longer reach it.

A task carries each item's best k from segment to segment, so the threshold
rises; only k rows per item leave a task. All scores are 64-bit integers, so
results are exact and do not depend on the partitioning.

Scale: items are taken in chunks of about ``CHUNK_BYTES`` of text. A chunk's
vocabulary and item lists go to the tasks (bounded by the chunk, not by the
documents); the text is read once per chunk, and the counts of documents and
of terms come out of the segments written in that pass, over all documents. A
segment ends at ``SEGMENT_DOCS`` documents or ``SEGMENT_POSTINGS`` postings,
so a task's memory does not grow with its input. No document moves; nothing is
grouped by term, so frequent terms are no hot keys.

Defined results:

- A null or empty text, or one without a term, is no document and no item with
  results. Whole texts are used, long ones in pieces cut between terms.
- Documents with equal scores rank by doc_id, a null id last; documents with
  one id are documents of their own, and so are repeated items.
- A document with score 0 (all its terms weigh 0) is not returned.
- Empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trickle.llm.common import slices, stage

SEGMENT_DOCS = 1 << 16
SEGMENT_POSTINGS = 1 << 22
BLOCK = 1024  # documents of a block that is skipped or read
SHORT = 32  # a list is short while it holds fewer than 1 / SHORT of the segment's documents
PIECE = 1 << 20  # bytes of a text split at once
CHUNK_BYTES = 4 << 20  # text of the items of a chunk, expected
NO_ID = (1 << 63) - 1  # stands for a null doc_id, which comes last

# Terms are runs of ASCII letters and digits and of all other characters from
# U+0080; only A-Z are lower-cased. In UTF-8 that is a table over bytes.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

SEGMENTS = (
    "doc_ids binary, no_ids binary, lengths binary, n_docs bigint, n_terms bigint, "
    "terms array<int>, counts array<bigint>, docs binary, tfs binary"
)
HITS = "item bigint, doc_id bigint, no_id boolean, score bigint"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, a bounded list at a time."""
    flat = text.translate(TABLE)
    start = 0
    while start < len(flat):
        end = len(flat) if len(flat) - start <= PIECE else flat.find(b" ", start + PIECE)
        end = len(flat) if end < 0 else end
        yield flat[start:end].split()
        start = end


class _Segment:
    """Postings of a run of documents while it is read."""

    def __init__(self):
        self.ids, self.lengths, self.docs, self.terms, self.tfs = [], [], [], [], []

    def add(self, doc_id, length: int, counts: Counter) -> None:
        at = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.docs.extend([at] * len(counts))
        self.terms.extend(counts.keys())
        self.tfs.extend(counts.values())

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or len(self.docs) >= SEGMENT_POSTINGS

    def batch(self) -> pa.RecordBatch:
        no = np.array([i is None for i in self.ids], dtype=bool)
        ids = np.array([NO_ID if i is None else i for i in self.ids], dtype=np.int64)
        order = np.lexsort((no, ids))  # documents in the order of ties
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        docs = place[np.array(self.docs, dtype=np.int64)]
        term = np.array(self.terms, dtype=np.int32)
        tf = np.array(self.tfs, dtype=np.int64)
        by = np.lexsort((docs, term))
        names, counts = np.unique(term, return_counts=True)
        return pa.record_batch([
            pa.array([ids[order].tobytes()], pa.binary()),
            pa.array([no[order].tobytes()], pa.binary()),
            pa.array([np.array(self.lengths, dtype=np.int64)[order].tobytes()], pa.binary()),
            pa.array([len(ids)], pa.int64()),
            pa.array([sum(self.lengths)], pa.int64()),
            pa.array([names], pa.list_(pa.int32())),
            pa.array([counts], pa.list_(pa.int64())),
            pa.array([docs[by].astype(np.int32).tobytes()], pa.binary()),
            pa.array([tf[by].tobytes()], pa.binary()),
        ], names=["doc_ids", "no_ids", "lengths", "n_docs", "n_terms", "terms", "counts", "docs", "tfs"])


def _index(vocabulary):
    """Documents -> segments with the postings of the vocabulary."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        segment = _Segment()
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                    buffer = text.as_buffer()
                    if buffer is None:
                        continue
                    length, counts = 0, Counter()
                    for piece in terms(buffer.to_pybytes()):
                        length += len(piece)
                        counts.update(map(number, piece))
                    counts.pop(None, None)
                    if not length:
                        continue
                    segment.add(doc_id, length, counts)
                    if segment.full():
                        yield segment.batch()
                        segment = _Segment()
        if segment.ids:
            yield segment.batch()

    return index


class Lists:
    """The posting lists of a segment with the score of every posting, and
    the largest score per block of documents."""

    def __init__(self, row: dict, weights: dict[int, int], n_docs: int, n_terms: int):
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.no_ids = np.frombuffer(row["no_ids"], bool)
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.n = len(self.ids)
        self.blocks = -(-self.n // BLOCK)
        if 50 * int(lengths.max()) * n_docs < 1 << 63:
            size = 50 + (50 * n_docs * lengths) // n_terms
        else:
            size = np.array([50 + 50 * n_docs * x // n_terms for x in lengths.tolist()], dtype=np.int64)
        docs = np.frombuffer(row["docs"], np.int32).astype(np.int64)
        tfs = np.frombuffer(row["tfs"], np.int64)
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 20 * size[docs])
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._edges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        start = 0
        for term, count in zip(row["terms"], row["counts"]):
            if weights.get(term, 0) > 0:
                self.lists[term] = docs[start : start + count], weights[term] * impact[start : start + count]
            start += count

    def edges(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a list: where each block starts, and its largest score."""
        if term not in self._edges:
            self._edges[term] = block_bounds(*self.lists[term], self.blocks)
        return self._edges[term]


def block_bounds(docs: np.ndarray, scores: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.searchsorted(docs, np.arange(blocks + 1) * BLOCK)
    top = np.zeros(blocks, dtype=np.int64)
    filled = cuts[1:] > cuts[:-1]
    if filled.any():
        top[filled] = np.maximum.reduceat(scores, cuts[:-1][filled])
    return cuts, top


def accumulate(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: the lists summed into one sorted list."""
    docs = np.concatenate([d for d, _ in parts])
    scores = np.concatenate([s for _, s in parts])
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], scores[order]
    starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    return docs[starts], np.add.reduceat(scores, starts)


class Best:
    """The k best (score, no id, id) of an item so far."""

    def __init__(self, k: int):
        self.k = k
        self.scores = np.zeros(0, dtype=np.int64)
        self.no_ids = np.zeros(0, dtype=bool)
        self.ids = np.zeros(0, dtype=np.int64)

    def threshold(self) -> int:
        """A document with a smaller score is not among the best; it needs a
        score above 0 in any case."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def take(self, scores: np.ndarray, no_ids: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.scores, scores])
        no_ids, ids = np.concatenate([self.no_ids, no_ids]), np.concatenate([self.ids, ids])
        order = np.lexsort((no_ids, ids, -scores))[: self.k]
        self.scores, self.no_ids, self.ids = scores[order], no_ids[order], ids[order]


def search(lists: Lists, query: list[int], best: Best) -> int:
    """Add a segment's documents to the ``best`` of an item; returns how many
    blocks were read."""
    found = sorted((len(lists.lists[t][0]), t) for t in query if t in lists.lists)
    if not found:
        return 0
    room = max(1, lists.n // SHORT)
    short = [t for n, t in found if n <= room]
    long = [t for n, t in found if n > room]
    iterators = [(lists.lists[t], lists.edges(t)) for t in long]
    threshold = best.threshold()
    if short:
        summed = accumulate([lists.lists[t] for t in short])
        iterators.append((summed, block_bounds(*summed, lists.blocks)))
        if len(summed[1]) >= best.k:
            threshold = max(threshold, int(np.partition(summed[1], -best.k)[-best.k]))
    tops = np.stack([top for _, (_, top) in iterators])
    ceiling = tops.sum(axis=0)
    read = 0
    for block in np.flatnonzero(ceiling >= threshold).tolist():
        if ceiling[block] < threshold:
            continue
        read += 1
        base = block * BLOCK
        partial = np.zeros(BLOCK, dtype=np.int64)
        order = np.argsort(-tops[:, block], kind="stable").tolist()
        rest = int(ceiling[block])
        seen = None
        for i in order:
            (docs, scores), (cuts, top) = iterators[i]
            if seen is None and rest < threshold:  # an unseen document cannot reach it any more
                seen = np.flatnonzero(partial)
            lo, hi = cuts[block], cuts[block + 1]
            rest_after = rest - int(top[block])
            if seen is None:
                partial[docs[lo:hi] - base] += scores[lo:hi]
            else:
                seen = seen[partial[seen] + rest >= threshold]
                if not len(seen):
                    break
                at = np.searchsorted(docs[lo:hi], seen + base)
                hit = at < hi - lo
                hit[hit] = docs[lo:hi][at[hit]] == seen[hit] + base
                partial[seen[hit]] += scores[lo:hi][at[hit]]
            rest = rest_after
        good = np.flatnonzero(partial >= threshold) if seen is None else seen[partial[seen] >= threshold]
        if len(good):
            at = good + base
            best.take(partial[good], lists.no_ids[at], lists.ids[at])
            threshold = max(threshold, best.threshold())
    return read


def _search(queries, weights, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(k) for item, _ in queries.value}
        for batch in batches:
            for i in range(batch.num_rows):
                lists = Lists(batch.slice(i, 1).to_pylist()[0], weights.value, n_docs, n_terms)
                for item, query in queries.value:
                    search(lists, query, best[item])
        for item, b in best.items():
            if len(b.ids):
                yield pa.record_batch([
                    pa.array(np.full(len(b.ids), item), pa.int64()), pa.array(b.ids, pa.int64()),
                    pa.array(b.no_ids, pa.bool_()), pa.array(b.scores, pa.int64()),
                ], names=["item", "doc_id", "no_id", "score"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _chunk_hits(docs: DataFrame, items: list, k: int) -> DataFrame | None:
    """The best k of every task for the items (row id, text) of one chunk."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    queries = []
    for r in items:
        own = {t for piece in terms(r.text.encode()) for t in piece}
        queries.append((r.item, [vocabulary.setdefault(t, len(vocabulary)) for t in sorted(own)]))
    words = spark.sparkContext.broadcast(vocabulary)
    segments = stage(docs.mapInArrow(_index(words), SEGMENTS), "segments")
    total = segments.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    if not total.n:
        return None
    held = (
        segments.select(F.explode(F.arrays_zip("terms", "counts")).alias("p"))
        .groupBy("p.terms").agg(F.sum("p.counts").alias("df")).collect()
    )
    weights = {r.terms: weight(total.n, r.df) for r in held}
    run = _search(spark.sparkContext.broadcast(queries), spark.sparkContext.broadcast(weights), total.n, total.l, k)
    return segments.mapInArrow(run, HITS)


def rank(docs: DataFrame, items: DataFrame, k: int = 50, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` (doc_id, text), ``items`` (item_id, text) -> item_id, rank,
    doc_id, score: each item's k highest-scoring documents."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    named = stage(
        items.where("text IS NOT NULL").select(
            F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("bigint").alias("item_id"), "text"
        ),
        "items",
    )
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    every = None
    for c in range(chunks):
        part = named.where(F.pmod(F.xxhash64("item"), F.lit(chunks)) == c).select("item", "text").collect()
        found = _chunk_hits(docs, part, k) if part else None
        if found is not None:
            every = found if every is None else every.unionAll(found)
    if every is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "no_id", "doc_id")
    top = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(named.select("item", "item_id"), "item").select(
        "item_id", "rank", F.expr("CASE WHEN NOT no_id THEN doc_id END").alias("doc_id"), "score"
    )
