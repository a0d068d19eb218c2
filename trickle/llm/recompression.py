"""Substring dedup by recompression.

A text is parsed in rounds over its words. A round first names every maximal
run of one symbol, then every adjacent pair whose first symbol is of the left
class and whose second is of the right class (a hash bit of the symbol), and
leaves the rest. Names are 64-bit hashes of what they stand for, so every task
gives equal strings equal names with nothing to exchange. Whether symbols are
joined depends on them and their neighbours only: equal passages get the same
symbols but for a few at either end. So a window of WINDOW words has an
*interior* that is the same wherever the window stands. Its anchor is the
phrase of PHRASE symbols with the least hash there, at the highest round whose
interior has one. About one word in 16 starts a new anchor.

1. Anchors (phrase, document) are grouped by phrase: windows that occur in
   two documents have an anchor that does, too.
2. Of documents with shared anchors, windows at shared anchors are verified
   by a 96-bit hash of all their words: the least doc_id of every such window
   is found, and a window with a smaller one is marked.
3. Marked windows go back to their documents, which drop the words covered.

Documents whose whole word sequence stands in a smaller doc_id lose all words
of their windows and skip step 2. Only documents with shared anchors have
their texts exchanged a second time, and texts are exchanged compressed.
Groupings of steps 1 and 2 aggregate before the exchange and join back through
plain exchanges that adaptive execution splits, so neither a passage nor a
text that very many documents share meets in one task.

A row is known by its doc_id and ``rid``, a hash of id and text: only rows of
one doc_id could be mistaken for each other, however many documents there are.

Defined cases: null text has no words; texts shorter than a window lose
nothing; a document with null doc_id neither loses words nor makes others lose
them; repeated rows (same doc_id) do not remove each other, and of equal texts
the smallest doc_id keeps its words, so there are no ties; a very long text is
parsed whole, by itself; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trickle.llm.common import slices, stage

WINDOW = 50
ROUNDS = 3
PHRASE = 4
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def name_runs(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and documents of the maximal runs, and each symbol's run."""
    new = np.ones(len(sym), bool)
    new[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(sym))).astype(np.uint64)
    s = sym[first]
    many = length > 1
    s[many] = mix(s[many] * U(0x9E3779B97F4A7C15) + length[many])
    return s, doc[first], np.cumsum(new) - 1


def name_pairs(
    sym: np.ndarray, doc: np.ndarray, round_: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and documents after pairing, each symbol's place there, and
    which symbols are of the right class."""
    right = (mix(sym + U(0xD1B54A32D192ED03 * (round_ + 1) % 2**64)) & U(1)).astype(bool)
    leads = np.zeros(len(sym), bool)
    leads[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
    head = np.ones(len(sym), bool)
    head[1:] = ~leads[:-1]
    at = np.flatnonzero(head)
    s = sym[at]
    paired = leads[at]
    s[paired] = mix(s[paired] * U(0xC2B2AE3D27D4EB4F) + mix(sym[at[paired] + 1]))
    return s, doc[at], np.cumsum(head) - 1, right


def _least(keys: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Place of the least key in each [x, y), the first if several."""
    out = np.empty(len(x), np.int64)
    width = y - x
    table = np.arange(len(keys))
    step = 1
    while True:
        now = (width >= step) & (width < 2 * step)
        if now.any():
            a, b = table[x[now]], table[y[now] - step]
            out[now] = np.where(keys[b] < keys[a], b, a)
        if step * 2 > width.max(initial=0):
            return out
        a, b = table[: len(table) - step], table[step:]
        table = np.where(keys[b] < keys[a], b, a)
        step *= 2


def window_anchors(sym: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window (within one document) and its anchor phrase.

    ``sym`` holds word hashes of several documents, ``doc`` their numbers.
    """
    if len(sym) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    start = np.flatnonzero(doc[: len(sym) - window + 1] == doc[window - 1 :])
    x, y = start, start + window
    levels = [(sym, x, y)]
    for r in range(ROUNDS):
        sym, doc, place = name_runs(sym, doc)
        some = y > x
        # the runs at both ends may go on outside the window
        x, y = np.where(some, place[x] + 1, 0), np.where(some, place[y - 1], 0)
        sym_, doc_, place, right = name_pairs(sym, doc, r)
        # an end symbol whose partner may stand outside is left out
        some = y > x
        x = x + (some & right[np.minimum(x, len(sym) - 1)])
        y = y - ((y > x) & ~right[y - 1])
        some = y > x
        x = np.where(some, place[np.minimum(x, len(sym) - 1)], 0)
        y = np.where(some, place[y - 1] + 1, 0)
        sym, doc = sym_, doc_
        levels.append((sym, x, y))
    anchor = np.empty(len(start), np.uint64)
    todo = np.ones(len(start), bool)
    for level in range(ROUNDS, -1, -1):
        s, x, y = levels[level]
        now = np.flatnonzero(todo & (y - x >= PHRASE))
        if len(now):
            phrase = s[: len(s) - PHRASE + 1]
            for i in range(1, PHRASE):
                phrase = mix(phrase * U(0x9E3779B97F4A7C15) + s[i : len(s) - PHRASE + 1 + i])
            phrase = mix(phrase + U(level))
            anchor[now] = phrase[_least(phrase, x[now], y[now] - (PHRASE - 1))]
            todo[now] = False
    return start, anchor


def window_hashes(sym: np.ndarray, start: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of every window from all its words: two polynomials over
    scrambled word hashes, mod 2^64."""
    out = []
    for factor, salt in ((0x9E3779B97F4A7C15, 1), (0xD6E8FEB86659FD93, 2)):
        power = np.cumprod(np.full(len(sym) + 1, U(factor), np.uint64))
        back = np.cumprod(np.full(len(sym) + 1, U(pow(factor, -1, 2**64)), np.uint64))
        sums = np.zeros(len(sym) + 1, np.uint64)
        np.cumsum(mix(sym + U(salt)) * power[:-1], out=sums[1:])
        out.append(mix((sums[start + window] - sums[start]) * back[start]))
    return out[0].view(np.int64), (out[1] >> U(32)).astype(np.uint32).view(np.int32)


def words_of(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, all word hashes, and the text each belongs to."""
    from xxhash import xxh64_intdigest

    words = [t.split() if t else [] for t in texts]  # bytes split at ASCII white space
    counts = np.array([len(w) for w in words], np.int64)
    sym = np.fromiter((xxh64_intdigest(w) for ws in words for w in ws), np.uint64, int(counts.sum()))
    return words, sym, np.repeat(np.arange(len(texts)), counts)


KEY = ["doc_id", "rid"]


def row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", row_hash().alias("rid"), F.col("text").cast("binary").alias("text"))


def parse(docs: DataFrame) -> DataFrame:
    """Rows of two kinds, told apart by ``phrase``. Null: one per document,
    with n_words and the SHA-256 of its words joined by a space. Not null: its
    anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                words, sym, doc = words_of(b.column("text").to_pylist())
                start, anchor = window_anchors(sym, doc)
                at = doc[start]
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1]) | (anchor[1:] != anchor[:-1])
                at, anchor = at[new], anchor[new]
                n = b.num_rows
                take = pa.array(np.concatenate([np.arange(n), at]))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("rid").take(take), b.column("doc_id").take(take),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(anchor.view(np.int64))]),
                        pa.array([len(w) for w in words] + [None] * len(at), pa.int64()),
                        pa.array(
                            [hashlib.sha256(b" ".join(w)).digest() for w in words] + [None] * len(at),
                            pa.binary(),
                        ),
                    ],
                    ["rid", "doc_id", "phrase", "n_words", "sha"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).mapInArrow(run, f"rid long, doc_id {kind}, phrase long, n_words long, sha binary")


def compressed(docs: DataFrame) -> DataFrame:
    """rid, doc_id and the text, compressed, for an exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                packed = [pack(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("rid"), b.column("doc_id"), pa.array(packed, pa.binary())],
                    ["rid", "doc_id", "packed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).where("text IS NOT NULL").mapInArrow(run, f"rid long, doc_id {kind}, packed binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of batches with their texts."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for whole in batches:
        for b in slices(whole, "packed", 1 << 20):
            yield b, [unpack(p) for p in b.column("packed").to_pylist()]


def windows_at(texts: DataFrame) -> DataFrame:
    """Windows of ``texts`` (rid, doc_id, packed, phrases) whose anchor is
    among the text's phrases: (h1, h2, rid, doc_id, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw in unpacked(batches):
            _, sym, doc = words_of(raw)
            start, anchor = window_anchors(sym, doc)
            lists = b.column("phrases")
            per_doc = np.diff(lists.offsets.to_numpy())
            phrases = lists.flatten().to_numpy().view(np.uint64)
            salt = mix(np.arange(b.num_rows, dtype=np.uint64) + U(1))
            asked = np.repeat(salt, per_doc) ^ phrases
            start = start[np.isin(salt[doc[start]] ^ anchor, asked)]
            h1, h2 = window_hashes(sym, start)
            at = doc[start]
            first = np.searchsorted(doc, np.arange(b.num_rows))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h1), pa.array(h2), b.column("rid").take(take),
                    b.column("doc_id").take(take), pa.array((start - first[at]).astype(np.int32)),
                ],
                ["h1", "h2", "rid", "doc_id", "start"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"h1 long, h2 int, rid long, doc_id {kind}, start int")


def covered(n: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of ``n`` words the windows at ``starts`` cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:-1]) > 0


def cut(texts: DataFrame) -> DataFrame:
    """rid, doc_id, n_removed and kept (the words left, joined by a space) of
    ``texts`` (rid, doc_id, packed, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw in unpacked(batches):
            lost, kept = [], []
            for text, starts in zip(raw, b.column("starts")):
                words = text.split()
                gone = covered(len(words), starts.values.to_numpy())
                left = [w for w, g in zip(words, gone.tolist()) if not g]
                lost.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("doc_id"), pa.array(lost, pa.int64()), pa.array(kept, pa.binary())],
                ["rid", "doc_id", "n_removed", "kept"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"rid long, doc_id {kind}, n_removed long, kept binary")


def find_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, rid, n_words, n_removed,
    kept_sha256, and kept, the words left (as bytes) of a document that lost
    some; null if it lost none."""
    parsed = stage(parse(docs), "parsed")
    heads = parsed.where("phrase IS NULL").select("rid", "doc_id", "n_words", "sha")
    first = stage(heads.groupBy("sha").agg(F.min("doc_id").alias("first")), "first-texts")
    heads = stage(
        heads.join(first, "sha").select(
            "*", F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= WINDOW), F.lit(False)).alias("copy")
        ).drop("first"),
        "heads",
    )
    anchors = parsed.where("phrase IS NOT NULL AND doc_id IS NOT NULL").select("rid", "doc_id", "phrase")
    shared = stage(
        anchors.groupBy("phrase").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        .where("lo < hi").select("phrase"),
        "shared-anchors",
    )
    wanted = stage(
        anchors.join(shared, "phrase")
        .groupBy(*KEY).agg(F.collect_set("phrase").alias("phrases"))
        .join(heads.where("copy").select(*KEY), KEY, "left_anti"),
        "wanted",
    )
    texts = stage(compressed(docs).join(wanted, KEY).dropDuplicates(KEY), "shared-texts")
    windows = stage(windows_at(texts), "windows")
    repeats = stage(
        windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        .where("lo < hi").select("h1", "h2", "lo"),
        "repeats",
    )
    marks = stage(
        windows.join(repeats, ["h1", "h2"]).where("lo < doc_id")
        .groupBy(*KEY).agg(F.sort_array(F.collect_set("start")).alias("starts")),
        "marks",
    )
    changed = stage(cut(texts.select(*KEY, "packed").join(marks, KEY)), "changed")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    sha = (
        F.when(F.col("copy"), nothing)
        .when(F.col("n_removed").isNotNull(), F.sha2("kept", 256))
        .otherwise(F.lower(F.hex("sha")))
    )
    return heads.join(changed, KEY, "left").select(
        "doc_id", "rid", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        sha.alias("kept_sha256"),
        F.when(F.col("copy"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with text replaced by the words left, joined by a space, where
    words were removed; all other columns as they are."""
    columns = docs.columns
    found = find_repeats(docs).where("n_removed > 0").groupBy(*KEY).agg(F.first("kept").alias("_kept"))
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    keyed_ = docs.select(row.alias("_row"), "doc_id", row_hash().alias("rid"))
    named = {c: F.col(f"_row.`{c}`") for c in columns}
    named["text"] = F.coalesce(F.col("_kept").cast("string"), named["text"])
    return keyed_.join(found, KEY, "left").select(*[v.alias(c) for c, v in named.items()])
