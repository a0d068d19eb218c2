"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are divided into partitions, correlated bits together. Partition
i gets a threshold t_i of its own, -1 (left out) or more, with
sum(t_i + 1) = D + 1; two fingerprints that differ in at most D bits then
differ in at most t_i bits of some partition i. So each fingerprint is
indexed under its bits of every partition and probes all values within t_i
bits of them, and what meets is verified by its full distance. The result
does not depend on the partitions; they decide only the work. Their number
and thresholds come from dynamic programming over estimated probe rows and
candidate pairs (pair counts of a bounded sample of SAMPLE fingerprints,
carried on to all).

Equal fingerprints are one node. Meetings are streamed: a task holds the
indexed fingerprints of one value (an index value with over BLOCK of them is
dealt out over several tasks, and its probes to each) and passes the probes
by them; of the links found in a large meeting only those that join something
new are given out, so no meeting gives out all its pairs, and no link between
components is lost. Components are then found by contraction.

Defined cases: null, empty and blank texts have fingerprint 0, linked like
any other; a text with fewer words than a shingle is one shingle; a null
doc_id takes part but never names a component that has another; repeated rows
are equal fingerprints; a bit set in just half of the shingles is 0; very long
texts are read whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trickle.llm.common import slices, stage
from trickle.llm.components import connected_components

BITS = 64
SAMPLE = 20_000
BLOCK = 4096
# Meetings with at most so many indexed fingerprints are compared at once.
SMALL = 16
MAX_THRESHOLD = 2
# Cost of comparing a pair, against that of a probe row.
PAIR_COST = 0.02


def fingerprint_column(texts: list[bytes | None], shingle: int) -> np.ndarray:
    """SimHash of each text (unsigned 64-bit)."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for at, text in enumerate(texts):
        words = text.lower().split() if text else []  # ASCII case and white space, as for bytes
        if not words:
            continue
        before = len(hashes)
        whole = b" ".join(words)
        if len(words) < shingle:
            hashes.append(xxh64_intdigest(whole, 42))
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[: len(words) - shingle].tolist()]
            stops = (ends[shingle - 1 :] - 1).tolist()
            hashes += [xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts, stops)]
        counts[at] = len(hashes) - before
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        raw = np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        begins = np.cumsum(counts[some]) - counts[some]
        ones = np.empty((len(some), BITS), np.int64)
        for byte in range(8):  # a byte column at a time bounds the unpacked bits
            bits = np.unpackbits(raw[:, byte : byte + 1], axis=1, bitorder="little")
            ones[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
        set_ = (2 * ones > counts[some][:, None]).astype(np.uint64)
        out[some] = (set_ << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, mark: Column | None = None) -> DataFrame:
    """doc_id, mark (default: a hash of id and text) and fp (signed 64-bit) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                fp = fingerprint_column(b.column("text").to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("mark"), pa.array(fp.view(np.int64))],
                    ["doc_id", "mark", "fp"],
                )

    mark = F.xxhash64("doc_id", "text") if mark is None else mark
    source = docs.select("doc_id", mark.alias("mark"), F.col("text").cast("binary").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    return source.mapInArrow(run, f"doc_id {kinds['doc_id']}, mark {kinds['mark']}, fp long")


# ---------------------------------------------------------------- partitions


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits 0 to 63 in ``parts`` groups of near-equal size, each grown by the
    bit most correlated with those it has."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(axis=0) if len(bits) else 0
    scale = np.sqrt((bits**2).sum(axis=0))
    scale[scale == 0] = 1
    corr = np.abs((bits.T @ bits) / np.outer(scale, scale))
    np.fill_diagonal(corr, 0)
    free = list(range(BITS))
    groups = []
    for left in range(parts, 0, -1):
        width = -(-len(free) // left)
        start = free[int(np.argmax(corr[np.ix_(free, free)].max(axis=1)))]
        group = [start]
        free.remove(start)
        while len(group) < width:
            best = free[int(np.argmax(corr[np.ix_(free, group)].sum(axis=1)))]
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def flips(group: list[int], threshold: int) -> np.ndarray:
    """All masks of at most ``threshold`` bits of ``group``."""
    out = [sum(1 << b for b in c) for n in range(threshold + 1) for c in combinations(group, n)]
    return np.array(out, np.uint64)


def mask_of(group: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in group))


def pair_share(sample: np.ndarray, group: list[int], threshold: int) -> float:
    """Share of pairs that agree in ``group`` but for ``threshold`` bits:
    counted over the sample, and no less than that of random bits."""
    masks = flips(group, threshold)
    random = len(masks) / 2.0 ** len(group)
    if len(sample) < 2:
        return random
    values, counts = np.unique(sample & mask_of(group), return_counts=True)
    met = -len(sample)
    for m in masks:
        at = np.minimum(np.searchsorted(values, values ^ m), len(values) - 1)
        met += int((counts * counts[at])[values[at] == values ^ m].sum())
    return max(random, met / (len(sample) * (len(sample) - 1.0)))


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = budget and the least cost;
    costs[i][t] is that of threshold t in partition i (t = -1 costs none)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, len(row)):
                total = cost + (row[t] if t >= 0 else 0.0)
                key = used + t + 1
                if key <= budget and (key not in nxt or total < nxt[key][0]):
                    nxt[key] = (total, [*chosen, t])
        best = nxt
    return best.get(budget, (float("inf"), []))


def plan_partitions(sample: np.ndarray, total: int, distance: int) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds, of the least estimated cost."""
    options = []
    for parts in range(2, distance + 2):
        groups = group_bits(sample, parts)
        costs = [
            [
                total * (1 + len(flips(g, t))) + PAIR_COST * pair_share(sample, g, t) * total**2
                for t in range(min(MAX_THRESHOLD, distance) + 1)
            ]
            for g in groups
        ]
        cost, thresholds = allocate(costs, distance + 1)
        options.append((cost, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    if not options:  # distance 0: equal fingerprints only
        return []
    return min(options, key=lambda x: x[0])[1]


# ------------------------------------------------------------- index, probes


def keys_of(values: np.ndarray, part: int) -> np.ndarray:
    """A 64-bit key of (part, value); a clash only adds candidates."""
    x = values + np.uint64(0x9E3779B97F4A7C15 * (part + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _rows(key: np.ndarray, side: int, fp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(np.full(len(key), side, np.int8)), pa.array(fp.view(np.int64))],
        ["key", "side", "fp"],
    )


def index_and_probe_rows(nodes: DataFrame, parts: list[tuple[list[int], int]], probes: bool) -> DataFrame:
    """(key, side, fp): side 0 the index, side 1 the probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for part, (group, threshold) in enumerate(parts):
                value = fp & mask_of(group)
                if not probes:
                    yield _rows(keys_of(value, part), 0, fp)
                    continue
                for flip in flips(group, threshold):
                    yield _rows(keys_of(value ^ flip, part), 1, fp)

    return nodes.select("fp").mapInArrow(run, "key long, side byte, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _small_meetings(fp, at, n_index, n_probe, distance):
    """Links of meetings that start at ``at`` (indexed first, then probes)."""
    pairs = n_index * n_probe
    which = np.repeat(np.arange(len(at)), pairs)
    nth = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    a = fp[at[which] + nth % n_index[which]]
    b = fp[at[which] + n_index[which] + nth // n_index[which]]
    near = (a < b) & (_popcount(a ^ b) <= distance)
    return a[near], b[near]


def _large_meeting(index: np.ndarray, probes: np.ndarray, distance: int, root: np.ndarray):
    """Links between ``probes`` and ``index`` that join something new; root
    holds what is joined among the indexed so far."""
    us, vs = [], []
    for p in probes:
        near = np.flatnonzero(_popcount(index ^ p) <= distance)
        if not len(near):
            continue
        first = near[0]
        if index[first] != p:
            us.append(p)
            vs.append(index[first])
        for r in np.unique(root[near]):
            if r != root[first]:
                us.append(index[first])
                vs.append(index[near[root[near] == r][0]])
                root[root == r] = root[first]
    return np.array(us, np.uint64), np.array(vs, np.uint64)


def find_links(meetings: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) among rows (key, chunk, side, fp) that are sorted by key,
    chunk and side within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, root = None, np.empty(0, np.uint64), None

        for b in batches:
            if not b.num_rows:
                continue
            key = np.rec.fromarrays([b.column("key").to_numpy(), b.column("chunk").to_numpy()])
            fp = b.column("fp").to_numpy().view(np.uint64)
            side = b.column("side").to_numpy()
            if held_key is not None and len(held):
                again = np.repeat(np.array([held_key], key.dtype), len(held))
                key = np.concatenate([again, key])
                fp = np.concatenate([held, fp])
                side = np.concatenate([np.zeros(len(held), side.dtype), side])
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            n_probe = np.add.reduceat(side.astype(np.int64), starts)
            n_index = sizes - n_probe
            out = []
            small = np.flatnonzero((n_index > 0) & (n_probe > 0) & (n_index <= SMALL))
            pairs = np.cumsum(n_index[small] * n_probe[small])
            for g in np.split(small, np.searchsorted(pairs, np.arange(1 << 20, pairs[-1], 1 << 20))) if len(small) else []:
                if len(g):
                    out.append(_small_meetings(fp, starts[g], n_index[g], n_probe[g], distance))
            for g in np.flatnonzero((n_index > SMALL) & (n_probe > 0)):
                s, n = starts[g], n_index[g]
                if not (s == 0 and root is not None and len(root) == n):
                    root = np.arange(n)
                out.append(_large_meeting(fp[s : s + n], fp[s + n : s + sizes[g]], distance, root))
            last, n = starts[-1], n_index[-1]
            if not (n > SMALL and n_probe[-1] > 0):
                root = None
            held_key, held = key[last], fp[last : last + n].copy()
            for u, v in out:
                if len(u):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"]
                    )

    return meetings.select("key", "chunk", "side", "fp").mapInArrow(run, "u long, v long")


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """Links between the distinct fingerprints ``nodes`` (fp) that connect
    every two at ``distance`` bits or less."""
    total = nodes.count()
    rows = nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r.fp for r in rows], np.int64).view(np.uint64)
    parts = plan_partitions(sample, total, distance)
    index = index_and_probe_rows(nodes, parts, probes=False)
    # index values with many fingerprints, and into how many chunks they are dealt
    hot = stage(
        index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks")),
        "hot-values",
    )
    probes = index_and_probe_rows(nodes, parts, probes=True)
    chunks = F.coalesce("chunks", F.lit(1))
    one: Column = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    every: Column = F.explode(F.sequence(F.lit(0), chunks - 1))
    if hot.take(1):
        dealt = (
            index.join(hot, "key", "left").select("key", one.alias("chunk"), "side", "fp")
            .unionAll(probes.join(hot, "key", "left").select("key", every.alias("chunk"), "side", "fp"))
        )
    else:
        dealt = index.unionAll(probes).select("key", F.lit(0).alias("chunk"), "side", "fp")
    met = dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "side")
    return find_links(met, distance)


def groups(docs: DataFrame, shingle: int = 4, distance: int = 4, mark: Column | None = None) -> DataFrame:
    """doc_id, mark, fp, root (a fingerprint naming the component) and
    component_id (its smallest doc_id) per row of ``docs``."""
    rows = stage(fingerprints(docs, shingle, mark), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "nodes")
    roots = connected_components(links(nodes.select("fp"), distance)) if distance else None
    named = nodes.withColumn("root", F.col("fp"))
    if roots is not None:
        named = nodes.join(roots, nodes.fp == roots.node, "left").select(
            "fp", "smallest", F.coalesce("root", "fp").alias("root")
        )
    named = stage(named, "roots")
    ids = stage(named.groupBy("root").agg(F.min("smallest").alias("component_id")), "component-ids")
    of = stage(named.select("fp", "root").join(ids, "root"), "components")
    return rows.join(of, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id per row of ``docs``."""
    return groups(docs, shingle, distance).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One document of every component, the one with the smallest doc_id
    (then by a hash of all columns; one of identical rows), with the columns
    of ``docs``. Rows are numbered and written, so that whole rows are
    exchanged once, for those that stay."""
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]))
    numbered = stage(
        docs.select(
            row.alias("_row"), F.xxhash64("text", others).alias("_hash"), F.monotonically_increasing_id().alias("_number")
        ), "numbered",
    )
    found = groups(
        numbered.select("_row.doc_id", "_row.text", "_hash", "_number"), shingle, distance, F.struct("_hash", "_number")
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    best = stage(
        found.groupBy("root").agg(F.min(order).alias("b")).select(F.col("b.mark._number").alias("_number")),
        "kept-documents",
    )
    return numbered.join(best, "_number", "left_semi").select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])
