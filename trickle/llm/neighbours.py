"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a vector of terms: hashed byte trigrams (square roots of their
shares) and a few pseudo-terms for style (repeated words, capitals, marks,
length). Latent-semantic analysis of the labelled sample (centred, truncated
singular values) gives DIMENSIONS directions. The labelled vectors, of unit
length, are broadcast: SAMPLE rows by DIMENSIONS, whatever the corpus. For
every document the cosines to all of them are computed exactly, block by
block, and the NEIGHBOURS closest vote with their similarity as weight. All
that are as close as the last of these (to five decimals) vote too, so that
ties and the rounding of a block's products decide nothing.

The share of votes becomes a probability by a logistic curve fitted on the
sample, each sample text voted on by the others.

Learned from a bounded sample of labelled documents (SAMPLE, by hash of
doc_id). Every document is scored, whole.

Defined cases: null and empty texts are one vector (no trigrams); very long
texts are read whole, in pieces of an Arrow batch of some megabytes or one
text; null and repeated ids are scored row by row, and an id of several labels
is of the larger one; an empty table gives an empty result; without labelled
documents every score is 0.5, with one label only it is that label; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trickle.llm.common import held_out, slices, stage
from trickle.llm.samples import fit_logistic, labelled_sample

SAMPLE = 6000
TERMS = 4096
DIMENSIONS = 64
NEIGHBOURS = 25
BLOCK = 256
LIMIT = 0.3
STYLES = 12


def _style(text: bytes, data: np.ndarray) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = max(1, len(data))
    counts = np.bincount(data, minlength=256)
    return [
        same,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        counts[65:91].sum() / size,
        counts[[35, 36, 37, 38, 42, 60, 62, 124]].sum() / size,
        counts[33] / size,
        counts[48:58].sum() / size,
        counts[10] / size,
        float(len(words) == 0),
        float(len(words) < 5),
        float(len(words) < 20),
        min(1.0, size / n / 20),
    ]


def term_vectors(texts: list[bytes | None]) -> np.ndarray:
    """One row per text: square roots of trigram shares, then style terms, all
    of half precision."""
    out = np.zeros((len(texts), TERMS + STYLES), np.float32)
    for i, text in enumerate(texts):
        data = np.frombuffer(text or b"", np.uint8)
        if len(data) >= 3:
            wide = data.astype(np.uint32)
            code = (wide[:-2] * 0x9E3779B1 + wide[1:-1] * 0x85EBCA6B + wide[2:] * 0xC2B2AE35) >> np.uint32(20)
            out[i, :TERMS] = np.sqrt(np.bincount(code, minlength=TERMS) / len(code))
        out[i, TERMS:] = _style(text or b"", data)
    # as the sample's are kept, so that equal texts are at one place
    return out.astype(np.float16).astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))


@dataclass(frozen=True)
class Model:
    center: np.ndarray
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled, of unit length
    labels: np.ndarray
    slope: float
    constant: float

    def place(self, terms: np.ndarray) -> np.ndarray:
        return unit((terms - self.center) @ self.axes)

    def votes(self, vectors: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Share of the votes for label 1; ``own``: labelled rows left out."""
        cosine = vectors @ self.vectors.T
        if own is not None:
            cosine[np.arange(len(own)), own] = -2
        k = min(NEIGHBOURS, cosine.shape[1])
        close = np.round(cosine, 5)
        last = -np.partition(-close, k - 1, axis=1)[:, k - 1 : k]
        weight = np.where(close >= last, np.maximum(np.float32(1e-6), cosine), np.float32(0))
        return (weight @ self.labels) / weight.sum(axis=1)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 1 / (1 + np.exp(-self.constant)))
        out = [
            self.votes(self.place(term_vectors(texts[a : a + BLOCK])))
            for a in range(0, len(texts), BLOCK)
        ]
        z = self.slope * tempered(np.concatenate(out).astype(float)) + self.constant
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def leading_axes(x: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """The ``count`` right singular vectors of ``x`` with the largest values,
    by subspace iteration from a fixed start."""
    wide = min(count + 16, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], wide)).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    values, rotation = np.linalg.eigh((x @ q).T @ (x @ q))
    return (q @ rotation[:, ::-1])[:, :count].astype(np.float32)


def tempered(share: np.ndarray) -> np.ndarray:
    """Log-odds of a share of votes, kept finite."""
    return np.log((share + 0.02) / (1.02 - share))


def learn(docs: DataFrame, labels: DataFrame, train: Column) -> Model:
    sample = labelled_sample(docs, labels, "quality", train, SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                terms = term_vectors(b.column("text").to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t.tobytes() for t in terms], pa.binary()), b.column("label")],
                    ["terms", "label"],
                )

    made = stage(
        sample.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, "terms binary, label int"),
        "quality-sample",
    )
    rows = made.orderBy(F.xxhash64("terms"), "label").limit(SAMPLE).collect()  # SAMPLE at most
    y = np.array([r.label == 1 for r in rows], np.float32)
    nothing = np.zeros((0, 0), np.float32)
    if not len(rows) or y.min() == y.max():
        constant = 0.0 if not len(rows) else 30.0 * (1 if y[0] else -1)
        return Model(nothing, nothing, nothing, y[:0], 0.0, constant)
    x = np.empty((len(rows), TERMS + STYLES), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r.terms, np.float16)
    center = x.mean(axis=0)
    x -= center
    axes = leading_axes(x, DIMENSIONS)
    placed = unit(x @ axes)  # x is centred; no second copy of it on the driver
    del x
    model = Model(center, axes, placed, y, 1.0, 0.0)
    share = np.concatenate(
        [
            model.votes(placed[a : a + BLOCK], np.arange(a, min(a + BLOCK, len(placed))))
            for a in range(0, len(placed), BLOCK)
        ]
    )
    slope, constant = fit_logistic(tempered(share)[:, None], y)
    return Model(center, axes, placed, y, max(0.0, float(slope)), float(constant))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    out = held_out(F.col("doc_id"), 5, 0)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, ~out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                s = model.scores(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()),
                        pa.array((s >= LIMIT).astype(np.int32)),
                    ],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"), out.alias("held_out"))
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
