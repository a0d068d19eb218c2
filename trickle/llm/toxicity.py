"""Toxic passages by maximum-scoring segments.

A word's score is the log-odds of standing in a toxic document. Its counts
are smoothed with a Dirichlet prior that carries the counts of its first
letters, these with one that carries the share of all words. CAUTION standard
errors are taken off positive log-odds (rare words of a few toxic texts are
mostly chance); what is negative, or comes to nothing by that, costs its own
log-odds, DRIFT at least. Words not seen have the score of their first letters.
The scan runs over every word of a text, at its full score however often it
stands: repeats count once per training text in the counts, and as often as
they stand in the rate l below.

Segment scores are calibrated by extreme-value theory: in clean texts of n
words the best segment has a Gumbel law, P(S > s) = 1 - exp(-K n exp(-l s)).
The rate l is the root of E[exp(l * word score)] = 1 over the words of clean
training texts, K follows from the median of their best segments. A segment's
significance is l S - ln(K n); a text's evidence is the sum over its
significant segments, and a logistic curve turns it into a probability.

Learned from a bounded sample of labelled texts (TRAIN_DOCS, by hash of doc_id
and text; half of either label where there are enough, of which the logistic
curve's constant is put right afterwards). Of near copies (0.8 of their
five-word shingles alike, verified) one counts, lest their chance words look
meaningful; texts that only share lines count each. Counts
are sums, so the model does not depend on the order of rows. The model keeps
at most VOCABULARY words, and as many first letters, on either side of the
share of all words; others have the score of their first letters. All
documents are scored, whole.

Defined cases: null, empty and wordless texts have no evidence; very long
texts are scanned whole, in time linear in their words; segments with equal
sums stay as the scan finds them, the first longest; an empty table gives an
empty result; null and repeated ids are scored row by row; without toxic or without clean training
documents every score is the share of toxic ones (0 without any); other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trickle.llm.common import held_out, slices, stage
from trickle.llm.samples import balanced_sample, fit_logistic

TRAIN_DOCS = 20_000
VOCABULARY = 50_000
STEM = 4
# Near copies among the training texts.
BANDS, SKETCH, SIMILAR = 4, 64, 0.8
PRIOR = 5.0
CAUTION = 3.0
DRIFT = 0.1
STEPS = 64
# Segments count from this significance on: a clean text has one by chance
# once in about exp(3) = 20 times.
SIGNIFICANT = 3.0
# More evidence than this counts as this much.
TOP = 20.0
LIMIT = 0.7

LETTERS = re.compile(r"[^\W\d_]+")
LETTERS_DIGITS = re.compile(r"\w+")


@dataclass(frozen=True)
class Words:
    """Scores of words and, for words not seen, of their first letters
    (DRIFT for those not seen either)."""

    word: dict[str, float]
    stem: dict[str, float]

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        """Number of words, and (place, score) of every one."""
        words = LETTERS.findall(text.lower()) if text else []
        stem, word = self.stem, self.word
        out = []
        for i, w in enumerate(words):
            s = word.get(w)
            out.append((i, stem.get(w[:STEM], -DRIFT) if s is None else s))
        return len(words), out


def segments(hits: list[tuple[int, float]]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last place), in order.

    The scan of Ruzzo and Tompa over the words given, with scores of either
    sign; places left out cost DRIFT each. A candidate holds the sums before and at its end;
    a new one is joined to the last candidate that starts lower, if it ends
    higher."""
    kept: list[tuple[float, float, int, int]] = []  # (sum before, sum at end, first, last)
    total, last = 0.0, -1
    for place, score in hits:
        before = total - DRIFT * (place - last - 1)
        total, last = before + score, place
        if score <= 0:
            continue
        left, right, first = before, total, place
        while True:
            at = len(kept) - 1
            while at >= 0 and kept[at][0] >= left:
                at -= 1
            if at < 0 or kept[at][1] >= right:
                kept.append((left, right, first, place))
                break
            left, first = kept[at][0], kept[at][2]
            del kept[at:]
    return [(b - a, i, j) for a, b, i, j in kept]


@dataclass(frozen=True)
class Model:
    words: Words
    scale: float  # l
    log_k: float  # ln K
    slope: float
    constant: float

    def evidence(self, n: int, scores: list[float]) -> float:
        base = self.log_k + math.log(max(1, n))
        return sum(v for v in (self.scale * s - base for s in scores) if v > SIGNIFICANT)

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Significant passages: first and last word, significance."""
        n, hits = self.words.hits(text)
        base = self.log_k + math.log(max(1, n))
        found = ((i, j, self.scale * s - base) for s, i, j in segments(hits))
        return [x for x in found if x[2] > SIGNIFICANT]

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score and significant passages."""
        found = self.passages(text)
        total = min(TOP, sum(v for _, _, v in found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * total + self.constant)))), found

    def score(self, text: str | None) -> float:
        return self.judge(text)[0]


def shrunk(toxic: np.ndarray, clean: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """Posterior share of toxic occurrences, with PRIOR of them at ``share``."""
    return (toxic + PRIOR * share) / (toxic + clean + PRIOR)


def scores_of(post: np.ndarray, toxic: np.ndarray, clean: np.ndarray, neutral: float) -> np.ndarray:
    """Log-odds against ``neutral``: where positive, less CAUTION standard
    errors (those of the counts, with PRIOR neutral occurrences); what that
    leaves nothing of, and the negative, is -DRIFT at most."""
    odds = np.log(post / (1 - post)) - math.log(neutral / (1 - neutral))
    error = np.sqrt(1 / (toxic + PRIOR * neutral) + 1 / (clean + PRIOR * (1 - neutral)))
    sure = odds - CAUTION * error
    return np.where(sure > 0, sure, np.minimum(odds, -DRIFT))


def _word_counts(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many training texts each word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                count: tuple[Counter, Counter] = (Counter(), Counter())
                for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                    count[label == 1].update(set(LETTERS.findall(text.lower()) if text else ()))
                words = list(count[0] | count[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(words, pa.string()),
                        pa.array([count[1][w] for w in words], pa.int64()),
                        pa.array([count[0][w] for w in words], pa.int64()),
                    ],
                    ["word", "toxic", "clean"],
                )

    counted = sample.mapInArrow(run, "word string, toxic long, clean long")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def without_copies(sample: DataFrame) -> DataFrame:
    """``sample`` without texts of which another one with the same label is a
    near copy: five-word shingles SIMILAR alike or more. Texts that share one
    of BANDS pairs of least hashes are compared with the first of them, by
    their SKETCH least shingle hashes (all, if fewer)."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.random.default_rng(7).integers(0, 1 << 63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b in batches:
            ids, sketches, bands = [], [], []
            for text in b.column("text").to_pylist():
                words = LETTERS_DIGITS.findall(text.lower()) if text else []
                grams = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
                h = np.array([xxh64_intdigest(g) for g in grams], np.uint64)
                least = [(h * m).min() for m in odd]
                ids.append(xxh64_intdigest(text or "") >> 1)
                sketches.append(np.sort(h >> np.uint64(1)).astype(np.int64)[:SKETCH])
                bands.append([f"{j} {least[2 * j]} {least[2 * j + 1]}" for j in range(BANDS)])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(ids, pa.int64()), pa.array(sketches, pa.list_(pa.int64())),
                 pa.array(bands, pa.list_(pa.string()))],
                ["text", "label", "id", "sketch", "bands"],
            )

    kind = "text string, label int, id long, sketch array<bigint>, bands array<string>"
    keyed = stage(sample.select("text", "label").mapInArrow(run, kind), "sketches")
    member = keyed.select("label", "id", "sketch", F.explode("bands").alias("band"))
    first = member.groupBy("label", "band").agg(F.min(F.struct("id", "sketch")).alias("first"))
    least = F.slice(F.array_sort(F.array_union("sketch", "first.sketch")), 1, SKETCH)
    both = F.array_intersect(F.array_intersect("sketch", "first.sketch"), least)
    gone = (
        member.join(first, ["label", "band"]).where("id <> first.id")
        .where(F.size(both) >= SIMILAR * F.size(least)).select("label", "id").distinct()
    )
    return keyed.join(gone, ["label", "id"], "left_anti").select("text", "label")


def learn_words(sample: DataFrame) -> Words:
    counts = stage(_word_counts(without_copies(sample)), "toxic-words")
    totals = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    toxic, clean = totals.t or 0, totals.c or 0
    if not toxic or not clean:
        return Words({}, {})
    neutral = toxic / (toxic + clean)

    def leading(table: DataFrame, key: str, t: str, c: str) -> dict[str, np.ndarray]:
        """At most VOCABULARY rows above ``neutral`` and as many below it,
        those of the largest counts."""
        above = F.col(t) / (F.col(t) + F.col(c)) > neutral
        rows = table.where(above).orderBy(F.desc(t), key).limit(VOCABULARY).collect()
        rows += table.where(~above).orderBy(F.desc(c), key).limit(VOCABULARY).collect()
        return {
            "key": [r[key] for r in rows],
            "toxic": np.array([r[t] for r in rows], float),
            "clean": np.array([r[c] for r in rows], float),
        }

    stems = counts.groupBy(F.substring("word", 1, STEM).alias("stem")).agg(
        F.sum("toxic").alias("st"), F.sum("clean").alias("sc")
    )
    found = leading(stems, "stem", "st", "sc")
    share = shrunk(found["toxic"], found["clean"], neutral)
    prior = dict(zip(found["key"], share.tolist()))
    stem = dict(zip(found["key"], scores_of(share, found["toxic"], found["clean"], neutral).tolist()))
    found = leading(counts, "word", "toxic", "clean")
    share = np.array([prior.get(w[:STEM], neutral) for w in found["key"]], float)
    post = shrunk(found["toxic"], found["clean"], share)
    scores = scores_of(post, found["toxic"], found["clean"], neutral)
    return Words(dict(zip(found["key"], scores.tolist())), stem)


def learn(docs: DataFrame, labels: DataFrame, train: Column) -> Model:
    sample, shift = balanced_sample(docs, labels, "toxic", train, TRAIN_DOCS)
    sample = stage(sample, "toxic-sample")
    words = learn_words(sample)

    def steps(hits: list[tuple[int, float]]) -> list[tuple[int, int]]:
        """Word scores in steps of 1/STEPS, with their numbers."""
        return list(Counter(round(s * STEPS) for _, s in hits).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                found = [words.hits(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("label"),
                        pa.array([n for n, _ in found], pa.int64()),
                        pa.array([[s for s, _, _ in segments(h)] for _, h in found], pa.list_(pa.float64())),
                        pa.array([steps(h) for _, h in found], pa.map_(pa.int32(), pa.int64())),
                    ],
                    ["label", "n", "scores", "steps"],
                )

    scored = stage(
        sample.mapInArrow(run, "label int, n long, scores array<double>, steps map<int,bigint>"), "toxic-scores"
    )
    # TRAIN_DOCS rows at most; in one order, so that the fit's sums agree
    rows = sorted(scored.select("label", "n", "scores").collect())
    label = np.array([r.label == 1 for r in rows], float)
    if not len(rows) or label.min() == label.max():
        share = label.mean() if len(rows) else 0.0
        return Model(Words({}, {}), 1.0, 0.0, 0.0, 30.0 if share else -30.0)
    clean = scored.where("label <> 1")
    n_words = clean.agg(F.sum("n")).first()[0] or 0
    hits = (  # a bounded table
        clean.select(F.explode("steps").alias("s", "n")).groupBy("s").agg(F.sum("n").alias("n")).collect()
    )
    scale = tail_rate([(r.s / STEPS, r.n) for r in hits], n_words)
    best = np.array([max(r.scores, default=0.0) for r in rows if r.label != 1])
    size = np.log(np.array([max(1, r.n) for r in rows if r.label != 1], float))
    # the median of a Gumbel law is at ln(K n) - ln(ln 2)
    log_k = float(np.median(scale * best - size)) + math.log(math.log(2))
    model = Model(words, scale, log_k, 0.0, 0.0)
    evidence = np.array([model.evidence(r.n, r.scores) for r in rows])
    slope, constant = fit_logistic(np.minimum(evidence, TOP)[:, None], label)
    return Model(words, scale, log_k, max(0.0, float(slope)), float(constant) - shift)


def tail_rate(hits: list[tuple[float, int]], n_words: int) -> float:
    """The positive l with E[exp(l * score)] = 1, by bisection; between 0.05
    and 5."""
    if not n_words:
        return 1.0
    share = [(s, n / n_words) for s, n in hits]
    rest = max(0.0, 1 - sum(q for _, q in share))

    def excess(rate: float) -> float:
        return rest * math.exp(-rate * DRIFT) + sum(q * math.exp(rate * s) for s, q in share) - 1

    low, high = 0.05, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if excess(mid) > 0 else (mid, high)
    return (low + high) / 2


def not_held_out() -> Column:
    return ~held_out(F.col("doc_id"), 3, 1)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the significant passages
    (first and last word, significance) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, not_held_out()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                texts = b.column("text").to_pylist()
                judged = [model.judge(t) for t in texts]
                scores = [s for s, _ in judged]
                found = [[{"first": i, "last": j, "significance": v} for i, j, v in f] for _, f in judged]
                kind = pa.list_(
                    pa.struct([("first", pa.int32()), ("last", pa.int32()), ("significance", pa.float64())])
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()),
                        pa.array([int(s >= LIMIT) for s in scores], pa.int32()), pa.array(found, kind),
                    ],
                    ["doc_id", "held_out", "score", "predicted", "passages"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out(F.col("doc_id"), 3, 1).alias("held_out")).mapInArrow(
        run,
        f"doc_id {kind}, held_out boolean, score double, predicted int, "
        "passages array<struct<first:int,last:int,significance:double>>",
    )


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(
        learn(docs.select("doc_id", "text"), labels, not_held_out())
    )
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            keep = [model.score(t.as_py()) < LIMIT for t in whole.column(at)]
            yield whole.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
