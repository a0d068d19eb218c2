"""Language identification with interpolated Kneser-Ney character models.

One trigram model per language, over the lower-cased letters of a text and
one boundary character for everything between them. Every order is
interpolated with the next lower one, whose counts are numbers of different
characters seen before (Kneser-Ney), with one discount per order and language;
the lowest order with the even distribution over all letters and the boundary.
The n-grams of all languages stand in sorted arrays of 64-bit codes with one
column of log-probabilities (or back-off weights) per language; the different
n-grams of a batch are looked up by binary search, once each.

A text gets the language of the lowest cross-entropy per character. The score
weighs the languages' likelihoods (CONFIDENT characters at most) and is halved
when the cross-entropy is above what TAIL of that language's own training
texts exceed: the text is rejected as unlike any learned language, though the
closest is still named.

Learned from every document that may be learned from, whole: the trigrams are
counted in the tasks and summed by a shuffle, and what reaches the driver is one
number per different trigram and language (it grows like an alphabet's trigrams,
not like the texts). Every document is scored once, whole; the limits come from
the scores of all training texts.

Defined cases: a null text, or one without a letter, is "und" with score 0;
without learned languages every text is "und"; ties go to the first language
in code point order; null and repeated ids are scored row by row; a very long
text is scored whole, in a batch of its own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trickle.llm.common import held_out, slices, stage

PER_LANGUAGE = math.inf  # training documents of a language: all of them
CONFIDENT = 50
TAIL = 0.005
UNKNOWN = "und"
HELD = 1 << 21  # trigram counts a task holds before it passes them on
# A text may differ this much more than its language's training texts did.
MARGIN = 1.15

_letters: np.ndarray | None = None
_alphabet = 0


def letter_table() -> np.ndarray:
    """Which code points are letters; made once per process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def alphabet_size() -> int:
    """All letters and the boundary."""
    global _alphabet
    if not _alphabet:
        _alphabet = int(letter_table().sum()) + 1
    return _alphabet


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (0 for a boundary: two before each text, one
    for each stretch without letters) and the number of the text of each."""
    table = letter_table()
    parts, owner = [], []
    for i, text in enumerate(texts):
        c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        c = np.concatenate([[0, 0], np.where(table[c], c, 0), [0]])
        keep = np.ones(len(c), bool)
        keep[2:] = (c[2:] != 0) | (c[1:-1] != 0)
        parts.append(c[keep])
        owner.append(np.full(len(parts[-1]), i))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(parts), np.concatenate(owner)


def trigrams(chars: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of the trigram that ends at each character but a text's first
    two, and the text."""
    inside = owner[2:] == owner[:-2]
    code = (chars[:-2] << 42) | (chars[1:-1] << 21) | chars[2:]
    return code[inside], owner[2:][inside]


def distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different codes and the place of each code among them."""
    return np.unique(code, return_inverse=True)


@dataclass(frozen=True)
class Order:
    """n-grams of one order: sorted codes, a row of values per code."""

    codes: np.ndarray
    values: np.ndarray

    def find(self, asked: np.ndarray, missing: float) -> np.ndarray:
        out = np.full((len(asked), self.values.shape[1]), missing)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, asked), len(self.codes) - 1)
            hit = self.codes[at] == asked
            out[hit] = self.values[at[hit]]
        return out


BIGRAM = (1 << 42) - 1
LAST = (1 << 21) - 1


@dataclass(frozen=True)
class Model:
    languages: list[str]
    tri: Order  # discounted probabilities of trigrams
    tri_weight: Order  # weight of the lower order after a two-character context
    bi: Order
    bi_weight: Order
    uni: Order
    uni_weight: np.ndarray  # weight of the even distribution

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        """Per trigram and language."""
        low = self.uni.find(code & LAST, 0.0) + self.uni_weight / alphabet_size()
        mid = self.bi.find(code & BIGRAM, 0.0) + self.bi_weight.find((code >> 21) & LAST, 1.0) * low
        high = self.tri.find(code, 0.0) + self.tri_weight.find(code >> 21, 1.0) * mid
        return np.log(high)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy (nats per character) of each text and language, and
        the number of characters that are letters."""
        chars, owner = characters(texts)
        code, of = trigrams(chars, owner)
        found, place = distinct(code)
        table = self.log_probabilities(found)
        n = np.maximum(1, np.bincount(of, minlength=len(texts)))
        sums = np.stack(
            [np.bincount(of, weights=table[place, k], minlength=len(texts)) for k in range(len(self.languages))],
            axis=1,
        )
        return -sums / n[:, None], np.bincount(owner, weights=chars != 0, minlength=len(texts))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Closest language, confidence in it, and the cross-entropies."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        h, letters = self.entropies(texts)
        best = h.argmin(axis=1)
        lowest = h[np.arange(len(h)), best]
        weight = np.exp(-(h - lowest[:, None]) * np.minimum(CONFIDENT, letters + 1)[:, None])
        some = letters > 0
        names = [self.languages[b] if s else UNKNOWN for b, s in zip(best, some)]
        return names, np.where(some, 1 / weight.sum(axis=1), 0.0), h


def _discounted(codes: np.ndarray, counts: np.ndarray, shift: int) -> tuple[np.ndarray, Order]:
    """Discounted probabilities of n-grams in their contexts (the code
    without its last character), and the contexts' weights for the lower
    order. ``counts``: a column per language."""
    context = codes >> shift
    contexts, place = np.unique(context, return_inverse=True)
    one = (counts == 1).sum(axis=0)
    two = (counts == 2).sum(axis=0)
    discount = np.clip(np.where(one > 0, one / np.maximum(1, one + 2 * two), 0.5), 0.1, 0.9)
    total = np.zeros((len(contexts), counts.shape[1]))
    kinds = np.zeros_like(total)
    np.add.at(total, place, counts)
    np.add.at(kinds, place, counts > 0)
    known = np.maximum(1, total)
    p = np.maximum(0, counts - discount) / known[place]
    weight = np.where(total > 0, discount * kinds / known, 1.0)
    return p, Order(contexts, weight)


def _merged(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept, place = np.unique(codes, return_inverse=True)
    out = np.zeros((len(kept), values.shape[1]))
    np.add.at(out, place, values)
    return kept, out


def estimate(languages: list[str], codes: np.ndarray, counts: np.ndarray) -> Model:
    """Model from trigram counts (sorted codes, a column per language)."""
    p3, w3 = _discounted(codes, counts, 21)
    bi_codes, bi_counts = _merged(codes & BIGRAM, counts > 0)
    p2, w2 = _discounted(bi_codes, bi_counts, 21)
    uni_codes, uni_counts = _merged(bi_codes & LAST, bi_counts > 0)
    p1, w1 = _discounted(uni_codes, uni_counts, 21)  # one context: none
    whole = w1.values[0] if len(w1.codes) else np.ones(len(languages))
    return Model(languages, Order(codes, p3), w3, Order(bi_codes, p2), w2, Order(uni_codes, p1), whole)


def _summed(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes of all pieces and the sums of their counts."""
    codes, place = np.unique(np.concatenate([c for c, _ in pieces]), return_inverse=True)
    return codes, np.bincount(place, np.concatenate([n for _, n in pieces]), len(codes)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, code, n: the trigrams of a task's texts, added up as far as
    HELD codes are at hand."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, pieces in held.items():
            codes, n = _summed(pieces)
            for at in range(0, len(codes), 1 << 16):
                some = codes[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[at : at + (1 << 16)])],
                    ["lang", "code", "n"],
                )
        held.clear()

    size = 0
    for whole in batches:
        for b in slices(whole, "text", 4 << 20):
            texts, langs = b.column("text").to_pylist(), np.array(b.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs):
                chars, owner = characters([t for t, x in zip(texts, langs) if x == lang])
                held.setdefault(lang, []).append(np.unique(trigrams(chars, owner)[0], return_counts=True))
                size += len(held[lang][-1][0])
            if size > HELD:
                held.update({lang: [_summed(pieces)] for lang, pieces in held.items()})
                size = sum(len(pieces[0][0]) for pieces in held.values())
                if size > HELD // 2:
                    yield from out()
                    size = 0
    yield from out()


def training(docs: DataFrame) -> Column:
    """Rows to learn from: not held out, with a text and a language."""
    return docs["lang"].isNotNull() & docs["text"].isNotNull() & ~held_out(docs["doc_id"], 4, 2)


def learn(docs: DataFrame) -> Model:
    """The model of all training rows."""
    train = docs.where(training(docs)).select("text", "lang")
    languages = sorted(r.lang for r in train.select("lang").distinct().collect())
    if not languages:
        empty = Order(np.empty(0, np.int64), np.empty((0, 0)))
        return Model([], empty, empty, empty, empty, empty, np.empty(0))
    rows = (
        train.mapInArrow(_counted, "lang string, code long, n long")
        .groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    )  # different trigrams of each language
    codes, place = np.unique(rows.column("code").to_numpy(), return_inverse=True)
    counts = np.zeros((len(codes), len(languages)))
    of = pc.index_in(rows.column("lang"), pa.array(languages, pa.string())).to_numpy()
    counts[place, of] = rows.column("n").to_numpy()
    return estimate(languages, codes, counts)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        number = {lang: i for i, lang in enumerate(model.languages)}
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                names, confidence, h = model.predict(b.column("text").to_pylist())
                at = [(i, number.get(x)) for i, x in enumerate(names)]
                own = [(i, number.get(x)) for i, x in enumerate(b.column("learned").to_pylist())]
                lowest, spread = ([None if k is None else h[i, k] for i, k in of] for of in (at, own))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()),
                        pa.array(confidence, pa.float64()), pa.array(lowest, pa.float64()),
                        b.column("learned"), pa.array(spread, pa.float64()),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score", "lowest", "learned", "spread"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stage(
        docs.select(
            "doc_id", "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"),
            F.when(training(docs), F.col("lang")).alias("learned"),
        ).mapInArrow(
            run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, lowest double, "
            "learned string, spread double"
        ),
        "language-scores",
    )
    # one row per language: the cross-entropy beyond which a text is rejected
    limits = scored.where("learned IS NOT NULL").groupBy(F.col("learned").alias("_lang")).agg(
        (MARGIN * F.percentile_approx("spread", 1 - TAIL)).alias("_limit"))
    rejected = F.coalesce(F.col("lowest") > F.col("_limit"), F.lit(False))
    return scored.join(F.broadcast(limits), F.col("lang_pred") == F.col("_lang"), "left").select(
        "doc_id", "held_out", "lang_pred", F.when(rejected, F.col("score") / 2).otherwise(F.col("score")).alias("score"),
        rejected.alias("rejected"),
    )
