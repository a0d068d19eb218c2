"""Quality rules: plain text rules, and an n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed word unigrams and bigrams:
the *trusted target* (texts labelled good) and the *raw corpus* (every
document). A document's ratio is the sum of log(target / raw) over its
n-grams, divided by their number; documents below a fixed threshold go. Log
ratios are rounded to whole millionths, so the sum does not depend on order
and a rerun decides every document alike.

Native throughout: n-grams are counted with partial aggregation over
2 * BUCKETS groups, and the table of log ratios (of that fixed size) becomes a
literal of the scoring expression. Raw counts cover all documents, the target
all documents labelled good. Their ids meet the documents in a merge join: texts
move once by doc_id, about as many bytes as the input at any size (a broadcast of
the ids, taken while they are small, would grow with the labels).

Defined cases: null and empty texts have no words and fail the base rules; a
null doc_id is scored like any other; repeated rows are scored each; without
labels or documents every log ratio is 0, and an empty table gives no rows; very long texts are counted whole; a
ratio at the threshold is kept; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trickle.llm.common import SPACE_CHARS
from trickle.llm.lets import let, word_array

BUCKETS = 8192
# A document is kept if its log ratio per n-gram is at least this.
THRESHOLD = -0.1
SMOOTHING = 1.0
UNIT = 1_000_000

# Base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c))
    return text


def pair_hashes(hashes: Column, apart: int) -> Column:
    """Hash of each element with the one ``apart`` later; as long as
    ``hashes`` (its last ``apart`` elements mean nothing)."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + apart)))


def first(array: Column, count: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(F.lit(0), count))


def repeated_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""

    def cover(ordered: Column) -> Column:
        again = F.filter(
            ordered,
            lambda x, i: (x.h == F.get(ordered, i + 1).h)
            | (F.coalesce(x.h == F.get(ordered, i - 1).h, F.lit(False))),
        )
        at = F.sort_array(F.transform(again, lambda x: x.i))
        return F.aggregate(
            at,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("words")),
            lambda acc, p: F.struct(
                p.alias("last"),
                (acc.words + F.least(F.lit(WINDOW), p - acc.last)).alias("words"),
            ),
            lambda acc: acc.words,
        )

    def counted(w: Column) -> Column:
        numbered = F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            let(F.sort_array(numbered), cover)
        )

    return let(windows, counted)


def gram_buckets(words: Column, pairs: Column) -> Column:
    """Bucket of every unigram (below BUCKETS) and bigram (above)."""
    return F.concat(
        F.transform(words, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")),
        F.transform(
            first(pairs, F.size(words) - 1),
            lambda h: (F.pmod(h, F.lit(BUCKETS)) + BUCKETS).cast("int"),
        ),
    )


def hashed_words(text: Column) -> Column:
    return F.transform(word_array(text), lambda w: F.xxhash64(w))


def marked_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and text of every document, ``_good`` = 1 where labelled good."""
    good = labels.where("quality = 1").select("doc_id").where("doc_id IS NOT NULL").distinct()
    trusted = good.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_good")).hint("merge")
    return docs.select("doc_id", "text").join(trusted, F.col("doc_id") == F.col("_id"), "left")


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[int]:
    """log(target / raw) of each bucket, in millionths."""
    grams = let(hashed_words(F.col("text")), lambda h: gram_buckets(h, pair_hashes(h, 1)))
    counts = (
        marked_good(docs, labels).select("_good", F.explode(grams).alias("b"))
        .groupBy("b")
        .agg(F.count("*").alias("raw"), F.count("_good").alias("target"))
        .collect()  # 2 * BUCKETS rows at most
    )
    raw, target = [SMOOTHING] * (2 * BUCKETS), [SMOOTHING] * (2 * BUCKETS)
    for r in counts:
        raw[r.b] += r.raw
        target[r.b] += r.target
    # smooth the target with the raw shares, so that unseen n-grams weigh little
    all_raw, all_target = math.fsum(raw), math.fsum(target)
    return [
        round(UNIT * (math.log(t / all_target) - math.log(r / all_raw)))
        for r, t in zip(raw, target)
    ]


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, the log ratio per n-gram and the verdict of every row."""
    table = F.split(F.lit(",".join(map(str, log_ratios(docs, labels)))), ",").cast("array<int>")

    text = F.coalesce(F.col("text"), F.lit(""))
    chars = F.length(without(text, SPACE_CHARS))
    lines = F.filter(
        F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != ""
    )
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def measured(h: Column) -> Column:
        return let(
            pair_hashes(h, 1),
            lambda h2: F.struct(
                F.size(h).cast("long").alias("n_words"),
                let(
                    pair_hashes(h2, 2),
                    lambda h4: repeated_words(first(pair_hashes(h4, 4), F.size(h) - (WINDOW - 1))),
                ).cast("long").alias("n_repeat_words"),
                F.aggregate(
                    gram_buckets(h, h2), F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b)
                ).alias("ratio_sum"),
            ),
        )

    scored = docs.select(
        "doc_id",
        chars.cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
        let(hashed_words(text), measured).alias("m"),
    ).select("doc_id", "m.*", "word_chars", "n_symbols", "n_dup_lines")
    grams = F.greatest(F.lit(1), 2 * F.col("n_words") - 1)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    ratio = F.col("ratio_sum") / (grams * UNIT)
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("ratio_sum") >= threshold * UNIT * grams)).alias("kept"),
        ratio.alias("log_ratio"),
    )
