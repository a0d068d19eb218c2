"""Learned operators: held-out accuracy, and the defined cases."""

from __future__ import annotations

import math
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import llm_data as data  # noqa: E402

from trickle.llm import language, neighbours, samples, toxicity  # noqa: E402


def tables(spark, sf):
    return (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))


def test_toxicity_on_held_out(spark):
    docs, labels = tables(spark, data.SF01)
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = [r.predicted for r in got if r.toxic == 1]
    false = [r.predicted for r in got if r.toxic == 0]
    assert np.mean(hit) > 0.8 and np.mean(false) < 0.03
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    plain = docs.select("doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    want = {r.doc_id for r in plain.where("h % 3 = 1").collect()}
    assert {r.doc_id for r in got} <= want


def test_toxicity_cases(spark):
    docs, (_, labels) = data.documents(spark), tables(spark, data.SF001)
    got = toxicity.score(docs, labels)
    assert got.count() == docs.count()
    assert got.where("score IS NULL OR score < 0 OR score > 1 OR held_out IS NULL").count() == 0
    assert toxicity.score(data.nothing(spark), labels).collect() == []
    none = toxicity.score(docs, labels.limit(0))
    assert none.where("predicted = 1").count() == 0
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == got.where("predicted = 0").count()


def test_passages_of_every_row(spark, monkeypatch):
    """A passage just above SIGNIFICANT in a text that is not toxic stays."""
    words = toxicity.Words({"bad": 8.0}, {})
    model = toxicity.Model(words, 1.0, -1.0, 0.5, -5.0)
    monkeypatch.setattr(toxicity, "learn", lambda *a: model)
    docs = spark.createDataFrame([(1, "calm " * 30 + "bad"), (2, "calm"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, None).collect()}
    assert got[1].score < 0.5 and got[1].predicted == 0
    assert [(p.first, p.last) for p in got[1].passages] == [(30, 30)]
    assert got[1].passages[0].significance > toxicity.SIGNIFICANT
    assert got[2].passages == [] and got[3].passages == []


def brute_segments(scores):
    """All maximal scoring segments by their definition, on short input."""
    out = []

    def split(a, b):
        best, at = 0.0, None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                s = sum(scores[i:j])
                if s > best + 1e-12:
                    best, at = s, (i, j)
        if at:
            split(a, at[0])
            out.append((round(best, 9), *at))
            split(at[1], b)

    split(0, len(scores))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_segments(seed):
    rnd = np.random.default_rng(seed)
    scores = [float(rnd.uniform(0.05, 0.4)) if rnd.random() < 0.35 else -toxicity.DRIFT for _ in range(30)]
    hits = [(i, s) for i, s in enumerate(scores) if s > 0]
    got = [(round(s, 9), i, j + 1) for s, i, j in toxicity.segments(hits)]
    assert got == brute_segments(scores)


@pytest.mark.parametrize("seed", range(30))
def test_segments_of_scores_of_either_sign(seed):
    rnd = np.random.default_rng(seed)
    scores = [float(x) for x in rnd.uniform(-1, 0.6, 30)]
    got = [(round(s, 9), i, j + 1) for s, i, j in toxicity.segments(list(enumerate(scores)))]
    assert got == brute_segments(scores)


def test_every_word_counts_wherever_it_stands():
    """One passage, again and again in a long text; clean words end it."""
    bad = [f"bad{c}" for c in "abcdef"]
    words = toxicity.Words(dict.fromkeys(bad, 2.0) | {"kind": -5.0}, {"gent": -0.5})
    calm = ["calm"] * 200
    n, hits = words.hits(" ".join((bad + calm) * 5))
    assert n == 5 * 206 and len(hits) == n
    assert [(round(s, 9), i, j) for s, i, j in toxicity.segments(hits)] == [
        (12.0, 206 * k, 206 * k + 5) for k in range(5)
    ]
    _, hits = words.hits("bada badb kind badc gently badd")
    assert [(round(s, 9), i, j) for s, i, j in toxicity.segments(hits)] == [(4.0, 0, 1), (3.5, 3, 5)]
    model = toxicity.Model(words, 1.0, -4.0, 1.0, -3.0)
    assert [(i, j) for i, j, _ in model.passages(" ".join((bad + calm) * 3))] == [(0, 5), (206, 211), (412, 417)]


def test_learned_words_have_scores_of_either_sign(spark):
    texts = [(f"calm river stone {'idiot' if i % 4 == 0 else 'lovely'} w{i}x", int(i % 4 == 0)) for i in range(400)]
    sample = spark.createDataFrame(texts, "text string, label int")
    word = toxicity.learn_words(sample).word
    assert word["idiot"] > 1 and word["lovely"] < -1
    assert word["river"] == -toxicity.DRIFT


def shared_line(n):
    line = "this line stands in all of them and is long enough to be the least shingle of every text"
    return [(i, f"{line} own{'abcdefghij'[i % 10]} {i} {'vile' if i % 5 == 0 else 'kind'}", i) for i in range(n)]


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def plain_toxicity(docs, labels):
    """(score, passages) of every id: the whole operator with dictionaries, by
    definition of the segments. For texts none of which are near copies."""
    words = {i: re.findall(r"[^\W\d_]+", t.lower()) for i, t in docs.items()}
    train = sorted({(docs[i], labels[i]): i for i in docs if i in labels and crc(i, 3) != 1}.values())
    count = {0: Counter(), 1: Counter()}
    for i in train:
        count[labels[i]].update(set(words[i]))
    t, c = sum(count[1].values()), sum(count[0].values())
    even = t / (t + c)
    logit = lambda p: math.log(p / (1 - p))

    def worth(a, b, prior):
        share = (a + 5 * prior) / (a + b + 5)
        odds = logit(share) - logit(even)
        sure = odds - 3 * math.sqrt(1 / (a + 5 * even) + 1 / (b + 5 * (1 - even)))
        return share, (sure if sure > 0 else min(odds, -0.1))

    stems = {0: Counter(), 1: Counter()}
    for y in (0, 1):
        for w, n in count[y].items():
            stems[y][w[:4]] += n
    stem = {s: worth(stems[1][s], stems[0][s], even) for s in stems[0] | stems[1]}
    word = {w: worth(count[1][w], count[0][w], stem[w[:4]][0])[1] for w in count[0] | count[1]}
    scores = {i: [word.get(w, stem.get(w[:4], (0, -0.1))[1]) for w in words[i]] for i in docs}
    found = {i: brute_segments(s) for i, s in scores.items()}

    clean = [i for i in train if labels[i] == 0]
    steps = [round(s * 64) / 64 for i in clean for s in scores[i]]
    low, high = 0.05, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(math.exp(mid * s) for s in steps) > len(steps) else (mid, high)
    rate = (low + high) / 2
    best = [rate * max((s for s, _, _ in found[i]), default=0) - math.log(max(1, len(words[i]))) for i in clean]
    log_k = float(np.median(best)) + math.log(math.log(2))

    def passages(i):
        base = log_k + math.log(max(1, len(words[i])))
        return [(a, b - 1, rate * s - base) for s, a, b in found[i] if rate * s - base > 3]

    evidence = {i: min(20.0, sum(v for _, _, v in passages(i))) for i in docs}
    slope, constant = samples.fit_logistic([[evidence[i]] for i in train], [labels[i] for i in train])
    return {i: (1 / (1 + math.exp(-max(0, slope) * evidence[i] - constant)), passages(i)) for i in docs}


def test_toxicity_against_plain_python(spark):
    rnd = np.random.default_rng(4)
    stem = lambda n: "".join(rnd.choice(list("abcdefgh"), n))
    calm, bad = [stem(6) for _ in range(80)], ["x" + stem(4) for _ in range(6)]
    docs, labels = {}, {}
    for i in range(240):
        text = [str(w) for w in rnd.choice(calm, 36)]
        toxic = int(i % 4 == 0)
        if toxic:
            at = int(rnd.integers(0, 20))
            text[at : at + 6] = [str(w) for w in rnd.choice(bad, 6)]
        if i % 5 == 0:
            text[30] = bad[0]
        docs[i], labels[i] = " ".join(text), toxic
    docs |= {500: docs[0], 501: docs[0], 502: "", 503: "Unseen words, alone. 7"}  # equal texts count once
    labels |= {500: 1, 501: 1}
    want = plain_toxicity(docs, labels)
    got = toxicity.score(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
        spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"),
    ).collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        score, passages = want[r.doc_id]
        assert abs(r.score - score) < 1e-6 and r.held_out == (crc(r.doc_id, 3) == 1)
        assert [(p.first, p.last) for p in r.passages] == [(a, b) for a, b, _ in passages]
        assert np.allclose([p.significance for p in r.passages], [v for _, _, v in passages])
    assert any(r.passages for r in got) and any(not r.passages for r in got)


def plain_quality(docs, labels):
    """Score of every id: trigram by trigram, all singular values, one cosine
    at a time."""

    def terms(text):
        data, out = text.encode(), np.zeros(neighbours.TERMS)
        for a, b, c in zip(data, data[1:], data[2:]):
            out[((a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) % 2**32) >> 20] += 1 / (len(data) - 2)
        style = neighbours._style(data, np.frombuffer(data, np.uint8))
        return np.concatenate([np.sqrt(out), style]).astype(np.float16).astype(float)

    x = {i: terms(t) for i, t in docs.items()}
    train = [i for i in docs if i in labels and crc(i, 5) != 0]
    center = np.mean([x[i] for i in train], axis=0)
    axes = np.linalg.svd(np.array([x[i] for i in train]) - center, full_matrices=False)[2][: neighbours.DIMENSIONS]
    place = {i: (v - center) @ axes.T for i, v in x.items()}
    place = {i: v / max(1e-9, np.linalg.norm(v)) for i, v in place.items()}

    def share(i, known):
        cosine = {j: float(place[i] @ place[j]) for j in known}
        last = sorted((round(c, 5) for c in cosine.values()), reverse=True)[: neighbours.NEIGHBOURS][-1]
        weight = {j: max(1e-6, c) for j, c in cosine.items() if round(c, 5) >= last}
        p = sum(w * labels[j] for j, w in weight.items()) / sum(weight.values())
        return math.log((p + 0.02) / (1.02 - p))

    left_out = [[share(i, [j for j in train if j != i])] for i in train]
    slope, constant = samples.fit_logistic(left_out, [labels[i] for i in train])
    return {i: 1 / (1 + math.exp(-max(0, slope) * share(i, train) - constant)) for i in docs}


def test_quality_against_plain_python(spark):
    docs, labels = tables(spark, data.SF001)
    labels = labels.where("quality IS NOT NULL").orderBy(F.xxhash64("doc_id")).limit(70)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    want = plain_quality(text, {r.doc_id: r.quality for r in labels.collect()})
    got = {r.doc_id: r.score for r in neighbours.score(docs, labels).collect()}
    assert set(got) == set(want)
    off = [abs(got[i] - want[i]) for i in want]
    # single precision may tell a tie from a near tie where the plain version does not
    assert np.mean(np.array(off) < 1e-3) > 0.98 and max(off) < 0.1


def test_ties_of_the_last_neighbour_all_vote():
    known = np.array([[1.0, 0.0]] * 20 + [[0.6, 0.8]] * 30)
    y = np.array([1.0] * 20 + [0.0, 1.0] * 15)
    for order in (np.arange(50), np.arange(50)[::-1]):
        model = neighbours.Model(np.zeros(2), np.eye(2), known[order], y[order], 1.0, 0.0)
        assert abs(model.votes(np.array([[1.0, 0.0]]))[0] - (20 + 15 * 0.6) / (20 + 30 * 0.6)) < 1e-9


def test_texts_that_share_a_line_all_count(spark):
    from trickle.llm.samples import balanced_sample

    rows = shared_line(2000)
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, n int")  # some rows twice
    labels = docs.selectExpr("doc_id", "int(doc_id % 5 = 0) AS toxic").distinct()
    everything = F.lit(True)
    got, shift = balanced_sample(docs, labels, "toxic", everything, 5000)
    assert got.count() == 2000 and shift == 0
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {0: 1600, 1: 400}
    got, shift = balanced_sample(docs, labels, "toxic", everything, 1000)
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {0: 600, 1: 400}
    assert abs(shift - (math.log(400 / 600) - math.log(400 / 1600))) < 1e-12
    got, _ = balanced_sample(docs, labels, "toxic", everything, 500)
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {0: 250, 1: 250}
    # the bound holds for rows: one id, many texts
    one = docs.withColumn("doc_id", F.lit(5).cast("long"))
    assert balanced_sample(one, labels, "toxic", everything, 100)[0].count() == 100


def test_one_of_near_copies_counts(spark):
    words = [f"w{i * 7919 % 1000}" for i in range(300)]
    near = [(" ".join(words[:k] + ["changed"] + words[k + 1 :]), 0) for k in range(0, 300, 15)]
    own = [(r[1], r[0] % 2) for r in shared_line(10)]  # 0.71 alike at most
    got = toxicity.without_copies(spark.createDataFrame(near + own, "text string, label int")).collect()
    assert {(r.text, r.label) for r in got} >= set(own) and len(got) == len(own) + 1


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    docs, labels = tables(spark, data.SF001)

    def run(d):
        return sorted((r.doc_id, r.score) for r in toxicity.score(d, labels).collect())

    assert run(docs) == run(docs.orderBy(F.desc(F.xxhash64("doc_id"))).repartition(7))


def test_quality_on_held_out(spark):
    docs, labels = tables(spark, data.SF01)
    got = neighbours.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in got]
    assert np.mean(right) > 0.95
    low = [r.score for r in got if r.quality == 0]
    high = [r.score for r in got if r.quality == 1]
    assert np.mean([a < b for a in low for b in high]) > 0.98


def test_quality_cases(spark):
    docs, (_, labels) = data.documents(spark), tables(spark, data.SF001)
    got = neighbours.score(docs, labels)
    assert got.count() == docs.count()
    assert got.where("score IS NULL OR isnan(score) OR score < 0 OR score > 1").count() == 0
    assert neighbours.score(data.nothing(spark), labels).collect() == []
    assert {r.score for r in neighbours.score(docs, labels.limit(0)).collect()} == {0.5}


def test_votes_are_exact_cosines():
    rnd = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    known, asked = unit(rnd.normal(size=(200, 8))), unit(rnd.normal(size=(20, 8)))
    y = rnd.integers(0, 2, 200).astype(float)
    model = neighbours.Model(np.zeros(8), np.eye(8), known, y, 1.0, 0.0)
    for q, vote in zip(asked, model.votes(asked)):
        order = sorted(range(200), key=lambda i: -(known[i] @ q))[: neighbours.NEIGHBOURS]
        w = [max(1e-6, known[i] @ q) for i in order]
        assert abs(vote - sum(a * y[i] for a, i in zip(w, order)) / sum(w)) < 1e-9


def test_logistic_survives_separation():
    x = np.array([0.0] * 50 + [10.0] * 50)
    w = samples.fit_logistic(x[:, None], x > 5)
    p = 1 / (1 + np.exp(-(w[0] * x + w[1])))
    assert p[:50].max() < 0.2 and p[50:].min() > 0.8


def test_language_on_held_out(spark):
    docs, _ = tables(spark, data.SF01)
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got if r.lang is not None]) > 0.98


def test_language_cases(spark):
    docs = data.documents(spark)
    rows = language.identify(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r for r in rows}
    for i in (900_001, 900_002, 900_003):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[900_006].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in rows)
    assert language.identify(data.nothing(spark)).collect() == []
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    """After any context the probabilities of all known characters, and the
    share kept for others, sum to one."""
    texts = ["abra cadabra", "abba ab", "cab"]
    chars, owner = language.characters(texts)
    codes, counts = np.unique(language.trigrams(chars, owner)[0], return_counts=True)
    model = language.estimate(["x"], codes, counts[:, None].astype(float))
    alphabet = np.unique(chars)
    unseen = language.alphabet_size() - len(alphabet)
    for a in alphabet:
        for b in alphabet:
            p = np.exp(model.log_probabilities((a << 42) | (b << 21) | alphabet))[:, 0]
            other = np.exp(model.log_probabilities(np.array([(a << 42) | (b << 21) | ord("z")])))[0, 0]
            assert abs(p.sum() + unseen * other - 1) < 1e-9


def test_language_learns_from_every_training_text(spark):
    """Each of 4,000 texts of one language has a letter of its own: the model
    knows the letters of all that may be learned from, and of no other."""
    texts = [(i, f"ab {chr(0x4E00 + i)} ab", "zh") for i in range(4000)]
    model = language.learn(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    want = {0x4E00 + i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(want) > 2500
    assert {c for c in model.uni.codes.tolist() if c >= 0x4E00} == want


def test_languages_against_plain_python(spark):
    """The whole query beside Kneser-Ney with dictionaries and fractions of
    counts, on every row (awkward ones too)."""
    docs = data.documents(spark)
    rows = docs.select("doc_id", "text", "lang", language.held_out(F.col("doc_id"), 4, 2).alias("out")).collect()

    def chars(text):
        out = ["", ""]
        for c in text.lower() + " ":
            c = c if c.isalpha() else ""
            if c or out[-1] or len(out) == 1:
                out.append(c)
        return out

    def discount(counts):
        one, two = (sum(c == n for c in counts.values()) for n in (1, 2))
        return min(0.9, max(0.1, one / (one + 2 * two) if one else 0.5))

    letters = sum(chr(c).isalpha() for c in range(0x110000)) + 1

    class Plain:
        """counts[n]: n-grams of n characters; those below the highest order
        count the different characters seen before."""

        def __init__(self, texts):
            self.counts = {3: Counter(), 2: Counter(), 1: Counter()}
            for t in texts:
                c = chars(t)
                self.counts[3].update(tuple(c[i : i + 3]) for i in range(len(c) - 2))
            for n in (2, 1):
                self.counts[n].update(g[1:] for g in self.counts[n + 1])
            self.off = {n: discount(c) for n, c in self.counts.items()}
            self.after = {n: {} for n in self.counts}
            for n, counts in self.counts.items():
                for g, c in counts.items():
                    total, kinds = self.after[n].get(g[:-1], (0, 0))
                    self.after[n][g[:-1]] = (total + c, kinds + 1)

        def p(self, g):
            n = len(g)
            if n == 0:
                return 1 / letters
            total, kinds = self.after[n].get(g[:-1], (0, 0))
            if not total:
                return self.p(g[1:])
            seen = self.counts[n].get(g, 0)
            return (max(0, seen - self.off[n]) + self.off[n] * kinds * self.p(g[1:])) / total

        def entropy(self, text):
            c = chars(text)
            return -sum(math.log(self.p(tuple(c[i : i + 3]))) for i in range(len(c) - 2)) / max(1, len(c) - 2)

    train = {}
    for r in rows:
        if r.text is not None and r.lang is not None and not r.out:
            train.setdefault(r.lang, []).append(r.text)
    assert 1 < len(train) and max(map(len, train.values())) < language.PER_LANGUAGE
    models = {lang: Plain(texts) for lang, texts in sorted(train.items())}
    got = {(r.doc_id, r.text): r for r in language.identify(docs.select("doc_id", "text", "lang"))
           .join(docs.select("doc_id", "text"), "doc_id").collect()}
    tested = 0
    for r in rows:
        if r.doc_id is None:
            continue
        found = got[r.doc_id, r.text]
        assert found.held_out == r.out
        if not any(c.isalpha() for c in r.text or ""):
            assert (found.lang_pred, found.score) == ("und", 0.0)
            continue
        h = {lang: m.entropy(r.text) for lang, m in models.items()}
        best = min(h, key=h.get)
        n = min(language.CONFIDENT, sum(c != "" for c in chars(r.text)) + 1)
        score = 1 / sum(math.exp(-(x - h[best]) * n) for x in h.values())
        assert found.lang_pred == best
        assert found.score == pytest.approx(score / 2 if found.rejected else score, rel=1e-6)
        tested += 1
    assert tested > 100
