"""URL filters, lexical search and vector codes against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_data import SF001, documents, nothing
from pyspark.sql import functions as F

from trickle.llm import lexical_search, queries, url_filters, vector_codes

# ------------------------------------------------------------- URL filters


def canonical(url):
    return f'<html><head><link rel="canonical" href="{url}"></head></html>'


def refresh(url):
    return f"<META HTTP-EQUIV='refresh' CONTENT='0; URL={url}'>"


CASES = [  # page_id, url, html, verdict
    (1, "http://a.example.net/x", "", "block"),  # net/
    (2, "http://a.example.net/en/x", None, "allow"),  # the longer rule
    (3, "http://a.example.com/p1", canonical("http://b.example.com/p2"), "block"),  # a chain to a blocked url
    (4, "http://b.example.com/p2#top", refresh("/p3"), "block"),
    (5, "https://b.example.com/p3", refresh("//b.example.com/de/x"), "block"),  # the url is no page
    (6, "http://shop.org/fr/a", canonical("http://a.example.net/x"), "allow"),  # allowed, tied to a blocked url
    (7, "http://shop.org/es/a", canonical("http://shop.org/fr/a"), "block"),  # over the allowed one
    (8, "http://free.org/1", canonical("http://free.org/2"), "allow"),
    (9, "http://free.org/2", "<!-- " + canonical("http://a.example.net/x") + " -->", "allow"),
    (10, "http://free.org/3", "<script>'" + canonical("http://a.example.net/x"), "allow"),  # unclosed
    (11, None, canonical("http://a.example.net/x"), "block"),  # an alias without an address
    (None, None, None, "allow"),
    (12, "no scheme", canonical("/de/"), "allow"),  # relative to nothing
    (13, "http://free.org/dir/page?q=1", "<link href='other&amp;x' rel=canonical >", "allow"),
    (14, "http://free.org/dir/other&x", canonical("HTTP://X.ORG.NET/"), "block"),
    (13, "http://free.org/dir/page?q=1", "<link href='other&amp;x' rel=canonical >", "allow"),  # repeated row
    (15, "http://net", "", "allow"),  # a path that does not start with the rule's
    (16, "http://Sub.NET/", "", "block"),
    (17, "http://xnet/", "", "allow"),  # no subdomain
    (18, "http://free.org/m", canonical("mailto:x@a.net/"), "allow"),
    (19, "http://free.org/long", "x" * 300_000 + canonical("http://q.net/") + "<" * 300_000, "block"),
    (20, "http://free.org/nocan", '<link rel="stylesheet" href="http://q.net/"><!-- canonical -->', "allow"),
    (21, "http://free.org/a?b://c.net/", "", "allow"),
    (22, "", "", "allow"),
]
for i, (page, url, html, verdict) in enumerate(CASES):
    if page == 13:  # tied to 14, which is tied to a blocked url
        CASES[i] = (page, url, html, "block")


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "node", "links", "rule", "verdict", "u", "root"):
        df = df.withColumn(name, F.lit(f"extra {name}"))
    return df


def test_url_cases(spark):
    got = queries.url_filters.judge(pages(spark, [c[:3] for c in CASES])).collect()
    found = Counter((r.page_id, r.verdict) for r in got)
    assert found == Counter((c[0], c[3]) for c in CASES)
    at = {r.page_id: r for r in got}
    assert (at[21].host, at[21].path) == ("free.org", "/a")
    assert (at[16].host, at[16].path, at[16].rule) == ("sub.net", "/", "net/")
    assert (at[12].host, at[12].path, at[12].rule) == ("", "", None)
    assert at[2].rule == "example.net/en/" and at[1].rule == "net/"


def test_urls_random_links(spark):
    """Random links, a hub that a third of the pages point to."""
    rng = random.Random(5)
    hosts = ["a.example.net", "b.example.com", "c.org", "d.org", "e.info", "f.info"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'x'])}/{i}" for i in range(400)]
    rows, parent = [], {u: u for u in urls}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    hub = next(u for u in urls if "e.info" in u)
    for i, u in enumerate(urls):
        to = hub if i % 3 == 0 and "e.info" in u else rng.choice(urls) if i % 5 == 0 else None
        rows.append((i, u, canonical(to) if to else None))
        if to:
            parent[find(u)] = find(to)

    def rule(u):
        host, path = re.match(r"http://([^/]*)(.*)", u).groups()
        fit = [r for r in url_filters.RULES
               if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=lambda r: len(r.text)).verdict if fit else None

    bad = {find(u) for u in urls if rule(u) == "block"}
    want = {i: rule(u) or ("block" if find(u) in bad else "allow") for i, u in enumerate(urls)}
    got = {r.page_id: r.verdict for r in url_filters.judge(pages(spark, rows)).collect()}
    assert got == want
    assert len({v for i, v in want.items() if rule(urls[i]) is None}) == 2


def test_urls_of_an_empty_table(spark):
    assert url_filters.judge(pages(spark, [])).collect() == []


def test_urls_need_no_python(spark):
    plan = queries.op11_url_filters(spark, SF001)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    kept = [(d, Counter(terms_of(t))) for d, t in docs if terms_of(t)]
    n, total = len(kept), sum(sum(c.values()) for _, c in kept)
    df = Counter(t for _, c in kept for t in c)
    out = []
    for item, text in items:
        query = set(terms_of(text)) & set(df)
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in query}
        scored = []
        for d, c in kept:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in query if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        for rank, (s, no, d) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if no else d, -s))
    return Counter(out)


def items_of(spark):
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text")
    odd = spark.createDataFrame(
        [(900, None), (901, ""), (902, "?! ..."), (903, "the THE the"), (903, "the THE the"), (None, "passage1 word1"),
         (904, "nowhere-to-be-found"), (905, "日本語 \U0001f600 été"), (906, "same one " + "w1 " * 50_000)],
        "item_id long, text string",
    )
    return bench.unionAll(odd).withColumn("rank", F.lit("extra")).withColumn("score", F.lit("extra"))


@pytest.mark.parametrize("chunk_bytes", [lexical_search.CHUNK_BYTES, 60_000])
def test_lexical_ranks(spark, chunk_bytes):
    docs, items = documents(spark), items_of(spark)
    want = ranked([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()],
                  [(r.item_id, r.text) for r in items.collect()], 50)
    got = lexical_search.rank(docs, items, 50, chunk_bytes=chunk_bytes)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, got.collect())) == want


def test_lexical_empty_tables(spark):
    items = items_of(spark)
    assert lexical_search.rank(nothing(spark), items).collect() == []
    assert lexical_search.rank(documents(spark), items.limit(0)).collect() == []


def test_lexical_pieces_keep_terms(monkeypatch):
    text = "Añb,c" * 300 + " x1 " * 100
    want = terms_of(text)
    monkeypatch.setattr(lexical_search, "PIECE", 64)
    got = [t.decode() for piece in lexical_search.terms(text.encode()) for t in piece]
    assert got == want


def test_lexical_skipping_is_exact():
    """Random posting lists: the best k by skipping equal those by summing,
    and blocks are skipped."""
    rng = np.random.default_rng(3)
    n, k = 40_000, 10
    for trial in range(8):
        segment = lexical_search._Segment()
        segment.ids = [int(x) for x in rng.permutation(n)]
        segment.lengths = rng.integers(1, 400, n).tolist()
        shares = [0.4, 0.3, 0.1, 0.05, 0.001, 0.0005, 0.0002]
        for term, share in enumerate(shares):
            docs = np.flatnonzero(rng.random(n) < share)
            if share < 0.01 and trial % 2:  # rare terms stand together, as copies do
                docs = np.flatnonzero((np.array(segment.ids) < 2000) & (rng.random(n) < 50 * share))
            segment.docs += docs.tolist()
            segment.terms += [term] * len(docs)
            segment.tfs += rng.integers(1, 3 + trial * 5, len(docs)).tolist()
        row = segment.batch().to_pylist()[0]
        total = sum(segment.lengths)
        weights = {t: lexical_search.weight(n, int(c)) for t, c in zip(row["terms"], row["counts"])}
        lists = lexical_search.Lists(row, weights, n, total)
        plain = np.zeros(n, dtype=np.int64)
        for docs, scores in lists.lists.values():
            plain[docs] += scores
        best = lexical_search.Best(k)
        read = lexical_search.search(lists, list(weights), best)
        order = np.lexsort((lists.ids, -plain))[:k]
        assert best.scores.tolist() == plain[order].tolist()
        assert best.ids.tolist() == lists.ids[order].tolist()
        assert read <= 8 if trial % 2 else read <= lists.blocks


# ------------------------------------------------------------ vector codes


def coded(rows, parts=16, entries=64, rounds=2):
    """Plain version over rows (vec_id, vector, label) of one length."""
    kept = [(i, [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v], lab)
            for i, v, lab in rows]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    d = len(kept[0][1])
    cut = [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]
    books = [[r[1][a:b] for r in first] for a, b in cut]

    def nearest(part, book):
        dist = [sum((x - y) ** 2 for x, y in zip(part, e)) for e in book]
        return dist.index(min(dist)), min(dist)

    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(v[a:b], books[p])[0], []).append(v[a:b])
            books[p] = [
                [sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else old
                for e, old in enumerate(books[p])
            ]
    out, totals = [], Counter()
    for i, v, lab in kept:
        near = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(cut)]
        error = sum(n[1] for n in near)
        totals[lab] += error
        out.append((i, "".join(f"{n[0]:02x}" for n in near), error, lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    top = (1 << 63) - 1
    return Counter(
        (i, c, e if e <= top else None, None if totals[lab] > top else totals[lab], sha) for i, c, e, lab in out
    )


def run_codes(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    for name in ("code", "error", "part", "_label", "d"):
        df = df.withColumn(name, F.lit("extra"))
    df = df.repartition(5)
    out, books = vector_codes.compress(df)
    out = vector_codes.with_label_errors(out)
    return Counter((r.vec_id, r.code, r.error, r.label_error, vector_codes.digest(books)) for r in out.collect())


def vectors(n, d, scale, seed, labels=(0, 1, None)):
    rng = random.Random(seed)
    return [(i if i % 11 else i // 2, [rng.gauss(0, 1) * scale for _ in range(d)], rng.choice(labels))
            for i in range(n)]


@pytest.mark.parametrize("n,d,scale", [(300, 32, 1.0), (40, 16, 0.1), (120, 16, 2.0**22), (90, 16, 2.0**45),
                                       (80, 20, 1.0), (70, 5, 1.0)])
def test_codes_equal_plain(spark, n, d, scale):
    rows = vectors(n, d, scale, seed=n)
    rows += [rows[3], rows[3], (None, rows[5][1], None), (None, rows[6][1], 1)]
    if scale > 2**44:
        # distances beyond a long: label errors do not fit where an error does not
        want = {(r[0], r[1], r[2], r[4]) for r in coded(rows)}
        got = {(r[0], r[1], r[2], r[4]) for r in run_codes(spark, rows)}
        assert got == want and any(r[2] is None for r in want)
        return
    assert run_codes(spark, rows) == coded(rows)


def test_codes_ties_go_to_the_lower_entry(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.5]) for _ in range(16)], 1) for i in range(200)]
    assert run_codes(spark, rows, "float") == coded(rows)


def test_codes_of_unusable_vectors(spark):
    rows = vectors(100, 16, 1.0, seed=9)
    bad = [(1, None, 0), (2, [None] + [0.0] * 15, 0), (3, [float("nan")] + [0.0] * 15, 0),
           (4, [float("inf")] + [0.0] * 15, 0), (5, [-float("inf")] + [0.0] * 15, 0)]
    odd = [(6, [1.0] * 15, 7), (7, [], 7)]
    want = coded(rows)
    sha = next(iter(want))[4]
    # a label of vectors without a code alone has no errors to add up
    for i, _, _ in odd:
        want[(i, None, None, 0, sha)] += 1
    assert run_codes(spark, rows + bad + odd) == want


def test_codes_of_largest_doubles(spark):
    rows = [(i, [x] * 16, 0) for i, x in enumerate([1e308, -1e308, 1.5e308, 0.25, -0.001] * 20)]
    got = run_codes(spark, rows)
    assert {(r[0], r[1], r[2], r[4]) for r in got} == {(r[0], r[1], r[2], r[4]) for r in coded(rows)}


def test_codes_of_nothing(spark):
    assert run_codes(spark, []) == Counter()
    assert run_codes(spark, [(1, None, 0)]) == Counter()
