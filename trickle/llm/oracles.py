"""DuckDB SQL of the queries that SQL can say. The others need tokenisers,
learned models or XXH64, and are tested against plain Python."""

from __future__ import annotations

from trickle.llm import url_filters
from trickle.llm.secret_scan import RULES, Rule

OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r,
         vec_id, score
  FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), win AS (
  SELECT r, doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d)
), firsts AS (
  SELECT k, min(doc_id) AS lo FROM win GROUP BY k
), hit AS (
  SELECT r, p FROM win JOIN firsts USING (k) WHERE lo < doc_id
), gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 50)) AS i FROM hit
), words AS (
  SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def _spans(rule: Rule, number: int) -> str:
    """List of {s, k, e} of a rule: from the lengths of the matches and of the
    text between them."""
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    before = (
        "list_sum(list_transform(gaps[1:i], lambda g: length(g)))"
        " + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)"
    )
    return f"""(
      SELECT list_transform(
        list_filter(range(1, len(hits) + 1), lambda i: length(vals[i]) >= {rule.least}),
        lambda i: struct_pack(s := CAST({before} AS BIGINT), k := {number},
                              e := CAST({before} + length(hits[i]) AS BIGINT)))
      FROM (SELECT regexp_extract_all(t, {pattern}, 0) AS hits,
                   regexp_extract_all(t, {pattern}, {rule.group}) AS vals,
                   string_split_regex(t, {pattern}) AS gaps))"""


def _joined(spans: str) -> str:
    names = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    return (
        f"coalesce(array_to_string(list_transform(list_sort({spans}), "
        f"lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), ','), '')"
    )


def op7_sql() -> str:
    spans = ",\n    ".join(f"{_spans(r, i)} AS sp_{r.kind}" for i, r in enumerate(RULES))
    base = " || ".join(f"sp_{r.kind}" for r in RULES if r.base)
    every = " || ".join(f"sp_{r.kind}" for r in RULES)
    counts = ", ".join(f"CAST(len(sp_{r.kind}) AS BIGINT) AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id,
    {spans}
  FROM d
)
SELECT doc_id, {counts}, sha256({_joined(base)}) AS base_sha256, {_joined(every)} AS spans
FROM found
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _rule_case(host: str, path: str, out: str) -> str:
    """CASE over the query's rules, the longest first."""
    whens = " ".join(
        f"WHEN ({host} = {_text(r.host)} OR ends_with({host}, {_text('.' + r.host)}))"
        f" AND starts_with({path}, {_text(r.path)}) THEN {_text(getattr(r, out))}"
        for r in sorted(url_filters.RULES, key=lambda r: -len(r.text))
    )
    return f"CASE {whens} END"


def _attribute(tag: str, pattern: str) -> str:
    return "(" + " || ".join(f"regexp_extract({tag}, {_text(pattern)}, {g})" for g in (1, 2, 3)) + ")"


def op11_sql() -> str:
    u = url_filters
    address = """translate(coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract({0}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1), '') AS query"""
    name = "host || CASE WHEN path = '' THEN '/' ELSE path END || query"
    return f"""
WITH RECURSIVE a AS (
  SELECT row_number() OVER () AS r, page_id, html, {address.format("url")}
  FROM pages
), p AS (
  SELECT *, {_rule_case("host", "path", "text")} AS rule, {_rule_case("host", "path", "verdict")} AS own,
    CASE WHEN host = '' THEN chr(1) || r ELSE {name} END AS node
  FROM a
), tags AS (
  SELECT node, host, path,
    unnest(regexp_extract_all(regexp_replace(html, {_text(u.HIDDEN)}, ' ', 'g'), {_text(u.TAG)})) AS t
  FROM p WHERE regexp_matches(html, {_text(u.ANY_LINK)})
), links AS (
  SELECT node, host AS h, path AS p, trim(replace(CASE
      WHEN regexp_matches(t, {_text(u.CANONICAL)}) THEN {_attribute("t", u.HREF)}
      WHEN regexp_matches(t, {_text(u.REFRESH)})
        THEN regexp_extract({_attribute("t", u.CONTENT)}, {_text(u.REFRESH_URL)}, 1)
      ELSE '' END, '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(13) || chr(12)) AS l
  FROM tags
), resolved AS (
  SELECT node, CASE
      WHEN regexp_matches(l, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://') THEN l
      WHEN regexp_matches(l, '(?s)^[A-Za-z][A-Za-z0-9+.-]*:') OR l = '' THEN NULL
      WHEN starts_with(l, '//') THEN ':' || l
      WHEN h = '' OR starts_with(l, '#') THEN NULL
      WHEN starts_with(l, '/') THEN '://' || h || l
      WHEN starts_with(l, '?') THEN '://' || h || p || l
      ELSE '://' || h || coalesce(nullif(regexp_extract(p, '(?s)^(.*/)', 1), ''), '/') || l END AS target
  FROM links
), ends AS (
  SELECT node AS u, {address.format("target")} FROM resolved WHERE target IS NOT NULL
), edges AS (
  SELECT u, {name} AS v, {_rule_case("host", "path", "verdict")} AS own FROM ends WHERE host <> ''
), both_ways AS (
  SELECT u, v FROM edges UNION SELECT v, u FROM edges
), blocked(node) AS (
  SELECT v FROM edges WHERE own = 'block'
  UNION SELECT node FROM p WHERE own = 'block' AND node IN (SELECT u FROM edges)
  UNION SELECT e.v FROM blocked b JOIN both_ways e ON e.u = b.node
)
SELECT page_id, host, path, rule,
       coalesce(own, CASE WHEN node IN (SELECT node FROM blocked) THEN 'block' END, 'allow') AS verdict
FROM p
"""


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), k AS (
  SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0
), total AS (
  SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM k
), i AS (
  SELECT DISTINCT item, item_id, term FROM (
    SELECT row_number() OVER () AS item, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark)
), p AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM k) GROUP BY r, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM p, total GROUP BY term, nn
), s AS (
  SELECT i.item, i.item_id, p.r,
         CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN k USING (r), total
  GROUP BY i.item, i.item_id, p.r
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rk,
         doc_id, score
  FROM s JOIN k USING (r) WHERE score > 0
)
SELECT item_id, CAST(rk AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rk <= 50
"""


def op13_sql(rounds: int = 2) -> str:
    def assign(n: int) -> str:
        return f"""a{n} AS (
  SELECT r, part, min(struct_pack(dist := dist, e := e)) AS m FROM (
    SELECT p.r, p.part, c.e,
           coalesce(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0) AS dist
    FROM p JOIN c{n} c USING (part))
  GROUP BY r, part
)"""

    def update(n: int) -> str:
        return f"""u{n} AS (
  SELECT part, e, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY i) AS x FROM (
    SELECT p.part, a.m.e AS e, i, sum(CAST(p.x[i] AS HUGEINT)) AS s, count(*) AS k
    FROM p JOIN a{n} a USING (r, part), unnest(range(1, len(p.x) + 1)) AS g(i)
    GROUP BY p.part, a.m.e, i)
  GROUP BY part, e
), c{n + 1} AS (
  SELECT c.part, c.e, coalesce(u.x, c.x) AS x FROM c{n} c LEFT JOIN u{n} u ON c.part = u.part AND c.e = u.e
)"""

    steps = ",\n".join(f"{assign(n)},\n{update(n)}" for n in range(rounds)) + ",\n" + assign(rounds)
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT r, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] AS x
  FROM v, unnest(range(16)) AS g(part)
), c0 AS (
  SELECT part, r - 1 AS e, x FROM p WHERE r <= 64
), {steps}, done AS (
  SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.dist) AS BIGINT) AS error
  FROM a{rounds} GROUP BY r
), book AS (
  SELECT sha256(string_agg(x, ',' ORDER BY part, e)) AS h
  FROM (SELECT part, e, array_to_string(x, ',') AS x FROM c{rounds})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       h AS codebooks_sha256
FROM v JOIN done USING (r), book
"""


def all_oracles() -> dict[str, str]:
    return {
        "op2_exact_top_k": OP2_SQL,
        "op6_substring_dedup": OP6_SQL,
        "op7_secret_scan": op7_sql(),
        "op11_url_filters": op11_sql(),
        "op12_lexical_search": OP12_SQL,
        "op13_vector_codes": op13_sql(),
    }
