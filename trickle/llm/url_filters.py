"""URL filters: rules on host and path, carried over to aliases.

A rule (host, path, verdict) fits a url whose host is the rule's or a
subdomain of it and whose path starts with the rule's; the longest rule wins.
A url's own rule is final: an explicit allow is never overruled. A url without
a rule takes over a block from its aliases: urls tied to it by redirects and
canonical links, directly or over other urls, whether or not those are pages
of the table. Without one it is allowed.

- *Edges* come from each page's html: ``<link rel="canonical" href=...>`` and
  ``<meta http-equiv="refresh" content="0; url=...">``, outside comments,
  scripts and styles. Hrefs are resolved against the page's url (``//host``,
  ``/path``, ``?query``, relative; dot segments stay as written; ``<base>`` is
  not read), ``&amp;`` is decoded.
- A *node* is host, path and query of a url: scheme and fragment do not tell
  resources apart for a filter.
- *Components* of the edges are found by contraction over written tables
  (``components.py``); blocked ones are those with a node whose own rule blocks.

All of it is DataFrame expressions, joins and aggregations. Html is read once,
in the scan that writes the narrow table of pages and links; only pages with
links enter the components. A hub that a third of all pages point to is
contracted in the first round through map-side minima; the page join meets a
written table of distinct blocked nodes, which AQE broadcasts when it is small
and otherwise joins with the hot page url split.

Defined results:

- A null url, or one without ``://``, has empty host and path and no rule; its
  page is still an alias of what its html links to by an absolute url.
- Null or empty html has no links; whole texts are searched, unclosed comments
  and scripts run to the end of the text.
- Ties: of rules of one length the one with the longer host, then the smaller
  text, then block. Repeated rows each give their row, also with one page_id.
- Empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trickle.llm.common import stage
from trickle.llm.components import connected_components

MAX_RULES = 1000  # the rules are an expression of the plan; more is an error


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str  # "allow" or "block"

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Patterns that Java's and RE2's engines read alike.
HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)"
)
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
ANY_LINK = r"(?is)<(?:link|meta)\b[^>]*(?:canonical|refresh)"
CANONICAL = r"""(?is)^<link\b.*\srel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"""
REFRESH = r"""(?is)^<meta\b.*\shttp-equiv\s*=\s*["']?\s*refresh\s*["'\s/>]"""
HREF = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
CONTENT = r"""(?is)\scontent\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH_URL = r"""(?is)^[\s0-9.]*[;,]\s*url\s*=\s*["']?([^"']*)"""


def host_of(url: Column) -> Column:
    """Lower-cased text after the first ``://`` up to ``/``, ``?`` or ``#``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """The query with its ``?``; empty without one."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the rule that decides; null without one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    first = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text, r.verdict != "block"))
    text = verdict = F
    for rule in first:
        at_host = (host == rule.host) | host.endswith("." + rule.host)
        fits = at_host & path.startswith(rule.path)
        text, verdict = text.when(fits, rule.text), verdict.when(fits, rule.verdict)
    if not first:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return text, verdict


def _value(tag: Column, pattern: str) -> Column:
    """The attribute's value, however it is quoted."""
    return F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])


def targets(html: Column) -> Column:
    """Array of the link texts of a page: canonical hrefs, refresh urls."""
    tags = F.regexp_extract_all(F.regexp_replace(html, HIDDEN, " "), F.lit(TAG), F.lit(0))
    links = F.transform(
        tags,
        lambda t: F.when(t.rlike(CANONICAL), _value(t, HREF))
        .when(t.rlike(REFRESH), F.regexp_extract(_value(t, CONTENT), REFRESH_URL, 1))
        .otherwise(F.lit("")),
    )
    links = F.transform(links, lambda x: F.trim(F.replace(x, F.lit("&amp;"), F.lit("&")), F.lit(" \t\n\r\f")))
    found = F.array_distinct(F.filter(links, lambda x: x != ""))
    return F.when(html.rlike(ANY_LINK), found).otherwise(F.array().cast("array<string>"))


def resolve(link: Column, host: Column, path: Column) -> Column:
    """The link as a url after ``://``, with an empty scheme; null for links
    to no address (other schemes, fragments, or relative without a host)."""
    base = F.concat(F.lit("://"), host)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    relative = (
        F.when(link.startswith("//"), F.concat(F.lit(":"), link))
        .when(host == "", F.lit(None))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.startswith("?"), F.concat(base, path, link))
        .when(link.startswith("#"), F.lit(None))
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )
    return (
        F.when(link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(relative)
    )


def node(host: Column, path: Column, query: Column) -> Column:
    """host, path and query as one text; an empty path is ``/``."""
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query)


def blocked_nodes(links: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """``links`` (node, node_verdict, target): the distinct nodes of components
    in which a node's own rule blocks; None without links."""
    to = links.select("node", F.col("node_verdict"), F.col("target"))
    to = to.withColumn("_host", host_of(F.col("target"))).withColumn("_path", path_of(F.col("target")))
    to = to.where("_host <> ''").select(
        F.col("node").alias("u"), F.col("node_verdict").alias("u_verdict"),
        node(F.col("_host"), F.col("_path"), query_of(F.col("target"))).alias("v"),
        best_rule(F.col("_host"), F.col("_path"), rules)[1].alias("v_verdict"),
    )
    edges = stage(to, "links")
    if not edges.take(1):
        return None
    labels = connected_components(edges.select("u", "v"))
    own = edges.select(F.col("u").alias("node"), F.col("u_verdict").alias("verdict")).unionAll(
        edges.select("v", "v_verdict"))
    sources = own.where("verdict = 'block'").select("node").distinct()
    roots = labels.join(sources, "node").select("root").distinct()
    return stage(labels.join(roots, "root", "left_semi").select("node"), "blocked")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, host, path, rule, verdict,
    own_verdict (the rule's, null without one)."""
    url, html = F.col("url"), F.col("html")
    at = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"),
                      query_of(url).alias("query"), targets(html).alias("links"))
    host, path = F.col("host"), F.col("path")
    text, verdict = best_rule(host, path, rules)
    # a page without an address is a node of its own
    own = F.concat(F.lit("\u0001"), F.monotonically_increasing_id().cast("string"))
    narrow = stage(
        at.select(
            "page_id", "host", "path", text.alias("rule"), verdict.alias("own_verdict"),
            F.when(host == "", own).otherwise(node(host, path, F.col("query"))).alias("node"), "links",
        ),
        "pages",
    )
    cols = ["page_id", "host", "path", "rule"]
    links = narrow.where("size(links) > 0").select(
        "node", F.col("own_verdict").alias("node_verdict"), "host", "path", F.explode("links").alias("link"))
    links = links.select(
        "node", "node_verdict", resolve(F.col("link"), F.col("host"), F.col("path")).alias("target")
    ).where("target IS NOT NULL")
    blocked = blocked_nodes(links, rules)
    if blocked is None:
        return narrow.select(*cols, F.coalesce("own_verdict", F.lit("allow")).alias("verdict"), "own_verdict")
    met = narrow.select(*cols, "own_verdict", "node").join(
        blocked.withColumn("_blocked", F.lit("block")), "node", "left")
    return met.select(*cols, F.coalesce("own_verdict", "_blocked", F.lit("allow")).alias("verdict"), "own_verdict")
