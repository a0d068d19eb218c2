"""Secret scanning through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived:
an OR of clauses, each an AND of trigrams that every match must contain
(letters lower-cased). The index holds, for the trigrams any rule asks for,
postings (trigram, document key). Intersecting the postings of a clause gives
candidate documents; only those are searched with the rule's expression. A
rule without mandatory trigrams is searched in every document.

A document's key is a hash of (doc_id, text): rows of one key have the same
matches, and a clash of keys only adds candidates.

Native throughout: postings are made, intersected (grouped by document key,
after partial aggregation) and joined back as DataFrames. Matches of a rule
are found leftmost and without overlap, and matches that fail its length test
are dropped afterwards. Their places follow from the lengths of the matches
and of the text between them.

Defined cases: null text is empty; very long texts are searched whole; spans
that start at one place stand in the order of the kinds, each kind being
matched on its own; rows with null or repeated ids are each searched; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trickle.llm.common import stage
from trickle.llm.lets import let


@dataclass(frozen=True)
class Rule:
    """``pattern`` must mean the same to Java and Python. A match counts if
    its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# A private key from its header to its END line (the text between has no run of
# five hyphens). Without END, over the base64 text that follows: pieces of 16
# characters or more, with lines of any length between them, and a last short
# piece that ends its line. Loops over groups are bounded: Java's recurse.
_B64 = "[A-Za-z0-9+/=]"
_PIECE = _B64 * 16 + r"[A-Za-z0-9+/=\\\r\n]*"
_BETWEEN = r"""[\x20\t\r\n"',>\\]"""
_KEY_NAME = r"[A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
PRIVATE_KEY = (
    f"-----BEGIN {_KEY_NAME}"
    f"(?:[^-]*(?:-{{1,4}}[^-]+){{0,64}}-----END {_KEY_NAME}"
    r"|(?:[\r\n]+[A-Za-z-]+:[^\r\n]*){0,16}"
    f"(?:{_BETWEEN}|{_BETWEEN}n){{0,16}}{_PIECE}(?:{_BETWEEN}+{_PIECE}){{0,250}}"
    rf"(?:[\x20\t]+{_B64}{{1,15}}(?:[\r\n]|$))?)?"
)

# The base rules, in their order, then the rules of this scan.
RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=6, base=True,
    ),
    # a run of one class has its least length in the pattern: shorter runs, which
    # are everywhere in plain words, then make no matches to be dropped
    Rule("access", r"AKIA[A-Z0-9]{16,}", least=20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", least=24, base=True),
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

# Strings a part of an expression may stand for before it is given up.
MAX_STRINGS = 64
MAX_CLASS = 8

Clauses = frozenset[frozenset[str]]  # OR of ANDs
ALWAYS: Clauses = frozenset([frozenset()])


def _both(a: Clauses, b: Clauses) -> Clauses:
    joined = frozenset(x | y for x in a for y in b)
    return joined if len(joined) <= MAX_STRINGS else min(a, b, key=len)


def _of_strings(strings: frozenset[str]) -> Clauses:
    """The trigrams that one of ``strings`` brings."""
    found = frozenset(
        frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in strings
    )
    return ALWAYS if frozenset() in found else found


def _characters(items: list) -> frozenset[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < MAX_CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= MAX_CLASS else None


def _walk(parsed) -> tuple[frozenset[str] | None, Clauses]:
    """The strings an expression stands for, if few, and the trigrams that
    every match holds otherwise."""
    query, run = ALWAYS, frozenset([""])  # ``run``: strings that end here
    whole = True
    for op, arg in parsed:
        strings: frozenset[str] | None = None
        inner = ALWAYS
        if op is sre.LITERAL:
            strings = frozenset([chr(arg).lower()])
        elif op is sre.IN:
            strings = _characters(arg)
        elif op is sre.SUBPATTERN:
            strings, inner = _walk(arg[-1])
        elif op is sre.BRANCH:
            ways = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in ways) and sum(len(s) for s, _ in ways) <= MAX_STRINGS:
                strings = frozenset().union(*[s for s, _ in ways])
            else:
                alternatives = [q if s is None else _both(q, _of_strings(s)) for s, q in ways]
                inner = ALWAYS if ALWAYS in alternatives else frozenset().union(*alternatives)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, body = arg
            s, q = _walk(body)
            if s is not None and most == 1:
                strings = s | {""}
            elif least:
                inner = q if s is None else _of_strings(s)
        elif op is sre.AT:
            strings = frozenset([""])
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = frozenset(a + b for a, b in product(run, strings))
            continue
        query, whole = _both(query, _of_strings(run)), False
        if strings is None:
            query, run = _both(query, inner), frozenset([""])
        else:
            run = strings
    return (run, ALWAYS) if whole else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Clauses:
    """An OR of ANDs of trigrams; ALWAYS if some match may have none."""
    strings, query = _walk(sre_parser.parse(pattern))
    if strings is not None:
        query = _of_strings(strings)
    return frozenset(c for c in query if not any(other < c for other in query))


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key) of the given trigrams, written once."""
    held = let(  # the text is lower-cased once
        F.lower(F.col("text")),
        lambda low: F.array_compact(
            F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams])
        ),
    )
    return stage(
        docs.where("text IS NOT NULL").select(F.explode(held).alias("trigram"), document_key()),
        "trigram-index",
    )


def document_key() -> Column:
    return F.xxhash64("doc_id", "text").alias("_key")


def candidates(postings: DataFrame, queries: dict[str, Clauses]) -> DataFrame:
    """Key and the kinds whose trigram query the document meets."""
    rows = [
        (kind, number, t, len(clause))
        for kind, query in sorted(queries.items())
        for number, clause in enumerate(sorted(query, key=sorted))
        for t in sorted(clause)
    ]
    spark = postings.sparkSession
    asked = spark.createDataFrame(rows, "kind string, clause int, trigram string, need int")
    met = (
        postings.join(F.broadcast(asked), "trigram")  # as many rows as the rules have trigrams
        .groupBy("_key", "kind", "clause", "need")
        .agg(F.count_distinct("trigram").alias("have"))
        .where("have = need")
    )
    return stage(met.groupBy("_key").agg(F.collect_set("kind").alias("_kinds")), "candidates")


def spans_of(rule: Rule, number: int, text: Column) -> Column:
    """Spans (start, kind number, end) of a rule, in code points."""
    pattern = F.lit(rule.pattern)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = F.arrays_zip(
        F.regexp_extract_all(text, pattern, 0).alias("hit"),
        F.regexp_extract_all(text, pattern, rule.group).alias("value"),
        F.split(text, rule.pattern, -1).alias("gap"),
    )

    def add(acc: Column, m: Column) -> Column:
        start = acc.at + F.length(m.gap)
        end = start + F.length(m.hit)
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        counts = F.length(m.value) >= rule.least
        return F.struct(
            F.coalesce(end, acc.at).alias("at"),
            F.when(counts, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"),
        )

    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return F.when(
        F.rlike(text, pattern), F.aggregate(found, start, add, lambda acc: acc.spans)
    ).otherwise(empty)


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(r.kind) for r in RULES])
    return F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda s: F.concat_ws(
                ":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string")
            ),
        ),
        ",",
    )


def with_spans(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` as struct ``_row``, its ``_text`` (null: empty)
    and one array of spans per rule (``_spans``)."""
    queries = {r.kind: trigram_query(r.pattern) for r in RULES}
    indexed = {k: q for k, q in queries.items() if q != ALWAYS}
    trigrams = sorted({t for q in indexed.values() for clause in q for t in clause})
    found = candidates(build_index(docs.select("doc_id", "text"), trigrams), indexed)
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    keyed = docs.select(
        row.alias("_row"), F.coalesce("text", F.lit("")).alias("_text"), document_key()
    )
    looked = keyed.join(found.withColumnRenamed("_key", "_found"), F.col("_key") == F.col("_found"), "left")
    spans = []
    for number, rule in enumerate(RULES):
        every = spans_of(rule, number, F.col("_text"))
        if rule.kind in indexed:
            none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
            every = F.when(F.array_contains("_kinds", rule.kind), every).otherwise(none)
        spans.append(every.alias(rule.kind))
    # bound once: each rule's spans are read several times
    return looked.select("_row", "_text", let(F.struct(*spans), lambda s: s).alias("_spans"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans by kind, their digest, all spans."""
    spans = F.col("_spans")
    base = F.concat(*[spans[r.kind] for r in RULES if r.base])
    every = F.concat(*[spans[r.kind] for r in RULES])
    return with_spans(docs, ["doc_id"]).select(
        "_row.doc_id",
        *[F.size(spans[r.kind]).cast("long").alias(f"n_{r.kind}") for r in RULES if r.base],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )


MASK = "[SECRET]"


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span, or run of overlapping spans, replaced by
    MASK; n_chars, if there, follows."""
    columns = docs.columns
    found = with_spans(docs, columns)
    text = F.col("_text")
    every = F.concat(*[F.col("_spans")[r.kind] for r in RULES])

    def cut(acc: Column, s: Column) -> Column:
        piece = F.array(F.substring(text, acc.at + 1, s.start - acc.at), F.lit(MASK))
        return F.struct(
            F.greatest(acc.at, s.end).alias("at"),
            F.when(s.start >= acc.at, F.concat(acc.out, piece)).otherwise(acc.out).alias("out"),
        )

    masked = F.aggregate(
        F.sort_array(every),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        cut,
        lambda acc: F.concat(F.array_join(acc.out, ""), F.substring(text, acc.at + 1, F.length(text))),
    )
    clean = F.when(F.size(every) == 0, F.col("_row.text")).otherwise(masked)
    named = {c: F.col(f"_row.`{c}`") for c in columns}
    named["text"] = F.col("_clean")
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        named["n_chars"] = F.when(F.col("_hits") == 0, F.col("_row.n_chars")).otherwise(
            F.length("_clean").cast(kind)
        )
    return found.select("_row", F.size(every).alias("_hits"), clean.alias("_clean")).select(
        *[v.alias(c) for c, v in named.items()]
    )
