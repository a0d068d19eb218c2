"""Decode, route and parse change-log lines with built-in expressions.

The reference splits the line stream three ways with side outputs, parses
each branch into a row object and drops lines with other tags. Here each
table is one branch over the lines: a filter on the tag (on the raw line, so
other tables' lines are dropped before any parsing), one ``split`` per line,
and one projection that types the fields. Lines that cannot be used go to a
dead-letter DataFrame with their reason instead of disappearing.

``on_error``: ``"fail"`` (the reference: a malformed record of a known table
fails the job; unknown tags are dropped) or ``"dead_letter"`` (malformed
records leave the tables and are reported). ``strict_op`` treats op chars
other than ``+``/``-`` as malformed; otherwise any non-``+`` char is a
delete, as in the reference.

Plan shape: no filter re-parses the line. In ``fail`` mode all columns come out
of a generator that checks the record (``raise_error`` on the failing branch):
Catalyst cannot push a filter on generated columns, or one it infers from a
join, below it, so no filter or join removes a bad record before it is seen.
In ``dead_letter`` mode the reason is computed from the typed columns.

``seq_mode``: ``"field"`` (our feeds: ``seq`` is one extra last field) or
``"position"`` (the reference's files: no seq; ``seq`` is the file position
as ``struct(file, block, row)``).
Expressions are SQL text (``selectExpr``): one call into the JVM per
projection instead of one per sub-expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trickle.functions import decode as D
from trickle.functions.measures import DISCOUNT, PRICE

SEQ_FIELD = "field"  # seq is the last field of every record
SEQ_POSITION = "position"  # the reference's format: no seq, order = file position

OUTPUT_COLS = {
    D.TAG_LINEITEM: ["l_orderkey", "line", "l_extendedprice", "l_discount", "l_shipdate",
                     "l_price_far", "l_discount_far"],
    D.TAG_ORDERS: ["o_orderkey", "o_custkey", "o_orderdate", "o_shippriority"],
    D.TAG_CUSTOMER: ["c_custkey", "c_mktsegment"],
}
INT_COLS = {"line", "o_shippriority"}
MONEY_COLS = {"l_extendedprice": PRICE, "l_discount": DISCOUNT}
# Money that needs more than an exact decimal (functions.measures): the doubles
# of both factors; NULL on all other rows, where the exact factors are.
FAR_COLS = {"l_price_far": "l_extendedprice", "l_discount_far": "l_discount"}
DATE_COLS = {"l_shipdate", "o_orderdate"}
TEXT_COLS = {"c_mktsegment"}


def _need(tbl: str, seq_mode: str = SEQ_FIELD) -> int:
    """Fields a record of ``tbl`` must have: up to the last one read (plus seq)."""
    return max(D.FIELDS[tbl].values()) + (2 if seq_mode == SEQ_FIELD else 1)


def with_position_seq(lines: DataFrame) -> DataFrame:
    """value, seq for change-log files without a seq field: seq is the file
    position, ``struct(file, block, row)`` (file path, start of the split,
    row id within the task), which orders like the lines of the files taken
    in path order.

    No sort is needed: structs compare field by field, so ``greatest``,
    window ordering and range partitioning work on it directly, and a query
    that does not use seq (the final view is order-free) prunes it away. The
    row id is assigned before any filter (Catalyst does not push a filter
    below a non-deterministic projection), so every table branch of the same
    scan sees the same values."""
    return lines.select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("_pos_seq"),
    )


def _parse_sql(col: str, s: str) -> str:
    if col in DATE_COLS:
        return D.date_sql(s)
    if col in MONEY_COLS:
        return D.money_sql(s, MONEY_COLS[col])
    if col in TEXT_COLS:
        return s
    return D.int_sql(s, "int" if col in INT_COLS else "bigint")


def _any_null(cols) -> str:
    return " OR ".join(f"{c} IS NULL" for c in cols)


def _far_sql(array: str) -> dict[str, str]:
    """The far columns, after the exact ones: NULL where both are exact."""
    at = D.FIELDS[D.TAG_LINEITEM]
    return {
        far: f"CASE WHEN {_any_null(MONEY_COLS)} THEN {D.double_sql(D.field_sql(array, at[exact]))} END"
        for far, exact in FAR_COLS.items()
    }


def _reason_sql(tbl: str, strict_op: bool, seq_mode: str = SEQ_FIELD) -> str:
    """Why a typed row of ``tbl`` is unusable (NULL when it is fine)."""
    nums = [c for c in OUTPUT_COLS[tbl] if c not in DATE_COLS | TEXT_COLS | {*MONEY_COLS, *FAR_COLS}]
    dates = [c for c in OUTPUT_COLS[tbl] if c in DATE_COLS]
    whens = []
    if strict_op:
        whens.append("WHEN op NOT IN ('+', '-') THEN 'bad_op'")
    whens.append(f"WHEN _n < {_need(tbl, seq_mode)} THEN 'short_line'")
    bad = [f"{c} IS NULL" for c in nums]
    if tbl == D.TAG_LINEITEM:
        bad.append(f"({_any_null(MONEY_COLS)}) AND ({_any_null(FAR_COLS)})")
    if bad:
        whens.append(f"WHEN {' OR '.join(bad)} THEN 'bad_number'")
    if dates:
        whens.append("WHEN " + " OR ".join(f"{c} IS NULL" for c in dates) + " THEN 'bad_date'")
    whens.append("WHEN seq IS NULL THEN 'bad_seq'")
    return "CASE " + " ".join(whens) + " END"


def _typed(lines: DataFrame, tbl: str, seq_mode: str = SEQ_FIELD, tagless: bool = False) -> DataFrame:
    """Lines of one table -> value, op, _n (field count), seq, sgn, typed columns.
    ``tagless`` lets in lines too short to have a tag."""
    fields = D.FIELDS[tbl]
    keep = ["_pos_seq"] if seq_mode == SEQ_POSITION else []
    seq = "_pos_seq" if seq_mode == SEQ_POSITION else D.int_sql("element_at(_f, -1)")
    # The field array comes out of a one-row generator. Catalyst pushes
    # filters written on parsed columns (the Q3 predicates, the not-null
    # filters it infers from joins) below plain projections by inlining them,
    # which would split every line again per predicate; it does not push a
    # filter on generated columns below the generator, so each line is
    # split once.
    own = f"{D.TAG_SQL} = '{tbl}'" + (" OR length(value) < 3" if tagless else "")
    split = lines.where(own).selectExpr(
        "value", *keep, f"{D.OP_SQL} AS op", f"explode(array({D.FIELDS_SQL})) AS _f"
    )
    plain = [c for c in OUTPUT_COLS[tbl] if c not in FAR_COLS]
    typed = split.selectExpr(
        "value",
        "op",
        "_f",
        "size(_f) AS _n",
        f"{seq} AS seq",
        D.SIGN_SQL.format(op="op") + " AS sgn",
        *[f"{_parse_sql(c, D.field_sql('_f', fields[c]))} AS {c}" for c in plain],
    )
    if tbl == D.TAG_LINEITEM:
        typed = typed.selectExpr("*", *[f"{x} AS {c}" for c, x in _far_sql("_f").items()])
    return typed.drop("_f")


def parse_table(lines: DataFrame, tbl: str, on_error: str = "fail", strict_op: bool = False,
                seq_mode: str = SEQ_FIELD) -> DataFrame:
    """seq, sgn and the typed columns of one table's change records."""
    typed = _typed(lines, tbl, seq_mode, tagless=on_error == "fail")
    cols = ["seq", "sgn", *OUTPUT_COLS[tbl]]
    reason = _reason_sql(tbl, strict_op, seq_mode)
    if on_error == "fail":
        return checked(typed, f"CASE WHEN length(value) < 3 THEN 'short_line' ELSE ({reason}) END", cols)
    if on_error == "dead_letter":
        return typed.where(f"({reason}) IS NULL").select(*cols)
    raise ValueError(f"unknown on_error {on_error!r}")


def checked(typed: DataFrame, reason: str, cols: list[str]) -> DataFrame:
    """``cols`` of ``typed``; the job fails at a row with a ``reason``."""
    row = ", ".join(f"'{c}', {c}" for c in cols)
    bad = f"raise_error(concat('malformed change record (', {reason}, '): ', value))"
    return typed.selectExpr(
        f"inline(array(CASE WHEN ({reason}) IS NULL THEN named_struct({row}) ELSE {bad} END))"
    )


def _decoded(lines: DataFrame, strict_op: bool = False, seq_mode: str = SEQ_FIELD) -> DataFrame:
    """All lines in one pass: value, tbl, op, seq, sgn, every table's typed
    columns (computed only on lines of their own table, so no cast fails on
    another table's field) and ``reason`` (NULL when the line is usable)."""
    keep = ["_pos_seq"] if seq_mode == SEQ_POSITION else []
    seq = "_pos_seq" if seq_mode == SEQ_POSITION else D.int_sql("element_at(_f, -1)")
    split = lines.selectExpr(
        "value", *keep, f"{D.TAG_SQL} AS tbl", f"{D.OP_SQL} AS op",
        f"explode(array({D.FIELDS_SQL})) AS _f",
    )
    typed = [
        f"CASE WHEN tbl = '{t}' THEN {_parse_sql(c, D.field_sql('_f', D.FIELDS[t][c]))} END AS {c}"
        for t in D.TAGS for c in OUTPUT_COLS[t] if c not in FAR_COLS
    ]
    far = [f"CASE WHEN tbl = '{D.TAG_LINEITEM}' THEN {x} END AS {c}" for c, x in _far_sql("_f").items()]
    tags = ", ".join(f"'{t}'" for t in D.TAGS)
    per_tag = " ".join(f"WHEN tbl = '{t}' THEN ({_reason_sql(t, strict_op, seq_mode)})" for t in D.TAGS)
    return split.selectExpr(
        "value", "tbl", "op", "_f", "size(_f) AS _n", f"{seq} AS seq",
        D.SIGN_SQL.format(op="op") + " AS sgn", *typed,
    ).selectExpr("*", *far).drop("_f").selectExpr(
        "*",
        "CASE WHEN length(value) < 3 THEN 'short_line' "
        f"WHEN tbl NOT IN ({tags}) THEN 'unknown_tag' {per_tag} END AS reason",
    )


def dead_letter(lines: DataFrame, strict_op: bool = False, seq_mode: str = SEQ_FIELD) -> DataFrame:
    """value, tbl, reason for every line that cannot be used (one pass)."""
    return (
        _decoded(lines, strict_op, seq_mode)
        .where("reason IS NOT NULL")
        .select("value", "tbl", "reason")
    )


class Routed:
    """The three parsed change tables and the dead letter of one feed.

    Built lazily: a DataFrame (and its share of plan analysis) is made only
    when a caller asks for it."""

    def __init__(self, lines: DataFrame, on_error: str = "fail", strict_op: bool = False,
                 seq_mode: str = SEQ_FIELD):
        self._lines, self._on_error, self._strict_op = lines, on_error, strict_op
        self._seq_mode = seq_mode
        self._cache: dict[str, DataFrame] = {}

    def _make(self, key: str) -> DataFrame:
        if key == "dead":
            return dead_letter(self._lines, self._strict_op, self._seq_mode)
        return parse_table(self._lines, key, self._on_error, self._strict_op, self._seq_mode)

    def _get(self, key: str) -> DataFrame:
        if key not in self._cache:
            self._cache[key] = self._make(key)
        return self._cache[key]

    @property
    def lineitem(self) -> DataFrame:
        return self._get(D.TAG_LINEITEM)

    @property
    def orders(self) -> DataFrame:
        return self._get(D.TAG_ORDERS)

    @property
    def customer(self) -> DataFrame:
        return self._get(D.TAG_CUSTOMER)

    @property
    def dead_letter(self) -> DataFrame:
        return self._get("dead")


def route(
    lines: DataFrame,
    on_error: str = "fail",
    strict_op: bool = False,
    seq_mode: str = SEQ_FIELD,
) -> Routed:
    """Split a DataFrame of change-log lines into the three parsed change
    tables and the dead letter. Lazy: nothing runs until an action."""
    if seq_mode not in (SEQ_FIELD, SEQ_POSITION):
        raise ValueError(f"unknown seq_mode {seq_mode!r}")
    if on_error not in ("fail", "dead_letter"):
        raise ValueError(f"unknown on_error {on_error!r}")
    if seq_mode == SEQ_POSITION:
        lines = with_position_seq(lines)
    return Routed(lines, on_error, strict_op, seq_mode)


class StagedRouted(Routed):
    """Routed tables read back from ``stage``'s Parquet folders."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        super().__init__(None)  # type: ignore[arg-type]
        self._spark, self._path, self._schema = spark, path, schema

    def _make(self, key: str) -> DataFrame:
        staged = self._spark.read.schema(self._schema).parquet(self._path)
        if key == "dead":
            return staged.where("part = '__dead__'").select("value", "tbl", "reason")
        return staged.where(f"part = '{key}'").select("seq", "sgn", *OUTPUT_COLS[key])


def decoded_changes(lines: DataFrame, on_error: str = "fail", strict_op: bool = False,
                    seq_mode: str = SEQ_FIELD) -> DataFrame:
    """All change records in one pass over the text: part (the table's tag, or
    ``__dead__`` for malformed records in ``dead_letter`` mode), value and
    reason (of dead ones), seq, sgn and every table's columns. In ``fail``
    mode a malformed record of a known table, or one too short to have a tag,
    fails the job; unknown tags are dropped as in the reference."""
    cols = ["seq", "sgn", *[c for t in D.TAGS for c in OUTPUT_COLS[t]]]
    d = _decoded(lines, strict_op, seq_mode)
    if on_error == "fail":
        d = checked(d, "nullif(reason, 'unknown_tag')", ["reason", "tbl", *cols])
        return d.where("reason IS NULL").selectExpr(
            "tbl AS part", "CAST(NULL AS STRING) AS value", "tbl", "reason", *cols
        )
    return d.selectExpr(
        "CASE WHEN reason IS NULL THEN tbl ELSE '__dead__' END AS part",
        "CASE WHEN reason IS NULL THEN NULL ELSE value END AS value",
        "tbl", "reason", *cols,
    )


def stage(spark: SparkSession, lines: DataFrame, path: str, strict_op: bool = False,
          on_error: str = "dead_letter", seq_mode: str = SEQ_FIELD,
          keep: dict[str, Column] | None = None) -> Routed:
    """Route once: one scan of the text and one write, Parquet partitioned by
    table (``part=LI/OR/CU``, malformed lines in ``part=__dead__`` with their
    text and reason). Later reads are columnar and pruned to one table's
    partition and columns. ``keep`` holds a condition per table; rows that
    fail it are not written. Lines with their position (``_pos_seq``) are
    taken as they are."""
    if seq_mode == SEQ_POSITION and "_pos_seq" not in lines.columns:
        lines = with_position_seq(lines)
    d = decoded_changes(lines, on_error, strict_op, seq_mode)
    if keep is not None:
        wanted = F.col("part") == "__dead__"
        for tag, condition in keep.items():
            wanted = wanted | ((F.col("part") == tag) & condition)
        d = d.where(wanted)
    d.write.mode("overwrite").partitionBy("part").parquet(path)
    return StagedRouted(spark, path, d.schema)
