"""The Q3 measure, in exact arithmetic.

The reference adds and subtracts doubles, so its sums depend on arrival order.
Here a price (below 10^12) and a discount (below 100) of up to eight decimals
are exact decimals, and their product is a whole number of 10^-16
(``VALUE_SQL``): at scale 0 Spark cuts no digits of a product or sum. It
becomes a DOUBLE only at the output, rounded once.

Any other number the reference takes (longer, larger, smaller, with an
exponent) is *far*: both factors stay the doubles they are and their product
(``FAR_SQL``) is summed beside the exact ones, as the reference sums it.

``money`` (two decimals) renders the base tables' prices as text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"

# The exact part of change rows, in units of 10^-SCALE, and the far part.
PRICE, DISCOUNT, SCALE = "decimal(20,8)", "decimal(10,8)", 16
VALUE_SQL = (
    "CAST(l_extendedprice * 100000000BD AS DECIMAL(20,0))"
    " * CAST((1 - l_discount) * 100000000BD AS DECIMAL(11,0))"
)
FAR_SQL = "l_price_far * (1D - l_discount_far)"

FACTOR = "decimal(15,4)"  # of the base tables' factors


def money(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(MONEY)


def revenue(price: Column | str, discount: Column | str) -> Column:
    """price * (1 - discount), both as DECIMAL(15,4)."""
    p, d = (F.col(c) if isinstance(c, str) else c for c in (price, discount))
    return p.cast(FACTOR) * (F.lit(1) - d.cast(FACTOR))


def weighted_sql(w: str) -> tuple[str, str]:
    """A change row's exact and far parts times the whole number ``w``; 0 for
    the part it does not have."""
    return f"coalesce({w} * ({VALUE_SQL}), 0BD)", f"coalesce({w} * ({FAR_SQL}), 0D)"


def amount_sql(exact: str, far: str) -> str:
    """The DOUBLE of an exact sum (units of 10^-SCALE) and a far sum."""
    return f"CAST(concat(CAST({exact} AS STRING), 'E-{SCALE}') AS DOUBLE) + {far}"


def to_double(c: Column) -> Column:
    return c.cast("double")
