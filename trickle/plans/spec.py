"""The maintained query, as parameters.

The reference keeps exactly one query up to date: TPC-H Q3 without ORDER BY
and LIMIT, over the foreign-key chain lineitem -> orders -> customer. Its date
and segment are literals there; here they are parameters with the same
defaults.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

# Fixed values that must equal the reference's for equal results.
DEFAULT_DATE = "1995-03-13"
DEFAULT_SEGMENT = "AUTOMOBILE"


@dataclass(frozen=True)
class Q3Spec:
    """Q3 filters: l_shipdate > date, o_orderdate < date, c_mktsegment = segment."""

    date: str = DEFAULT_DATE
    segment: str = DEFAULT_SEGMENT

    def __post_init__(self) -> None:
        _dt.date.fromisoformat(self.date)  # reject malformed dates early

    @property
    def as_date(self) -> _dt.date:
        return _dt.date.fromisoformat(self.date)


Q3 = Q3Spec()
Q3_1998 = Q3Spec(date="1998-03-13")
