"""The missing-value marker and its predicate.

A cell is missing when it is SQL NULL or exactly ``'*'``.  A value that only
*contains* ``'*'`` is an ordinary value.  Every attribute is compared as a
string, so numeric and string columns behave alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the missing marker of the input format.
MISSING = "*"


def is_missing(c: Column | str) -> Column:
    v = (F.col(c) if isinstance(c, str) else c).cast("string")
    return v.isNull() | (v == F.lit(MISSING))


def normalize(c: Column | str) -> Column:
    """Cast to string and map NULL to the missing marker."""
    v = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(v.isNull(), F.lit(MISSING)).otherwise(v)


def is_complete(attrs: list[str]) -> Column:
    """True when none of ``attrs`` is missing (columns already normalized)."""
    cond = F.lit(True)
    for a in attrs:
        cond = cond & (F.col(a) != F.lit(MISSING))
    return cond
