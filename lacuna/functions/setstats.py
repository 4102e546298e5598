"""Set identity and set digests as map-side-combinable aggregates.

A set of object ids is never materialised as one value. Every set is
summarised by seven numbers that can be combined from the summaries of
disjoint parts (sum / min / max / bit_xor), so Spark computes them with a
partial (map-side) hash aggregate and no group is ever held in one task:

====  =====================================  =========
n     number of members                      sum
lo    smallest id                            min
hi    largest id                             max
x1    xor of xxhash64(id)                    bit_xor
x2    xor of xxhash64(salt, id)              bit_xor
s1    sum of id mod M1                       sum
s2    sum of (id mod M2)^2                   sum
====  =====================================  =========

``(n, lo, x1, x2)`` is the *fingerprint* used as the class id when sets are
deduplicated by content: two different sets share it only if they have the
same size and smallest member and both 64-bit xor-hashes cancel over their
symmetric difference (about 2^-128 per pair).  ``(n, lo, hi, s1, s2)`` is
the *digest* that result queries report; it is made of plain integer
arithmetic so that the DuckDB oracle computes exactly the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values shared with the oracle SQL (see lacuna/plans/oracle.py).
M1 = 1000003
M2 = 2039
SALT = "lacuna"

STATS = ("n", "lo", "hi", "x1", "x2", "s1", "s2")
FINGERPRINT = ("n", "lo", "x1", "x2")
DIGEST = ("n", "lo", "hi", "s1", "s2")


def unit_stats(obj: Column | str) -> list[Column]:
    """Row-level stats of the singleton ``{obj}`` (no aggregation)."""
    o = F.col(obj) if isinstance(obj, str) else obj
    return [
        F.lit(1).cast("bigint").alias("n"),
        o.alias("lo"),
        o.alias("hi"),
        F.xxhash64(o).alias("x1"),
        F.xxhash64(F.lit(SALT), o).alias("x2"),
        (o % M1).alias("s1"),
        ((o % M2) * (o % M2)).alias("s2"),
    ]


def object_stats(obj: Column | str) -> list[Column]:
    """Aggregate expressions: stats of the set of ``obj`` values in a group."""
    o = F.col(obj) if isinstance(obj, str) else obj
    return [
        F.count(o).alias("n"),
        F.min(o).alias("lo"),
        F.max(o).alias("hi"),
        F.bit_xor(F.xxhash64(o)).alias("x1"),
        F.bit_xor(F.xxhash64(F.lit(SALT), o)).alias("x2"),
        F.sum(o % M1).alias("s1"),
        F.sum((o % M2) * (o % M2)).alias("s2"),
    ]


def merge_stats(prefix: str = "") -> list[Column]:
    """Aggregate expressions: stats of a union of *disjoint* parts."""
    c = lambda name: F.col(prefix + name)
    return [
        F.sum(c("n")).alias("n"),
        F.min(c("lo")).alias("lo"),
        F.max(c("hi")).alias("hi"),
        F.bit_xor(c("x1")).alias("x1"),
        F.bit_xor(c("x2")).alias("x2"),
        F.sum(c("s1")).alias("s1"),
        F.sum(c("s2")).alias("s2"),
    ]


def fingerprint(prefix: str = "") -> Column:
    """Content key of a set, as a struct usable in joins and group-bys."""
    return F.struct(*[F.col(prefix + k).alias(k) for k in FINGERPRINT])

