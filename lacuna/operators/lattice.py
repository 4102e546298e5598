"""Stats of the blocks of maxA attribute by attribute, without their memberships.

A value tuple's block is the union of the patterns that agree with it or are missing, attribute by attribute.  Patterns are
disjoint, so its stats are a sum over patterns, and the sum can be taken one attribute after the other: after each step a
key holds values of the tuple for the attributes done and cells of the pattern for the others, and equal keys are merged
before the next attribute multiplies them.  No step has more keys than there are tuples, ``∏ (values + 1)``, or than
memberships, and a key reaches the next step once, however many patterns stand behind it.

The way back, from marked tuples to the patterns below them, goes by the same steps.

A missing cell of an attribute with many values meets all of them.  These are dealt out in runs of ``RUN`` codes first, so
few keys with wide gaps do not end in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.setstats import STATS, merge_stats
from lacuna.operators.blocks import Cost
from lacuna.operators.codes import Coding

# Codes that one row is expanded to in its own task.
RUN = 256
# Tuples for each task that writes such runs out.
TASK_TUPLES = 1 << 19


@dataclass
class Lattice:
    """All value tuples over ``attrs``, as packed codes ``cid``; a complete pattern's key is its own tuple."""

    coding: Coding
    attrs: list[str]
    tuples: int

    def _order(self) -> list[str]:
        return sorted(self.attrs, key=lambda a: self.coding.sizes[a])  # wide domains last: few keys meet them

    def sums(self, rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        """``(cid, keys..., stats)`` of every block that holds a pattern of ``rows`` ``(u, keys..., stats)``."""
        rows = rows.select(F.col("u").bitwiseAND(self.coding.kept(self.attrs)).alias("cid"), *keys, *STATS)
        for a in self._order():
            rows = self._widened(rows, a, keys).groupBy("cid", *keys).agg(*merge_stats())
        return rows

    def _widened(self, rows: DataFrame, a: str, keys: tuple[str, ...]) -> DataFrame:
        """``rows`` with their own code of ``a``, and with every code and 0 where they miss it."""
        size, shift = self.coding.sizes[a], self.coding.shift[a]
        rest, miss = [*(f"`{k}`" for k in keys), *STATS], f"(cid & {self.coding.mask[a]}L) = 0"
        if size < RUN:
            rows = rows.selectExpr("cid", *rest, f"explode(sequence(0L, if({miss}, {size}L, 0L))) AS _c")
        else:
            rows = rows.selectExpr("cid", *rest, f"explode(sequence(0L, if({miss}, {size // RUN}L, 0L))) AS _r")
            rows = rows.repartition(max(1, math.ceil(self.tuples / TASK_TUPLES)), "cid", *keys, "_r")
            last = f"if({miss}, least({size}L, _r * {RUN} + {RUN - 1}), 0L)"
            rows = rows.selectExpr("cid", *rest, f"explode(sequence(_r * {RUN}, {last})) AS _c")
        return rows.selectExpr(f"cid + shiftleft(_c, {shift}) AS cid", *rest)

    def below(self, marked: DataFrame, keys: tuple[str, ...], mark: str) -> DataFrame:
        """``(u, keys..., mark)``: pattern keys compatible with a tuple of ``marked`` ``(cid, keys..., mark)``, the largest mark.

        Keys that no pattern has are among them; join the patterns.
        """
        for a in reversed(self._order()):
            own = F.col("cid").bitwiseAND(self.coding.mask[a])
            both = F.explode(F.when(own == 0, F.array("cid")).otherwise(F.array(F.col("cid"), F.col("cid") - own)))
            marked = marked.select(both.alias("cid"), *keys, mark).groupBy("cid", *keys).agg(F.max(mark).alias(mark))
        return marked.withColumnRenamed("cid", "u")


def lattice(coding: Coding, attrs: list[str], cost: Cost) -> Lattice | None:
    """The tuples over ``attrs`` where there are few for the patterns; None where blocks are better sought (``blocks``)."""
    from lacuna.operators import aggregate as limits

    tuples = math.prod(coding.sizes[a] + 1 for a in attrs)
    return Lattice(coding, attrs, tuples) if tuples <= limits.EXPAND_FACTOR * cost.patterns + limits.EXPAND_MIN else None
