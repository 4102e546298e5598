"""Dense codes for attribute values, so that a value pattern is one BIGINT.

``dictionary`` numbers the regular values of every attribute from 1 in value order; a missing cell has code 0.  The
numbering is distributed: distinct values are range-partitioned by (attribute, value) and numbered within their
partition, and what earlier partitions hold of the attribute is added (one figure for each attribute and partition).
No task sees a whole domain.

A pattern's key packs the codes of its cells into one number.  Joins, groupings and value tuples of maxA then work on
eight bytes, and a missing cell shows as a field of zeros.  Where the domains need more than ``KEY_BITS`` bits together,
``fits`` is false and keys stay structs of the values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.missing import MISSING
from lacuna.plans.tuning import BROADCAST_ROWS, cut_lineage

KEY_BITS = 62


@dataclass
class Coding:
    """The codes of some attributes: ``table`` is ``(key, code)`` with ``key`` = attribute number and value."""

    attrs: list[str]
    sizes: dict[str, int]  # regular values of each attribute
    table: DataFrame | None

    def __post_init__(self) -> None:
        self.shift, self.mask, at = {}, {}, 0
        for a in self.attrs:
            bits = self.sizes[a].bit_length()
            self.shift[a], self.mask[a] = at, ((1 << bits) - 1) << at
            at += bits
        self.fits = at <= KEY_BITS

    def encode(self, rows: DataFrame) -> DataFrame:
        """``rows`` (normalized attributes) with their pattern key ``u``.

        The table of codes is sent to all tasks where it was counted under ``BROADCAST_ROWS``, once for all attributes.
        """
        if not self.fits:
            return rows.withColumn("u", F.struct(*self.attrs))
        codes = self.table
        if sum(self.sizes.values()) <= BROADCAST_ROWS:
            codes = F.broadcast(codes)
        u, names = "0L", []
        for i, a in enumerate(self.attrs):
            if not self.sizes[a]:
                continue
            key, code = f"_key{i}", f"_code{i}"
            own = codes.selectExpr(f"key AS {key}", f"code AS {code}")
            rows = rows.join(own, F.expr(f"concat('{i}:', `{a}`) = {key}"), "left")
            u += f" + shiftleft(if(`{a}` = '{MISSING}', 0L, {code}), {self.shift[a]})"
            names += [key, code]
        return rows.withColumn("u", F.expr(u)).drop(*names)

    def absent(self, attr: str, u: str = "u") -> Column:
        """Whether the pattern key ``u`` is missing on ``attr``."""
        return F.col(u).bitwiseAND(self.mask[attr]) == 0

    def field(self, attr: str, u: str = "u") -> Column:
        """The code of ``attr`` in ``u``."""
        return F.shiftright(F.col(u).bitwiseAND(self.mask[attr]), self.shift[attr])

    def complete(self, u: str = "u") -> Column:
        cond = F.lit(True)
        for a in self.attrs:
            cond = cond & (~self.absent(a, u) if self.fits else F.col(u)[a] != F.lit(MISSING))
        return cond

    def missing_bits(self, attrs: list[str], u: str = "u") -> Column:
        """Bit ``i`` is set where the key is missing on ``attrs[i]``."""
        bits = F.lit(0).cast("bigint")
        for i, a in enumerate(attrs):
            bits = bits + F.when(self.absent(a, u), F.lit(1 << i)).otherwise(F.lit(0))
        return bits

    def kept(self, attrs: list[str]) -> int:
        """The bits of ``attrs`` in a key."""
        return sum(self.mask[a] for a in attrs)

    def expansion(self, attrs: list[str], u: str = "u") -> Column:
        """Value tuples over ``attrs`` that a pattern is compatible with: ``∏ (values + 1)`` over its missing cells."""
        return F.expr(" * ".join(f"if((`{u}` & {self.mask[a]}L) = 0, {float(self.sizes[a] + 1)!r}D, 1.0D)" for a in attrs))

    def expand(self, rows: DataFrame, attrs: list[str], out: str = "cid") -> DataFrame:
        """``rows`` once for each value tuple over ``attrs`` they are compatible with, as packed codes ``out``.

        A regular cell keeps its code, a missing one takes every code and 0, the block of missing cells.  Codes are
        dense, so the tuples are generated in place, without a join.
        """
        rows = rows.withColumn(out, F.col("u").bitwiseAND(self.kept(attrs)))
        rest = [c for c in rows.columns if c != out]
        for a in attrs:
            last = f"if((u & {self.mask[a]}L) = 0, {self.sizes[a]}L, 0L)"
            rows = rows.selectExpr(*(f"`{c}`" for c in rest), f"`{out}`", f"explode(sequence(0L, {last})) AS _c")
            rows = rows.selectExpr(*(f"`{c}`" for c in rest), f"`{out}` + shiftleft(_c, {self.shift[a]}) AS `{out}`")
        return rows


def dictionary(rows: DataFrame, attrs: list[str]) -> Coding:
    """Codes of all regular values that ``attrs`` have in ``rows`` (normalized columns; best a written table)."""
    cells = F.array(*[F.struct(F.lit(i).alias("attr"), F.col(a).alias("value")) for i, a in enumerate(attrs)])
    values = rows.select(F.inline(cells)).where(F.col("value") != F.lit(MISSING)).distinct()
    ranged = values.repartitionByRange("attr", "value").sortWithinPartitions("attr", "value")
    ranged = cut_lineage(ranged.withColumn("nth", F.monotonically_increasing_id()), tag="codes")
    part = F.shiftright("nth", 33).alias("part")  # the partition that numbered the value
    held = ranged.groupBy("attr", part).agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    sizes, base = dict.fromkeys(attrs, 0), []
    for r in sorted(held):  # at most one row for each attribute and partition
        base.append((r["attr"], r["part"], sizes[attrs[r["attr"]]] + 1 - r["first"]))
        sizes[attrs[r["attr"]]] += r["n"]
    shift = ranged.sparkSession.createDataFrame(base, "attr int, part bigint, base bigint")
    numbered = ranged.withColumn("part", part).join(F.broadcast(shift), ["attr", "part"])
    table = numbered.select(F.concat(F.col("attr").cast("string"), F.lit(":"), F.col("value")).alias("key"), (F.col("nth") + F.col("base")).alias("code"))
    return Coding(list(attrs), sizes, table)
