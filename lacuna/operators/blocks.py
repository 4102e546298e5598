"""maxA over coded patterns: cheap patterns expanded in one pass, costly ones folded, merged by content.

A block is ``P(t)`` for a value tuple ``t``: all patterns that agree with ``t`` or are missing, attribute by attribute.  A
pattern lies in ``∏ (values + 1)`` blocks, the product running over its missing cells, so what it costs to write its
memberships out depends on its mask of missing cells alone.

* Patterns of cheap masks (*light*: all that fit the budget, cheapest first) are expanded to their tuples, generated from
  the dense codes without a join.
* A pattern of a costly mask (*heavy*) is never expanded.  A tuple meets at most one pattern of each mask, namely its own
  codes with zeros at the mask.  So the tuples that light patterns reach are joined with the heavy patterns on that key:
  at most one row for each tuple and heavy mask.
* Tuples that heavy patterns alone reach need only their distinct sets.  A fold over the heavy patterns yields these sets,
  each with the number of tuples that give it.  The sets whose number exceeds that of light tuples with this heavy part
  are blocks of their own.  Values that no heavy pattern has act alike in the fold and are one class with their count.

``memberships`` then lists the blocks of any rows that carry a pattern key; nothing is dropped or cut off.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.setstats import STATS, fingerprint, merge_stats
from lacuna.operators.codes import Coding
from lacuna.operators.sets import distinct_family
from lacuna.plans.tuning import cut_lineage

# Rows of the expansion: light patterns are taken while they stay under EXPAND_FACTOR * patterns + EXPAND_MIN ...
EXPAND_FACTOR = 16
EXPAND_MIN = 1_000_000
# ... and while no single pattern, whose rows one task writes, has more than this.
EXPAND_PER_PATTERN = 5_000_000
# Heavy masks looked up for each light tuple; with more of them all patterns are folded.
HEAVY_MASKS = 64
# Steps of the cost histogram for each power of two.
_STEPS = 8


class CostExceeded(ValueError):
    """maxA was estimated above the caller's cap; nothing has been expanded or folded."""


@dataclass
class Cost:
    rows: int                # memberships of all blocks, were every pattern expanded
    patterns: int
    largest: int             # of one pattern
    light: int | None        # cost step up to which patterns are light; None: all are
    sizes: dict[str, int]    # regular values of each attribute


def _step(coding: Coding, attrs: list[str]):
    return F.floor(F.log2(coding.expansion(attrs)) * _STEPS)


def measure(pats: DataFrame, coding: Coding, attrs: list[str], factor: int | None = None, least: int | None = None,
            per_pattern: int | None = None) -> Cost:
    """Cost of the blocks and where light patterns end: one aggregate of at most ``_STEPS * KEY_BITS`` rows."""
    from lacuna.operators import aggregate as limits

    factor = limits.EXPAND_FACTOR if factor is None else factor
    least = limits.EXPAND_MIN if least is None else least
    per_pattern = limits.EXPAND_PER_PATTERN if per_pattern is None else per_pattern
    cost = coding.expansion(attrs)
    found = pats.select(cost.alias("c"), _step(coding, attrs).alias("s")).groupBy("s").agg(
        F.sum("c").alias("rows"), F.max("c").alias("most"), F.count(F.lit(1)).alias("n")).collect()
    found = sorted((int(r["s"]), int(r["rows"]), int(r["most"]), int(r["n"])) for r in found)
    patterns = sum(n for *_, n in found)
    budget, total, light = factor * patterns + least, 0, None
    for step, rows, most, _ in found:
        if step and (total + rows > budget or most > per_pattern):
            break
        total, light = total + rows, step
    every = not found or light == found[-1][0]
    return Cost(sum(r for _, r, *_ in found), patterns, max((m for *_, m, _ in found), default=0), None if every else light, dict(coding.sizes))


def guard(cost: Cost, max_rows: int | None) -> None:
    """Raises where a cap was given and the estimate exceeds it; there is no cap by default."""
    if max_rows is not None and cost.rows > max_rows:
        raise CostExceeded(
            f"maxA has {cost.rows} memberships of {cost.patterns} patterns in value tuples, above max_rows={max_rows}; "
            f"largest pattern {cost.largest}; values of each attribute {cost.sizes}"
        )


@dataclass
class Blocks:
    """The blocks of maxA over ``attrs``; ``cid`` is the packed value tuple, negative for a block of heavy patterns alone."""

    coding: Coding
    attrs: list[str]
    light: int | None
    links: DataFrame | None  # (cid, u): the blocks of heavy patterns

    def memberships(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``u``) once for each block their pattern lies in, with its ``cid``."""
        if self.light is None:
            return self.coding.expand(rows, self.attrs)
        cheap = self.coding.expand(rows.where(_step(self.coding, self.attrs) <= self.light), self.attrs)
        costly = rows.where(_step(self.coding, self.attrs) > self.light).join(self.links, "u")
        return cheap.unionByName(costly.select(*cheap.columns))


def find_blocks(pats: DataFrame, coding: Coding, attrs: list[str], cost: Cost) -> Blocks | None:
    """The blocks of all patterns ``(u, stats)``; None where the heavy masks are too many to look up."""
    if cost.light is None:
        return Blocks(coding, attrs, None, None)
    step = _step(coding, attrs)
    heavy = cut_lineage(pats.where(step > cost.light).select("u", *STATS), tag="heavy")
    masks = heavy.select(coding.missing_bits(attrs).alias("m")).distinct().limit(HEAVY_MASKS + 1).collect()
    if len(masks) > HEAVY_MASKS:
        return None
    masks = sorted(r["m"] for r in masks)
    tuples = cut_lineage(coding.expand(pats.where(step <= cost.light).select("u"), attrs).select("cid").distinct(), tag="tuples")
    keep = [coding.kept([a for i, a in enumerate(attrs) if not m >> i & 1]) for m in masks]
    each = F.inline(F.array(*[F.struct(F.lit(k).cast("bigint").alias("keep"), F.lit(m).cast("bigint").alias("m")) for k, m in zip(keep, masks)]))
    keys = tuples.select("cid", each).select("cid", F.col("cid").bitwiseAND(F.col("keep")).alias("u"), "m")
    # a tuple with the block of missing cells at a kept attribute holds no pattern of this mask
    keys = keys.where(coding.missing_bits(attrs) == F.col("m")).drop("m")
    part = coding.kept(attrs)
    own = heavy.select(F.col("u").alias("_u"), F.col("u").bitwiseAND(part).alias("u"), *STATS)
    reached = cut_lineage(keys.join(own, "u").select("cid", F.col("_u").alias("u"), *STATS), tag="reached")
    alone = heavy_alone(heavy, reached, coding, attrs)
    return Blocks(coding, attrs, cost.light, reached.select("cid", "u").unionByName(alone))


def heavy_alone(heavy: DataFrame, reached: DataFrame, coding: Coding, attrs: list[str]) -> DataFrame:
    """``(cid, u)`` of the blocks that hold heavy patterns alone; ``cid`` is negative."""
    fam, sets = fold(heavy, coding, attrs)
    seen = reached.groupBy("cid").agg(*merge_stats()).groupBy(fingerprint().alias("fp")).agg(F.count(F.lit(1)).alias("by"))
    left = sets.join(seen, sets["cid"] == seen["fp"], "left").where(F.col("tuples") > F.coalesce(F.col("by"), F.lit(0)))
    ids = cut_lineage(left.select(sets["cid"].alias("fp"), (F.lit(-1) - F.monotonically_increasing_id()).alias("id")), tag="alone")
    return fam.join(ids, F.col("cid") == F.col("fp")).select(F.col("id").alias("cid"), "u")


def fold(pats: DataFrame, coding: Coding, attrs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct blocks of ``pats`` alone, ``(cid, u, stats)``, and ``(cid, tuples)``: how many value tuples give each.

    Refinement, attribute by attribute, keyed by content after each step.  ``tuples`` fits a BIGINT, as tuples do.
    """
    counts = pats.agg(*[F.countDistinct(F.when(~coding.absent(a), coding.field(a))).alias(a) for a in attrs]).collect()[0]
    fam = None
    for a in attrs:
        values = pats.select(coding.field(a).alias("v")).where("v <> 0").distinct()
        others = coding.sizes[a] + 1 - int(counts[a])  # values no pattern here has, and the block of missing cells
        one = F.lit(1).cast("bigint")
        vmap = values.select(F.col("v").alias("key"), F.col("v").alias("value"), one.alias("many"))
        vmap = vmap.unionByName(values.select(F.lit(0).cast("bigint").alias("key"), F.col("v").alias("value"), one.alias("many")))
        rest = pats.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("value"),
                                                 F.lit(others).cast("bigint").alias("many"))
        vmap = vmap.unionByName(rest)
        own = pats.withColumn("key", coding.field(a)).join(vmap, "key").drop("key")
        if fam is None:
            pairs = own.select(F.struct(F.lit(0).alias("f"), F.col("value").alias("g")).alias("cid"), "u", *STATS, F.col("many").alias("tuples"))
        else:
            both = fam.join(own.select("u", "value", "many"), "u")
            pairs = both.select(F.struct(F.col("cid").alias("f"), F.col("value").alias("g")).alias("cid"), "u", *STATS,
                                (F.col("tuples") * F.col("many")).alias("tuples"))
        pairs = cut_lineage(pairs, tag="pairs")
        per = pairs.groupBy("cid").agg(*merge_stats(), F.first("tuples").alias("tuples"))
        sets = per.groupBy(fingerprint().alias("fp")).agg(F.sum("tuples").alias("tuples"), F.min("cid").alias("one"))
        sets = cut_lineage(sets, tag="sets")
        fam = pairs.drop("tuples").join(sets, F.col("cid") == F.col("one")).select(F.col("fp").alias("cid"), "u", *STATS, "tuples")
    return fam.drop("tuples"), sets.select(F.col("fp").alias("cid"), "tuples")


def by_content(fam: DataFrame, verify: bool = False) -> DataFrame:
    """``fam`` ``(cid, u, stats)`` with one class for each distinct set, keyed by its fingerprint.

    With ``verify`` equal fingerprints are held against the members (``sets.verified_classes``).
    """
    if verify:
        return distinct_family(fam, verify=True)
    per = fam.groupBy("cid").agg(*merge_stats())
    one = cut_lineage(per.groupBy(fingerprint().alias("fp")).agg(F.min("cid").alias("one")), tag="distinct")
    return fam.join(one, F.col("cid") == F.col("one")).select(F.col("fp").alias("cid"), "u", *STATS)
