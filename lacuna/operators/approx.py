"""Certain/possible lower and upper approximations of target sets.

Definitions (sets of object ids; minA/maxA from ``aggregate``; X a target):

    CL  {min : some max ⊆ min and max ⊆ X}        whole min
    CU  {min ∩ X ≠ ∅}                              restricted to X
    PL  {max ∩ X ≠ ∅ : some min ⊆ max, min ⊆ X}    restricted to X
    PU  {max : max ∩ X ≠ ∅}                        whole max
    PUr {max ∩ X ≠ ∅}                              restricted to X

Fast path (same table, same attributes).  A complete pattern t is one min
block C(t) and lies in exactly one max block, P(t).  Then ``max ⊆ min`` holds
only for (P(t), C(t)) with |P(t)| = |C(t)|, and ``min ⊆ max`` only for
(C(t), P(t)).  So the theta joins become equi-joins on pattern / block ids
plus count comparisons:

    CL  {C(t) : C(t) ⊆ X, |P(t)| = |C(t)|}
    CU  {C(t) ∩ X}
    PL  {P(t) ∩ X : C(t) ⊆ X}
    PU  {P : P ∩ X ≠ ∅}

General path (families supplied by the caller): containment by anchored
candidate pairs and unit counts (``sets.containment_join``).

Every kind is returned per target ``d`` as distinct sets with their stats.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.missing import MISSING
from lacuna.functions.setstats import FINGERPRINT, STATS, fingerprint, merge_stats, object_stats
from lacuna.operators.aggregate import aggregate_possible, coded_blocks, coded_patterns, pattern_units
from lacuna.operators.blocks import Blocks, fold, guard, measure
from lacuna.operators.codes import Coding, dictionary
from lacuna.operators.lattice import Lattice, lattice
from lacuna.operators.sets import as_family, containment_join, family_stats
from lacuna.plans import tuning
from lacuna.plans.tuning import cut_lineage, split_hot_join

# Result kind labels of the original output (CL, CU, PL, PU);
# PUr (restricted PU) is ours.
KINDS = ("CL", "CU", "PL", "PU", "PUr")


@dataclass
class TableParts:
    """Target-independent frames: computed once per (table, attributes)."""
    pats: DataFrame     # u, stats
    comp: DataFrame     # complete patterns: u, stats
    blocks: Blocks | None  # maxA over coded patterns, where they are
    fam: DataFrame | None  # maxA over pattern units: cid, u, stats
    maxst: DataFrame | None  # cid, stats of each max block
    link: DataFrame | None  # u, cid: the max block of each complete pattern
    objects: Callable[[], DataFrame]  # u, obj; built where members are asked for
    tuples: Lattice | None = None  # in place of blocks and fam where only stats are asked for

    @property
    def units(self) -> DataFrame:
        return self.objects()

    def memberships(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``u``) once for each max block their pattern lies in, with its ``cid``."""
        if self.blocks is not None:
            return self.blocks.memberships(rows)
        return self.fam.select("cid", "u").join(rows, "u")


@dataclass
class FastParts:
    table: TableParts
    objects: Callable[[], DataFrame]  # target memberships with their pattern: d, u, obj
    xp: DataFrame       # per (d, pattern) stats of the pattern's objects in X_d
    mx: DataFrame       # cid, d, stats of max ∩ X_d (non-empty only), with whole: w_* stats of max too
    inside: DataFrame   # d, u, stats: complete patterns with C(t) ⊆ X_d
    whole: bool = False

    @property
    def xo(self) -> DataFrame:
        return self.objects()


def table_parts(pats: DataFrame, attrs: list[str], units: Callable[[], DataFrame], coding: Coding | None = None, cut: bool = True,
                need_max: bool = True, method: str = "auto", max_rows: int | None = None, members: bool = True) -> TableParts:
    """``pats``: (u, stats).  ``u`` is the packed key of ``coding``, or without one the struct of the values.

    Without ``members`` the blocks' stats are summed by attributes where that is bounded (``lattice``).
    """
    comp = pats.where(coding.complete() if coding is not None else complete_key(attrs)).select("u", *STATS)
    if not need_max:  # only CU requested: maxA is not needed at all
        return TableParts(pats, comp, None, None, None, None, units)
    found = fam = None
    if coding is not None:
        cost = measure(pats, coding, attrs)
        guard(cost, max_rows)
        tuples = lattice(coding, attrs, cost) if method == "auto" and not members else None
        if tuples is not None:
            return TableParts(pats, comp, None, None, tuples.sums(pats), comp.select("u", F.col("u").alias("cid")), units, tuples)
        found = coded_blocks(pats, coding, attrs, method, max_rows, cost)
        if found is None:
            fam = fold(pats, coding, attrs)[0]
    else:
        fam = aggregate_possible(with_attrs(pats, attrs).withColumnRenamed("u", "pid"), attrs, cut=cut, distinct=False, method=method, max_rows=max_rows)
    if found is not None:
        # a complete pattern's codes are its value tuple, so it names its own block; blocks may repeat a set under another
        # tuple: kinds that report whole blocks (PU) dedupe by fingerprint, the others are distinct anyway
        fam = found.memberships(pats.select("u", *STATS))
        return TableParts(pats, comp, found, fam, family_stats(fam), comp.select("u", F.col("u").alias("cid")), units)
    if cut:  # read by every kind: write it once (pattern-level)
        fam = cut_lineage(fam, tag="maxa")
    return TableParts(pats, comp, None, fam, family_stats(fam), fam.select("cid", "u").join(comp.select("u"), "u"), units)


def target_parts(tp: TableParts, xo: Callable[[], DataFrame], xp: DataFrame, cut: bool = True,
                 need_mx: bool = True, mx_readers: int = 3, by: DataFrame | None = None) -> FastParts:
    """Frames that depend on the targets (``xo``: d, u, obj; ``xp``: per (d, u) stats).

    ``max ∩ X`` is written once when several kinds read it; a single reader
    uses it in place.  ``by`` (d, u, stats of all objects, ``d`` null for those
    in no target; targets part the objects) also gives the stats of the whole
    blocks, merged over their few targets, so no kind joins them again.
    """
    mx, whole = None, by is not None and need_mx
    if need_mx and tp.maxst is not None:
        rows = by if whole else xp
        mx = tp.tuples.sums(rows, ("d",)) if tp.tuples is not None else tp.memberships(rows).groupBy("cid", "d").agg(*merge_stats())
        if whole:
            w = Window.partitionBy("cid")
            mx = mx.select("*", *[c.over(w).alias(f"w_{k}") for k, c in zip(STATS, plain_merge())])
        if cut and mx_readers > 1:
            mx = cut_lineage(mx, tag="mx")
        mx = mx.where(F.col("d").isNotNull())
    xpc = xp.join(tp.comp.select("u", F.col("n").alias("cn")), "u")
    inside = xpc.where(F.col("n") == F.col("cn")).select("d", "u", *STATS)
    return FastParts(tp, xo, xp, mx, inside, whole)


def plain_merge() -> list:
    """``merge_stats`` without names, for windows."""
    how = {"n": F.sum, "lo": F.min, "hi": F.max, "x1": F.bit_xor, "x2": F.bit_xor, "s1": F.sum, "s2": F.sum}
    return [how[k](k) for k in STATS]


def external_targets(units: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(xo, xp)`` for a ``(d, obj)`` target DataFrame (equi-join on obj)."""
    x = targets.select(F.col("d").cast("string").alias("d"), F.col("obj").cast("bigint").alias("obj")).distinct()
    xo = x.join(units, "obj").select("d", "u", "obj")
    return xo, xo.groupBy("d", "u").agg(*object_stats("obj"))


def with_attrs(pstats: DataFrame, attrs: list[str]) -> DataFrame:
    return pstats.select("u", *[F.col("u")[a].alias(a) for a in attrs], *STATS)


def complete_key(attrs: list[str]):
    """True where the struct key ``u`` has no missing cell."""
    cond = F.lit(True)
    for a in attrs:
        cond = cond & (F.col("u")[a] != F.lit(MISSING))
    return cond


def coded_table(pdf: DataFrame, attrs: list[str], method: str = "auto") -> tuple[DataFrame, DataFrame, Coding | None]:
    """``(pats, units, coding)``: written pattern stats and the objects' keys; packed keys where they fit."""
    if method != "fold":
        pats, coding = coded_patterns(pdf, attrs)
        if coding.fits:
            return pats.select(F.col("pid").alias("u"), *STATS), coding.encode(pdf).select("u", "obj"), coding
        return pats.select(F.col("pid").alias("u"), *STATS), pattern_units(pdf, attrs), None
    units = pattern_units(pdf, attrs)
    return cut_lineage(units.groupBy("u").agg(*object_stats("obj")), tag="pats"), units, None


def fast_parts(pdf: DataFrame, attrs: list[str], targets: str | DataFrame, cut: bool = True,
               kinds: tuple[str, ...] = KINDS, method: str = "auto", max_rows: int | None = None, members: bool = True) -> FastParts:
    """Shared intermediate frames of the fast path.

    ``pdf`` is prepared (``obj`` + normalized attributes).  ``targets`` is
    either the name of a decision column of ``pdf`` or a ``(d, obj)``
    DataFrame of possibly overlapping targets.

    Object-level work is one aggregation: per (target, pattern) stats,
    written once to the checkpoint folder, keyed by packed codes (``codes``),
    for which the attributes' distinct values are read first.  With a decision
    column the pattern stats are merged from it (the targets partition the
    objects); everything after runs on patterns.
    Only the parts the requested ``kinds`` need are built: CU needs no maxA,
    CL no max ∩ X.  ``members``: whether ``fast_members`` will be asked for.
    """
    bad = set(kinds) - set(KINDS)
    if bad:
        raise ValueError(f"unknown kinds {sorted(bad)}; use {KINDS}")
    need_max = bool(set(kinds) - {"CU"})
    mx_readers = len(set(kinds) & {"PL", "PU", "PUr"})
    coding = by = None
    if isinstance(targets, str):
        named = pdf.select(F.col(targets).cast("string").alias("d"), *attrs, "obj")
        coding = dictionary(pdf, attrs) if cut and need_max and method != "fold" else None
        if coding is not None and not coding.fits:
            coding = None
        key = (lambda rows: coding.encode(rows)) if coding is not None else (lambda rows: rows.withColumn("u", F.struct(*attrs)))
        by = key(named).groupBy("d", "u").agg(*object_stats("obj"))
        by = cut_lineage(by, tag="xp") if cut else by
        units, xo = lambda: key(pdf).select("u", "obj"), lambda: key(named).select("d", "u", "obj")
        xp = by.where(F.col("d").isNotNull())
        pstats = by.groupBy("u").agg(*merge_stats())
    elif cut:
        pstats, own, coding = coded_table(pdf, attrs, method if need_max else "fold")
        of, xp = external_targets(own, targets)
        xp = cut_lineage(xp, tag="xp")
        units, xo = lambda: own, lambda: of
    else:
        own = pattern_units(pdf, attrs)
        of, xp = external_targets(own, targets)
        pstats = own.groupBy("u").agg(*object_stats("obj"))
        units, xo = lambda: own, lambda: of
    tp = table_parts(pstats, attrs, units, coding, cut=cut, need_max=need_max, method=method, max_rows=max_rows, members=members)
    return target_parts(tp, xo, xp, cut=cut, need_mx=mx_readers > 0, mx_readers=mx_readers, by=by)


def _dedupe(sets: DataFrame, keys: list[str], loc: str) -> DataFrame:
    """Distinct sets per ``keys`` by fingerprint; smallest locator kept."""
    return sets.groupBy(*keys, *FINGERPRINT).agg(
        F.min(loc).alias(loc), F.first("hi").alias("hi"), F.first("s1").alias("s1"), F.first("s2").alias("s2")
    ).select(*keys, *STATS, loc)


def fast_sets(p: FastParts, kinds: tuple[str, ...] = KINDS) -> dict[str, DataFrame]:
    """Per kind: ``(d, stats..., loc)`` with ``loc`` = pattern ``u`` or block ``cid``."""
    out: dict[str, DataFrame] = {}
    own = None
    if {"CL", "PL"} & set(kinds):  # the max block of each complete pattern inside its target
        own = p.inside.withColumn("cid", F.col("u")) if p.table.blocks is not None or p.table.tuples is not None else p.inside.join(p.table.link, "u")
    if "CL" in kinds:
        size = p.mx.select("cid", "d", F.col("w_n").alias("mn")) if p.whole else p.table.maxst.select("cid", F.col("n").alias("mn"))
        out["CL"] = own.join(size, ["cid", "d"] if p.whole else ["cid"]).where(F.col("mn") == F.col("n")).select("d", *STATS, "u")
    if "CU" in kinds:
        out["CU"] = p.xp.join(p.table.comp.select("u"), "u").select("d", *STATS, "u")
    if "PL" in kinds:
        out["PL"] = own.select("d", "cid").join(p.mx, ["cid", "d"]).select("d", *STATS, "cid")
    if "PU" in kinds:
        if p.whole:
            pu = p.mx.select("d", *[F.col(f"w_{k}").alias(k) for k in STATS], "cid")
        else:
            pu = p.mx.select("cid", "d").join(p.table.maxst, "cid").select("d", *STATS, "cid")
        out["PU"] = _dedupe(pu, ["d"], "cid")
    if "PUr" in kinds:
        out["PUr"] = _dedupe(p.mx.select("d", *STATS, "cid"), ["d"], "cid")
    return out


def fast_members(p: FastParts, sets: dict[str, DataFrame]) -> DataFrame:
    """``(kind, d, class_id, obj)``; ``class_id`` is the result set's fingerprint."""
    out = []
    # one size total per side, shared by all kinds
    t_units = p.table.pats.agg(F.sum("n").alias("t")).collect()[0]["t"] or 0
    t_targets = p.xp.agg(F.sum("n").alias("t")).collect()[0]["t"] or 0
    for kind, s in sets.items():
        s = s.withColumn("class_id", fingerprint())
        if "u" in s.columns:
            locs = s.select("d", "class_id", "u")
        else:
            locs = s.select("d", "class_id", "cid").join(p.table.fam.select("cid", "u"), "cid").select("d", "class_id", "u")
        if kind in ("CU", "PL", "PUr"):
            m = split_hot_join(locs, p.xo, ["d", "u"], p.xp.select("d", "u", "n"), total=t_targets)
        else:
            m = split_hot_join(locs, p.table.units, ["u"], p.table.pats.select("u", "n"), total=t_units)
        m = m.select("d", "class_id", "obj")
        out.append(m.select(F.lit(kind).alias("kind"), "d", "class_id", "obj"))
    res = out[0]
    for m in out[1:]:
        res = res.unionByName(m)
    return res


def fast_coverage(p: FastParts, sets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Per kind: ``(d, n_objects)`` = size of the union of the kind's sets."""
    cov = {}
    for kind in ("CL", "CU"):  # disjoint blocks
        if kind in sets:
            cov[kind] = sets[kind].groupBy("d").agg(F.sum("n").alias("n_objects"))
    if "PUr" in sets:
        # every object lies in the block of its own pattern, so the union of
        # all max ∩ X_d is X_d itself - no join with the blocks is needed
        cov["PUr"] = p.xp.groupBy("d").agg(F.sum("n").alias("n_objects"))
    # patterns under the blocks of PL and PU, in one join: every block of PL meets its target, so it is one of PU's
    marks = [sets[k].select("d", "cid", F.lit(k == "PL").alias("pl")) for k in ("PL", "PU") if k in sets]
    if not marks:
        return cov
    if "PU" in sets:  # all blocks that meet X_d, the repeated sets too: what they cover is the same
        marks[-1] = p.mx.select("d", "cid", F.lit(False).alias("pl"))
    held = marks[0] if len(marks) == 1 else marks[0].unionByName(marks[1]).groupBy("d", "cid").agg(F.max("pl").alias("pl"))
    if p.table.tuples is not None:
        du = p.table.tuples.below(held, ("d",), "pl")
    else:
        du = held.join(p.table.fam.select("cid", "u"), "cid").groupBy("d", "u").agg(F.max("pl").alias("pl"))
    if "PU" in sets:
        cov["PU"] = du.join(p.table.pats.select("u", "n"), "u").groupBy("d").agg(F.sum("n").alias("n_objects"))
    if "PL" in sets:
        cov["PL"] = du.where("pl").join(p.xp.select("d", "u", "n"), ["d", "u"]).groupBy("d").agg(F.sum("n").alias("n_objects"))
    return cov


def met_targets(fam: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of ``fam`` once for each target that holds their unit.

    A unit in ``c`` classes and ``t`` targets makes ``c * t`` rows.  Both are counted first; a unit with more rows than
    one task should write is split by class over ``ceil(c * t / bound)`` tasks, its targets going to each.
    """
    per = fam.groupBy("u").agg(F.count(F.lit(1)).alias("c")).join(targets.groupBy("u").agg(F.count(F.lit(1)).alias("t")), "u")
    return split_hot_join(targets, fam, ["u"], per.select("u", (F.col("c") * F.col("t")).alias("n")), rows_per_split=tuning.SPLIT_ROWS, salt="cid")


def general_sets(min_long: DataFrame, max_long: DataFrame, targets: DataFrame) -> dict[str, DataFrame]:
    """Approximations from caller-supplied families ``(class_id, obj)``.

    No lemma applies, so containment is tested explicitly (anchored
    candidates + counts).  Empty sets cannot occur in long form.
    """
    # Duplicate input sets need no dedupe here: every kind is deduped by
    # content at the end and duplicates change no existence test.  Each
    # family is read by several joins below, so it is written once.
    mn = cut_lineage(as_family(min_long), tag="minf")
    mx = cut_lineage(as_family(max_long), tag="maxf")
    xf = targets.select(F.col("d").cast("string").alias("d"), F.col("obj").cast("bigint").alias("u")).distinct()
    minst = family_stats(mn)
    maxst = family_stats(mx)
    xf = cut_lineage(xf, tag="targets")
    nx = met_targets(mn, xf).groupBy("cid", "d").agg(*merge_stats())
    mxx = met_targets(mx, xf).groupBy("cid", "d").agg(*merge_stats())
    min_in = nx.join(minst.select("cid", F.col("n").alias("tn")), "cid").where(F.col("n") == F.col("tn")).select("cid", "d")
    max_in = mxx.join(maxst.select("cid", F.col("n").alias("tn")), "cid").where(F.col("n") == F.col("tn")).select("cid", "d")

    max_in_min = containment_join(mn, mx)   # f = min block, g = max block, min ⊇ max
    cl = (max_in_min.join(max_in.withColumnRenamed("cid", "g"), "g")
          .select("d", F.col("f").alias("cid")).distinct().join(minst, "cid"))
    min_in_max = containment_join(mx, mn)   # f = max block, g = min block, max ⊇ min
    pl = (min_in_max.join(min_in.withColumnRenamed("cid", "g"), "g")
          .select("d", F.col("f").alias("cid")).distinct().join(mxx, ["cid", "d"]))
    pu = mxx.select("cid", "d").join(maxst, "cid")
    raw = {"CL": cl, "CU": nx, "PL": pl, "PU": pu, "PUr": mxx}
    return {k: _dedupe(v.select("d", *STATS, "cid"), ["d"], "cid") for k, v in raw.items()}


def pooled(sets: dict[str, DataFrame]) -> DataFrame:
    """All targets pooled per kind, ``d`` dropped, duplicate sets removed."""
    parts = [s.select(F.lit(k).alias("kind"), *STATS) for k, s in sets.items()]
    allk = parts[0]
    for s in parts[1:]:
        allk = allk.unionByName(s)
    return allk.distinct()


def union_kinds(sets: dict[str, DataFrame]) -> DataFrame:
    """``(kind, d, stats)`` for all kinds."""
    parts = [s.select(F.lit(k).alias("kind"), "d", *STATS) for k, s in sets.items()]
    res = parts[0]
    for s in parts[1:]:
        res = res.unionByName(s)
    return res


def summary_from(sets: dict[str, DataFrame], coverage: dict[str, DataFrame]) -> DataFrame:
    """``(d, kind, n_classes, n_objects)``."""
    parts = []
    for k, s in sets.items():
        nc = s.groupBy("d").agg(F.count(F.lit(1)).alias("n_classes"))
        parts.append(nc.join(coverage[k], "d").select("d", F.lit(k).alias("kind"), "n_classes", "n_objects"))
    res = parts[0]
    for s in parts[1:]:
        res = res.unionByName(s)
    return res
