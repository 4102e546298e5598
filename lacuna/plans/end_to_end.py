"""What users call: DataFrame in, DataFrame out.

``classes``      per-attribute certain and possible classes (long form)
``aggregate``    minA / maxA over many attributes (long form)
``approximate``  CL, CU, PL, PU, PUr of each target (sets with stats, or members)
``approximate_families``  the same from caller-supplied families
``summary``      per (d, kind): number of classes, number of covered objects
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.setstats import DIGEST, fingerprint
from lacuna.operators import approx as _approx
from lacuna.operators import classes as _classes
from lacuna.operators.aggregate import aggregate as _aggregate
from lacuna.operators.aggregate import aggregate_status, coded_patterns, pattern_units, patterns, possible_stats
from lacuna.operators.blocks import by_content
from lacuna.operators.sets import distinct_sets, family_members, family_stats
from lacuna.plans.tuning import cut_lineage


_internal = _classes.prepare_private


def classes(df: DataFrame, obj: str, attrs: list[str], kind: str | None = None) -> DataFrame:
    """``(kind, attr, value, obj)`` for kind in certain / possible (only ``kind`` if given)."""
    return _classes.classes(df, obj, attrs, kind)


def aggregate(df: DataFrame, obj: str, attrs: list[str], kind: str = "certain",
              members: bool = True, method: str = "auto", max_rows: int | None = None, verify: bool = False) -> DataFrame:
    """minA (``kind='certain'``) or maxA (``'possible'``).

    ``members=True``: ``(class_id, obj)``; otherwise one row per class with
    its size and digest.  ``max_rows`` caps what maxA may cost: above it,
    ``CostExceeded`` is raised with the estimate before any class is built.
    ``verify`` (members of maxA): classes are merged where their members are
    equal, not on equal fingerprints alone; ``class_id`` then also tells sets
    of one fingerprint apart.
    """
    pdf, attrs = _internal(df, obj, attrs)
    if kind == "certain":
        pats = patterns(pdf, attrs)
        if members:
            return family_members(_aggregate(pats, attrs, kind), pattern_units(pdf, attrs)).withColumnRenamed("cid", "class_id")
        # complete patterns are distinct and disjoint blocks: one aggregate
        return _aggregate(pats, attrs, kind).select(F.col("cid").alias("class_id"), *DIGEST)
    if method == "fold":
        pats, coding = cut_lineage(patterns(pdf, attrs), tag="pats"), None  # read once per attribute
    else:
        pats, coding = coded_patterns(pdf, attrs)
    stats = possible_stats(pats, attrs, coding, max_rows) if method == "auto" and not members else None
    if stats is not None:
        return distinct_sets(stats, []).select(fingerprint().alias("class_id"), *DIGEST)
    fam = _aggregate(pats, attrs, kind, distinct=members and not verify, method=method, coding=coding, max_rows=max_rows)
    if members:
        fam = by_content(fam, verify=True) if verify else fam
        units = coding.encode(pdf).select("u", "obj") if coding is not None else pattern_units(pdf, attrs)
        return family_members(fam, units).withColumnRenamed("cid", "class_id")
    # set rows only: duplicates are removed on the stats, not on memberships
    sets = distinct_sets(family_stats(fam), [])
    return sets.select(fingerprint().alias("class_id"), *DIGEST)


def estimate_possible(df: DataFrame, obj: str, attrs: list[str]) -> dict:
    """Cost of maxA before running it: rows of the one-pass expansion
    (``Σ_p ∏ (|dom(a)|+1)`` over patterns missing on a), number of patterns,
    distinct values per attribute, and the method ``aggregate`` would pick."""
    from lacuna.operators.aggregate import EXPAND_FACTOR, EXPAND_MIN, EXPAND_PER_PATTERN, expansion_profile

    pdf, names = _internal(df, obj, attrs)
    rows, n, dom, peak = expansion_profile(patterns(pdf, names), names)
    dom = {a: dom[nm] for a, nm in zip(attrs, names)}
    bounded = rows <= EXPAND_FACTOR * n + EXPAND_MIN and peak <= EXPAND_PER_PATTERN
    method = "expand" if len(attrs) > 1 and bounded else "fold"
    return {"expansion_rows": rows, "patterns": n, "largest_pattern_rows": peak, "domains": dom, "method": method}


def status(df: DataFrame, obj: str, attrs: list[str], kind: str = "certain") -> DataFrame:
    """``(attrs, status)``: ``not_exist`` when the aggregated family is empty.

    maxA is empty only for an empty table (every object lies in the block of
    its own pattern), so the possible status needs no aggregation.
    """
    label = ",".join(str(i + 1) for i in range(len(attrs)))
    pdf, attrs = _internal(df, obj, attrs)
    if kind == "possible":
        return aggregate_status(pdf.select(F.col("obj").alias("u")), label)
    fam = _aggregate(patterns(pdf, attrs), attrs, kind)
    return aggregate_status(fam, label)


def _parts(df, obj, attrs, targets, kinds=_approx.KINDS, method="auto", max_rows=None, members=False):
    if isinstance(targets, str):
        pdf, names = _internal(df, obj, attrs, targets)
        return _approx.fast_parts(pdf, names, "_target", kinds=kinds, method=method, max_rows=max_rows, members=members)
    pdf, names = _internal(df, obj, attrs)
    return _approx.fast_parts(pdf, names, targets, kinds=kinds, method=method, max_rows=max_rows, members=members)


def approximate(df: DataFrame, obj: str, attrs: list[str], targets: str | DataFrame,
                members: bool = False, pooled: bool = False, kinds=None, method: str = "auto",
                max_rows: int | None = None) -> DataFrame:
    """Approximations of each target over ``attrs``.

    ``targets``: a decision column name, or a ``(d, obj)`` DataFrame.
    Returns ``(kind, d, n, lo, hi, s1, s2)`` per distinct set, or with
    ``members=True`` the long form ``(kind, d, class_id, obj)``.
    ``pooled=True`` drops ``d`` and dedupes across targets.  ``kinds`` (a
    subset of CL, CU, PL, PU, PUr) builds only what those kinds need;
    ``method`` picks the maxA method (``auto``, ``fold`` or ``expand``),
    ``max_rows`` caps its estimated cost (``aggregate``; CU alone needs no maxA).
    """
    kinds = tuple(kinds) if kinds else _approx.KINDS
    p = _parts(df, obj, attrs, targets, kinds, method, max_rows, members)
    sets = _approx.fast_sets(p, kinds)
    if members:
        m = _approx.fast_members(p, sets)
        if pooled:
            return m.drop("d").distinct()
        return m
    if pooled:
        return _approx.pooled(sets).select("kind", *DIGEST)
    return _approx.union_kinds(sets).select("kind", "d", *DIGEST)


def approximate_families(min_family: DataFrame, max_family: DataFrame, targets: DataFrame,
                         pooled: bool = False) -> DataFrame:
    """General path on ``(class_id, obj)`` families; ``(kind, d, n, lo, hi, s1, s2)``.

    ``pooled=True`` drops ``d`` and dedupes each kind across targets.
    """
    sets = _approx.general_sets(min_family, max_family, targets)
    if pooled:
        return _approx.pooled(sets).select("kind", *DIGEST)
    return _approx.union_kinds(sets).select("kind", "d", *DIGEST)

def summary(df: DataFrame, obj: str, attrs: list[str], targets: str | DataFrame, kinds=None,
            method: str = "auto", max_rows: int | None = None) -> DataFrame:
    """``(d, kind, n_classes, n_objects)``; computed on pattern units."""
    kinds = tuple(kinds) if kinds else _approx.KINDS
    p = _parts(df, obj, attrs, targets, kinds, method, max_rows)
    sets = _approx.fast_sets(p, kinds)
    return _approx.summary_from(sets, _approx.fast_coverage(p, sets))

