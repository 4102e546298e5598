"""Set algebra on families in long form.

A *family* is a DataFrame with one row per (class, unit):

    cid   opaque class id (any type; after dedupe the set fingerprint struct)
    u     unit: an object id, or a pattern key standing for all objects
          with one value pattern (units of one family are disjoint)
    n lo hi x1 x2 s1 s2   stats of the unit's objects (setstats.STATS)

Sets are compared by content through their fingerprint, computed with a
partial aggregate; no set is ever collected into one row or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.setstats import STATS, fingerprint, merge_stats, unit_stats


def as_family(long_df: DataFrame, class_col: str = "class_id", obj_col: str = "obj") -> DataFrame:
    """Object-level family from ``(class_col, obj_col)`` rows (duplicates removed)."""
    base = long_df.select(F.col(class_col).alias("cid"), F.col(obj_col).cast("bigint").alias("u")).distinct()
    return base.select("cid", "u", *unit_stats(F.col("u")))


def family_stats(fam: DataFrame) -> DataFrame:
    """``(cid, n, lo, hi, x1, x2, s1, s2)`` per class, map-side combined."""
    return fam.groupBy("cid").agg(*merge_stats())


def distinct_family(fam: DataFrame, verify: bool = False) -> DataFrame:
    """Re-key each class by its content fingerprint and drop duplicate sets.

    The per-class stats are written first: read from a table, their side of
    the many-to-one join back is a shuffle of its own, so AQE may broadcast
    it or split the rows of a hot class.  (Directly on its aggregate, the
    join would share the aggregate's partitions, which AQE cannot split.)

    ``verify=True`` holds equal fingerprints against the members (see
    ``verified_classes``); ``cid`` then also has the field ``again``.
    """
    from lacuna.plans.tuning import cut_lineage

    st = family_stats(fam).select(F.col("cid").alias("old"), fingerprint().alias("cid"))
    if verify:
        st = verified_classes(fam, st).select("old", F.struct("cid.*", "again").alias("cid"))
    st = cut_lineage(st, tag="stats")
    j = fam.join(st, fam["cid"] == st["old"]).select(st["cid"], fam["u"], *[fam[k] for k in STATS])
    return j.distinct()


def verified_classes(fam: DataFrame, keyed: DataFrame) -> DataFrame:
    """``(old, cid, again)``: which classes of ``fam`` are one set, decided by their units instead of a fingerprint alone.

    ``keyed`` is ``(old, cid)``, each class with its fingerprint.  A class is held against the representative (smallest
    ``old``) of its fingerprint: they are one set if ``|A and B| = |A| = |B|``, which a join of their units counts, so a
    round reads every membership once.  Classes that share a fingerprint but not the set go to another round among
    themselves, numbered by ``again``: 0 for the first set of a fingerprint, so without collisions one round decides all.
    """
    from lacuna.plans.tuning import cut_lineage

    units = cut_lineage(fam.select(F.col("cid").alias("old"), "u").distinct(), tag="units")
    sizes = cut_lineage(units.groupBy("old").agg(F.count(F.lit(1)).alias("k")), tag="sizes")
    left, again, found = cut_lineage(keyed, tag="keyed"), 0, []
    while True:
        first = left.groupBy("cid").agg(F.min("old").alias("rep"))
        pairs = left.join(first, "cid").join(sizes, "old").join(sizes.select(F.col("old").alias("rep"), F.col("k").alias("rk")), "rep")
        mine = pairs.where((F.col("old") != F.col("rep")) & (F.col("k") == F.col("rk"))).select("old", "rep")
        shared = mine.join(units, "old").join(units.select(F.col("old").alias("rep"), "u"), ["rep", "u"], "left_semi")
        shared = shared.groupBy("old").agg(F.count(F.lit(1)).alias("both"))
        held = pairs.join(shared, "old", "left")
        same = (F.col("old") == F.col("rep")) | (F.coalesce(F.col("both"), F.lit(-1)) == F.col("k"))
        held = cut_lineage(held.select("old", "cid", same.alias("same")), tag="verified")
        found.append(held.where("same").select("old", "cid", F.lit(again).alias("again")))
        left, again = held.where(~F.col("same")).select("old", "cid"), again + 1
        if left.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def refine(f: DataFrame, g: DataFrame) -> DataFrame:
    """All distinct non-empty intersections ``f ∩ g`` of two families.

    Inverted-index equi-join on the unit: a pair of classes only meets where
    they share a unit, so empty intersections never appear.  Output classes
    are keyed by content fingerprint.
    """
    j = f.select(F.col("cid").alias("f"), "u", *STATS).join(
        g.select(F.col("cid").alias("g"), "u"), "u"
    )
    return distinct_family(j.select(F.struct("f", "g").alias("cid"), "u", *STATS))


# 64-bit words of a class's signature.
SIGNATURE_WORDS = 4


def signatures(fam: DataFrame) -> DataFrame:
    """``(cid, k, b0, b1, ...)``: number of units and a bit mask of their hashes, by partial aggregates.

    A superset has every bit of its subset, so ``sub & ~super = 0`` word by word is necessary for containment.
    """
    h = F.xxhash64("u")
    bit = F.expr("shiftleft(1L, CAST(pmod(shiftright(xxhash64(u), 8), 64) AS INT))")
    words = [F.bit_or(F.when(F.pmod(h, F.lit(SIGNATURE_WORDS)) == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"b{i}") for i in range(SIGNATURE_WORDS)]
    return fam.groupBy("cid").agg(F.count("u").alias("k"), *words)


def containment_candidates(f: DataFrame, g: DataFrame) -> DataFrame:
    """``(f, g, k)``: pairs that may be ``set(f) ⊇ set(g)``, ``k`` = units of g.

    Three necessary conditions, each met before any unit is counted: f holds the unit of g that the fewest classes of f
    hold (the anchor, an equi-join), has as many units and all signature bits of g (a condition of that join), and holds
    g's second rarest unit (a semi-join).  Where every unit lies in many classes the anchor alone would pair each g with
    all of them; the signature leaves few, and the second anchor acts where large sets have filled their signature.
    """
    from lacuna.plans.tuning import cut_lineage

    held = f.groupBy("u").agg(F.count(F.lit(1)).alias("_held"))
    rated = g.select("cid", "u").join(held, "u", "left").select("cid", "u", F.struct(F.coalesce("_held", F.lit(0)).alias("h"), "u").alias("r"))
    first = cut_lineage(rated.groupBy("cid").agg(F.min("r").alias("r1")), tag="anchor")
    second = rated.join(first, "cid").where(F.col("r") > F.col("r1")).groupBy("cid").agg(F.min("r").alias("r2"))
    anchors = first.join(second, "cid", "left").join(signatures(g), "cid")
    fs = signatures(f)
    sub = anchors.select(F.col("cid").alias("g"), F.col("r1.u").alias("anchor"), F.col("r2.u").alias("next"), "k",
                         *[F.col(f"b{i}").alias(f"g{i}") for i in range(SIGNATURE_WORDS)])
    sup = f.select("cid", F.col("u").alias("anchor")).join(fs, "cid").select(
        F.col("cid").alias("f"), F.col("anchor").alias("held"), F.col("k").alias("kf"), *[F.col(f"b{i}").alias(f"f{i}") for i in range(SIGNATURE_WORDS)])
    fits = (F.col("anchor") == F.col("held")) & (F.col("kf") >= F.col("k"))
    for i in range(SIGNATURE_WORDS):
        fits = fits & (F.col(f"g{i}").bitwiseAND(F.bitwise_not(f"f{i}")) == 0)
    cand = sub.join(sup, fits).select("f", "g", "k", F.coalesce("next", "anchor").alias("next"))
    members = f.select(F.col("cid").alias("f"), F.col("u").alias("next"))
    return cand.join(members, ["f", "next"], "left_semi").select("f", "g", "k")


def containment_join(f: DataFrame, g: DataFrame) -> DataFrame:
    """Pairs ``(f, g)`` of class ids with ``set(f) ⊇ set(g)``.

    Both families use the same units.  Candidates (``containment_candidates``)
    are verified by counting the units of g found in f.  A unit shared by
    every class makes no pair of its own.
    """
    cand = containment_candidates(f, g)
    gu = g.select(F.col("cid").alias("g"), "u")
    hits = gu.join(cand, "g").join(f.select(F.col("cid").alias("f"), "u"), ["f", "u"], "left_semi")
    counted = hits.groupBy("g", "f", "k").agg(F.count("u").alias("m"))
    return counted.where(F.col("m") == F.col("k")).select("f", "g")


def set_membership(s: DataFrame, fam: DataFrame) -> DataFrame:
    """For each class of ``s``: is the same set (by content) a class of ``fam``?"""
    ss = family_stats(s).select(F.col("cid").alias("id"), fingerprint().alias("fp"))
    fs = family_stats(fam).select(fingerprint().alias("fp")).distinct().withColumn("found", F.lit(True))
    return ss.join(fs, "fp", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def intersect_sets(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """n-way intersection: ``(group_id, obj)`` for objects in every set of a group.

    ``sets`` is ``(set_id, obj)``; ``groups`` is ``(group_id, set_id)``.  An
    object is kept when it is counted in as many sets as its group has.
    """
    g = groups.select("group_id", "set_id").distinct()
    k = g.groupBy("group_id").agg(F.count("set_id").alias("k"))
    s = sets.select("set_id", F.col("obj").cast("bigint").alias("obj")).distinct()
    hits = g.join(s, "set_id").groupBy("group_id", "obj").agg(F.count("set_id").alias("m"))
    return hits.join(k, "group_id").where(F.col("m") == F.col("k")).select("group_id", "obj")


def union_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-1 in long form: ``(set_id, obj)`` rows of two sets with one id."""
    return a.select("set_id", "obj").unionByName(b.select("set_id", "obj")).distinct()


def intersect_two(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-2 in long form: objects of set ``a`` also in ``b`` (semi-join on obj)."""
    return a.select("set_id", "obj").join(b.select("obj").distinct(), "obj", "left_semi")


def distinct_sets(sets: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-5 on set rows ``(keys..., stats)``: one row per distinct set per key."""
    return sets.select(*keys, *STATS).distinct()


def sized_sets(family: DataFrame, class_col: str = "class_id", obj_col: str = "obj") -> DataFrame:
    """SRT-2 as one call: distinct non-empty sets of ``(class, obj)`` rows with their place by size.

    ``(pos, stats)``; ``pos`` counts from 1 by size, then smallest member, then content.  Sets are ranked by size class
    (one row a size) and within their size, so no task ranks them all.
    """
    st = distinct_sets(family_stats(as_family(family, class_col, obj_col)), [])
    per = st.groupBy("n").agg(F.count(F.lit(1)).alias("_c"))
    before = per.select(F.col("n").alias("_n"), (F.sum("_c").over(Window.orderBy("n")) - F.col("_c")).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("n").orderBy("lo", "x1", "x2"))
    return st.withColumn("_r", rank).join(before, F.col("n") == F.col("_n")).select((F.col("_b") + F.col("_r")).alias("pos"), *STATS)


def order_by_size(sets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """SRT-2: sets by size ascending; smallest member breaks ties (deterministic)."""
    return sets.orderBy(*(keys or []), "n", "lo")


def family_members(fam: DataFrame, units: DataFrame) -> DataFrame:
    """Expand a unit-level family to objects through ``units (u, obj)``.

    Object-level join on the unit key; a unit holding very many objects is
    split over several tasks (``split_hot_join``, sizes from the family's
    own unit stats).
    """
    from lacuna.plans.tuning import split_hot_join

    sizes = fam.select("u", "n").distinct()
    return split_hot_join(fam.select("cid", "u"), units.select("u", "obj"), ["u"], sizes).select("cid", "obj")
