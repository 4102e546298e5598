"""Registered queries: each reads the driver tables at ``sf_dir`` (whole
tables) and returns a DataFrame whose columns equal the oracle SQL's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.codec import (EMPTY_FAMILY, FIELD_SEP, SET_SEP, decode_family, encode_family, encode_ids,
                                    encode_sets, explode_family, explode_ids)
from lacuna.functions.setstats import DIGEST, object_stats
from lacuna.operators import classes as C
from lacuna.operators.aggregate import aggregate_possible, coded_patterns, merge_partials
from lacuna.operators.sets import (as_family, containment_join, family_stats, intersect_sets, refine,
                                   set_membership, sized_sets, union_sets)
from lacuna.plans import end_to_end as E
from lacuna.plans import fixtures as fx
from lacuna.plans.tuning import cut_lineage, scratch_path
from lacuna.sources import pairs as P
from lacuna.sources import sinks as S
from lacuna.sources import text as T

A = fx.F2_ATTRS
PART = 4096  # id values a line, where a query writes sets that may be large
ALL4 = A + ["d"]


def _cells(spark, sf):
    return C.unpivot(fx.f2(spark, sf), "obj", ALL4)


def _class_digest(fam: DataFrame, keys: list[str]) -> DataFrame:
    return C.class_stats(fam, keys).select(*keys, *DIGEST)


def q_unpivot(spark, sf):
    return _cells(spark, sf)


def q_equivalence_classes(spark, sf):
    return _class_digest(C.equivalence_classes(_cells(spark, sf)), ["attr", "value"])


def q_certain_classes(spark, sf):
    return _class_digest(C.certain_classes(_cells(spark, sf)), ["attr", "value"])


def q_possible_classes(spark, sf):
    return C.possible_class_stats(_cells(spark, sf)).select("attr", "value", *DIGEST)


def q_select_attributes(spark, sf):
    return C.unpivot(fx.f2(spark, sf), "obj", ALL4, only=[1, 3])


def q_pick_family(spark, sf):
    half = C.classes(fx.f2(spark, sf), "obj", A, kind="certain")
    return _class_digest(C.pick_family(half, "certain"), ["attr", "value"])


def q_classes(spark, sf):
    """E2E-1: certain and possible families of a1..a3 with their kind."""
    return C.classes_stats(fx.f2(spark, sf), "obj", A).select("kind", "attr", "value", *DIGEST)


def q_refine_two(spark, sf):
    """Object-level refine of the possible families of a1 and a2."""
    poss = C.possible_classes(C.unpivot(fx.f2(spark, sf), "obj", ["a1", "a2"]))
    f1 = as_family(poss.where(F.col("attr") == 1), class_col="value")
    f2 = as_family(poss.where(F.col("attr") == 2), class_col="value")
    return family_stats(refine(f1, f2)).select(*DIGEST)


def q_aggregate_certain(spark, sf):
    return E.aggregate(fx.f2(spark, sf), "obj", A, "certain", members=False).select(*DIGEST)


def q_aggregate_possible(spark, sf):
    return E.aggregate(fx.f2(spark, sf), "obj", A, "possible", members=False).select(*DIGEST)


def q_merge_partials(spark, sf):
    """fold({a1, a2}) merged with fold({a3}) over the same pattern units."""
    pats, coding = coded_patterns(C.prepare(fx.f2(spark, sf), "obj", A), A)
    f12 = aggregate_possible(pats, ["a1", "a2"], coding=coding)
    f3 = aggregate_possible(pats, ["a3"], coding=coding)
    merged, label = merge_partials(f12, f3, "1,2", "3")
    assert label == "1,2,3"
    return family_stats(merged).select(*DIGEST)


def q_aggregate_status(spark, sf):
    t3 = fx.f3(spark, sf)
    cer = E.status(t3, "obj", fx.F3_ATTRS, "certain").select(F.lit("certain").alias("kind"), "attrs", "status")
    pos = E.status(t3, "obj", fx.F3_ATTRS, "possible").select(F.lit("possible").alias("kind"), "attrs", "status")
    return cer.unionByName(pos)


def q_decision_classes(spark, sf):
    x = C.decision_classes(fx.f2(spark, sf), "obj", "d")
    return x.groupBy("d").agg(*object_stats("obj")).select("d", *DIGEST)


def _kind(kind):
    def q(spark, sf):
        res = E.approximate(fx.f2(spark, sf), "obj", A, "d", kinds=[kind])
        return res.select("d", *DIGEST)
    q.__name__ = f"q_{kind}"
    return q


def q_approximations_pooled(spark, sf):
    return E.approximate(fx.f2(spark, sf), "obj", A, fx.f2b_targets(spark, sf), pooled=True)


def _families(spark, sf):
    t = fx.f2(spark, sf)
    mn = E.aggregate(t, "obj", A, "certain", members=True)
    mx = E.aggregate(t, "obj", A, "possible", members=True)
    # read by several joins each: write both families once
    return t, cut_lineage(mn, tag="minf"), cut_lineage(mx, tag="maxf")


def q_approximate_families(spark, sf):
    t = fx.f2(spark, sf)
    mn = E.aggregate(t, "obj", A, "certain", members=True)
    mx = E.aggregate(t, "obj", A, "possible", members=True)
    return E.approximate_families(mn, mx, C.decision_classes(t, "obj", "d"))


def q_approximation_summary(spark, sf):
    return E.summary(fx.f2(spark, sf), "obj", A, "d")


def q_containment_pairs(spark, sf):
    """Pairs (max block ⊇ min block): g = smallest id of the min block,
    digest of the max block."""
    _, mn, mx = _families(spark, sf)
    fmn, fmx = as_family(mn), as_family(mx)
    pairs = containment_join(fmx, fmn)
    g = family_stats(fmn).select(F.col("cid").alias("g"), F.col("lo").alias("g_lo"))
    f = family_stats(fmx).withColumnRenamed("cid", "f")
    return pairs.join(g, "g").join(f, "f").select(F.col("g_lo").alias("g"), *DIGEST)


def q_set_membership(spark, sf):
    _, mn, mx = _families(spark, sf)
    fmn = as_family(mn)
    found = set_membership(fmn, as_family(mx))
    ids = family_stats(fmn).select(F.col("cid").alias("id"), F.col("lo").alias("lo_id"))
    return found.join(ids, "id").select(F.col("lo_id").alias("id"), "found")


def q_nway_intersection(spark, sf):
    """Each decision class intersected with the ``mod3`` target."""
    t = fx.f2(spark, sf)
    dec = C.decision_classes(t, "obj", "d")
    mod3 = fx.f2b_targets(spark, sf).where(F.col("d") == "mod3")
    sets = dec.unionByName(mod3).select(F.col("d").alias("set_id"), "obj")
    names = dec.select("d").distinct()
    groups = names.select(F.col("d").alias("group_id"), F.col("d").alias("set_id")).unionByName(
        names.select(F.col("d").alias("group_id"), F.lit("mod3").alias("set_id")))
    inter = intersect_sets(sets, groups)
    return inter.groupBy("group_id").agg(*object_stats("obj")).select("group_id", *DIGEST)


def q_codec_roundtrip(spark, sf):
    enc = encode_sets(_cells(spark, sf), ["attr", "value"], width=PART)
    dec = explode_ids(enc, "ids", ["attr", "value", "part"])
    return dec.groupBy("attr", "value").agg(
        F.countDistinct("part").alias("n_lines"), *object_stats("obj")
    ).select("attr", "value", "n_lines", *DIGEST)


def q_read_targets(spark, sf):
    path = scratch_path(spark, "targets")
    enc = encode_sets(C.decision_classes(fx.f2(spark, sf), "obj", "d"), ["d"], width=PART)
    enc.select(F.concat_ws(FIELD_SEP, "d", "ids")).write.text(path)
    return P.read_targets(spark, path)


def q_orders_aggregate_possible(spark, sf):
    """F4 (orders): few, large classes."""
    return E.aggregate(fx.f4(spark, sf), "obj", fx.F4_ATTRS, "possible", members=False).select(*DIGEST)


def q_orders_summary(spark, sf):
    return E.summary(fx.f4(spark, sf), "obj", fx.F4_ATTRS, "d")


def q_events_aggregate_possible(spark, sf):
    """F5 (events): high-cardinality attribute; maxA has many overlapping blocks."""
    return E.aggregate(fx.f5(spark, sf), "obj", fx.F5_ATTRS, "possible", members=False).select(*DIGEST)


def q_events_summary(spark, sf):
    return E.summary(fx.f5(spark, sf), "obj", fx.F5_ATTRS, "d")


def q_orders8_aggregate_possible(spark, sf):
    """F6 (orders, eight attributes): maxA."""
    return E.aggregate(fx.f6(spark, sf), "obj", fx.F6_ATTRS, "possible", members=False).select(*DIGEST)


def q_orders8_summary(spark, sf):
    """F6 summary (orders, eight attributes)."""
    return E.summary(fx.f6(spark, sf), "obj", fx.F6_ATTRS, "d")


# --- file round trips -------------------------------------------------------

def q_read_numbered(spark, sf):
    """Text table written in key order, read back with line-number ids."""
    path = scratch_path(spark, "table")
    t = fx.f2(spark, sf)
    t.orderBy("obj").select(F.concat_ws(",", *ALL4)).write.text(path)
    return T.read_table(spark, path, ALL4)


def q_ragged_aggregate_possible(spark, sf):
    """Text F2 where a missing a3 is written as a trailing empty cell: read
    with ``on_ragged='absent'`` those objects have no a3 cell, so they lie in
    no block; maxA of the rest, ids = line numbers."""
    path = scratch_path(spark, "ragged")
    t = fx.f2(spark, sf)
    a3 = F.when(F.col("a3") == "*", F.lit("")).otherwise(F.col("a3"))
    t.orderBy("obj").select(F.concat_ws(",", "a1", "a2", a3)).write.text(path)
    wide = T.read_table(spark, path, A, on_ragged="absent")
    return E.aggregate(wide, "obj", A, "possible", members=False).select(*DIGEST)


def q_compact(spark, sf):
    src, dst = scratch_path(spark, "parts"), scratch_path(spark, "compact")
    _cells(spark, sf).repartition(16).write.parquet(src)
    return S.compact(spark, src, dst, target_bytes=1 << 20).select("attr", "value", "obj")


def q_sequencefile_roundtrip(spark, sf):
    """Equivalence classes as (Text 'attr,value', Text ids) SequenceFile and back."""
    path = scratch_path(spark, "seq")
    enc = encode_sets(_cells(spark, sf), ["attr", "value"], width=PART)
    S.write_sequencefile(enc.select(F.concat_ws(",", F.col("attr").cast("string"), "value").alias("k"), "ids"),
                         path, "k", "ids")
    back = P.read_pairs(spark, path, "sequencefile")
    kv = F.split("key", ",", 2)
    dec = explode_ids(back.select(kv[0].cast("int").alias("attr"), kv[1].alias("value"), F.col("value").alias("ids")),
                      "ids", ["attr", "value"])
    return _class_digest(dec, ["attr", "value"])


def q_long_pairs_roundtrip(spark, sf):
    """Rows of ``part`` as (Long id, Text cells) SequenceFiles, ids on both sides of 2^31, compacted and read back."""
    src, dst = scratch_path(spark, "longseq"), scratch_path(spark, "longone")
    obj = F.col("obj") + F.when(F.col("obj") % 2 == 0, F.lit(0)).otherwise(F.lit(5_000_000_000))
    rows = fx.f2(spark, sf).select(obj.alias("k"), F.concat_ws(",", *A).alias("line"))
    S.write_sequencefile(rows.repartition(16), src, "k", "line", key_type="long")
    S.compact(spark, src, dst, target_bytes=1 << 20, fmt="sequencefile")
    return P.read_pairs(spark, dst, "sequencefile", "bigint").select(F.col("key").alias("obj"), F.col("value").alias("line"))


def q_stream_targets(spark, sf):
    """Target files (F2b, bounded lines) streamed through foreachBatch against
    families precomputed from ``part``; the parquet sink read back."""
    from lacuna.streaming import targets as ST

    src, out, ckpt = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    enc = encode_sets(fx.f2b_targets(spark, sf), ["d"], width=PART)
    enc.select(F.concat_ws(FIELD_SEP, "d", "ids")).write.text(src)
    tp = ST.table_side(fx.f2(spark, sf), "obj", A)
    q = ST.start(spark, tp, src, out, ckpt)  # available-now: every file present is one batch
    q.awaitTermination()
    return ST.latest(spark, out).select("kind", "d", *DIGEST)


def q_write_sets_text(spark, sf):
    """All approximations as set text files, one directory per kind, read back."""
    path = scratch_path(spark, "sets")
    m = E.approximate(fx.f2(spark, sf), "obj", A, "d", members=True)
    m = m.withColumn("set", F.concat_ws(":", *[F.col("class_id")[k].cast("string") for k in ("n", "lo", "x1", "x2")]))
    S.write_sets_text(m, path, keys=["d"], set_key="set", partition_by="kind", width=PART)
    back = P.read_families(spark, path, layout="parts")  # partition discovery restores `kind`
    back = back.withColumn("d", F.split("class_id", FIELD_SEP)[0])
    return back.groupBy("kind", "d", "class_id").agg(*object_stats("obj")).select("kind", "d", *DIGEST)


def q_sets_text_roundtrip(spark, sf):
    """The classes of all attributes in numbered parts, written by kind and read back."""
    path = scratch_path(spark, "sets")
    m = _cells(spark, sf).withColumn("kind", F.concat(F.lit("a"), F.col("attr")))
    S.write_sets_text(m, path, keys=[], set_key="value", partition_by="kind", order_by_size=True, width=PART)
    back = P.read_families(spark, path, layout="parts").withColumnRenamed("class_id", "value")
    return back.groupBy("kind", "value").agg(*object_stats("obj")).select("kind", "value", *DIGEST)


def q_families_roundtrip(spark, sf):
    """Keyed families in parts: one key, two sets for each brand (odd and even parts), every set a class of its own."""
    path = scratch_path(spark, "families")
    t = spark.read.parquet(f"{sf}/part.parquet").select(F.lit(1).alias("key"), F.col("p_partkey").cast("bigint").alias("obj"),
                                                        F.concat_ws("#", "p_brand", (F.col("p_partkey") % 2).cast("string")).alias("set"))
    S.write_families_text(t, path, "key", "set", PART)
    back = P.read_families(spark, path, layout="keyed_parts")
    return back.groupBy("class_id").agg(*object_stats("obj")).select(F.split("class_id", ":")[0].alias("key"), *DIGEST)


def q_family_halves(spark, sf):
    """Certain and possible families by attribute (nation keys of suppliers) in parts: the possible half."""
    path = scratch_path(spark, "halves")
    t = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").cast("bigint").alias("obj"))
    even = t.where("obj % 2 = 0")
    rows = [even.select("k", F.lit("certain").alias("half"), F.lit("even").alias("set"), "obj")]
    rows += [x.select("k", F.lit("possible").alias("half"), F.lit(name).alias("set"), "obj") for name, x in (("all", t), ("even", even))]
    S.write_families_text(rows[0].unionByName(rows[1]).unionByName(rows[2]), path, "k", "set", PART, half="half")
    back = P.read_families(spark, path, layout="halves_parts", kind="possible")
    return back.groupBy("class_id").agg(*object_stats("obj")).select(F.split("class_id", ":")[0].cast("int").alias("key"), *DIGEST)


def q_family_strings(spark, sf):
    """Family codec: each nation's suppliers as one family ``even|odd``, ids ascending, through both directions."""
    t = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").cast("bigint").alias("obj"))
    part = lambda r: F.collect_list(F.when(F.col("obj") % 2 == r, F.col("obj")))
    enc = t.groupBy("k").agg(encode_family(F.array(part(0), part(1))).alias("s"))
    long = explode_family(enc, "s", ["k"]).groupBy("k").agg(F.count("*").alias("n"))
    return enc.select("k", encode_family(decode_family("s")).alias("family")).join(long, "k")


def q_sets_by_size(spark, sf):
    """Distinct classes of a2, each given twice, by size with their position."""
    cells = C.unpivot(fx.f2(spark, sf), "obj", ALL4, only=[2])
    twice = cells.select("value", "obj").unionByName(cells.select(F.concat("value", F.lit("'")).alias("value"), "obj"))
    return sized_sets(twice, "value").select("pos", *DIGEST)


def q_set_union(spark, sf):
    """The union of two targets."""
    both = fx.f2b_targets(spark, sf).select(F.lit("u").alias("set_id"), "d", "obj")
    return union_sets(both.where("d = 'low'"), both.where("d = 'mod3'")).select("obj")


def q_nway_three(spark, sf):
    """Three sets a group: each class of d, the ``mod3`` target and the objects with a known a2."""
    t = fx.f2(spark, sf)
    dec = C.decision_classes(t, "obj", "d").select(F.col("d").alias("set_id"), "obj")
    mod3 = fx.f2b_targets(spark, sf).where("d = 'mod3'").select(F.col("d").alias("set_id"), "obj")
    known = t.where("a2 <> '*'").select(F.lit("known").alias("set_id"), "obj")
    names = dec.select(F.col("set_id").alias("group_id")).distinct()
    groups = names.select("group_id", F.explode(F.array(F.col("group_id"), F.lit("mod3"), F.lit("known"))).alias("set_id"))
    inter = intersect_sets(dec.unionByName(mod3).unionByName(known), groups)
    return inter.groupBy("group_id").agg(*object_stats("obj")).select("group_id", *DIGEST)


def q_approximation_members(spark, sf):
    """All approximations with their members as rows, beside the digest of their set."""
    m = cut_lineage(E.approximate(fx.f2(spark, sf), "obj", A, "d", members=True), tag="members")
    st = m.groupBy("kind", "d", "class_id").agg(*object_stats("obj")).select("kind", "d", "class_id", *DIGEST)
    return m.join(st, ["kind", "d", "class_id"]).select("kind", "d", *DIGEST, "obj")


def q_containment_shared(spark, sf):
    """Containment where every class shares the smallest object: each class of a2 with object 0 added, in itself."""
    cells = C.unpivot(fx.f2(spark, sf), "obj", ALL4, only=[2]).select("value", "obj")
    fam = cells.unionByName(cells.select("value").distinct().withColumn("obj", F.lit(0).cast("bigint"))).withColumnRenamed("value", "class_id")
    f = cut_lineage(as_family(fam), tag="shared")
    return containment_join(f, f).select("f", "g")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "unpivot": q_unpivot,
    "equivalence_classes": q_equivalence_classes,
    "certain_classes": q_certain_classes,
    "possible_classes": q_possible_classes,
    "select_attributes": q_select_attributes,
    "pick_family": q_pick_family,
    "classes": q_classes,
    "refine_two": q_refine_two,
    "aggregate_certain": q_aggregate_certain,
    "aggregate_possible": q_aggregate_possible,
    "merge_partials": q_merge_partials,
    "aggregate_status": q_aggregate_status,
    "decision_classes": q_decision_classes,
    "certain_lower": _kind("CL"),
    "certain_upper": _kind("CU"),
    "possible_lower": _kind("PL"),
    "possible_upper": _kind("PU"),
    "possible_upper_restricted": _kind("PUr"),
    "approximations_pooled": q_approximations_pooled,
    "approximate_families": q_approximate_families,
    "approximation_summary": q_approximation_summary,
    "containment_pairs": q_containment_pairs,
    "set_membership": q_set_membership,
    "nway_intersection": q_nway_intersection,
    "codec_roundtrip": q_codec_roundtrip,
    "read_targets": q_read_targets,
    "orders_aggregate_possible": q_orders_aggregate_possible,
    "orders_summary": q_orders_summary,
    "events_aggregate_possible": q_events_aggregate_possible,
    "events_summary": q_events_summary,
    "orders8_aggregate_possible": q_orders8_aggregate_possible,
    "orders8_summary": q_orders8_summary,
    "read_numbered": q_read_numbered,
    "ragged_aggregate_possible": q_ragged_aggregate_possible,
    "compact": q_compact,
    "sequencefile_roundtrip": q_sequencefile_roundtrip,
    "long_pairs_roundtrip": q_long_pairs_roundtrip,
    "write_sets_text": q_write_sets_text,
    "stream_targets": q_stream_targets,
    "sets_text_roundtrip": q_sets_text_roundtrip,
    "families_roundtrip": q_families_roundtrip,
    "family_halves": q_family_halves,
    "family_strings": q_family_strings,
    "sets_by_size": q_sets_by_size,
    "set_union": q_set_union,
    "nway_three": q_nway_three,
    "approximation_members": q_approximation_members,
    "containment_shared": q_containment_shared,
}
