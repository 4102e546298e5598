"""Sources, sinks and codec (FIXTURES.md F5 and round trips)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lacuna.functions import codec
from lacuna.sources import pairs as P
from lacuna.sources import sinks as S
from lacuna.sources import text as T

F5 = "a,*,x\nb,y,\n c,,z\nd\n"


def _write(content: str) -> str:
    d = tempfile.mkdtemp(prefix="lacuna-io-")
    p = os.path.join(d, "table.txt")
    with open(p, "w") as f:
        f.write(content)
    return p


def test_text_table_blank_is_a_value_and_short_row_raises(spark):
    p = _write(F5)
    lines = T.number_lines(spark, p)
    assert [r["obj"] for r in lines.orderBy("obj").collect()] == [1, 2, 3, 4]
    ok = T.parse_table(lines.where("obj <= 3"), ["a1", "a2", "a3"]).orderBy("obj").collect()
    assert [tuple(r) for r in ok] == [(1, "a", "*", "x"), (2, "b", "y", ""), (3, "c", "", "z")]
    with pytest.raises(Exception):
        T.parse_table(lines, ["a1", "a2", "a3"]).collect()


def test_text_cells_absent_mode(spark):
    lines = T.number_lines(spark, _write(F5))
    cells = {(r["obj"], r["attr"]): r["value"] for r in T.parse_cells(lines, on_ragged="absent").collect()}
    assert (2, 3) not in cells and cells[(2, 2)] == "y"
    assert cells[(3, 2)] == "" and cells[(3, 1)] == "c"
    assert [a for (o, a) in cells if o == 4] == [1]


def test_codec_roundtrip(spark):
    df = spark.createDataFrame([("1,2,3|4|", )], "s string")
    fam = df.select(codec.decode_family("s").alias("f")).collect()[0]["f"]
    assert fam == [[1, 2, 3], [4], []]
    enc = df.select(codec.encode_family(codec.decode_family("s")).alias("e")).collect()[0]["e"]
    assert enc == "1,2,3|4|"
    long = codec.explode_family(df, "s", [])
    assert sorted((r["set_no"], r["obj"]) for r in long.collect()) == [(0, 1), (0, 2), (0, 3), (1, 4)]


def test_encode_sets_bounds_each_line(spark):
    m = spark.range(0, 10000).select(F.lit("k").alias("key"), F.col("id").alias("obj"))
    enc = codec.encode_sets(m, ["key"], width=1000)
    assert enc.count() == 10
    back = codec.explode_ids(enc, "ids", ["key"])
    assert back.count() == 10000


def test_targets_and_families_text(spark):
    d = tempfile.mkdtemp(prefix="lacuna-io-")
    t = os.path.join(d, "targets.txt")
    with open(t, "w") as f:
        f.write("yes\t1,2,4\nno\t3\nyes\t5\n\n")
    got = {(r["d"], r["obj"]) for r in P.read_targets(spark, t).collect()}
    assert got == {("yes", 1), ("yes", 2), ("yes", 4), ("yes", 5), ("no", 3)}
    fpath = os.path.join(d, "fam.txt")
    with open(fpath, "w") as f:
        f.write("1\t1,2|4,7|7\n")
    fam = P.read_families(spark, fpath, layout="keyed")
    sets = fam.groupBy("class_id").agg(F.sort_array(F.collect_list("obj")).alias("s")).collect()
    assert sorted(r["s"] for r in sets) == [[1, 2], [4, 7], [7]]


def test_sequencefile_and_compact(spark):
    d = tempfile.mkdtemp(prefix="lacuna-io-")
    df = spark.createDataFrame([("1,a", "1,2"), ("2,b", "3")], "k string, v string")
    S.write_sequencefile(df, os.path.join(d, "seq"), "k", "v")
    back = P.read_pairs(spark, os.path.join(d, "seq"), "sequencefile")
    assert sorted(tuple(r) for r in back.collect()) == [("1,a", "1,2"), ("2,b", "3")]
    spark.range(0, 5000).repartition(10).write.parquet(os.path.join(d, "parts"))
    out = S.compact(spark, os.path.join(d, "parts"), os.path.join(d, "one"), target_bytes=1 << 30)
    assert out.count() == 5000 and out.rdd.getNumPartitions() == 1


def test_array_set_functions(spark):
    from lacuna.functions import setops as so

    df = spark.createDataFrame([([3, 1, 2], [2, 4], [[2, 1], [4]])], "a array<bigint>, b array<bigint>, f array<array<bigint>>")
    r = df.select(so.set_union("a", "b").alias("u"), so.set_intersect("a", "b").alias("i"),
                  so.set_contains("a", F.array(F.lit(1).cast("bigint"))).alias("c"),
                  so.set_contains("b", "a").alias("nc"),
                  so.set_in_family(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")), "f").alias("m"),
                  so.set_intersect_all(F.array("a", "b")).alias("all")).collect()[0]
    assert r["u"] == [1, 2, 3, 4] and r["i"] == [2] and r["c"] and not r["nc"] and r["m"] and r["all"] == [2]
    assert codec.parse_attribute_list("1,10,12") == [1, 10, 12]


def test_write_sets_text_ordered_by_size(spark):
    d = tempfile.mkdtemp(prefix="lacuna-io-")
    m = spark.createDataFrame([("A", "s1", 5), ("A", "s1", 6), ("A", "s1", 7), ("A", "s2", 1), ("B", "s3", 2),
                               ("B", "s3", 3)], "kind string, set string, obj bigint")
    S.write_sets_text(m, os.path.join(d, "out"), keys=[], set_key="set", partition_by="kind", order_by_size=True)
    a = [r["value"] for r in spark.read.text(os.path.join(d, "out", "kind=A")).collect()]
    assert a == ["s2\t1", "s1\t5,6,7"]


def test_absent_cells_drop_out_of_aggregation(spark):
    """F5 with on_ragged='absent': row 2 lacks a3 and row 4 lacks a2, a3.
    Over (a1, a2) only row 4 drops out; over (a1, a2, a3) rows 2 and 4 do."""
    from helpers import aggregate as brute

    from lacuna import aggregate
    from lacuna.operators.classes import cells_to_table

    cells = T.parse_cells(T.number_lines(spark, _write(F5)), on_ragged="absent")
    for attrs, rows in ((["a1", "a2"], {1: ("a", "*"), 2: ("b", "y"), 3: ("c", "")}),
                        (["a1", "a2", "a3"], {1: ("a", "*", "x"), 3: ("c", "", "z")})):
        wide = cells_to_table(cells.where(F.col("attr") <= len(attrs)), attrs)
        for kind in ("certain", "possible"):
            m = aggregate(wide, "obj", attrs, kind)
            got = {frozenset(r["s"]) for r in m.groupBy("class_id").agg(F.collect_set("obj").alias("s")).collect()}
            assert got == brute(rows, len(attrs), kind), (attrs, kind)


def test_families_one_set_per_line_and_pairs(spark):
    d = tempfile.mkdtemp(prefix="lacuna-io-")
    fpath = os.path.join(d, "sets.txt")
    with open(fpath, "w") as f:
        f.write("1,2\n\n4,7\n7\n")
    fam = P.read_families(spark, fpath, layout="lines")
    sets = fam.groupBy("class_id").agg(F.sort_array(F.collect_list("obj")).alias("s")).collect()
    assert sorted(r["s"] for r in sets) == [[1, 2], [4, 7], [7]]
    S.write_pairs(fam, os.path.join(d, "pq"))
    assert P.read_pairs(spark, os.path.join(d, "pq")).count() == 5


def test_long_form_set_helpers(spark):
    from lacuna.operators import sets as so
    from lacuna.functions.setstats import object_stats

    a = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3)], "set_id string, obj bigint")
    b = spark.createDataFrame([("s", 3), ("s", 4)], "set_id string, obj bigint")
    assert sorted(r["obj"] for r in so.union_sets(a, b).collect()) == [1, 2, 3, 4]
    assert [r["obj"] for r in so.intersect_two(a, b).collect()] == [3]
    st = a.unionByName(b.withColumn("set_id", F.lit("t"))).groupBy("set_id").agg(*object_stats("obj"))
    assert [r["set_id"] for r in so.order_by_size(st).collect()] == ["t", "s"]
    dup = st.unionByName(st.withColumn("set_id", F.lit("x")).where(F.col("n") == 2))
    assert so.distinct_sets(dup, []).count() == 2


def test_read_table_with_key_column(spark):
    p = _write("15,a,*\n7,b,x\n")
    df = T.read_table(spark, p, ["a1", "a2"], key="1")
    assert sorted(tuple(r) for r in df.collect()) == [(7, "b", "x"), (15, "a", "*")]
    p2 = _write("a,15,*\n")
    df2 = T.read_table(spark, p2, ["a1", "a2"], key="2")
    assert [tuple(r) for r in df2.collect()] == [(15, "a", "*")]


def _sets(fam):
    return sorted(r["s"] for r in fam.groupBy("class_id").agg(F.sort_array(F.collect_list("obj")).alias("s")).collect())


def test_family_lines_keep_their_sets(spark):
    p = _write("1 \t 1,2|3\n1\t1,4,5|6|\n1,2\tnot_exist\n2\t \n\n")
    assert _sets(P.read_families(spark, p)) == [[1, 2], [1, 4, 5], [3], [6]]
    halves = _write("1\t1,2|4\t1,2,7|4,7|7\n2\tnot_exist\t3\n")
    assert _sets(P.read_families(spark, halves, layout="halves", kind="certain")) == [[1, 2], [4]]
    assert _sets(P.read_families(spark, halves, layout="halves", kind="possible")) == [[1, 2, 7], [3], [4, 7], [7]]
    aggregated = _write("1\t1,2\t1,2|4\n1\t3\tnot_exist\n")
    assert _sets(P.read_families(spark, aggregated)) == [[1, 2], [4]]
    with pytest.raises(Exception):
        P.read_families(spark, _write("1\tnope\n")).collect()


def test_family_records_of_a_sequencefile(spark):
    d = tempfile.mkdtemp(prefix="lacuna-io-")
    df = spark.createDataFrame([("1", "1,2\t1,2|4"), ("1", "3\tnot_exist"), ("1", "4\t1,9")], "k string, v string")
    S.write_sequencefile(df, os.path.join(d, "seq"), "k", "v")
    assert _sets(P.read_families(spark, os.path.join(d, "seq"), fmt="sequencefile")) == [[1, 2], [1, 9], [4]]


def test_sets_text_is_one_line_a_set_and_reads_back(spark):
    d = tempfile.mkdtemp(prefix="lacuna-io-")
    m = spark.createDataFrame([("A", "s1", 1), ("A", "s1", 4097), ("A", "s1", 8193), ("B", "s1", 2)], "kind string, set string, obj bigint")
    S.write_sets_text(m, os.path.join(d, "one"), keys=[], set_key="set")
    assert [r["value"] for r in spark.read.text(os.path.join(d, "one", "kind=A")).collect()] == ["s1\t1,4097,8193"]
    S.write_sets_text(m, os.path.join(d, "parts"), keys=[], set_key="set", width=4096)
    for name, layout in (("one", "sets"), ("parts", "parts")):
        back = P.read_families(spark, os.path.join(d, name), layout=layout)
        assert sorted(tuple(r) for r in back.collect()) == [("A", "s1", 1), ("A", "s1", 4097), ("A", "s1", 8193), ("B", "s1", 2)]


def test_ragged_and_long_rows(spark):
    p = _write("a,b\t\n c,d \n")
    assert sorted(tuple(r) for r in T.read_table(spark, p, ["x", "y"]).collect()) == [(1, "a", "b"), (2, "c", "d")]
    with pytest.raises(Exception):
        T.read_table(spark, _write("a,b,c\n"), ["x", "y"]).collect()
    short = T.read_table(spark, _write("a,b\na\n"), ["x", "y"])
    for ask in (short.count, short.select("obj").collect, short.select("x").collect):
        with pytest.raises(Exception):
            ask()
    absent = T.read_table(spark, _write("a,b\na\nc,\n,d\n"), ["x", "y"], on_ragged="absent")
    assert sorted(tuple(r) for r in absent.collect()) == [(1, "a", "b"), (4, "", "d")]


def test_hot_class_is_split(spark):
    """80 % of the rows in one class: the join back of the class stats splits them over several tasks."""
    from lacuna.functions.setstats import unit_stats
    from lacuna.operators.sets import distinct_family

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.shuffle.partitions": "8",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 5 < 4, F.lit(-1)).otherwise(F.col("id") % 50).alias("cid"), F.col("id").alias("u"))
        out = distinct_family(rows.select("cid", "u", *unit_stats(F.col("u"))))
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 40_000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_containment_with_a_shared_object(spark):
    """Classes that all hold one object make candidates in proportion to their number."""
    from lacuna.operators.sets import as_family, containment_join

    fam = spark.range(1, 301).select(F.col("id").alias("class_id"), F.explode(F.array(F.lit(0), F.col("id") * 2, F.col("id") * 2 + 1)).alias("obj"))
    f = as_family(fam)
    assert sorted(tuple(r) for r in containment_join(f, f).collect()) == [(k, k) for k in range(1, 301)]
