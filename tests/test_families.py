"""Families in numbered parts, and hot units of the general path."""

import random
import tempfile

from helpers import aggregate as brute_aggregate
from helpers import approximations
from pyspark.sql import functions as F

from lacuna.operators import approx
from lacuna.operators.sets import as_family
from lacuna.plans import tuning
from lacuna.sources import pairs as P
from lacuna.sources import sinks as S


def test_set_numbers_are_places_within_the_key(spark):
    rows = [(k, f"s{i:04d}") for k in ("a", "b") for i in range(700 if k == "a" else 5)] + [(None, "s1"), (None, "s0")]
    got = S.set_numbers(spark.createDataFrame(rows * 2, "k string, s string").repartition(5), "k", "s").collect()
    want = {(k, s, sorted(x for y, x in rows if y == k).index(s) + 1) for k, s in rows}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_families_in_parts_come_back(spark):
    path = tempfile.mkdtemp() + "/fam"
    rows = [("k", str(s), o) for s in range(3) for o in range(s, 50, s + 1)] + [("m", "x", 10**10)]
    S.write_families_text(spark.createDataFrame(rows, "key string, set string, obj bigint"), path, "key", "set", width=8)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert max(len(line.split("\t")[-1].split(",")) for line in lines) <= 8
    spark.createDataFrame([("n\tnot_exist",), ("  ",)], "value string").write.mode("append").text(path)
    got = {r["class_id"]: set(r["s"]) for r in P.read_families(spark, path, layout="keyed_parts").groupBy("class_id").agg(F.collect_list("obj").alias("s")).collect()}
    assert got == {f"k:{s + 1}": set(range(s, 50, s + 1)) for s in range(3)} | {"m:1": {10**10}}


def test_halves_in_parts_come_back(spark):
    path = tempfile.mkdtemp() + "/halves"
    rows = [("k", "certain", "x", 1), ("k", "possible", "x", 1), ("k", "possible", "x", 9), ("k", "possible", "y", 2)]
    S.write_families_text(spark.createDataFrame(rows, "key string, half string, set string, obj bigint"), path, "key", "set", width=4, half="half")
    read = lambda kind: sorted(map(tuple, P.read_families(spark, path, layout="halves_parts", kind=kind).collect()))
    assert read("certain") == [("k:1", 1)]
    assert read("possible") == [("k:1", 1), ("k:1", 9), ("k:2", 2)]


def test_a_unit_of_all_classes_and_targets_is_split(spark, monkeypatch):
    """Object 0 lies in 60 classes and 50 targets: 3,000 rows of one key, dealt over many tasks."""
    classes = [(c, o) for c in range(60) for o in (0, c + 1)]
    targets = [(f"t{d}", o) for d in range(50) for o in (0, d + 1)]
    fam = as_family(spark.createDataFrame(classes, "class_id int, obj bigint"))
    xf = spark.createDataFrame(targets, "d string, u bigint")
    monkeypatch.setattr(tuning, "SPLIT_ROWS", 100)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = approx.met_targets(fam, xf).withColumn("p", F.spark_partition_id())
        per = [r["count"] for r in rows.where("u = 0").groupBy("p").count().collect()]
        assert sum(per) == 3000 and len(per) == 4 and max(per) < 1500  # all four shuffle partitions of the test session
        assert sorted((r["cid"], r["d"]) for r in rows.where("u <> 0").collect()) == sorted((c, f"t{c}") for c in range(50))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_general_path_with_split_units_equals_brute_force(spark, monkeypatch):
    from test_property import random_table

    from lacuna import approximate_families

    rows, targets = random_table(random.Random(202), 9, 2, 0.3)
    mn, mx = brute_aggregate(rows, 2, "certain"), brute_aggregate(rows, 2, "possible")
    fam = lambda fs: spark.createDataFrame([(i, o) for i, s in enumerate(sorted(fs, key=sorted)) for o in s], "class_id int, obj bigint")
    x = spark.createDataFrame([(d, o) for d, s in targets.items() for o in s], "d string, obj bigint")
    monkeypatch.setattr(tuning, "SPLIT_ROWS", 2)
    got = {}
    for r in approximate_families(fam(mn), fam(mx), x).collect():
        got.setdefault((r["kind"], r["d"]), []).append((r["n"], r["lo"], r["hi"]))
    want = {k: sorted((len(s), min(s), max(s)) for s in v) for k, v in approximations(rows, 2, targets).items()}
    assert {k: sorted(v) for k, v in got.items()} == want
