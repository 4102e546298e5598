"""Containment candidates, verified set identity and line numbers without a shuffle."""

import random

from helpers import aggregate as brute_aggregate
from helpers import collect_sets
from pyspark.sql import functions as F
from test_property import random_table, to_frames

import lacuna.operators.sets as S
from lacuna import aggregate
from lacuna.plans import tuning
from lacuna.sources.text import number_lines


def family(spark, sets):
    return S.as_family(spark.createDataFrame([(i, o) for i, s in enumerate(sets) for o in s], "class_id int, obj bigint"))


def test_candidates_stay_near_the_results_where_units_are_shared(spark):
    """Each of 40 units lies in about 1,000 of 2,000 classes; the anchor alone would make a million pairs."""
    rnd = random.Random(4)
    big = [frozenset(rnd.sample(range(40), 20)) for _ in range(2000)]
    small = [frozenset(rnd.sample(sorted(big[i]), 12)) for i in range(0, 2000, 2)]
    f, g = family(spark, big), family(spark, small)
    want = {(i, j) for j, s in enumerate(small) for i, b in enumerate(big) if s <= b}
    assert {(r["f"], r["g"]) for r in S.containment_join(f, g).collect()} == want
    made = S.containment_candidates(f, g).count()
    assert len(want) <= made <= 10 * len(want)


def test_containment_of_odd_families(spark):
    rnd = random.Random(5)
    big = [frozenset(rnd.sample(range(2000), rnd.choice([1, 3, 900]))) for _ in range(40)]
    small = [frozenset(rnd.sample(sorted(b), max(1, len(b) // 2))) for b in big] + [frozenset({9999}), frozenset({1, 9999})]
    got = S.containment_join(family(spark, big), family(spark, small)).collect()
    assert {(r["f"], r["g"]) for r in got} == {(i, j) for j, s in enumerate(small) for i, b in enumerate(big) if s <= b}
    none = family(spark, [])
    assert S.containment_join(family(spark, big), none).count() == 0 and S.containment_join(none, family(spark, big)).count() == 0


def weak(prefix=""):
    """A fingerprint that most sets of one size share."""
    c = lambda k: F.col(prefix + k)
    return F.struct(c("n").alias("n"), F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("x1"), F.lit(0).cast("bigint").alias("x2"))


def test_verified_family_is_exact_under_a_weak_fingerprint(spark, monkeypatch):
    sets = [{1, 2}, {2, 3}, {1, 2}, {3, 4}, {5}, {6}, {5}, {1, 2, 3}, {2, 3}]
    want = {frozenset(s) for s in sets}
    monkeypatch.setattr(S, "fingerprint", weak)
    loose = S.distinct_family(family(spark, sets))
    assert loose.select("cid").distinct().count() < len(want)
    got = S.distinct_family(family(spark, sets), verify=True)
    found = [frozenset(r["s"]) for r in got.groupBy("cid").agg(F.collect_list("u").alias("s")).collect()]
    assert len(found) == len(want) and set(found) == want
    rows, _ = random_table(random.Random(8), 9, 2, 0.3)
    df, _ = to_frames(spark, rows, 2, {"x": {1}})
    m = aggregate(df, "obj", ["a1", "a2"], "possible", verify=True)
    assert collect_sets(m.withColumn("k", F.lit(0)), ["k"])[(0,)] == brute_aggregate(rows, 2, "possible")


def test_lines_are_numbered_without_moving(spark, tmp_path, monkeypatch):
    lines = [f"row {i}" for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines[:3000]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(lines[3000:]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        for bound in (tuning.BROADCAST_ROWS, 0):  # 0: by shuffle
            monkeypatch.setattr(tuning, "BROADCAST_ROWS", bound)
            got = number_lines(spark, str(tmp_path))
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("hashpartitioning" in plan) == (bound == 0 and "BroadcastHashJoin" not in plan)
            if bound:
                assert "BroadcastHashJoin" in plan and plan.count("Exchange") == 1  # that of the offsets
            assert [r["line"] for r in sorted(got.collect())] == lines
            assert sorted(r["obj"] for r in got.collect()) == list(range(1, 5001))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
