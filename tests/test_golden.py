"""Golden micro table F1 (FIXTURES.md): every operator, exact sets."""

from helpers import collect_sets
from pyspark.sql import functions as F

from lacuna import aggregate, approximate
from lacuna.operators import classes as C
from lacuna.plans import fixtures as fx

S = lambda *sets: {frozenset(s) for s in sets}


def _by_attr(df):
    rows = df.groupBy("attr", "value").agg(F.collect_set("obj").alias("s")).collect()
    out = {}
    for r in rows:
        out.setdefault(r["attr"], set()).add(frozenset(r["s"]))
    return out


def test_certain_and_possible_classes(spark):
    cells = C.unpivot(fx.f1(spark), "obj", ["a1", "a2"])
    cer = _by_attr(C.certain_classes(cells))
    pos = _by_attr(C.possible_classes(cells))
    assert cer[1] == S({1, 2, 3}, {4, 5}, {7, 8})
    assert cer[2] == S({1, 2, 6}, {3, 4, 5}, {8})
    assert pos[1] == S({1, 2, 3, 6}, {4, 5, 6}, {6, 7, 8}, {6})
    assert pos[2] == S({1, 2, 6, 7}, {3, 4, 5, 7}, {7, 8}, {7})


def test_equivalence_classes_keep_missing_as_value(spark):
    cells = C.unpivot(fx.f1(spark), "obj", ["a1", "a2"])
    eq = _by_attr(C.equivalence_classes(cells))
    assert frozenset({6}) in eq[1] and frozenset({7}) in eq[2]


def test_min_and_max(spark):
    df = fx.f1(spark)
    mn = collect_sets(aggregate(df, "obj", ["a1", "a2"], "certain").withColumn("k", F.lit(0)), ["k"])[(0,)]
    mx = collect_sets(aggregate(df, "obj", ["a1", "a2"], "possible").withColumn("k", F.lit(0)), ["k"])[(0,)]
    assert mn == S({3}, {8}, {1, 2}, {4, 5})
    assert mx == S({3}, {6}, {7}, {4, 5}, {6, 7}, {7, 8}, {1, 2, 6})


def test_approximations(spark):
    m = approximate(fx.f1(spark), "obj", ["a1", "a2"], "target", members=True)
    got = collect_sets(m, ["kind", "d"])
    assert got[("CL", "yes")] == S({4, 5})
    assert got[("CU", "yes")] == S({8}, {1, 2}, {4, 5})
    assert got[("PL", "yes")] == S({8}, {1, 2}, {4, 5})
    assert got[("PU", "yes")] == S({4, 5}, {7, 8}, {1, 2, 6})
    assert got[("PUr", "yes")] == S({8}, {1, 2}, {4, 5})
    assert got[("CL", "no")] == got[("CU", "no")] == got[("PL", "no")] == S({3})
    assert got[("PU", "no")] == S({3}, {6}, {7}, {6, 7}, {7, 8}, {1, 2, 6})
    assert got[("PUr", "no")] == S({3}, {6}, {7}, {6, 7})


def test_pooled_drops_target(spark):
    m = approximate(fx.f1(spark), "obj", ["a1", "a2"], "target", members=True, pooled=True)
    got = collect_sets(m, ["kind"])
    assert got[("CL",)] == S({4, 5}, {3})
    assert got[("PU",)] == S({3}, {6}, {7}, {4, 5}, {6, 7}, {7, 8}, {1, 2, 6})


def test_status_not_exist(spark):
    from lacuna import status

    df = spark.createDataFrame([(1, "*", "x"), (2, "a", "*")], "obj bigint, a1 string, a2 string")
    assert status(df, "obj", ["a1", "a2"], "certain").collect()[0]["status"] == "not_exist"
    assert status(df, "obj", ["a1", "a2"], "possible").collect()[0]["status"] == "ok"


def test_null_is_missing_and_star_substring_is_not(spark):
    df = spark.createDataFrame([(1, None), (2, "a*"), (3, "a*")], "obj bigint, a1 string")
    cells = C.unpivot(df, "obj", ["a1"])
    cer = _by_attr(C.certain_classes(cells))
    assert cer[1] == S({2, 3})
    pos = _by_attr(C.possible_classes(cells))
    assert pos[1] == S({1, 2, 3}, {1})


def test_user_column_names_do_not_collide(spark):
    """Attributes named like internal columns give the same sets as F1."""
    df = fx.f1(spark).select(F.col("obj").alias("u"), F.col("a1").alias("n"), F.col("a2").alias("lo"),
                             F.col("target").alias("d"))
    m = approximate(df, "u", ["n", "lo"], "d", members=True)
    got = collect_sets(m, ["kind", "d"])
    assert got[("PU", "no")] == S({3}, {6}, {7}, {6, 7}, {7, 8}, {1, 2, 6})
    assert got[("CL", "yes")] == S({4, 5})
    mx = collect_sets(aggregate(df, "u", ["n", "lo"], "possible").withColumn("k", F.lit(0)), ["k"])[(0,)]
    assert mx == S({3}, {6}, {7}, {4, 5}, {6, 7}, {7, 8}, {1, 2, 6})


def test_kind_subsets_equal_the_full_result(spark):
    df = fx.f1(spark)
    full = collect_sets(approximate(df, "obj", ["a1", "a2"], "target", members=True), ["kind", "d"])
    for kinds in (["CU"], ["CL"], ["PL", "PUr"], ["PU"]):
        part = collect_sets(approximate(df, "obj", ["a1", "a2"], "target", members=True, kinds=kinds), ["kind", "d"])
        assert part == {k: v for k, v in full.items() if k[0] in kinds}


def test_methods_and_summary_kinds(spark):
    from lacuna import summary

    df = fx.f1(spark)
    a = collect_sets(approximate(df, "obj", ["a1", "a2"], "target", members=True, method="fold"), ["kind", "d"])
    b = collect_sets(approximate(df, "obj", ["a1", "a2"], "target", members=True, method="expand"), ["kind", "d"])
    assert a == b
    full = {(r["d"], r["kind"]): tuple(r) for r in summary(df, "obj", ["a1", "a2"], "target").collect()}
    part = {(r["d"], r["kind"]): tuple(r) for r in summary(df, "obj", ["a1", "a2"], "target", kinds=["PL"]).collect()}
    assert part == {k: v for k, v in full.items() if k[1] == "PL"}
