"""Coded patterns, mixed expansion and fold, and the cost guard, against the definitions."""

import itertools
import random

import pytest
from helpers import aggregate as brute_aggregate
from helpers import approximations, collect_sets
from pyspark.sql import functions as F
from test_property import _sets, random_table, to_frames

import lacuna.operators.aggregate as ag
import lacuna.operators.blocks as bl
import lacuna.operators.codes as co
from lacuna import aggregate, approximate, summary
from lacuna.operators import classes as C
from lacuna.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def heavy_table(rng, n, k):
    """A random table, some of whose objects miss all attributes but one."""
    rows, targets = random_table(rng, n, k, 0.2)
    for o in list(rows)[: n // 3]:
        known = rng.randrange(k)
        rows[o] = tuple(v if i == known else "*" for i, v in enumerate(rows[o]))
    return rows, targets


def coded(spark, rows, k):
    df, _ = to_frames(spark, rows, k, {"x": {1}})
    attrs = [f"a{i + 1}" for i in range(k)]
    pats, coding = ag.coded_patterns(C.prepare(df, "obj", attrs), attrs)
    return pats.withColumnRenamed("pid", "u"), coding, attrs


def possible(spark, rows, k):
    df, _ = to_frames(spark, rows, k, {"x": {1}})
    m = aggregate(df, "obj", [f"a{i + 1}" for i in range(k)], "possible")
    return collect_sets(m.withColumn("k", F.lit(0)), ["k"]).get((0,), set())


def test_codes_are_ranks_without_a_global_window(spark):
    rows = [(i, f"v{i * 7919 % 400:03d}" if i % 5 else "*", None if i % 3 else "w") for i in range(1000)]
    df = C.prepare(spark.createDataFrame(rows, "obj int, a string, b string").repartition(7), "obj", ["a", "b"])
    coding = co.dictionary(df, ["a", "b"])
    values = sorted({a for _, a, _ in rows if a != "*"})
    want = {f"0:{v}": i + 1 for i, v in enumerate(values)} | {"1:w": 1}
    assert {r["key"]: r["code"] for r in coding.table.collect()} == want
    assert coding.sizes == {"a": len(values), "b": 1}
    got = {r["obj"]: (r["a_"], r["b_"]) for r in coding.encode(df).select("obj", coding.field("a").alias("a_"), coding.field("b").alias("b_")).collect()}
    assert got == {i: (want.get(f"0:{a}", 0), 1 if b == "w" else 0) for i, a, b in rows}
    plan = aggregate(fx.f2(spark, SF), "obj", fx.F2_ATTRS, "possible", members=False)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("seed", range(4))
def test_heavy_masks_equal_brute_force(spark, monkeypatch, seed):
    rng = random.Random(500 + seed)
    k = 3
    rows, targets = heavy_table(rng, 14, k)
    monkeypatch.setattr(ag, "EXPAND_FACTOR", 1)
    monkeypatch.setattr(ag, "EXPAND_MIN", 0)
    pats, coding, attrs = coded(spark, rows, k)
    cost = bl.measure(pats, coding, attrs)
    assert cost.light is not None  # some masks are heavy
    assert bl.find_blocks(pats, coding, attrs, cost).links.count() > 0
    assert possible(spark, rows, k) == brute_aggregate(rows, k, "possible")
    df, x = to_frames(spark, rows, k, targets)
    assert _sets(approximate(df, "obj", attrs, x, members=True)) == approximations(rows, k, targets)


def test_heavy_patterns_alone_make_blocks(spark, monkeypatch):
    """Values that complete patterns never combine: only heavy patterns lie in those blocks."""
    rows = {1: ("a", "x"), 2: ("b", "y"), 3: ("*", "x"), 4: ("a", "*"), 5: ("*", "*"), 6: ("*", "z"), 7: ("c", "*")}
    monkeypatch.setattr(ag, "EXPAND_FACTOR", 0)
    monkeypatch.setattr(ag, "EXPAND_MIN", 0)
    want = brute_aggregate(rows, 2, "possible")
    assert frozenset({5, 6, 7}) in want  # (c, z)
    assert possible(spark, rows, 2) == want


@pytest.mark.parametrize("seed", range(3))
def test_fold_counts_the_tuples_of_each_set(spark, seed):
    rng = random.Random(600 + seed)
    rows, _ = heavy_table(rng, 10, 3)
    pats, coding, attrs = coded(spark, rows, 3)
    fam, sets = bl.fold(pats, coding, attrs)
    got = {r["cid"]: r["tuples"] for r in sets.collect()}
    assert len(got) == fam.select("cid").distinct().count() == len(brute_aggregate(rows, 3, "possible"))
    doms = [sorted({p[i] for p in rows.values()} - {"*"}) + ["*"] for i in range(3)]
    want = {}
    for t in itertools.product(*doms):
        s = frozenset(o for o, p in rows.items() if all(v in ("*", w) for v, w in zip(p, t)))
        if s:
            want[s] = want.get(s, 0) + 1
    assert sorted(got.values()) == sorted(want.values())


def test_many_heavy_masks_and_wide_keys_equal_brute_force(spark, monkeypatch):
    rng = random.Random(71)
    rows, targets = heavy_table(rng, 12, 3)
    df, x = to_frames(spark, rows, 3, targets)
    want = approximations(rows, 3, targets)
    monkeypatch.setattr(ag, "EXPAND_FACTOR", 0)
    monkeypatch.setattr(ag, "EXPAND_MIN", 0)
    monkeypatch.setattr(bl, "HEAVY_MASKS", 0)  # all patterns are folded
    assert possible(spark, rows, 3) == brute_aggregate(rows, 3, "possible")
    assert _sets(approximate(df, "obj", ["a1", "a2", "a3"], x, members=True)) == want
    monkeypatch.setattr(co, "KEY_BITS", 2)  # keys stay structs
    assert possible(spark, rows, 3) == brute_aggregate(rows, 3, "possible")
    assert _sets(approximate(df, "obj", ["a1", "a2", "a3"], x, members=True)) == want


@pytest.mark.parametrize("method", ["auto", "expand", "fold"])
def test_cap_raises_with_the_estimate(spark, method):
    rng = random.Random(3)
    rows, targets = random_table(rng, 12, 3, 0.3)
    df, x = to_frames(spark, rows, 3, targets)
    attrs = ["a1", "a2", "a3"]
    from lacuna import estimate_possible

    est = estimate_possible(df, "obj", attrs)
    with pytest.raises(bl.CostExceeded, match=f"{est['expansion_rows']} memberships of {est['patterns']} patterns"):
        aggregate(df, "obj", attrs, "possible", method=method, max_rows=est["expansion_rows"] - 1)
    with pytest.raises(bl.CostExceeded):
        approximate(df, "obj", attrs, x, method=method, max_rows=1)
    with pytest.raises(bl.CostExceeded):
        summary(df, "obj", attrs, x, method=method, max_rows=1)
    m = aggregate(df, "obj", attrs, "possible", method=method, max_rows=est["expansion_rows"])
    assert collect_sets(m.withColumn("k", F.lit(0)), ["k"])[(0,)] == brute_aggregate(rows, 3, "possible")


def test_no_rows_and_attributes_without_values(spark):
    none = spark.createDataFrame([], "obj bigint, a string, b string")
    assert aggregate(none, "obj", ["a", "b"], "possible").count() == 0
    gone = spark.createDataFrame([(1, None, "x"), (2, "*", "y"), (3, None, None)], "obj bigint, a string, b string")
    m = aggregate(gone, "obj", ["a", "b"], "possible")
    assert collect_sets(m.withColumn("k", F.lit(0)), ["k"])[(0,)] == {frozenset({1, 3}), frozenset({2, 3}), frozenset({3})}
