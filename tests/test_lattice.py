"""Block stats summed attribute by attribute, against the definitions; families as one string a key."""

import random

import pytest
from helpers import aggregate as brute_aggregate
from helpers import approximations
from pyspark.sql import functions as F
from test_blocks import coded, heavy_table
from test_property import to_frames

import lacuna.operators.aggregate as ag
import lacuna.operators.blocks as bl
import lacuna.operators.codes as co
import lacuna.operators.lattice as la
from lacuna import aggregate, summary
from lacuna.plans import registry


def no_memberships(*args, **kwargs):
    raise AssertionError("memberships were written out")


@pytest.mark.parametrize("run", [1, 2, 256])
def test_set_rows_and_summaries_need_no_memberships(spark, monkeypatch, run):
    rng = random.Random(800 + run)
    k = 3
    rows, targets = heavy_table(rng, 16, k)
    monkeypatch.setattr(la, "RUN", run)  # wide attributes are dealt out in runs
    monkeypatch.setattr(la, "TASK_TUPLES", 8)
    monkeypatch.setattr(co.Coding, "expand", no_memberships)
    monkeypatch.setattr(bl, "fold", no_memberships)
    attrs = [f"a{i + 1}" for i in range(k)]
    df, x = to_frames(spark, rows, k, targets)
    got = aggregate(df, "obj", attrs, "possible", members=False).collect()
    want = brute_aggregate(rows, k, "possible")
    assert sorted((r["n"], r["lo"], r["hi"]) for r in got) == sorted((len(s), min(s), max(s)) for s in want)
    sets = approximations(rows, k, targets)
    found = {(r["kind"], r["d"]): (r["n_classes"], r["n_objects"]) for r in summary(df, "obj", attrs, x).collect()}
    assert found == {key: (len(s), len(frozenset().union(*s))) for key, s in sets.items()}


@pytest.mark.parametrize("seed", range(2))
def test_summary_of_a_decision_column(spark, monkeypatch, seed):
    rng = random.Random(830 + seed)
    rows, _ = heavy_table(rng, 16, 3)
    monkeypatch.setattr(la, "RUN", 2)
    monkeypatch.setattr(co.Coding, "expand", no_memberships)
    d = {o: rng.choice(["x", "y", None]) for o in rows}
    df, _ = to_frames(spark, rows, 3, {"x": {1}})
    df = df.join(spark.createDataFrame([(o, v) for o, v in d.items()], "obj bigint, d string"), "obj")
    targets = {v: {o for o in rows if d[o] == v} for v in ("x", "y")}
    sets = approximations(rows, 3, {v: s for v, s in targets.items() if s})
    found = {(r["kind"], r["d"]): (r["n_classes"], r["n_objects"]) for r in summary(df, "obj", ["a1", "a2", "a3"], "d").collect()}
    assert found == {key: (len(s), len(frozenset().union(*s))) for key, s in sets.items()}


def test_a_wide_gap_is_dealt_over_tasks(spark, monkeypatch):
    """One pattern that meets all 1000 values: its tuples are written by several tasks, none lost."""
    monkeypatch.setattr(la, "TASK_TUPLES", 250)
    rows = {i: (f"v{i:04d}", "x") for i in range(1, 1001)} | {1001: ("*", "x")}
    pats, coding, attrs = coded(spark, rows, 2)
    found = la.lattice(coding, attrs, bl.measure(pats, coding, attrs))
    assert found.tuples == 2002
    wide = found._widened(pats.withColumn("cid", F.col("u")), "a1", ())
    assert wide.rdd.getNumPartitions() == 9 and wide.count() == 2001
    sizes = [n for n in wide.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()]
    assert max(sizes) < 1001
    assert found.sums(pats).count() == 1001


def test_many_tuples_are_left_to_the_blocks(spark, monkeypatch):
    rng = random.Random(850)
    rows, _ = heavy_table(rng, 14, 3)
    monkeypatch.setattr(ag, "EXPAND_FACTOR", 0)
    monkeypatch.setattr(ag, "EXPAND_MIN", 0)
    pats, coding, attrs = coded(spark, rows, 3)
    assert la.lattice(coding, attrs, bl.measure(pats, coding, attrs)) is None
    df, _ = to_frames(spark, rows, 3, {"x": {1}})
    assert aggregate(df, "obj", attrs, "possible", members=False).count() == len(brute_aggregate(rows, 3, "possible"))


def test_family_strings_hold_a_whole_key(spark, tmp_path):
    """Ids on both sides of a part's edge stay in one family."""
    ids = [1, 2, 4095, 4096, 4097, 12288]
    spark.createDataFrame([(i, 3) for i in ids] + [(5, 4)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = registry.q_family_strings(spark, str(tmp_path)).collect()
    assert {(r["k"], r["n"], r["family"]) for r in rows} == {(3, 6, "2,4096,12288|1,4095,4097"), (4, 1, "|5")}
