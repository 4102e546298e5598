"""Random small tables: Spark (fast path, both maxA methods, general path)
against the brute force of the definitions."""

import random

import pytest
from helpers import aggregate as brute_aggregate
from helpers import approximations, collect_sets
from pyspark.sql import functions as F

from lacuna import approximate, approximate_families
from lacuna.functions.setstats import DIGEST
from lacuna.operators import classes as C
from lacuna.operators.aggregate import aggregate_possible, patterns
from lacuna.operators.aggregate import pattern_units
from lacuna.operators.sets import family_members


def random_table(rng, n, k, p_missing):
    rows = {}
    for o in range(1, n + 1):
        rows[o] = tuple("*" if rng.random() < p_missing else rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(k))
    targets = {"x": {o for o in rows if rng.random() < 0.5}, "y": {o for o in rows if rng.random() < 0.4}}
    return rows, {d: s for d, s in targets.items() if s}


def to_frames(spark, rows, k, targets):
    df = spark.createDataFrame([(o, *v) for o, v in rows.items()], ["obj"] + [f"a{i+1}" for i in range(k)])
    x = spark.createDataFrame([(d, o) for d, s in targets.items() for o in s], "d string, obj bigint")
    return df, x


def _sets(m):
    return {key: v for key, v in collect_sets(m, ["kind", "d"]).items()}


@pytest.mark.parametrize("seed", range(6))
def test_fast_path_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    k = rng.randint(1, 3)
    rows, targets = random_table(rng, rng.randint(3, 9), k, rng.choice([0.1, 0.3, 0.6]))
    df, x = to_frames(spark, rows, k, targets)
    attrs = [f"a{i+1}" for i in range(k)]
    got = _sets(approximate(df, "obj", attrs, x, members=True))
    assert got == approximations(rows, k, targets)


@pytest.mark.parametrize("seed", range(4))
def test_fold_and_expansion_equal_brute_force(spark, seed):
    rng = random.Random(100 + seed)
    k = 3
    rows, _ = random_table(rng, 12, k, 0.35)
    df, _ = to_frames(spark, rows, k, {"x": {1}})
    attrs = ["a1", "a2", "a3"]
    pdf = C.prepare(df, "obj", attrs)
    pats = patterns(pdf, attrs)
    want = brute_aggregate(rows, k, "possible")
    for method in ("fold", "expand"):
        fam = aggregate_possible(pats, attrs, method=method)
        m = family_members(fam, pattern_units(pdf, attrs)).withColumnRenamed("cid", "class_id")
        got = collect_sets(m.withColumn("k", F.lit(0)), ["k"]).get((0,), set())
        assert got == want, method


@pytest.mark.parametrize("seed", range(3))
def test_general_path_matches_brute_force(spark, seed):
    rng = random.Random(200 + seed)
    k = 2
    rows, targets = random_table(rng, 8, k, 0.3)
    mn, mx = brute_aggregate(rows, k, "certain"), brute_aggregate(rows, k, "possible")
    if not mn:
        pytest.skip("no complete object")
    fam = lambda fs: spark.createDataFrame(
        [(i, o) for i, s in enumerate(sorted(fs, key=sorted)) for o in s], "class_id int, obj bigint")
    x = spark.createDataFrame([(d, o) for d, s in targets.items() for o in s], "d string, obj bigint")
    res = approximate_families(fam(mn), fam(mx), x)
    want = approximations(rows, k, targets)
    got_counts = {(r["kind"], r["d"]): r["c"] for r in res.groupBy("kind", "d").agg(F.count("*").alias("c")).collect()}
    assert got_counts == {key: len(v) for key, v in want.items()}
    digests = {(r["kind"], r["d"], r["n"], r["lo"], r["hi"]) for r in res.select("kind", "d", *DIGEST).collect()}
    assert digests == {(kk, d, len(s), min(s), max(s)) for (kk, d), v in want.items() for s in v}


def test_attribute_order_does_not_matter(spark):
    rng = random.Random(7)
    rows, targets = random_table(rng, 10, 3, 0.3)
    df, x = to_frames(spark, rows, 3, targets)
    a = approximate(df, "obj", ["a1", "a2", "a3"], x).collect()
    b = approximate(df, "obj", ["a3", "a1", "a2"], x).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_hot_key_split_keeps_every_row(spark, monkeypatch):
    """Force every pattern to be 'hot' and check members are unchanged."""
    from lacuna.plans import tuning

    rng = random.Random(11)
    rows, targets = random_table(rng, 12, 2, 0.3)
    df, x = to_frames(spark, rows, 2, targets)
    want = _sets(approximate(df, "obj", ["a1", "a2"], x, members=True))
    orig = tuning.split_hot_join

    def tiny(small, big, keys, sizes, **kw):
        kw["rows_per_split"] = 1
        return orig(small, big, keys, sizes, **kw)

    monkeypatch.setattr(tuning, "split_hot_join", tiny)
    import lacuna.operators.approx as ap
    monkeypatch.setattr(ap, "split_hot_join", tiny)
    got = _sets(approximate(df, "obj", ["a1", "a2"], x, members=True))
    assert got == want == approximations(rows, 2, targets)


def test_large_domain_paths_split_the_missing_key(spark, monkeypatch):
    """Force the non-broadcast value-map joins and tiny splits: same sets."""
    from lacuna.plans import tuning
    import lacuna.operators.aggregate as ag
    import lacuna.operators.classes as cl

    rng = random.Random(5)
    rows, targets = random_table(rng, 12, 3, 0.4)
    df, x = to_frames(spark, rows, 3, targets)
    cells = C.unpivot(df, "obj", ["a1", "a2", "a3"])
    want_pos = sorted(map(tuple, C.possible_classes(cells).collect()))
    orig = tuning.split_hot_join

    def tiny(*a, **k):
        k["rows_per_split"] = 1
        return orig(*a, **k)

    monkeypatch.setattr(ag, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(cl, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ag, "split_hot_join", tiny)
    monkeypatch.setattr(cl, "split_hot_join", tiny)
    assert sorted(map(tuple, C.possible_classes(cells).collect())) == want_pos
    got = _sets(approximate(df, "obj", ["a1", "a2", "a3"], x, members=True))
    assert got == approximations(rows, 3, targets)


def test_general_path_ignores_duplicate_input_sets(spark):
    rng = random.Random(3)
    rows, targets = random_table(rng, 9, 2, 0.3)
    mn, mx = brute_aggregate(rows, 2, "certain"), brute_aggregate(rows, 2, "possible")
    if not mn:
        pytest.skip("no complete object")

    def fam(fs, copies):
        sets = [s for s in sorted(fs, key=sorted) for _ in range(copies)]
        return spark.createDataFrame([(i, o) for i, s in enumerate(sets) for o in s], "class_id int, obj bigint")

    x = spark.createDataFrame([(d, o) for d, s in targets.items() for o in s], "d string, obj bigint")
    once = sorted(map(tuple, approximate_families(fam(mn, 1), fam(mx, 1), x).collect()))
    twice = sorted(map(tuple, approximate_families(fam(mn, 2), fam(mx, 3), x).collect()))
    assert once == twice


def test_renaming_ids_and_adding_all_missing_object(spark):
    """Metamorphic: ids renamed by a monotone map keep every set size; an
    object missing everywhere joins every max block (and adds {z} when some
    value tuple had no object) but no min block."""
    rng = random.Random(21)
    rows, targets = random_table(rng, 10, 2, 0.25)
    base = approximations(rows, 2, targets)
    renamed = {o * 7 + 3: v for o, v in rows.items()}
    rtargets = {d: {o * 7 + 3 for o in s} for d, s in targets.items()}
    df, x = to_frames(spark, renamed, 2, rtargets)
    got = _sets(approximate(df, "obj", ["a1", "a2"], x, members=True))
    assert {k: sorted(len(s) for s in v) for k, v in got.items()} == \
           {k: sorted(len(s) for s in v) for k, v in base.items()}
    z = max(rows) + 1
    rows2 = dict(rows)
    rows2[z] = ("*", "*")
    mx1, mx2 = brute_aggregate(rows, 2, "possible"), brute_aggregate(rows2, 2, "possible")
    assert {m | {z} for m in mx1} <= mx2 and all(z in m for m in mx2)
    df2, _ = to_frames(spark, rows2, 2, targets)
    from lacuna import aggregate as agg
    got_mx = collect_sets(agg(df2, "obj", ["a1", "a2"], "possible").withColumn("k", F.lit(0)), ["k"])[(0,)]
    assert got_mx == mx2


@pytest.mark.parametrize("seed", range(2))
def test_wide_tables_match_brute_force(spark, seed):
    """Seven attributes (the fold cuts its lineage on the way): fold,
    expansion and the full fast path against brute force."""
    rng = random.Random(300 + seed)
    k = 7
    rows, targets = random_table(rng, 14, k, 0.25)
    df, x = to_frames(spark, rows, k, targets)
    attrs = [f"a{i+1}" for i in range(k)]
    pdf = C.prepare(df, "obj", attrs)
    pats = patterns(pdf, attrs)
    want = brute_aggregate(rows, k, "possible")
    for method in ("fold", "expand"):
        fam = aggregate_possible(pats, attrs, method=method)
        m = family_members(fam, pattern_units(pdf, attrs)).withColumnRenamed("cid", "class_id")
        assert collect_sets(m.withColumn("k", F.lit(0)), ["k"]).get((0,), set()) == want, method
    assert _sets(approximate(df, "obj", attrs, x, members=True)) == approximations(rows, k, targets)


def test_per_pattern_bound_falls_back_to_fold(spark, monkeypatch):
    import lacuna.operators.aggregate as ag

    rng = random.Random(41)
    rows, targets = random_table(rng, 12, 3, 0.4)
    df, x = to_frames(spark, rows, 3, targets)
    monkeypatch.setattr(ag, "EXPAND_PER_PATTERN", 1)
    called = []
    orig = ag.aggregate_possible_expand
    monkeypatch.setattr(ag, "aggregate_possible_expand", lambda *a, **k: called.append(1) or orig(*a, **k))
    got = _sets(approximate(df, "obj", ["a1", "a2", "a3"], x, members=True))
    assert not called
    assert got == approximations(rows, 3, targets)


def test_general_path_pooled_equals_fast_path_pooled(spark):
    rng = random.Random(17)
    rows, targets = random_table(rng, 10, 2, 0.3)
    df, x = to_frames(spark, rows, 2, targets)
    from lacuna import aggregate as agg

    mn = agg(df, "obj", ["a1", "a2"], "certain")
    mx = agg(df, "obj", ["a1", "a2"], "possible")
    if mn.count() == 0:
        pytest.skip("no complete object")
    gen = sorted(map(tuple, approximate_families(mn, mx, x, pooled=True).collect()))
    fast = sorted(map(tuple, approximate(df, "obj", ["a1", "a2"], x, pooled=True).collect()))
    assert gen == fast


def test_estimate_matches_direct_count(spark):
    """Expansion rows = Σ over objects' patterns of ∏ (|dom|+1) over missing attributes."""
    from lacuna import estimate_possible

    rng = random.Random(9)
    rows, _ = random_table(rng, 15, 3, 0.3)
    df, _ = to_frames(spark, rows, 3, {"x": {1}})
    est = estimate_possible(df, "obj", ["a1", "a2", "a3"])
    pats = set(rows.values())
    dom = [len({p[i] for p in pats}) for i in range(3)]  # distinct values incl. '*'
    want = 0
    for p in pats:
        prod = 1
        for i in range(3):
            if p[i] == "*":
                prod *= dom[i]
        want += prod
    assert est["expansion_rows"] == want and est["patterns"] == len(pats)
    assert est["domains"] == {"a1": dom[0], "a2": dom[1], "a3": dom[2]}
    assert est["method"] in ("expand", "fold")
