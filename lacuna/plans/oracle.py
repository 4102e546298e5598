"""DuckDB oracle SQL: the literal set definitions, on the same parquet views.

Sets are built as sorted lists and compared with ``list_has_all`` /
``list_intersect``; Spark uses the pattern-level fast path, so every run
re-tests the equivalence.  Each set is reported by the same digest as
``lacuna.functions.setstats`` (n, lo, hi, s1, s2).
"""

from __future__ import annotations

from lacuna.functions.setstats import M1, M2

# Fixture tables (must equal lacuna.plans.fixtures).
F2 = """t AS (SELECT p_partkey AS obj,
  CASE WHEN p_partkey % 53 = 3 THEN '*' ELSE p_brand END AS a1,
  CASE WHEN p_partkey % 59 = 5 THEN '*' ELSE p_type END AS a2,
  CASE WHEN p_partkey % 61 = 7 THEN '*' ELSE CAST(p_size AS VARCHAR) END AS a3,
  CASE WHEN p_partkey % 10 < 7 THEN 'low' ELSE 'high' END AS d
FROM part)"""

F2B = """xt AS (SELECT 'low' AS d, p_partkey AS obj FROM part WHERE p_partkey % 10 < 7
  UNION ALL SELECT 'mod3' AS d, p_partkey AS obj FROM part WHERE p_partkey % 3 = 0)"""

F3 = """t3 AS (SELECT p_partkey AS obj,
  CASE WHEN p_partkey % 2 = 0 THEN '*' ELSE p_type END AS a1,
  CASE WHEN p_partkey % 2 = 1 THEN '*' ELSE p_brand END AS a2
FROM part)"""

F4 = """t AS (SELECT o_orderkey AS obj,
  CASE WHEN o_orderkey % 7 = 3 THEN '*' ELSE o_orderstatus END AS a1,
  CASE WHEN o_orderkey % 11 = 5 THEN '*' ELSE o_orderpriority END AS a2,
  CASE WHEN o_orderkey % 13 = 7 THEN '*' ELSE CAST(o_custkey % 4 AS VARCHAR) END AS a3,
  CASE WHEN o_totalprice >= 250000 THEN 'big' ELSE 'small' END AS d
FROM orders)"""

F5 = """t AS (SELECT event_id AS obj,
  CASE WHEN event_id % 17 = 4 THEN '*' ELSE event_type END AS a1,
  CASE WHEN event_id % 19 = 6 THEN '*' ELSE CAST(user_id AS VARCHAR) END AS a2,
  CASE WHEN event_id % 23 = 8 THEN '*' ELSE CAST(day(ts) AS VARCHAR) END AS a3,
  CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS d
FROM events)"""

F6 = """t AS (SELECT o_orderkey AS obj,
  CASE WHEN o_orderkey % 7 = 3 THEN '*' ELSE o_orderstatus END AS a1,
  CASE WHEN o_orderkey % 11 = 5 THEN '*' ELSE o_orderpriority END AS a2,
  CASE WHEN o_orderkey % 13 = 7 THEN '*' ELSE CAST(o_custkey % 4 AS VARCHAR) END AS a3,
  CASE WHEN o_orderkey % 17 = 2 THEN '*' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS a4,
  CASE WHEN o_orderkey % 19 = 4 THEN '*' ELSE CAST(month(o_orderdate) AS VARCHAR) END AS a5,
  CASE WHEN o_orderkey % 23 = 6 THEN '*' ELSE CAST(floor(o_totalprice / 100000) AS BIGINT)::VARCHAR END AS a6,
  CASE WHEN o_orderkey % 29 = 8 THEN '*' ELSE CAST(o_custkey % 3 AS VARCHAR) END AS a7,
  CASE WHEN o_orderkey % 31 = 10 THEN '*' ELSE CAST(dayofweek(o_orderdate) + 1 AS VARCHAR) END AS a8,
  CASE WHEN o_totalprice >= 250000 THEN 'big' ELSE 'small' END AS d
FROM orders)"""


def reachable_maxa(k: int) -> str:
    """maxA over a1..ak: P(t) for every value tuple t holding some object.

    Each object is joined to {its value, or every value of the column when
    missing} per attribute, i.e. to exactly the tuples whose block holds it.
    """
    doms = ",\n".join(f"d{i} AS (SELECT DISTINCT a{i} AS v FROM t)" for i in range(1, k + 1))
    joins = "\n".join(f"  JOIN d{i} ON (t.a{i} = d{i}.v OR t.a{i} = '*')" for i in range(1, k + 1))
    vs = ", ".join(f"d{i}.v AS v{i}" for i in range(1, k + 1))
    gs = ", ".join(f"v{i}" for i in range(1, k + 1))
    return (f"{doms},\nex AS (SELECT t.obj, {vs} FROM t\n{joins}),\n"
            f"maxa AS (SELECT DISTINCT list_sort(list(obj)) AS s FROM ex GROUP BY {gs})")


CELLS = """cells AS (
  SELECT 1 AS attr, a1 AS value, obj FROM t UNION ALL
  SELECT 2, a2, obj FROM t UNION ALL
  SELECT 3, a3, obj FROM t UNION ALL
  SELECT 4, d, obj FROM t)"""

POSSIBLE = """poss AS (SELECT c.attr, v.value, c.obj
  FROM cells c JOIN (SELECT DISTINCT attr, value FROM cells) v
    ON c.attr = v.attr AND (c.value = v.value OR c.value = '*'))"""

# minA: one certain class per attribute, intersected: the complete tuples.
MINA = """mina AS (SELECT DISTINCT list_sort(list(obj)) AS s FROM t
  WHERE a1 <> '*' AND a2 <> '*' AND a3 <> '*' GROUP BY a1, a2, a3)"""

# maxA: one possible class per attribute (P(v) or the missing block), intersected.
MAXA = """tup AS (SELECT * FROM (SELECT DISTINCT a1 AS v1 FROM t), (SELECT DISTINCT a2 AS v2 FROM t),
    (SELECT DISTINCT a3 AS v3 FROM t)),
maxa AS (SELECT DISTINCT list_sort(list(t.obj)) AS s FROM tup JOIN t
  ON (t.a1 = tup.v1 OR t.a1 = '*') AND (t.a2 = tup.v2 OR t.a2 = '*') AND (t.a3 = tup.v3 OR t.a3 = '*')
  GROUP BY tup.v1, tup.v2, tup.v3)"""

XS = """xs AS (SELECT d, list_sort(list(obj)) AS s FROM t GROUP BY d)"""
XS_B = """xs AS (SELECT d, list_sort(list(obj)) AS s FROM xt GROUP BY d)"""

# Pre-filtered containment in X keeps the literal definitions cheap to run.
APPROX = """max_in AS (SELECT mx.s, x.d FROM maxa mx, xs x WHERE list_has_all(x.s, mx.s)),
min_in AS (SELECT mn.s, x.d FROM mina mn, xs x WHERE list_has_all(x.s, mn.s)),
cl AS (SELECT DISTINCT mi.d, mn.s FROM mina mn, max_in mi WHERE list_has_all(mn.s, mi.s)),
cu AS (SELECT DISTINCT x.d, list_sort(list_intersect(mn.s, x.s)) AS s FROM mina mn, xs x
  WHERE len(list_intersect(mn.s, x.s)) > 0),
pl AS (SELECT DISTINCT mi.d, list_sort(list_intersect(mx.s, x.s)) AS s
  FROM maxa mx, min_in mi, xs x WHERE mi.d = x.d AND list_has_all(mx.s, mi.s)),
pu AS (SELECT DISTINCT x.d, mx.s FROM maxa mx, xs x WHERE len(list_intersect(mx.s, x.s)) > 0),
pur AS (SELECT DISTINCT x.d, list_sort(list_intersect(mx.s, x.s)) AS s FROM maxa mx, xs x
  WHERE len(list_intersect(mx.s, x.s)) > 0),
allk AS (SELECT 'CL' AS kind, d, s FROM cl UNION ALL SELECT 'CU', d, s FROM cu UNION ALL
  SELECT 'PL', d, s FROM pl UNION ALL SELECT 'PU', d, s FROM pu UNION ALL SELECT 'PUr', d, s FROM pur)"""


def digest(sets: str, keys: list[str]) -> str:
    """Digest per row of ``sets`` (keys..., s LIST)."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    return f"""SELECT {kc}CAST(COUNT(*) AS BIGINT) AS n, MIN(x) AS lo, MAX(x) AS hi,
  CAST(SUM(x % {M1}) AS BIGINT) AS s1, CAST(SUM((x % {M2}) * (x % {M2})) AS BIGINT) AS s2
FROM (SELECT {kc}sid, UNNEST(s) AS x FROM (SELECT *, ROW_NUMBER() OVER () AS sid FROM {sets}))
GROUP BY {kc}sid"""


def group_digest(src: str, keys: list[str], obj: str = "obj") -> str:
    """Digest of the members of each group of ``src`` (no dedupe needed)."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    return f"""SELECT {kc}CAST(COUNT(*) AS BIGINT) AS n, MIN({obj}) AS lo, MAX({obj}) AS hi,
  CAST(SUM({obj} % {M1}) AS BIGINT) AS s1, CAST(SUM(({obj} % {M2}) * ({obj} % {M2})) AS BIGINT) AS s2
FROM {src} GROUP BY {k}"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def kind_query(kind_cte: str) -> str:
    return with_(F2, MINA, MAXA, XS, APPROX) + digest(kind_cte, ["d"])


def summary_by_division(fixture: str, k: int) -> str:
    """The summary with containment as relational division: sets as rows, kept where the shared rows are all."""
    known = " AND ".join(f"a{i} <> '*'" for i in range(1, k + 1))
    by = ", ".join(f"a{i}" for i in range(1, k + 1))
    return with_(fixture, reachable_maxa(k), f"""mn AS (SELECT row_number() OVER () AS i, list(obj) AS s FROM t WHERE {known} GROUP BY {by}),
mx AS (SELECT row_number() OVER () AS j, s FROM maxa),
mnu AS (SELECT i, len(s) AS n, unnest(s) AS obj FROM mn),
mxu AS (SELECT j, len(s) AS n, unnest(s) AS obj FROM mx),
mnx AS (SELECT i, d, n, count(*) AS m FROM mnu JOIN t USING (obj) GROUP BY i, d, n),
mxx AS (SELECT j, d, n, count(*) AS m, list(obj ORDER BY obj) AS s FROM mxu JOIN t USING (obj) GROUP BY j, d, n),
pairs AS (SELECT i, j, mnu.n AS ni, mxu.n AS nj, count(*) AS m FROM mnu JOIN mxu USING (obj) GROUP BY i, j, mnu.n, mxu.n),
cl AS (SELECT DISTINCT mxx.d, pairs.i, pairs.ni FROM pairs JOIN mxx USING (j) WHERE pairs.m = pairs.nj AND mxx.m = mxx.n),
pl AS (SELECT DISTINCT mnx.d, pairs.j FROM pairs JOIN mnx USING (i) WHERE pairs.m = pairs.ni AND mnx.m = mnx.n),
pls AS (SELECT mxx.d, mxx.s FROM pl JOIN mxx ON mxx.j = pl.j AND mxx.d = pl.d)""") + """SELECT d, 'CL' AS kind, count(*) AS n_classes, CAST(sum(ni) AS BIGINT) AS n_objects FROM cl GROUP BY d
UNION ALL SELECT d, 'CU', count(*), CAST(sum(m) AS BIGINT) FROM mnx GROUP BY d
UNION ALL SELECT d, 'PL', count(DISTINCT s), (SELECT count(DISTINCT x) FROM (SELECT unnest(p.s) AS x FROM pls p WHERE p.d = pls.d)) FROM pls GROUP BY d
UNION ALL SELECT d, 'PU', count(*), (SELECT count(DISTINCT mxu.obj) FROM mxu JOIN mxx y USING (j) WHERE y.d = mxx.d) FROM mxx GROUP BY d
UNION ALL SELECT d, 'PUr', count(DISTINCT s), (SELECT count(DISTINCT x) FROM (SELECT unnest(y.s) AS x FROM mxx y WHERE y.d = mxx.d)) FROM mxx GROUP BY d"""


def queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["unpivot"] = with_(F2, CELLS) + "SELECT attr, value, obj FROM cells"
    q["equivalence_classes"] = with_(F2, CELLS) + group_digest("cells", ["attr", "value"])
    q["certain_classes"] = with_(F2, CELLS) + group_digest("(SELECT * FROM cells WHERE value <> '*')", ["attr", "value"])
    q["possible_classes"] = with_(F2, CELLS, POSSIBLE) + group_digest("poss", ["attr", "value"])
    q["select_attributes"] = with_(F2, CELLS) + "SELECT attr, value, obj FROM cells WHERE attr IN (1, 3)"
    q["pick_family"] = with_(F2, CELLS) + group_digest(
        "(SELECT * FROM cells WHERE value <> '*' AND attr <= 3)", ["attr", "value"])
    q["classes"] = with_(F2, CELLS, POSSIBLE) + group_digest(
        "(SELECT 'certain' AS kind, attr, value, obj FROM cells WHERE value <> '*' AND attr <= 3 "
        "UNION ALL SELECT 'possible' AS kind, attr, value, obj FROM poss WHERE attr <= 3)", ["kind", "attr", "value"])
    q["refine_two"] = with_(
        F2, CELLS, POSSIBLE,
        """p1 AS (SELECT value, list_sort(list(obj)) AS s FROM poss WHERE attr = 1 GROUP BY value),
p2 AS (SELECT value, list_sort(list(obj)) AS s FROM poss WHERE attr = 2 GROUP BY value),
r AS (SELECT DISTINCT list_sort(list_intersect(p1.s, p2.s)) AS s FROM p1, p2
  WHERE len(list_intersect(p1.s, p2.s)) > 0)""") + digest("r", [])
    q["aggregate_certain"] = with_(F2, MINA) + digest("mina", [])
    q["aggregate_possible"] = with_(F2, MAXA) + digest("maxa", [])
    q["merge_partials"] = with_(
        F2,
        """tup12 AS (SELECT * FROM (SELECT DISTINCT a1 AS v1 FROM t), (SELECT DISTINCT a2 AS v2 FROM t)),
f12 AS (SELECT DISTINCT list_sort(list(t.obj)) AS s FROM tup12 JOIN t
  ON (t.a1 = tup12.v1 OR t.a1 = '*') AND (t.a2 = tup12.v2 OR t.a2 = '*') GROUP BY tup12.v1, tup12.v2),
f3 AS (SELECT DISTINCT list_sort(list(t.obj)) AS s FROM (SELECT DISTINCT a3 AS v3 FROM t) v JOIN t
  ON (t.a3 = v.v3 OR t.a3 = '*') GROUP BY v.v3),
r AS (SELECT DISTINCT list_sort(list_intersect(f12.s, f3.s)) AS s FROM f12, f3
  WHERE len(list_intersect(f12.s, f3.s)) > 0)""") + digest("r", [])
    q["aggregate_status"] = with_(F3) + """SELECT 'certain' AS kind, '1,2' AS attrs,
  CASE WHEN COUNT(*) > 0 THEN 'ok' ELSE 'not_exist' END AS status FROM t3 WHERE a1 <> '*' AND a2 <> '*'
UNION ALL SELECT 'possible', '1,2', CASE WHEN COUNT(*) > 0 THEN 'ok' ELSE 'not_exist' END FROM t3"""
    q["decision_classes"] = with_(F2) + group_digest("t", ["d"])
    for name, cte in [("certain_lower", "cl"), ("certain_upper", "cu"), ("possible_lower", "pl"),
                      ("possible_upper", "pu"), ("possible_upper_restricted", "pur")]:
        q[name] = kind_query(cte)
    q["approximations_pooled"] = with_(
        F2, F2B, MINA, MAXA, XS_B, APPROX,
        "pooled AS (SELECT DISTINCT kind, s FROM allk)") + digest("pooled", ["kind"])
    q["approximate_families"] = with_(F2, MINA, MAXA, XS, APPROX) + digest("allk", ["kind", "d"])
    q["approximation_summary"] = with_(F2, MINA, MAXA, XS, APPROX) + """SELECT d, kind,
  CAST(COUNT(DISTINCT s) AS BIGINT) AS n_classes,
  CAST((SELECT COUNT(DISTINCT x) FROM (SELECT UNNEST(a.s) AS x FROM allk a WHERE a.d = g.d AND a.kind = g.kind))
    AS BIGINT) AS n_objects
FROM allk g GROUP BY d, kind"""
    q["containment_pairs"] = with_(
        F2, MINA, MAXA,
        "pairs AS (SELECT list_min(mn.s) AS g, mx.s AS s FROM maxa mx, mina mn WHERE list_has_all(mx.s, mn.s))"
    ) + digest("pairs", ["g"])
    q["set_membership"] = with_(F2, MINA, MAXA) + """SELECT list_min(mn.s) AS id,
  EXISTS (SELECT 1 FROM maxa mx WHERE mx.s = mn.s) AS found FROM mina mn"""
    q["nway_intersection"] = with_(F2, F2B) + group_digest(
        "(SELECT t.d AS group_id, t.obj FROM t JOIN xt ON xt.obj = t.obj AND xt.d = 'mod3')", ["group_id"])
    q["codec_roundtrip"] = with_(F2, CELLS) + f"""SELECT attr, value, CAST(COUNT(DISTINCT obj // 4096) AS BIGINT) AS n_lines,
  CAST(COUNT(*) AS BIGINT) AS n, MIN(obj) AS lo, MAX(obj) AS hi,
  CAST(SUM(obj % {M1}) AS BIGINT) AS s1, CAST(SUM((obj % {M2}) * (obj % {M2})) AS BIGINT) AS s2
FROM cells GROUP BY attr, value"""
    q["read_targets"] = with_(F2) + "SELECT d, obj FROM t"
    q["orders_aggregate_possible"] = with_(F4, MAXA) + digest("maxa", [])
    q["orders_summary"] = q["approximation_summary"].replace(F2, F4)
    q["events_aggregate_possible"] = with_(F5, MAXA) + digest("maxa", [])
    q["events_summary"] = summary_by_division(F5, 3)
    q["orders8_summary"] = summary_by_division(F6, 8)
    q["orders8_aggregate_possible"] = with_(F6, reachable_maxa(8)) + digest("maxa", [])
    q["read_numbered"] = with_(F2) + "SELECT ROW_NUMBER() OVER (ORDER BY obj) AS obj, a1, a2, a3, d FROM t"
    q["compact"] = q["unpivot"]
    # line numbers in key order; objects whose a3 cell is absent lie in no block
    ragged = ("t AS (SELECT * FROM (SELECT ROW_NUMBER() OVER (ORDER BY obj) AS obj, a1, a2, a3 FROM ("
              + F2[len("t AS ("):-1] + ")) WHERE a3 <> '*')")
    q["ragged_aggregate_possible"] = with_(ragged, MAXA) + digest("maxa", [])
    q["sequencefile_roundtrip"] = q["equivalence_classes"]
    q["long_pairs_roundtrip"] = with_(F2) + """SELECT obj + CASE WHEN obj % 2 = 0 THEN 0 ELSE 5000000000 END AS obj,
  a1 || ',' || a2 || ',' || a3 AS line FROM t"""
    q["write_sets_text"] = q["approximate_families"]
    q["sets_text_roundtrip"] = with_(F2, CELLS) + group_digest(
        "(SELECT 'a' || attr AS kind, value, obj FROM cells)", ["kind", "value"])
    q["families_roundtrip"] = group_digest(
        "(SELECT '1' AS key, p_brand, p_partkey % 2 AS odd, p_partkey AS obj FROM part)", ["key", "p_brand", "odd"]
    ).replace("SELECT key, p_brand, odd, ", "SELECT key, ", 1)
    q["family_halves"] = group_digest(
        "(SELECT s_nationkey AS key, 1 AS h, s_suppkey AS obj FROM supplier UNION ALL "
        "SELECT s_nationkey, 2, s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)", ["key", "h"]
    ).replace("SELECT key, h, ", "SELECT key, ", 1)
    q["family_strings"] = """SELECT s_nationkey AS k, count(*) AS n,
  coalesce(string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) FILTER (s_suppkey % 2 = 0), '') || '|' ||
  coalesce(string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) FILTER (s_suppkey % 2 = 1), '') AS family
FROM supplier GROUP BY s_nationkey"""
    q["sets_by_size"] = with_(F2, CELLS) + "SELECT row_number() OVER (ORDER BY n, lo) AS pos, * EXCLUDE (value) FROM (" + group_digest(
        "(SELECT * FROM cells WHERE attr = 2)", ["value"]) + ")"
    q["set_union"] = with_(F2B) + "SELECT DISTINCT obj FROM xt"
    q["nway_three"] = with_(F2, F2B) + group_digest(
        "(SELECT t.d AS group_id, t.obj FROM t JOIN xt ON xt.obj = t.obj AND xt.d = 'mod3' WHERE t.a2 <> '*')", ["group_id"])
    q["approximation_members"] = with_(F2, MINA, MAXA, XS, APPROX) + f"""SELECT kind, d, len(s)::BIGINT AS n, list_min(s) AS lo,
  list_max(s) AS hi, CAST(list_sum(list_transform(s, lambda x: x % {M1})) AS BIGINT) AS s1,
  CAST(list_sum(list_transform(s, lambda x: (x % {M2}) * (x % {M2}))) AS BIGINT) AS s2, unnest(s) AS obj FROM allk"""
    q["containment_shared"] = with_(F2) + "SELECT DISTINCT a2 AS f, a2 AS g FROM t"
    q["stream_targets"] = with_(F2, F2B, MINA, MAXA, XS_B, APPROX) + digest("allk", ["kind", "d"])
    return q
