"""Brute force of the set definitions (pure Python) and result readers."""

from __future__ import annotations

from pyspark.sql import functions as F

MISSING = "*"


def family(rows: dict[int, tuple], i: int, kind: str) -> list[frozenset]:
    vals = sorted({r[i] for r in rows.values() if r[i] != MISSING})
    miss = frozenset(o for o, r in rows.items() if r[i] == MISSING)
    cer = {v: frozenset(o for o, r in rows.items() if r[i] == v) for v in vals}
    if kind == "certain":
        return [cer[v] for v in vals]
    fam = [cer[v] | miss for v in vals]
    if miss:
        fam.append(miss)
    return fam


def aggregate(rows, k, kind) -> set[frozenset]:
    fam = {s for s in family(rows, 0, kind) if s}
    for i in range(1, k):
        fam = {f & g for f in fam for g in family(rows, i, kind) if f & g}
    return fam


def approximations(rows, k, targets: dict[str, set]) -> dict[tuple[str, str], set[frozenset]]:
    mn, mx = aggregate(rows, k, "certain"), aggregate(rows, k, "possible")
    out = {}
    for d, x in targets.items():
        x = frozenset(x)
        out[("CL", d)] = {m for m in mn if any(M <= m and M <= x for M in mx)}
        out[("CU", d)] = {m & x for m in mn if m & x}
        out[("PL", d)] = {M & x for M in mx if M & x and any(m <= M and m <= x for m in mn)}
        out[("PU", d)] = {M for M in mx if M & x}
        out[("PUr", d)] = {M & x for M in mx if M & x}
    return {k2: v for k2, v in out.items() if v}


def collect_sets(members_df, keys: list[str]) -> dict[tuple, set[frozenset]]:
    """Long ``(keys..., class_id, obj)`` -> {keys: {frozenset}} (small results only)."""
    rows = members_df.groupBy(*keys, "class_id").agg(F.collect_set("obj").alias("s")).collect()
    out: dict[tuple, set[frozenset]] = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), set()).add(frozenset(r["s"]))
    return out
