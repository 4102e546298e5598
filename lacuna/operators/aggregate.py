"""Aggregation of classes over many attributes (minA, maxA), at pattern level.

Objects with the same value pattern over the chosen attributes (``'*'``
included) belong to exactly the same blocks, so all set algebra runs on the
distinct patterns, each carrying the stats of its objects.  Object ids come
back only when a caller asks for members.

* minA (certain): the blocks are the complete patterns themselves - a single
  partial aggregate, no join.
* maxA (possible): cheap patterns expanded to their value tuples, costly
  ones folded (``blocks``), over packed keys (``codes``); where only stats
  are asked for, summed attribute by attribute (``lattice``); or a left fold of
  ``refine`` over the attributes, with content dedupe after every step and
  the lineage cut by a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.codec import parse_attribute_list
from lacuna.functions.missing import MISSING, is_complete
from lacuna.functions.setstats import STATS, fingerprint, merge_stats, object_stats
from lacuna.operators.blocks import EXPAND_FACTOR, EXPAND_MIN, EXPAND_PER_PATTERN, Blocks, Cost, by_content, find_blocks, fold, guard, measure
from lacuna.operators.codes import Coding, dictionary
from lacuna.operators.lattice import lattice
from lacuna.operators.sets import distinct_family, refine
from lacuna.plans.tuning import BROADCAST_ROWS, cut_lineage, split_hot_join


def patterns(pdf: DataFrame, attrs: list[str]) -> DataFrame:
    """Distinct value patterns with the stats of their objects.

    ``pdf`` is a prepared table (``obj`` + normalized attributes).  One hash
    aggregate with map-side combine: a pattern shared by a third of all rows
    is reduced per partition before the shuffle.
    """
    return pdf.groupBy(*attrs).agg(*object_stats("obj")).withColumn("pid", F.struct(*attrs))


def coded_patterns(pdf: DataFrame, attrs: list[str]) -> tuple[DataFrame, Coding]:
    """``patterns`` written once with their packed key ``pid``, and the dictionary behind it."""
    plain = cut_lineage(pdf.groupBy(*attrs).agg(*object_stats("obj")), tag="pats")
    coding = dictionary(plain, attrs)
    return cut_lineage(coding.encode(plain).withColumnRenamed("u", "pid"), tag="coded"), coding


def pattern_units(pdf: DataFrame, attrs: list[str]) -> DataFrame:
    """``(u, obj)``: the pattern key of every object (no shuffle)."""
    return pdf.select(F.struct(*attrs).alias("u"), "obj")


def domain_sizes(pats: DataFrame, attrs: list[str]) -> dict[str, int]:
    """Distinct values (``'*'`` included) per attribute: one job over the patterns."""
    row = pats.agg(*[F.countDistinct(a).alias(a) for a in attrs]).collect()[0]
    return {a: int(row[a]) for a in attrs}


def value_map(pats: DataFrame, attr: str) -> DataFrame:
    """``(key, value)``: the possible classes a cell with ``key`` joins.

    A regular value v joins only P(v); ``'*'`` joins every P(v) of the
    attribute and the missing block (value ``'*'``).  At most 2·|dom| rows.
    """
    values = pats.select(F.col(attr).alias("value")).distinct()
    return values.where(F.col("value") != F.lit(MISSING)).select(F.col("value").alias("key"), "value") \
        .unionByName(values.select(F.lit(MISSING).alias("key"), "value"))


def join_value_map(rows: DataFrame, col: str, vmap: DataFrame, dom_size: int | None, out: str,
                   salt: str) -> DataFrame:
    """Add ``out`` = each possible class of ``rows[col]`` (one row per class).

    Broadcast hash join on the attribute column when the domain was measured
    under ``BROADCAST_ROWS``; otherwise a shuffle join in which the ``'*'``
    key (every row missing on the attribute) is split by ``salt``.
    """
    vm = vmap.select(F.col("key").alias("_key"), F.col("value").alias(out))
    if dom_size is not None and 2 * dom_size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(vm), rows[col] == vm["_key"]).drop("_key")
    if dom_size is not None:
        sizes = rows.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
        return split_hot_join(vm, rows, [col], sizes, small_keys=["_key"], salt=salt)
    return rows.join(vm, rows[col] == vm["_key"]).drop("_key")  # AQE decides


def value_membership(pats: DataFrame, attr: str, kind: str, dom_size: int | None = None) -> DataFrame:
    """Family of one attribute over pattern units: ``(cid, u, stats)``.

    certain: a pattern joins the class of its value, missing patterns none.
    possible: a regular value joins P(v); ``'*'`` joins every P(v) of the
    attribute and the missing block (cid ``'*'``).
    """
    base = pats.select(F.col(attr).alias("key"), F.col("pid").alias("u"), *STATS)
    if kind == "certain":
        return base.where(F.col("key") != F.lit(MISSING)).withColumnRenamed("key", "cid")
    j = join_value_map(base, "key", value_map(pats, attr), dom_size, "cid", salt="u")
    return j.select("cid", "u", *STATS)


def aggregate_certain(pats: DataFrame, attrs: list[str]) -> DataFrame:
    """minA as a family over pattern units; class id = content fingerprint."""
    comp = pats.where(is_complete(attrs))
    return comp.select(fingerprint().alias("cid"), F.col("pid").alias("u"), *STATS)


# Fixed value: status of an aggregation that leaves no class; "ok" is ours.
STATUS_EMPTY = "not_exist"
STATUS_OK = "ok"

# Fold steps between two lineage cuts.
CUT_EVERY = 3
def expansion_estimate(pats: DataFrame, attrs: list[str]) -> tuple[int, int, dict[str, int]]:
    """(rows of the one-pass expansion, number of patterns, domain sizes).

    A pattern missing on a joins every value of a and the missing block:
    ``|dom(a)| + 1`` = distinct values of the column, ``'*'`` included.  With
    ``c_m`` patterns per missing-attribute mask m, the rows are
    ``Σ_m c_m · ∏_{a in m} |dom(a)|``; up to four attributes the mask counts
    and the domain sizes come from one aggregate (one small job).
    """
    rows, n, dom, _ = expansion_profile(pats, attrs)
    return rows, n, dom


def expansion_profile(pats: DataFrame, attrs: list[str]) -> tuple[int, int, dict[str, int], int]:
    """``expansion_estimate`` plus the largest expansion of a single pattern."""
    k = len(attrs)
    if k > 4:
        dom = domain_sizes(pats, attrs)
        factor = F.lit(1.0)
        for a in attrs:
            factor = factor * F.when(F.col(a) == F.lit(MISSING), F.lit(float(dom[a]))).otherwise(F.lit(1.0))
        row = pats.agg(F.sum(factor).alias("rows"), F.count(F.lit(1)).alias("n"),
                       F.max(factor).alias("peak")).collect()[0]
        return int(row["rows"] or 0), int(row["n"]), dom, int(row["peak"] or 0)
    mask = F.lit(0)
    for i, a in enumerate(attrs):
        mask = mask + F.when(F.col(a) == F.lit(MISSING), F.lit(1 << i)).otherwise(F.lit(0))
    m = pats.select(*attrs, mask.alias("_m"))
    row = m.agg(*[F.countDistinct(a).alias(f"_d{i}") for i, a in enumerate(attrs)],
                *[F.count_if(F.col("_m") == F.lit(j)).alias(f"_c{j}") for j in range(1 << k)]).collect()[0]
    dom = {a: int(row[f"_d{i}"]) for i, a in enumerate(attrs)}
    rows, n, peak = 0, 0, 0
    for j in range(1 << k):
        c = int(row[f"_c{j}"] or 0)
        n += c
        prod = 1
        for i, a in enumerate(attrs):
            if j >> i & 1:
                prod *= dom[a]
        rows += c * prod
        if c:
            peak = max(peak, prod)
    return rows, n, dom, peak


def aggregate_possible_expand(pats: DataFrame, attrs: list[str], dom: dict[str, int] | None = None,
                              distinct: bool = True) -> DataFrame:
    """maxA in one pass where keys do not fit one number: each pattern is
    expanded to every value tuple whose possible block holds it (equi-joins
    with the per-attribute value maps), tuples are grouped once, and equal
    blocks are merged by fingerprint.

    ``distinct=False`` skips the merge and keys blocks by their value tuple:
    two tuples may then hold the same set, which callers that only need
    distinct sets at set level remove with a cheap aggregate on the stats
    (``sets.distinct_sets``) instead of a join over all memberships."""
    dom = dom or {}
    rows = pats.select("pid", *attrs, *STATS)
    for a in attrs:  # joins on the attribute column itself: broadcast, no shuffle
        rows = join_value_map(rows, a, value_map(pats, a), dom.get(a), f"_t_{a}", salt="pid")
    tup = F.struct(*[F.col(f"_t_{a}") for a in attrs]).alias("cid")
    rows = rows.select(tup, F.col("pid").alias("u"), *STATS)
    return rows if not distinct else by_content(rows)


def coded_blocks(pats: DataFrame, coding: Coding, attrs: list[str], method: str = "auto", max_rows: int | None = None,
                 cost: Cost | None = None) -> Blocks | None:
    """The blocks of coded patterns ``(u, stats)``; None where the heavy masks are too many to look up."""
    if cost is None:
        cost = measure(pats, coding, attrs)
        guard(cost, max_rows)
    if method == "expand":
        cost.light = None
    return find_blocks(pats, coding, attrs, cost)


def possible_stats(pats: DataFrame, attrs: list[str], coding: Coding, max_rows: int | None = None) -> DataFrame | None:
    """``(cid, stats)`` of the blocks of maxA where no one asks for memberships (``lattice``); a set may come twice.

    None where value tuples are too many: ``aggregate_possible`` then seeks the blocks.
    """
    if not coding.fits:
        return None
    cost = measure(pats.withColumnRenamed("pid", "u"), coding, attrs)
    guard(cost, max_rows)
    found = lattice(coding, attrs, cost)
    return found.sums(pats.withColumnRenamed("pid", "u")) if found is not None else None


def aggregate_possible(pats: DataFrame, attrs: list[str], cut: bool = True,
                       method: str = "auto", broadcast_domains: bool = True,
                       distinct: bool = True, coding: Coding | None = None, max_rows: int | None = None) -> DataFrame:
    """maxA: distinct non-empty intersections of one possible class per attribute.

    ``method='auto'`` measures the cost of every pattern's mask of missing
    cells, expands the cheap ones in one pass and folds the others (see
    ``blocks``); ``'expand'`` expands all.  ``'fold'`` is the left fold of
    ``refine`` over the attributes with dedupe per step; the possible classes of
    a single attribute are already distinct (each P(v) holds its own C(v)).
    The fold also serves keys of more than ``codes.KEY_BITS`` bits whose
    expansion is not bounded.  Every ``CUT_EVERY`` steps its family is written
    to the checkpoint folder, so a long fold neither grows its plan nor
    recomputes from the start.

    ``pats`` should be materialised.  ``coding``: the dictionary of its
    attributes where the caller has it (``pid`` is then the packed key).
    ``distinct=False`` allows a class to repeat another's set; the fold always
    returns distinct sets.  ``max_rows``: see ``blocks.guard``.

    The value maps that the fold joins per attribute hold at most
    ``2 * |dom|`` rows; the domains are measured in one job and a map is
    broadcast only below ``BROADCAST_ROWS``.  Otherwise (or with
    ``broadcast_domains=False``) the strategy is AQE's: it broadcasts after
    measuring the map at runtime, or keeps the shuffle join and splits the hot
    ``'*'`` key.
    """
    if not attrs:
        raise ValueError("need at least one attribute")
    if method not in ("auto", "fold", "expand"):
        raise ValueError(f"method must be auto, fold or expand, got {method!r}")
    if method != "fold" and broadcast_domains:
        rows = pats.withColumn("u", F.col("pid"))
        if coding is None:
            coding = dictionary(pats, attrs)
            if coding.fits:
                rows = coding.encode(pats)
                rows = cut_lineage(rows, tag="coded") if cut else rows
        if coding.fits:
            found = coded_blocks(rows.select("u", *STATS), coding, attrs, method, max_rows)
            if found is None:
                fam = fold(rows.select("u", *STATS), coding, attrs)[0].drop(*STATS)
                return fam.join(rows.select("u", "pid", *STATS), "u").select("cid", F.col("pid").alias("u"), *STATS)
            fam = found.memberships(rows.select("u", "pid", *STATS)).select("cid", F.col("pid").alias("u"), *STATS)
            return by_content(fam) if distinct else fam
    dom = {a: None for a in attrs}
    if (len(attrs) > 1 and method in ("auto", "expand")) or max_rows is not None:
        est, n_pats, dom, peak = expansion_profile(pats, attrs)
        guard(Cost(est, n_pats, peak, None, dom), max_rows)
        bounded = est <= EXPAND_FACTOR * n_pats + EXPAND_MIN and peak <= EXPAND_PER_PATTERN
        if method == "expand" or (method == "auto" and bounded):
            return aggregate_possible_expand(pats, attrs, dom if broadcast_domains else None, distinct=distinct)
    elif broadcast_domains:
        dom = domain_sizes(pats, attrs)
    if not broadcast_domains:
        dom = {a: None for a in attrs}
    fam = value_membership(pats, attrs[0], "possible", dom[attrs[0]])
    if len(attrs) == 1:
        return distinct_family(fam)
    for i, a in enumerate(attrs[1:], start=2):
        fam = refine(fam, value_membership(pats, a, "possible", dom[a]))
        if cut and i < len(attrs) and (i - 1) % CUT_EVERY == 0:
            fam = cut_lineage(fam, tag=f"fold{i}")
    return fam


def aggregate(pats: DataFrame, attrs: list[str], kind: str, cut: bool = True, distinct: bool = True,
              method: str = "auto", coding: Coding | None = None, max_rows: int | None = None) -> DataFrame:
    if kind == "certain":
        return aggregate_certain(pats, attrs)
    if kind == "possible":
        return aggregate_possible(pats, attrs, cut=cut, distinct=distinct, method=method, coding=coding, max_rows=max_rows)
    raise ValueError(f"kind must be 'certain' or 'possible', got {kind!r}")


def merge_partials(f: DataFrame, g: DataFrame, f_attrs: list[int] | str, g_attrs: list[int] | str) -> tuple[DataFrame, str]:
    """Merge the families of two disjoint attribute groups over the same units; the family and its attribute list.

    Associative and commutative, so partial results of attribute groups can be combined in any order.  An empty side
    (status ``not_exist``) absorbs the other.  Both sides are written once: refinement reads them more than once.
    """
    ords = [parse_attribute_list(a) if isinstance(a, str) else list(a) for a in (f_attrs, g_attrs)]
    if set(ords[0]) & set(ords[1]):
        raise ValueError(f"attribute groups overlap: {ords[0]} and {ords[1]}")
    label = ",".join(map(str, sorted(ords[0] + ords[1])))
    return refine(cut_lineage(f, tag="merge"), cut_lineage(g, tag="merge")), label


def aggregate_status(fam: DataFrame, attrs: list[str] | str) -> DataFrame:
    """One row ``(attrs, status)``: ``'ok'`` or ``'not_exist'`` for an empty family."""
    label = attrs if isinstance(attrs, str) else ",".join(str(a) for a in attrs)
    n = fam.select("u").limit(1).groupBy().count()
    return n.select(
        F.lit(label).alias("attrs"),
        F.when(F.col("count") > 0, F.lit(STATUS_OK)).otherwise(F.lit(STATUS_EMPTY)).alias("status"),
    )
