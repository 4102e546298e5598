"""Per-attribute classes: unpivot, equivalence, certain and possible classes.

Long form everywhere: one row per (attribute, value, object).  A class is
the set of rows sharing ``(attr, value)``; it is never collected into one
value, so a value held by a third of all objects is just many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.missing import MISSING, normalize
from lacuna.functions.setstats import STATS, object_stats
from lacuna.plans.tuning import BROADCAST_ROWS, split_hot_join


def prepare(df: DataFrame, obj: str, attrs: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Project to ``obj BIGINT`` + attributes as strings with ``'*'`` for missing."""
    cols = [F.col(obj).cast("bigint").alias("obj")]
    cols += [normalize(a).alias(a) for a in attrs]
    cols += [F.col(k) for k in keep if k not in attrs and k != obj]
    return df.select(*cols)


def prepare_private(df: DataFrame, obj: str, attrs: list[str], target: str | None = None):
    """Like ``prepare`` but with private column names (``_a1``..., ``_target``),
    so user attribute names never collide with stats or pattern columns.
    Returns the table and the attribute column names to use."""
    names = [f"_a{i + 1}" for i in range(len(attrs))]
    cols = [F.col(obj).cast("bigint").alias("obj")]
    cols += [normalize(a).alias(n) for a, n in zip(attrs, names)]
    if target is not None:
        cols.append(F.col(target).alias("_target"))
    return df.select(*cols), names


def unpivot(df: DataFrame, obj: str, attrs: list[str], only: list[int] | None = None) -> DataFrame:
    """Row -> one ``(attr, value, obj)`` per attribute; ``attr`` is 1-based.

    ``only`` names the ordinals wanted: the scan then reads their columns alone, and they keep their numbers.
    """
    wanted = range(1, len(attrs) + 1) if only is None else [int(i) for i in only]
    cells = F.array(*[F.struct(F.lit(i).alias("attr"), normalize(attrs[i - 1]).alias("value")) for i in wanted])
    return df.select(F.col(obj).cast("bigint").alias("obj"), F.inline(cells).alias("attr", "value")) \
             .select("attr", "value", "obj")


def cells_to_table(cells: DataFrame, attrs: list[str], drop_absent: bool = True) -> DataFrame:
    """Long cells ``(attr, value, obj)`` -> wide ``(obj, attrs...)``.

    A pivot by object (one shuffle on ``obj``, values listed, so no extra
    job).  An object without a cell for some attribute (``on_ragged='absent'``)
    is in no class of it, hence in no block over any attribute set holding
    it: ``drop_absent`` removes such objects before aggregation instead of
    reading the gap as missing.
    """
    ords = list(range(1, len(attrs) + 1))
    wide = cells.groupBy("obj").pivot("attr", ords).agg(F.first("value"))
    wide = wide.select("obj", *[F.col(str(i)).alias(a) for i, a in zip(ords, attrs)])
    if drop_absent:
        cond = F.lit(True)
        for a in attrs:
            cond = cond & F.col(a).isNotNull()
        wide = wide.where(cond)
    return wide


def equivalence_classes(cells: DataFrame) -> DataFrame:
    """Classes per (attr, value), ``'*'`` being an ordinary value here.

    The long cells already are the memberships; this only names the class.
    """
    return cells.select("attr", "value", "obj")


def class_stats(family: DataFrame, keys: list[str]) -> DataFrame:
    """Size and digest of each class of a long family (partial aggregation)."""
    return family.groupBy(*keys).agg(*object_stats("obj"))


def certain_classes(cells: DataFrame) -> DataFrame:
    """``C_a(v)``: objects whose attribute is the regular value v."""
    return cells.where(F.col("value") != F.lit(MISSING)).select("attr", "value", "obj")


def _possible_value_map(cells: DataFrame) -> DataFrame:
    """(attr_m, key, value): which possible classes a cell with ``key`` joins.

    A regular value v joins only P(v); the missing marker joins every P(v) of
    its attribute and the missing block itself (value ``'*'``).
    """
    values = cells.select("attr", "value").distinct()
    regular = values.where(F.col("value") != F.lit(MISSING)) \
        .select(F.col("attr").alias("attr_m"), F.col("value").alias("key"), "value")
    from_missing = values.select(F.col("attr").alias("attr_m"), F.lit(MISSING).alias("key"), "value")
    return regular.unionByName(from_missing)


def possible_classes(cells: DataFrame) -> DataFrame:
    """``P_a(v) = C_a(v) ∪ M_a`` for each regular v, plus ``M_a`` as value ``'*'``.

    An equi-join of the cells with a (attr, key) -> value map.  The map is
    the size of the value domains; it is broadcast after a row count, else
    joined by shuffle where AQE splits the hot ``'*'`` key.  An attribute
    without missing cells gets no ``'*'`` class (empty sets have no rows).
    """
    vmap = _possible_value_map(cells)
    if vmap.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        j = cells.join(F.broadcast(vmap.withColumnRenamed("value", "v")),
                       (cells["attr"] == F.col("attr_m")) & (cells["value"] == F.col("key")))
        return j.select("attr", F.col("v").alias("value"), "obj")
    # large domains: the ('*') key of an attribute may hold most rows; split it
    sizes = cells.groupBy("attr", "value").agg(F.count(F.lit(1)).alias("n"))
    j = split_hot_join(vmap.withColumnRenamed("value", "v"), cells, ["attr", "value"], sizes,
                       small_keys=["attr_m", "key"])
    return j.select("attr", F.col("v").alias("value"), "obj")


def possible_class_stats(cells: DataFrame) -> DataFrame:
    """``(attr, value, stats)`` of the possible classes without their members.

    The missing block is disjoint from every regular class, so ``P_a(v)`` has the merged stats of ``C_a(v)`` and
    ``M_a``: one aggregate over the cells and a join of its few rows, no object for every value.
    """
    st = class_stats(cells, ["attr", "value"])
    miss = st.where(F.col("value") == F.lit(MISSING)).select(F.col("attr").alias("_a"), *[F.col(k).alias(f"_{k}") for k in STATS])
    both = st.where(F.col("value") != F.lit(MISSING)).join(miss, F.col("attr") == F.col("_a"), "left")
    none = F.col("_n").isNull()
    add = lambda k: F.col(k) + F.coalesce(F.col(f"_{k}"), F.lit(0))
    xor = lambda k: F.when(none, F.col(k)).otherwise(F.col(k).bitwiseXOR(F.col(f"_{k}")))
    merged = both.select("attr", "value", add("n").alias("n"), F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi"),
                         xor("x1").alias("x1"), xor("x2").alias("x2"), add("s1").alias("s1"), add("s2").alias("s2"))
    return merged.unionByName(st.where(F.col("value") == F.lit(MISSING)))


def classes_stats(df: DataFrame, obj: str, attrs: list[str]) -> DataFrame:
    """``(kind, attr, value, stats)``: both families of every attribute by size and digest."""
    cells = unpivot(df, obj, attrs)
    cer = class_stats(certain_classes(cells), ["attr", "value"]).withColumn("kind", F.lit("certain"))
    return cer.unionByName(possible_class_stats(cells).withColumn("kind", F.lit("possible")))


def classes(df: DataFrame, obj: str, attrs: list[str], kind: str | None = None) -> DataFrame:
    """Both families of every attribute: ``(kind, attr, value, obj)``; with ``kind`` only that half is built."""
    cells = unpivot(df, obj, attrs)
    if kind not in (None, "certain", "possible"):
        raise ValueError(f"kind must be 'certain' or 'possible', got {kind!r}")
    if kind is not None:
        half = certain_classes(cells) if kind == "certain" else possible_classes(cells)
        return half.select(F.lit(kind).alias("kind"), "attr", "value", "obj")
    cer = certain_classes(cells).select(F.lit("certain").alias("kind"), "attr", "value", "obj")
    pos = possible_classes(cells).select(F.lit("possible").alias("kind"), "attr", "value", "obj")
    return cer.unionByName(pos)


def select_attributes(cells: DataFrame, attrs: list[int]) -> DataFrame:
    """Keep the listed 1-based attribute ordinals (e.g. ``[1, 10, 12]``)."""
    return cells.where(F.col("attr").isin([int(a) for a in attrs]))


def pick_family(classes_df: DataFrame, kind: str) -> DataFrame:
    """The certain or the possible half of ``classes`` output."""
    if kind not in ("certain", "possible"):
        raise ValueError(f"kind must be 'certain' or 'possible', got {kind!r}")
    return classes_df.where(F.col("kind") == kind).select("attr", "value", "obj")


def decision_classes(df: DataFrame, obj: str, decision: str) -> DataFrame:
    """Target sets from a decision column: ``(d, obj)``, one set per value."""
    return df.select(F.col(decision).cast("string").alias("d"), F.col(obj).cast("bigint").alias("obj"))
