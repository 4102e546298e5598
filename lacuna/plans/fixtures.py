"""Information tables derived from the driver's parquet tables.

The driver tables hold no NULLs, so missing cells are derived with fixed
modulo rules on the key (whole tables, every row kept).  The SQL text of each
fixture is in ``lacuna.plans.oracle`` and must stay equal to these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.missing import MISSING


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _star_if(cond, value):
    return F.when(cond, F.lit(MISSING)).otherwise(value)


F2_ATTRS = ["a1", "a2", "a3"]


def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part``: obj, a1 brand, a2 type, a3 size (as string), d low/high."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("obj"),
        _star_if(k % 53 == 3, F.col("p_brand")).alias("a1"),
        _star_if(k % 59 == 5, F.col("p_type")).alias("a2"),
        _star_if(k % 61 == 7, F.col("p_size").cast("string")).alias("a3"),
        F.when(k % 10 < 7, F.lit("low")).otherwise(F.lit("high")).alias("d"),
    )


def f2b_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping targets on ``part``: ``low`` and ``mod3``."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(k.alias("obj"))
    low = part.where(k % 10 < 7).select(F.lit("low").alias("d"), "obj")
    mod3 = part.where(k % 3 == 0).select(F.lit("mod3").alias("d"), "obj")
    return low.unionByName(mod3)


F3_ATTRS = ["a1", "a2"]


def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` with no complete object: minA is empty (``not_exist``)."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("obj"),
        _star_if(k % 2 == 0, F.col("p_type")).alias("a1"),
        _star_if(k % 2 == 1, F.col("p_brand")).alias("a2"),
    )


F4_ATTRS = ["a1", "a2", "a3"]


def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders``: few, large classes."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("obj"),
        _star_if(k % 7 == 3, F.col("o_orderstatus")).alias("a1"),
        _star_if(k % 11 == 5, F.col("o_orderpriority")).alias("a2"),
        _star_if(k % 13 == 7, (F.col("o_custkey") % 4).cast("string")).alias("a3"),
        F.when(F.col("o_totalprice") >= 250000, F.lit("big")).otherwise(F.lit("small")).alias("d"),
    )


F5_ATTRS = ["a1", "a2", "a3"]


def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``: a high-cardinality attribute (user) next to small ones."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k.alias("obj"),
        _star_if(k % 17 == 4, F.col("event_type")).alias("a1"),
        _star_if(k % 19 == 6, F.col("user_id").cast("string")).alias("a2"),
        _star_if(k % 23 == 8, F.dayofmonth("ts").cast("string")).alias("a3"),
        F.when(F.col("value") >= 50, F.lit("high")).otherwise(F.lit("low")).alias("d"),
    )


F6_ATTRS = [f"a{i}" for i in range(1, 9)]


def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with eight attributes, as wide as the reference's own run."""
    k = F.col("o_orderkey")
    dt = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        k.alias("obj"),
        _star_if(k % 7 == 3, F.col("o_orderstatus")).alias("a1"),
        _star_if(k % 11 == 5, F.col("o_orderpriority")).alias("a2"),
        _star_if(k % 13 == 7, (F.col("o_custkey") % 4).cast("string")).alias("a3"),
        _star_if(k % 17 == 2, F.year(dt).cast("string")).alias("a4"),
        _star_if(k % 19 == 4, F.month(dt).cast("string")).alias("a5"),
        _star_if(k % 23 == 6, F.floor(F.col("o_totalprice") / 100000).cast("string")).alias("a6"),
        _star_if(k % 29 == 8, (F.col("o_custkey") % 3).cast("string")).alias("a7"),
        _star_if(k % 31 == 10, F.dayofweek(dt).cast("string")).alias("a8"),
        F.when(F.col("o_totalprice") >= 250000, F.lit("big")).otherwise(F.lit("small")).alias("d"),
    )


def f1(spark: SparkSession) -> DataFrame:
    """Golden micro table (tests only)."""
    rows = [(1, "a", "x", "yes"), (2, "a", "x", "yes"), (3, "a", "y", "no"), (4, "b", "y", "yes"),
            (5, "b", "y", "yes"), (6, "*", "x", "no"), (7, "c", "*", "no"), (8, "c", "z", "yes")]
    return spark.createDataFrame(rows, "obj bigint, a1 string, a2 string, target string")
