"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id.  Words are summed by source and by the top ``BITS`` bits of the hash; the
running sum along the buckets shows in which bucket a source's budget ends.  Only that boundary bucket is split by the
next bits, until it holds one hash value.  What remains is one threshold for each source, and the mix is a filter:
nothing is sorted, and a larger budget takes a superset of a smaller one's documents.

A source whose target exceeds its size is taken once in full, and the threshold decides which documents come a second
time.  The boundary document is taken if that brings the source nearer to its target, so a source misses its target by
at most half of one document (and of that document's repeated rows, which share its hash).

Defined results: null text has size 0; a null id hashes as the text ``null``; a null source is a source of its own, last
in order; rows with one id share their fate; an empty table gives an empty result; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import fresh, row_hash, word_count
from .session import ship, stored

BITS = 12  # hash bits for each level of the histogram: at most 4,096 buckets a source and level
LEVELS = 5  # 60 bits in all
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``: one row a source, all that is held in one task.

    Targets share ``share`` times the sum of all sizes by weight; none exceeds ``most`` times its source's size, and the
    excess goes to the others by weight.  In order of cap / weight, sources are capped until the rate that the rest would
    share is no longer above the next one's cap / weight.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(place) - 1) % len(weights)
    by_rate = Window.orderBy("_rate", F.col("source").asc_nulls_last())
    rest = by_rate.rowsBetween(0, Window.unboundedFollowing)
    before = by_rate.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    # all but the source's name are sums of integers, so any engine finds the same doubles
    return (
        total.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (k + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_rate", F.col("_cap").cast("double") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_common", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(rest))
        .withColumn("_n", F.row_number().over(by_rate))
        .withColumn("_level", F.min_by("_common", F.when(F.col("_common") <= F.col("_rate"), F.col("_n"))).over(everything))
        .select("source", "source_size", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level"), F.lit(float("inf"))) * F.col("_w")).alias("target"))
    )


def thresholds(sizes: DataFrame, targets: DataFrame, bits: int = BITS) -> DataFrame:
    """``(source, source_size, target, base, cut)``: rows with hash <= ``cut`` are taken once more than ``base`` times.

    ``sizes`` has ``(source, h, size)``.  Each level sums one bucket per source by the hash's next ``bits`` bits.
    """
    full = F.col("target") >= F.col("source_size")
    state = targets.select(
        "source", "source_size", "target", full.cast("int").alias("base"),
        (F.col("target") - F.when(full, F.col("source_size")).otherwise(0)).alias("budget"),
        F.lit(0).cast("bigint").alias("_prefix"), F.lit(0).cast("bigint").alias("_before"), F.lit(None).cast("bigint").alias("cut"),
    )
    level, levels = 0, -(-60 // bits)
    while True:
        shift = 60 - bits * (level + 1)
        narrow = F.shiftright("h", max(shift, 0))
        held = state.where("cut IS NULL").select(F.col("source").alias("_s"), F.col("_prefix").alias("_p"))
        rows = sizes.join(held, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", shift + bits) == F.col("_p")), "left_semi")
        buckets = rows.groupBy("source", narrow.alias("_b")).agg(F.sum("size").alias("_n"), F.min("h").alias("_lo"), F.max("h").alias("_hi"))
        s = state.where("cut IS NULL").select(F.col("source").alias("_s"), "budget", "_before")
        along = Window.partitionBy("_s").orderBy("_b")
        walked = (
            buckets.join(s, F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("_to", F.col("_before") + F.sum("_n").over(along))
            .withColumn("_from", F.col("_to") - F.col("_n"))
        )
        # the boundary: the first bucket that ends above the budget; without one, all rows are taken
        edge = (
            walked.where(F.col("_to") > F.col("budget")).groupBy(F.col("_s").alias("_e"))
            .agg(F.min_by(F.struct("_b", "_from", "_to", "_lo", "_hi"), "_b").alias("_x"))
        )
        one = (F.col("_x._lo") == F.col("_x._hi")) | F.lit(level + 1 >= levels)
        nearer = (F.col("_x._to") - F.col("budget")) < (F.col("budget") - F.col("_x._from"))
        known = F.col("cut").isNotNull()
        cut = (
            F.when(known, F.col("cut")).when(F.col("_x").isNull(), F.lit((1 << 60) - 1))
            .when(one, F.when(nearer, F.col("_x._hi")).otherwise(F.col("_x._lo") - 1))
        )
        state = stored(
            state.join(edge, F.col("source").eqNullSafe(F.col("_e")), "left").select(
                "source", "source_size", "target", "base", "budget",
                F.when(known, F.col("_prefix")).otherwise(F.coalesce(F.col("_x._b"), F.lit(0))).cast("bigint").alias("_prefix"),
                F.when(known, F.col("_before")).otherwise(F.coalesce(F.col("_x._from"), F.lit(0))).cast("bigint").alias("_before"),
                cut.cast("bigint").alias("cut"),
            ),
            "mix-level",
        )
        level += 1
        if level >= levels or state.where("cut IS NULL").isEmpty():
            return state.select("source", "source_size", "target", "base", "cut")


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text",
                weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, str]:
    """``docs`` with one struct column ``(size, source_size, target, taken)`` added; returns it and the column's name.

    ``taken`` is 0, 1 or 2 times ``size``: the words that the mix takes of the row.  All columns of ``docs`` stay.
    """
    ship(docs.sparkSession)
    at = fresh("mix", docs.columns)
    sizes = stored(
        docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), row_hash(doc_id).alias("h")), "mix-sizes"
    )
    cuts = thresholds(sizes, stored(source_targets(sizes, weights, share, most), "mix-targets"))
    s, h, n = (fresh(x, docs.columns) for x in ("_source", "_hash", "_size"))
    cuts = cuts.select(F.col("source").alias(s), F.struct("source_size", "target", "base", "cut").alias(at))
    rows = docs.withColumn(n, word_count(F.col(text))).withColumn(h, row_hash(doc_id))
    times = F.col(f"{at}.base") + (F.col(h) <= F.col(f"{at}.cut")).cast("int")
    mixed = rows.join(cuts, F.col(source).eqNullSafe(F.col(s)), "left")
    made = F.struct(F.col(n).alias("size"), F.col(f"{at}.source_size"), F.col(f"{at}.target"), (F.col(n) * times).alias("taken"))
    return mixed.withColumn(at, made).select(*docs.columns, at), at


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: a row taken twice stands twice, one not taken is left out."""
    rows, at = mix_sources(docs, **options)
    times = F.when(F.col(f"{at}.size") > 0, (F.col(f"{at}.taken") / F.col(f"{at}.size")).cast("int")).otherwise(1)
    one = fresh("_copy", docs.columns)
    return rows.withColumn(one, F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
