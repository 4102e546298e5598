"""Target sets arriving as a stream, approximated against fixed families.

The batch job of the reference reads target lines as its input while minA
and maxA are loaded once per task.  Here the target-independent frames
(patterns, maxA, links) are computed once and written to the checkpoint
folder; target files (``d <tab> id,id,...``) are read with ``readStream``
and every micro-batch is approximated with ``foreachBatch``.

A target may arrive in pieces.  Each batch's lines are kept under its batch
id, and the targets that it touches are approximated anew from all their
lines so far; the set rows ``(kind, d, n, lo, hi, s1, s2)`` are written under
the batch id as well.  Both writes overwrite, so a batch that is replayed
after a failure changes nothing, and ``latest`` reads each target from the
last batch that touched it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lacuna.functions.codec import FIELD_SEP, _regex, decode_ids, trimmed
from lacuna.functions.setstats import DIGEST
from lacuna.operators import approx as A
from lacuna.operators.classes import prepare_private
from lacuna.plans.tuning import cut_lineage


def table_side(df: DataFrame, obj: str, attrs: list[str]) -> A.TableParts:
    """Target-independent part of the fast path, materialised once."""
    pdf, names = prepare_private(df, obj, attrs)  # private column names: no clash with stats columns
    pats, units, coding = A.coded_table(pdf, names)
    units = cut_lineage(units, tag="units")
    tp = A.table_parts(pats, names, lambda: units, coding)
    return replace(tp, maxst=cut_lineage(tp.maxst, tag="maxst"))


def parse_target_lines(lines: DataFrame) -> DataFrame:
    """``value`` text lines -> ``(d, obj)``."""
    parts = F.split(F.col("value"), _regex(FIELD_SEP), 2)
    rows = lines.where(trimmed(F.col("value")) != "").select(trimmed(parts[0]).alias("d"), parts[1].alias("ids"))
    return rows.select("d", F.explode(decode_ids("ids")).alias("obj"))


def approximate_targets(tp: A.TableParts, targets: DataFrame) -> DataFrame:
    """Set rows of all kinds for a batch of targets ``(d, obj)``."""
    xo, xp = A.external_targets(tp.units, targets)
    parts = A.target_parts(tp, lambda: xo, xp, cut=False)
    return A.union_kinds(A.fast_sets(parts)).select("kind", "d", *DIGEST)


def start(spark: SparkSession, tp: A.TableParts, source_dir: str, sink_dir: str, checkpoint_dir: str,
          available_now: bool = True) -> StreamingQuery:
    """Stream target files from ``source_dir`` into parquet at ``sink_dir``."""
    lines = spark.readStream.format("text").load(source_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        parse_target_lines(batch).write.mode("overwrite").parquet(f"{sink_dir}/lines/batch_id={batch_id}")
        seen = spark.read.schema("d string, obj bigint, batch_id bigint").option("basePath", f"{sink_dir}/lines").parquet(f"{sink_dir}/lines")
        seen = seen.where(F.col("batch_id") <= batch_id)
        touched = seen.where(F.col("batch_id") == batch_id).select("d").distinct()
        targets = seen.join(touched, "d", "left_semi").select("d", "obj").distinct()
        approximate_targets(tp, targets).write.mode("overwrite").parquet(f"{sink_dir}/sets/batch_id={batch_id}")

    w = lines.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def latest(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The current set rows: of each target, those of the last batch that touched it."""
    last = spark.read.parquet(f"{sink_dir}/lines").groupBy("d").agg(F.max("batch_id").alias("batch_id"))
    sets = spark.read.parquet(f"{sink_dir}/sets").join(last, ["d", "batch_id"], "left_semi")
    return sets.select("kind", "d", *DIGEST)
