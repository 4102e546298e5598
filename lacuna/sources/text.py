"""Information tables stored as text: one object per line, cells split by ','.

Not ``spark.read.csv``: it turns blank *and* absent cells into NULL, which
would read as missing.  Here a blank cell is the regular value ``''``, only
``'*'`` is missing, and a short row is an error (default) or absent cells.
Lines are trimmed of outer whitespace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna.functions.codec import _regex, split_cells, trimmed
from lacuna.plans import tuning
from lacuna.plans.tuning import cut_lineage


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(obj, line)`` with 1-based consecutive ids in file and line order.

    JVM-side and distributed.  Every line gets its split (file path, block
    start) from the text source's ``_metadata`` and an id that grows within
    its task (``monotonically_increasing_id``; a split's lines are contiguous
    within one task).  A first pass counts the lines of each split; the
    running offset of each split in (path, block start) order is written as a
    small table (one row per split) and added back.  It is sent to all tasks
    where its measured size allows (``BROADCAST_ROWS``), so no line is
    shuffled; beyond that it is joined by shuffle.  Ids are deterministic, so
    a recomputed task yields the same numbers.
    Tables with a natural key should skip this and use the key.
    """
    lines = (spark.read.text(path)
             .select(F.col("value").alias("line"),
                     F.col("_metadata.file_path").alias("_f"),
                     F.col("_metadata.file_block_start").alias("_b"),
                     F.monotonically_increasing_id().alias("_m")))
    splits = lines.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    w = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_f", "_b", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    offsets = cut_lineage(offsets, tag="splits")
    if offsets.count() <= tuning.BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    numbered = lines.join(offsets, ["_f", "_b"])
    return numbered.select((F.col("_off") + F.col("_m") - F.col("_m0") + 1).cast("bigint").alias("obj"), "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line)`` rows in no particular order (for tables with a key column)."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse_table(lines: DataFrame, attrs: list[str], sep: str = ",", key: str | None = None,
                on_ragged: str = "error") -> DataFrame:
    """Wide table ``(obj, attrs...)`` from ``(obj, line)`` or keyed lines.

    A row with more cells than ``attrs`` raises.  ``on_ragged='error'``: so does one with fewer, and a blank cell is the
    value ``''``.  ``'absent'``: trailing blank cells and those a short row lacks are absent, and the object, being in
    no class of these attributes, is left out.  The check is a filter, so it holds whatever columns are read.  With
    ``key`` the object id is that (1-based) cell instead of the ``obj`` column.
    """
    if on_ragged not in ("error", "absent"):
        raise ValueError("on_ragged must be 'error' or 'absent'")
    k = len(attrs) + (1 if key is not None else 0)
    line = trimmed(F.col("line"))
    if on_ragged == "absent":
        line = F.regexp_replace(line, f"({_regex(sep)})+$", "")
    df = lines.select(*(["obj"] if key is None else []), "line", split_cells(line, sep).alias("_c"))
    # naming the row's id in the error also keeps the check above any filter on ids
    who = F.lit("") if key is not None else F.col("obj").cast("string")
    bad = lambda what: F.raise_error(F.concat(F.lit(what + " row "), who, F.lit(": "), F.col("line"))).cast("boolean")
    short = F.lit(False) if on_ragged == "absent" else bad("short")
    df = df.where(F.when(F.size("_c") > k, bad("long")).when(F.size("_c") < k, short).otherwise(True))
    own = int(key) - 1 if key is not None else -1
    places = [p for p in range(k) if p != own]
    obj = F.col("_c")[own].cast("bigint").alias("obj") if key is not None else F.col("obj")
    return df.select(obj, *[F.col("_c")[p].alias(a) for p, a in zip(places, attrs)])


def parse_cells(lines: DataFrame, sep: str = ",", on_ragged: str = "absent") -> DataFrame:
    """Long cells ``(attr, value, obj)`` straight from ``(obj, line)``.

    ``on_ragged='absent'``: a short row has no cell for the attributes it
    lacks, and trailing blank cells are absent as well (the object is then
    in no class of that attribute, neither certain nor missing).
    """
    if on_ragged not in ("absent", "keep"):
        raise ValueError("on_ragged must be 'absent' or 'keep'")
    line = trimmed(F.col("line"))
    if on_ragged == "absent":
        # trailing blank cells are absent: cut the separators after the last value
        line = F.regexp_replace(line, f"({_regex(sep)})+$", "")
    df = lines.select("obj", F.posexplode(split_cells(line, sep)).alias("pos", "value"))
    return df.select((F.col("pos") + 1).alias("attr"), "value", "obj")


def read_table(spark: SparkSession, path: str, attrs: list[str], sep: str = ",",
               key: str | None = None, on_ragged: str = "error") -> DataFrame:
    """Text file(s) -> wide information table ``(obj, attrs...)``; see ``parse_table`` for ragged rows."""
    lines = number_lines(spark, path) if key is None else read_lines(spark, path)
    return parse_table(lines, attrs, sep, key=key, on_ragged=on_ragged)
