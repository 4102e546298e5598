"""Key/value datasets: parquet by default, Hadoop SequenceFile for interop,
plus the text forms of target sets and families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.codec import EMPTY_FAMILY, FIELD_SEP, _regex, decode_ids, explode_family, trimmed


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet", key_type: str = "string") -> DataFrame:
    """Every part file of a directory; files named ``_*`` / ``.*`` are skipped
    by the Hadoop input listing.  SequenceFiles come back as ``(key, value)``
    strings (Text/Long writables converted by PySpark), keys as ``key_type``
    (``bigint`` for Long keys)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "sequencefile":  # Spark reads this format by RDD only: rows pass through Python
        pairs = spark.sparkContext.sequenceFile(path).map(lambda kv: (str(kv[0]), str(kv[1])))
        pairs = spark.createDataFrame(pairs, "key string, value string")  # a schema: nothing is read ahead, and no row is needed
        return pairs.select(F.col("key").cast(key_type), "value")
    raise ValueError(f"unknown format {fmt!r}")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``d <tab> id,id,...`` -> ``(d, obj)``.

    A target may span several lines (their union is taken); blank lines are
    skipped.  Whole file, one row per line, exploded per row.
    """
    lines = spark.read.text(path).where(trimmed(F.col("value")) != "")
    parts = F.split(F.col("value"), _regex(FIELD_SEP), 2)
    df = lines.select(trimmed(parts[0]).alias("d"), parts[1].alias("ids"))
    return df.select("d", F.explode(decode_ids("ids")).alias("obj")).distinct()


def _line_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(line_id, value)`` of the lines that are not blank; ids tell lines of all files apart."""
    lines = spark.read.text(path).select(
        "value", F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.file_block_start").cast("string"),
                             F.monotonically_increasing_id().cast("string")).alias("line_id"))
    return lines.where(trimmed(F.col("value")) != "")


def read_families(spark: SparkSession, path: str, layout: str = "keyed", kind: str | None = None,
                  fmt: str = "text") -> DataFrame:
    """Families -> long ``(class_id, obj)``; blank sets and lines vanish.

    ``keyed``   ``key <tab> a|b|c``: every set of every line is a class of its own, also where lines share a key; the
                class id is ``key:line:set_no``.  A line with the status ``not_exist`` is an empty family.
    ``halves``  ``key <tab> certain <tab> possible``: like ``keyed``, for the half that ``kind`` names.
    ``lines``   one set per line.
    ``parts``   ``keys... <tab> set <tab> part <tab> ids``, as ``write_sets_text(width=...)`` writes it: lines with
                equal keys and set are one class, whose id is keys and set.
    ``sets``    ``keys... <tab> set <tab> ids``, as ``write_sets_text`` writes it.
    ``keyed_parts``, ``halves_parts``  ``key [<tab> half] <tab> set <tab> part <tab> ids``, as ``write_families_text``
                writes it: lines with equal key (and half) and set are one class ``key:set``; ``halves_parts`` reads the
                half that ``kind`` names.  A line ``key <tab> not_exist`` is an empty family.

    ``fmt='sequencefile'`` reads ``(key, value)`` records instead of lines (``keyed`` and ``halves``).
    """
    if layout in ("keyed", "halves"):
        if fmt == "sequencefile":
            pairs = read_pairs(spark, path, fmt)
            df = pairs.select(trimmed(F.col("key")).alias("key"), F.col("value").alias("rest"),
                              F.monotonically_increasing_id().cast("string").alias("line_id"))
        else:
            parts = F.split(F.col("value"), _regex(FIELD_SEP), 2)
            df = _line_ids(spark, path).select(trimmed(parts[0]).alias("key"), parts[1].alias("rest"), "line_id")
        rest = F.split("rest", _regex(FIELD_SEP), -1)
        if layout == "halves":
            if kind not in ("certain", "possible"):
                raise ValueError("layout 'halves' needs kind='certain' or 'possible'")
            fam = rest[0 if kind == "certain" else 1]
        else:  # an aggregated record may carry its attribute list before the sets: the last field holds the sets
            fam = F.element_at(rest, -1)
        long = explode_family(df.select("key", "line_id", fam.alias("fam")), "fam", ["key", "line_id"])
        return long.select(F.concat_ws(":", "key", "line_id", F.col("set_no").cast("string")).alias("class_id"), "obj")
    if layout == "lines":
        df = _line_ids(spark, path)
        return df.select(F.col("line_id").alias("class_id"), F.explode(decode_ids("value")).alias("obj"))
    if layout in ("parts", "sets"):
        cells = F.split("value", _regex(FIELD_SEP), -1)
        lines = spark.read.text(path).where(trimmed(F.col("value")) != "")
        extra = [c for c in lines.columns if c != "value"]  # partition folders such as kind=CL
        last = 2 if layout == "parts" else 1
        named = lines.select(*extra, F.array_join(F.slice(cells, F.lit(1), F.size(cells) - last), FIELD_SEP).alias("class_id"),
                             F.element_at(cells, -1).alias("ids"))
        return named.select(*extra, "class_id", F.explode(decode_ids("ids")).alias("obj"))
    if layout in ("keyed_parts", "halves_parts"):
        if layout == "halves_parts" and kind not in ("certain", "possible"):
            raise ValueError("layout 'halves_parts' needs kind='certain' or 'possible'")
        cells = F.split("value", _regex(FIELD_SEP), -1)
        lines = spark.read.text(path).where(trimmed(F.col("value")) != "").select(cells.alias("c"))
        lines = lines.where(trimmed(F.element_at("c", -1)) != F.lit(EMPTY_FAMILY))
        if layout == "halves_parts":
            lines = lines.where(F.col("c")[1] == F.lit(kind))
        named = F.concat_ws(":", trimmed(F.col("c")[0]), F.element_at("c", -3))
        return lines.select(named.alias("class_id"), F.explode(decode_ids(F.element_at("c", -1))).alias("obj"))
    raise ValueError(f"unknown layout {layout!r}")
