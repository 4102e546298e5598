"""Execution helpers: size-checked broadcast and lineage cuts.

Nothing here re-implements a Spark mechanism; these are the few decisions a
Spark user makes by hand (whether a side is provably small, where to cut an
iterative plan).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows under which a build side made from value domains is broadcast; the
# domain sizes are measured before the hint is applied.
BROADCAST_ROWS = 2_000_000


# Objects per task for one hot key, and the most hot keys ever broadcast.
SPLIT_ROWS = 2_000_000
HOT_KEYS = 200_000


def split_hot_join(small: DataFrame, big: DataFrame, keys: list[str], sizes: DataFrame,
                   rows_per_split: int = SPLIT_ROWS, max_hot: int = HOT_KEYS,
                   small_keys: list[str] | None = None, salt: str = "obj",
                   total: int | None = None) -> DataFrame:
    """Inner equi-join of a key-level ``small`` side with a ``big`` side
    whose keys may be hot (``salt`` is a big-side column that varies within
    a key, e.g. the object id).  ``small_keys`` names the small side's key
    columns when they differ from ``keys``; the result keeps big's names.
    ``total`` (the sum of ``sizes.n``) may be passed when already known.

    ``sizes`` gives the exact number of ``big`` rows per key (``keys..., n``).
    A key with more than ``t`` rows is split into ``ceil(n / t)`` parts: its
    big rows get the salt ``pmod(xxhash64(obj), k)`` and its small rows are
    repeated once per salt, so one key's rows spread over ``k`` tasks.  The
    threshold is ``t = max(rows_per_split, total / max_hot)``, so at most
    ``max_hot`` keys are hot: that bounded list is what gets broadcast.
    """
    if total is None:
        total = sizes.agg(F.sum("n").alias("t")).collect()[0]["t"] or 0
    t = max(rows_per_split, -(-int(total) // max_hot))
    hot = sizes.where(F.col("n") > t).select(*keys, F.ceil(F.col("n") / t).cast("int").alias("_k"))
    hot = F.broadcast(hot)
    b = big.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(salt), F.col("_k")))
    ).drop("_k")
    if small_keys is not None:
        small = small.select(*[F.col(sk).alias(k) for sk, k in zip(small_keys, keys)],
                             *[c for c in small.columns if c not in small_keys])
    s = small.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_k"), F.lit(1)) - 1))
    ).drop("_k")
    return s.join(b, [*keys, "_salt"]).drop("_salt")


def _checkpoint_root(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        return root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        sc.setCheckpointDir(root)
        return sc.getCheckpointDir()
    # Unset: only a local-mode session (tests, bench) gets a private folder.
    if sc.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="lacuna-ckpt-")
        sc.setCheckpointDir(root)
        return sc.getCheckpointDir()
    return None


def cut_lineage(df: DataFrame, tag: str = "step") -> DataFrame:
    """Materialise ``df`` as a parquet table under the checkpoint folder.

    Used once per fold step: the written table survives executor loss and the
    next step plans against a short lineage.  The data is computed once
    (unlike ``DataFrame.checkpoint``, which recomputes an unpersisted plan).
    On a cluster ``spark.checkpoint.dir`` must be set.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared checkpoint folder (for file round trips)."""
    root = _checkpoint_root(spark)
    if root is None:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for file outputs")
    return f"{root.rstrip('/')}/lacuna-{tag}-{uuid.uuid4().hex}"
