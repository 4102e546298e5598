"""Where the operators keep intermediate tables, and how Python workers find this package."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a private folder only where it is unset and the master is local."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lacuna-ckpt-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, tag: str, batch: int | None = None) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back.

    The table outlives lost executors and cuts the lineage.  Folders are named ``lacuna-<tag>-<id>`` and can be removed
    after the job.  Python workers are sent ``batch`` rows at once at most, where given, while this table is made.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lacuna-{tag}-{uuid.uuid4().hex}"
    with _batches(spark, batch):
        df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _batches(spark: SparkSession, batch: int | None) -> Iterator[None]:
    """Lowers the session's rows of an Arrow batch to ``batch`` for a while."""
    was = int(spark.conf.get(ROWS_AT_ONCE))
    if batch is None or 0 < was <= batch:
        yield
        return
    spark.conf.set(ROWS_AT_ONCE, str(batch))
    try:
        yield
    finally:
        spark.conf.set(ROWS_AT_ONCE, str(was))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where neither PYTHONPATH nor the working folder holds it."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _shipped or any(p and os.path.realpath(p) == os.path.realpath(top) for p in known):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lacuna-py-"), "lacuna_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "lacuna")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
