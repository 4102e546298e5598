"""Local session for tests and the benchmark (a cluster brings its own)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "lacuna") -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="lacuna-run-")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LACUNA_DRIVER_MEMORY", "8g"))
        .config("spark.local.dir", scratch)
        .config("spark.checkpoint.dir", os.path.join(scratch, "checkpoints"))
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
    )
    if os.environ.get("LACUNA_EVENT_LOG") == "1":
        # stage and task times without the UI: Spark's event log in the scratch folder
        events = os.path.join(scratch, "events")
        os.makedirs(events, exist_ok=True)
        builder = (builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", events)
                   .config("spark.eventLog.compress", "false"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
