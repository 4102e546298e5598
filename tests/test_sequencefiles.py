"""Long and Text keyed SequenceFiles, and compaction without a shuffle."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lacuna.sources import pairs as P
from lacuna.sources import sinks as S

KEYS = [0, 1, -1, 127, 128, 2**31 - 1, 2**31, -(2**31) - 1, 2**62, -(2**63), 2**63 - 1]


def files(path):
    return [f for f in os.listdir(path) if f.startswith("part-")]


def key_class(spark, path):
    return S._sequence_classes(spark, path)[0]


@pytest.mark.parametrize("codec", [S.DEFAULT_CODEC, None])
def test_long_keys_come_back(spark, codec):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([(k, f"é{k}") for k in KEYS], "k bigint, v string").repartition(3)
    S.write_sequencefile(df, d + "/seq", "k", "v", codec=codec, key_type="long")
    assert key_class(spark, d + "/seq") == S.LONG_KEY
    back = P.read_pairs(spark, d + "/seq", "sequencefile", "bigint")
    assert sorted(map(tuple, back.collect())) == sorted((k, f"é{k}") for k in KEYS)


def test_null_pairs_and_unknown_key_types_are_errors(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([(1, None)], "k bigint, v string")
    with pytest.raises(Exception, match="null value"):
        S.write_sequencefile(df, d + "/seq", "k", "v", key_type="long")
    with pytest.raises(ValueError):
        S.write_sequencefile(df, d + "/other", "k", "v", key_type="int")


@pytest.mark.parametrize("key_type", ["long", "text"])
def test_sequencefiles_are_packed_into_few(spark, key_type):
    d = tempfile.mkdtemp()
    rows = [(i * 10**9, "x" * (i % 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "k bigint, v string").repartition(20)
    S.write_sequencefile(df, d + "/many", "k", "v", key_type=key_type)
    assert len(files(d + "/many")) == 20
    out = S.compact(spark, d + "/many", d + "/one", target_bytes=1 << 30, fmt="sequencefile")
    assert sorted((int(k), v) for k, v in out.collect()) == rows
    assert key_class(spark, d + "/one") == (S.LONG_KEY if key_type == "long" else S.TEXT)
    assert len(files(d + "/one")) == 1
    size = S.path_bytes(spark, d + "/many")
    S.compact(spark, d + "/many", d + "/four", target_bytes=size // 4 + 1, fmt="sequencefile")
    assert 3 <= len(files(d + "/four")) <= 7
    with pytest.raises(ValueError):
        S.compact(spark, tempfile.mkdtemp(), d + "/none", fmt="sequencefile")


def test_no_rows(spark):
    d = tempfile.mkdtemp()
    S.write_sequencefile(spark.createDataFrame([], "k bigint, v string"), d + "/seq", "k", "v", key_type="long")
    assert P.read_pairs(spark, d + "/seq", "sequencefile", "bigint").count() == 0


def test_compaction_shuffles_nothing(spark):
    d = tempfile.mkdtemp()
    spark.range(50_000).withColumn("v", F.col("id") % 7).repartition(40).write.parquet(d + "/many")
    size = S.path_bytes(spark, d + "/many")
    plan = S.packed_read(spark, d + "/many", "parquet", size // 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    out = S.compact(spark, d + "/many", d + "/few", target_bytes=size // 4)
    assert 3 <= len(files(d + "/few")) <= 8
    assert out.exceptAll(spark.read.parquet(d + "/many")).count() == 0 and out.count() == 50_000
    assert spark.conf.get("spark.sql.files.openCostInBytes") != "0"  # the caller's session keeps its settings
