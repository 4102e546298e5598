"""Streamed target files give the same sets as the batch fast path."""

import os
import tempfile

from pyspark.sql import functions as F

from lacuna import approximate
from lacuna.streaming import targets as ST

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    from lacuna.plans import fixtures as fx

    t = fx.f2(spark, SF)
    d = tempfile.mkdtemp(prefix="lacuna-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    x = fx.f2b_targets(spark, SF)
    for name in ("low", "mod3"):  # one file per target
        ids = ",".join(str(r["obj"]) for r in x.where(F.col("d") == name).collect())
        with open(os.path.join(src, f"{name}.txt"), "w") as f:
            f.write(f"{name}\t{ids}\n")
    tp = ST.table_side(t, "obj", fx.F2_ATTRS)
    q = ST.start(spark, tp, src, os.path.join(d, "out"), os.path.join(d, "ckpt"))
    q.awaitTermination(300)
    got = ST.latest(spark, os.path.join(d, "out"))
    want = approximate(t, "obj", fx.F2_ATTRS, x)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_is_incremental_across_triggers(spark):
    """A second target file arriving later is processed once, in a new batch."""
    from lacuna.plans import fixtures as fx

    t = fx.f2(spark, SF)
    x = fx.f2b_targets(spark, SF)
    d = tempfile.mkdtemp(prefix="lacuna-stream-")
    src, out, ckpt = os.path.join(d, "in"), os.path.join(d, "out"), os.path.join(d, "ckpt")
    os.makedirs(src)
    tp = ST.table_side(t, "obj", fx.F2_ATTRS)
    for name in ("low", "mod3"):
        ids = ",".join(str(r["obj"]) for r in x.where(F.col("d") == name).collect())
        with open(os.path.join(src, f"{name}.txt"), "w") as f:
            f.write(f"{name}\t{ids}\n")
        ST.start(spark, tp, src, out, ckpt).awaitTermination(300)
    res = spark.read.parquet(f"{out}/sets")
    assert sorted(r["batch_id"] for r in res.select("batch_id").distinct().collect()) == [0, 1]
    want = approximate(t, "obj", fx.F2_ATTRS, x)
    assert sorted(map(tuple, res.drop("batch_id").collect())) == sorted(map(tuple, want.collect()))


def test_target_in_two_batches_and_a_replay(spark):
    """A target whose lines arrive in two batches has one result, also when the last batch runs again."""
    from lacuna.plans import fixtures as fx

    t = fx.f2(spark, SF)
    d = tempfile.mkdtemp(prefix="lacuna-stream-")
    src, out, ckpt = os.path.join(d, "in"), os.path.join(d, "out"), os.path.join(d, "ckpt")
    os.makedirs(src)
    tp = ST.table_side(t, "obj", fx.F2_ATTRS)
    ids = [r["obj"] for r in fx.f2b_targets(spark, SF).where("d = 'mod3'").orderBy("obj").collect()]
    for k, part in enumerate((ids[::2], ids[1::2])):
        with open(os.path.join(src, f"{k}.txt"), "w") as f:
            f.write(f"mod3 \t{','.join(map(str, part))} \t\n")
        ST.start(spark, tp, src, out, ckpt).awaitTermination(300)
    x = fx.f2b_targets(spark, SF).where("d = 'mod3'")
    want = sorted(map(tuple, approximate(t, "obj", fx.F2_ATTRS, x).collect()))
    assert sorted(map(tuple, ST.latest(spark, out).collect())) == want
    for name in ("1", ".1.crc"):  # as after a failure between the writes and the commit
        os.remove(os.path.join(ckpt, "commits", name))
    ST.start(spark, tp, src, out, ckpt).awaitTermination(300)
    assert sorted(map(tuple, ST.latest(spark, out).collect())) == want
