"""Sinks: parquet (default), SequenceFile interop, set text files, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.functions.codec import FIELD_SEP, encode_sets
from lacuna.plans.tuning import cut_lineage

SNAPPY = "org.apache.hadoop.io.compress.SnappyCodec"
SEQUENCE_OUTPUT = "org.apache.hadoop.mapreduce.lib.output.SequenceFileOutputFormat"
COMBINE_INPUT = "org.apache.hadoop.mapreduce.lib.input.CombineSequenceFileInputFormat"
LONG_KEY = "org.apache.hadoop.io.LongWritable"
TEXT = "org.apache.hadoop.io.Text"
DEFAULT_CODEC = "org.apache.hadoop.io.compress.DefaultCodec"


def write_pairs(df: DataFrame, path: str, compression: str = "snappy", mode: str = "error") -> None:
    """Compressed columnar output of any long-form result."""
    df.write.mode(mode).option("compression", compression).parquet(path)


def _long_batches():
    """A serializer whose integers all arrive in the JVM as ``java.lang.Long``.

    Python's pickle writes small integers in a form that the JVM reads as ``Integer``, and a file may not mix Int and
    Long keys.  Made inside a function, so that workers get it by value.
    """
    import io
    import pickle
    from pickle import LONG1, encode_long

    from pyspark.serializers import AutoBatchedSerializer, CPickleSerializer

    class LongPickler(pickle._Pickler):
        dispatch = dict(pickle._Pickler.dispatch)

        def save_long(self, obj):
            data = encode_long(obj)
            self.write(LONG1 + bytes([len(data)]) + data)

        dispatch[int] = save_long

    class LongSerializer(CPickleSerializer):
        def dumps(self, obj):
            out = io.BytesIO()
            LongPickler(out, 3).dump(obj)
            return out.getvalue()

    return AutoBatchedSerializer(LongSerializer())


def write_sequencefile(df: DataFrame, path: str, key: str, value: str, codec: str | None = DEFAULT_CODEC,
                       key_type: str = "text") -> None:
    """SequenceFile of (Text or Long key, Text value) for Hadoop interop (block compression by codec; None: plain).

    ``key_type='long'`` writes LongWritable keys, whatever their size; null keys or values are an error.
    """
    if key_type not in ("text", "long"):
        raise ValueError(f"key_type must be 'text' or 'long', got {key_type!r}")
    keys = F.col(key).cast("string" if key_type == "text" else "bigint")
    text = F.col(value).cast("string")
    whole = [F.when(c.isNull(), F.raise_error(F.lit(f"null {what} in a pair"))).otherwise(c).alias(what) for what, c in (("key", keys), ("value", text))]
    rows = df.select(*whole).rdd.map(tuple)
    if key_type == "text":
        rows.saveAsSequenceFile(path, compressionCodecClass=codec)
        return
    sc = rows.ctx
    packed = rows._reserialize(_long_batches())
    conf = {"mapreduce.output.fileoutputformat.outputdir": path}
    if codec:
        conf |= {"mapreduce.output.fileoutputformat.compress": "true", "mapreduce.output.fileoutputformat.compress.type": "BLOCK",
                 "mapreduce.output.fileoutputformat.compress.codec": codec}
    sc._jvm.PythonRDD.saveAsNewAPIHadoopFile(packed._jrdd, True, path, SEQUENCE_OUTPUT, LONG_KEY, TEXT, None, None, _java_map(sc, conf))


def _java_map(sc, entries: dict[str, str]):
    out = sc._jvm.java.util.HashMap()
    for k, v in entries.items():
        out.put(k, v)
    return out


def write_sets_text(members: DataFrame, path: str, keys: list[str], set_key: str,
                    partition_by: str | None = "kind", width: int | None = None,
                    order_by_size: bool = False) -> None:
    """One text line per set: ``keys.. <tab> set <tab> ids`` (``read_families(layout='sets')``).

    With ``partition_by`` each value of that column gets its own directory
    (``kind=CL`` ...), as one output per kind.  ``width`` is for sets too
    large for one line: ``keys.. <tab> set <tab> part <tab> ids`` with
    numbered parts of ``width`` id values (``layout='parts'``).
    """
    group = [*keys, set_key] + ([partition_by] if partition_by else [])
    enc = encode_sets(members, group, width=width)
    if order_by_size:
        # SRT-2: sets by size ascending, ties by set key, blocks in id order;
        # a global sort (range partitioning), no single-task gather
        sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        enc = enc.join(sizes, group).orderBy(*([partition_by] if partition_by else []), *keys, "_n",
                                             set_key, "part")
    line_cols = [F.col(k).cast("string") for k in keys] + [F.col(set_key).cast("string")]
    line_cols += ([F.col("part").cast("string")] if width is not None else []) + [F.col("ids")]
    out = enc.select(F.concat_ws(FIELD_SEP, *line_cols).alias("value"),
                     *([partition_by] if partition_by else []))
    w = out.write.mode("error")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.text(path)


def set_numbers(sets: DataFrame, key: str, by: str) -> DataFrame:
    """``sets`` (one row a set) with ``set_no``, its place from 1 among its key's sets in the order of ``by``.

    Ranked in ranges of (key, set): a set's place in its range plus the key's sets in earlier ranges, so a key with very
    many sets is numbered by many tasks.
    """
    ranged = sets.select(key, by).distinct().repartitionByRange(key, by).sortWithinPartitions(key, by)
    ranged = cut_lineage(ranged.withColumn("_nth", F.monotonically_increasing_id()), tag="ranks").withColumn("_part", F.shiftright("_nth", 33))
    held = ranged.groupBy(key, "_part").agg(F.min("_nth").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = held.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), (before + 1 - F.col("_first")).alias("_base"))
    found = ranged.join(base, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return found.select(key, by, (F.col("_nth") + F.col("_base")).alias("set_no"))


def write_families_text(members: DataFrame, path: str, key: str, set_key: str, width: int, half: str | None = None) -> None:
    """Families in numbered parts: ``key <tab> set <tab> part <tab> ids`` (``read_families(layout='keyed_parts')``).

    For families whose sets, or whose number of sets, are too large for one line.  Sets are numbered within their key
    (``set_numbers``); a part holds at most ``width`` id values.  ``half`` names a column with ``certain`` or ``possible``:
    lines are then ``key <tab> half <tab> set <tab> part <tab> ids`` (``layout='halves_parts'``).
    """
    group = [key] + ([half] if half else [])
    rows = members.withColumn("_set", F.col(set_key).cast("string"))
    if half:  # sets are numbered within key and half
        rows = rows.withColumn("_of", F.concat_ws(FIELD_SEP, F.col(key).cast("string"), F.col(half)))
    of = "_of" if half else key
    parts = encode_sets(rows, [*dict.fromkeys([*group, of]), "_set"], width=width)
    parts = cut_lineage(parts, tag="families")
    numbered = set_numbers(parts, of, "_set").select(F.col(of).alias("_k"), F.col("_set").alias("_s"), "set_no")
    lines = parts.join(numbered, F.col(of).eqNullSafe(F.col("_k")) & F.col("_set").eqNullSafe(F.col("_s")))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*group, "set_no", "part")]
    lines.select(F.concat_ws(FIELD_SEP, *cells, "ids").alias("value")).write.mode("error").text(path)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files under ``path`` (Hadoop FileSystem API)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(hpath).getLength())


def _sequence_classes(spark: SparkSession, src: str) -> tuple[str, str]:
    """Key and value class of the SequenceFiles under ``src``, from the header of the first that is not empty."""
    sc = spark.sparkContext
    conf, fs_api = sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.hadoop.fs
    path = fs_api.Path(src)
    files = path.getFileSystem(conf).listStatus(path)
    names = sorted(f.getPath().toString() for f in files if f.isFile() and f.getLen() and f.getPath().getName()[0] not in "._")
    if not names:
        raise ValueError(f"no SequenceFile under {src}")
    reader_class = sc._jvm.org.apache.hadoop.io.SequenceFile.Reader
    options = sc._gateway.new_array(reader_class.Option, 1)
    options[0] = reader_class.file(fs_api.Path(names[0]))
    reader = reader_class(conf, options)
    try:
        return reader.getKeyClassName(), reader.getValueClassName()
    finally:
        reader.close()


def compact_sequencefiles(spark: SparkSession, src: str, dst: str, target_bytes: int = 128 << 20, codec: str | None = DEFAULT_CODEC) -> DataFrame:
    """Rewrites a directory of SequenceFiles into files of about ``target_bytes``; returns the pairs of the new one.

    The input format packs the listed files into splits of that size, each is read by one task and written as one file:
    no shuffle, and records pass from reader to writer inside the JVM, whatever their key and value classes
    (LongWritable and Text among them).  Values keep their order within a file.
    """
    from lacuna.sources.pairs import read_pairs

    sc = spark.sparkContext
    loader = sc._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    key, value = (loader.loadClass(c) for c in _sequence_classes(spark, src))
    conf = sc._jvm.org.apache.hadoop.conf.Configuration(sc._jsc.hadoopConfiguration())
    for k, v in {"mapreduce.input.fileinputformat.split.maxsize": str(max(1, target_bytes)),
                 "mapreduce.output.fileoutputformat.compress": "true" if codec else "false",
                 "mapreduce.output.fileoutputformat.compress.type": "BLOCK",
                 "mapreduce.output.fileoutputformat.compress.codec": codec or DEFAULT_CODEC}.items():
        conf.set(k, v)
    pairs = sc._jsc.newAPIHadoopFile(src, loader.loadClass(COMBINE_INPUT), key, value, conf)
    pairs.saveAsNewAPIHadoopFile(dst, key, value, loader.loadClass(SEQUENCE_OUTPUT), conf)
    return read_pairs(spark, dst, "sequencefile")


def packed_read(spark: SparkSession, src: str, fmt: str, target_bytes: int) -> DataFrame:
    """``src`` read with one task for each ``target_bytes`` of input, small files packed together by their listed sizes."""
    own = spark.newSession()  # the packing is a setting of the session that reads
    for k, v in {"spark.sql.files.maxPartitionBytes": target_bytes, "spark.sql.files.openCostInBytes": 0,
                 "spark.sql.files.minPartitionNum": 1}.items():
        own.conf.set(k, str(max(v, 0)))
    return own.read.format(fmt).load(src)


def compact(spark: SparkSession, src: str, dst: str, target_bytes: int = 128 << 20,
            fmt: str = "parquet") -> DataFrame:
    """Rewrite a dataset of many part files into ~``target_bytes`` files.

    Content is unchanged.  Input files are packed into reads of the target
    size and each read is written as one file, so nothing is shuffled; parquet
    row groups get the same block size.  ``fmt='sequencefile'``: see
    ``compact_sequencefiles``.  Returns the new dataset.
    """
    target_bytes = max(1, target_bytes)
    if fmt == "sequencefile":
        return compact_sequencefiles(spark, src, dst, target_bytes)
    df = packed_read(spark, src, fmt, target_bytes)
    df.write.mode("error").format(fmt).option("parquet.block.size", str(target_bytes)).save(dst)
    return spark.read.format(fmt).load(dst)
