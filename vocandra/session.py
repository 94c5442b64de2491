"""Session helpers: where intermediate tables go, when a side may be broadcast, and tables bucketed by a key."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes on disk (compressed parquet) up to which a staged side may be sent to every executor.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). On a cluster it must be set; a local session gets a temporary one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = "file://" + os.path.join(tempfile.gettempdir(), "vocandra-shared")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


def _at(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's API."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def bytes_under(spark: SparkSession, path: str) -> int:
    fs, where = _at(spark, path)
    return fs.getContentSummary(where).getLength()


def listed(spark: SparkSession, path: str) -> list[str]:
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and renames it, so that readers see all of it or nothing."""
    fs, where = _at(spark, path)
    _, beside = _at(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if not fs.rename(beside, where):
        raise OSError(f"{path} is there already")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here, lost executors or not.

    The table goes when the driver ends, or earlier by ``unstage``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _at(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again, and let go of the shuffle files behind them."""
    for df in frames:
        remove(df.sparkSession, df.staged_at)
    if frames:
        release(frames[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Shuffle files of plans that nobody holds any more go when both collectors have seen it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def is_small(df: DataFrame, bytes_most: int = BROADCAST_BYTES) -> bool:
    """Of a staged table: whether its files are small enough to be broadcast; looks at file sizes only."""
    return bytes_under(df.sparkSession, df.staged_at) <= bytes_most


def broadcast_if_small(df: DataFrame, bytes_most: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast where the table's files are small; what isn't staged yet is staged for that."""
    df = df if hasattr(df, "staged_at") else stage(df, "side")
    return F.broadcast(df) if is_small(df, bytes_most) else df


def marked(frame: DataFrame, wanted: DataFrame, group: str, at: str) -> DataFrame:
    """The rows of ``frame`` whose (group, at) one of ``wanted`` has; both are expressions, ``at`` a number from 0 on.

    What is wanted goes to the rows as bitmaps, one a group, so that wide rows aren't shuffled: 100 million rows take 12 MB.
    """
    place, bit = f"cast(({at}) div 64 AS int)", f"cast(({at}) % 64 AS int)"
    bits = wanted.select(F.expr(group).alias("_group"), F.expr(place).alias("_place"), F.expr(f"shiftleft(1L, {bit})").alias("_bits"))
    bits = stage(bits.groupBy("_group", "_place").agg(F.bit_or("_bits").alias("_bits")), "marks")
    tops = bits.groupBy("_group").agg(F.max("_place").alias("top"))
    gaps = tops.select("_group", F.explode(F.sequence(F.lit(0), "top")).alias("_place"), F.lit(0).cast("long").alias("_bits"))
    full = bits.union(gaps).groupBy("_group", "_place").agg(F.bit_or("_bits").alias("_bits"))
    maps = full.groupBy("_group").agg(F.array_sort(F.collect_list(F.struct("_place", "_bits")))["_bits"].alias("_marks"))
    met = frame.withColumn("_group", F.expr(group)).join(broadcast_if_small(stage(maps, "marks")), "_group")
    return met.filter(F.expr(f"shiftright(get(_marks, {place}), {bit}) & 1 = 1")).drop("_group", "_marks")


def bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Writes ``df``, which is partitioned by ``key`` into ``buckets``, as a table bucketed and sorted by it, and opens it."""
    name = f"b_{uuid.uuid4().hex}"
    df.sortWithinPartitions(key).write.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    spark = df.sparkSession
    out = spark.table(name)
    out.table_name = name
    return out


def open_bucketed(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """A bucketed table that this or another session wrote: joins and groups by ``key`` need no exchange."""
    name = f"b_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
