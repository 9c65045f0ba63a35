"""Tables stored once and read again: they cut lineage, are computed once for several readers, and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local session without one (tests) gets a folder of its own."""
    found, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if found:
        return found
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return context._jsc.sc().getCheckpointDir().get()


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder and read it again.  It is deleted when the driver's session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


POINTER = "_current"


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return hadoop, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that readers see; None before the first."""
    hadoop, place, fs = _fs(spark, path)
    pointer = hadoop.Path(place, POINTER)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None, version: str | None = None) -> str:
    """Replaces a derived table whole: writes a new version beside the old ones, then moves one pointer file to it.

    A job that fails on the way leaves readers with the version they had, and the table may be made from itself.  Old versions
    stay until `drop_old_versions`, so a reader that has begun is not disturbed.
    """
    spark = df.sparkSession
    version = version or f"v-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")  # what a failed try of the same version left
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{version}")
    hadoop, place, fs = _fs(spark, path)
    moving = hadoop.Path(place, f"{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(moving, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(moving), fs.makeQualified(hadoop.Path(place, POINTER)), options)
    return version


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that `replace_table` wrote."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no version of {path}")
    return spark.read.parquet(f"{path}/{version}")


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Deletes every version but the current one; how many went."""
    _, place, fs = _fs(spark, path)
    keep, gone = current_version(spark, path), 0
    for found in fs.listStatus(place):
        if found.isDirectory() and found.getPath().getName() != keep:
            gone += bool(fs.delete(found.getPath(), True))
    return gone


def store_index(index: DataFrame, table: str, keys: list[str], path: str, buckets: int = 64) -> None:
    """What has been done already, bucketed by its keys, so that looking it up moves only the new side."""
    index.select(*keys).distinct().write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("append").saveAsTable(table)


def pending_by_index(catalog: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """What a stored index does not have yet; only the catalogue is dealt, by the index's buckets."""
    return catalog.join(catalog.sparkSession.table(table).hint("merge"), keys, "left_anti")
