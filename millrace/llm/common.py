"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local session without one (tests) gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Lists to which `materialize` adds the paths it writes, innermost `scratch` last; each thread has its own.
_WRITTEN: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


#: Rows of a narrow table that are worth a file of their own.
ROWS_A_FILE = 5_000


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write a table in the shared folder and read it again: cuts lineage and survives lost executors.

    It is deleted by the `scratch` around it, or else when the driver's session ends.  rows: about how many there are, if known;
    small tables then have fewer files than shuffle partitions (at least two for each core).  Each file that an executor creates
    on a local disk makes its JVM start a process for the file's permissions.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    if rows is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))
    df.write.parquet(path)
    for written in _WRITTEN.get()[-1:]:
        written.append(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    store, place = _place(spark, path)
    store.delete(place, True)
    store.cancelDeleteOnExit(place)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a table or folder when the driver's session ends."""
    store, place = _place(spark, path)
    store.deleteOnExit(place)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at the end what `materialize` wrote inside, but for the paths taken out of the list."""
    mine: list[str] = []
    before = _WRITTEN.set((*_WRITTEN.get(), mine))
    try:
        yield mine
    finally:
        _WRITTEN.reset(before)
        for path in mine:
            discard(spark, path)


def open_shared(uri: str, mode: str):
    """Open a file of the shared folder inside a task, whatever store it is in."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        path = parts.path if parts.scheme else uri
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if "w" in mode else store.open_input_file(path)


def remove_shared(uri: str) -> None:
    """Delete one file that an earlier step wrote; a file already gone is fine (a retried task)."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        try:
            os.remove(parts.path if parts.scheme else uri)
        except FileNotFoundError:
            pass
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    try:
        store.delete_file(path)
    except FileNotFoundError:
        pass


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times in `body` (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array.  No regular expression: every break becomes a space first."""
    text = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def unused_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(table: DataFrame, most: int = 200_000) -> DataFrame:
    """A stored table, broadcast in joins if it has no more rows than that."""
    return F.broadcast(table) if table.count() <= most else table


def join_unique(rows: DataFrame, table: DataFrame, key: str | list[str], count: str, hot_share: int = 10_000) -> DataFrame:
    """rows inner join table on `key`, which is unique in table; `count` is how many rows have the key.

    Keys with more than 1/hot_share of all rows would each fill a task of a shuffle; there are fewer
    than hot_share of them however large the input, so these are broadcast and the rest is shuffled.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    hot = F.col(count) > max(1000, total // hot_share)
    few = F.broadcast(table.where(hot).drop(count))
    rest = table.where(~hot).drop(count)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(rest, key))
