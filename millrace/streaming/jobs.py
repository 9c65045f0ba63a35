"""Streams: files ingested once each, retries dropped and reversals met within bounded delays, last-wins tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.prices import latest_per_key, upsert
from millrace.sources.stored import current_version, read_table, replace_table


def ingest_files(spark: SparkSession, source: str, schema, target: str, checkpoint: str, per_trigger: int = 100, fmt: str = "parquet") -> StreamingQuery:
    """Each new file once, a bounded number per trigger; the checkpoint is the index of what has been read."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(source)
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_retries(stream: DataFrame, key: str = "auth_code", ts: str = "ts", delay: str = "3 days") -> DataFrame:
    """First copy of each key; copies later than the delay may pass, and state older than it is dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def cancel_late_reversals(purchases: DataFrame, reversals: DataFrame, id_col: str = "auth_code", ref_col: str = "auth_ref", ts: str = "ts", within: str = "3 days", delay: str = "2 days") -> DataFrame:
    """Purchases with motivo null (kept) or `reversa` (a reversal within the time names it), and reversals that cancel nothing with motivo `reversa_sin_compra`.

    A reversal comes days after its purchase, so both streams have a watermark and are joined on the reference and a range of
    time; a purchase is given out once no reversal in time can come any more, and its state is dropped.  A reversal later than
    `within`, before its purchase, or of an unknown one is reported, never lost.  Both streams have the same columns.
    """
    a = purchases.withWatermark(ts, delay)
    b = reversals.select(*[F.col(c).alias(f"_r_{c}") for c in reversals.columns]).withWatermark(f"_r_{ts}", delay)
    when = F.col(f"_r_{ts}")
    named = (F.col(id_col) == F.col(f"_r_{ref_col}")) & (when >= F.col(ts)) & (when <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    both = a.join(b, named, "full_outer")
    bought, turned = F.col(ts).isNotNull(), when.isNotNull()
    reason = F.when(bought & turned, "reversa").when(turned, "reversa_sin_compra")
    return both.select(*[F.when(bought, F.col(c)).otherwise(F.col(f"_r_{c}")).alias(c) for c in purchases.columns], reason.alias("motivo"))


def upsert_stream(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps a last-wins table: each batch makes a new version of the table out of the old one and itself.

    A version carries the number of its batch; a batch that is given again after a failure finds its version and changes nothing.
    Readers see whole versions only.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, version = batch.sparkSession, f"batch-{number:012d}"
        held = current_version(spark, path)
        if held is not None and held >= version:
            return
        new = latest_per_key(batch, keys, order)
        replace_table(new if held is None else upsert(read_table(spark, path), new, keys, order), path, version=version)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
