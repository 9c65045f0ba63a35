"""Versioned tables, stored indexes, and streams replayed in batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import prices
from millrace.sources import stored
from millrace.streaming import jobs


def test_a_failed_replacement_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "gold")
    with pytest.raises(FileNotFoundError):
        stored.read_table(spark, path)
    stored.replace_table(spark.range(10).withColumn("k", F.col("id") % 2), path, ["k"])
    reader = stored.read_table(spark, path)

    @F.udf("long")
    def fails_half_way(x):
        if x == 7:
            raise ValueError("half way")
        return x

    with pytest.raises(Exception, match="half way"):
        stored.replace_table(spark.range(10).select(fails_half_way("id").alias("id")), path)
    assert stored.read_table(spark, path).count() == 10 and reader.where("k = 1").count() == 5
    # A table may be made from itself.
    stored.replace_table(stored.read_table(spark, path).where("id < 4"), path)
    assert stored.read_table(spark, path).count() == 4 and reader.count() == 10
    assert stored.drop_old_versions(spark, path) == 2 and stored.read_table(spark, path).count() == 4


def test_index_is_not_dealt_again(spark, tmp_path):
    stored.store_index(spark.range(0, 100, 2).select(F.col("id").alias("key")), "seen_in_test", ["key"], str(tmp_path / "seen"), 4)
    stored.store_index(spark.range(1, 20, 2).select(F.col("id").alias("key")), "seen_in_test", ["key"], str(tmp_path / "seen"), 4)
    fresh = stored.pending_by_index(spark.range(0, 120).select(F.col("id").alias("key"), F.lit("x").alias("name")), "seen_in_test", ["key"])
    assert sorted(r["key"] for r in fresh.collect()) == [x for x in range(120) if not (x % 2 == 0 and x < 100 or x % 2 and x < 20)]
    plan = fresh._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    # The one exchange is the catalogue's.
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in plan
    spark.sql("DROP TABLE seen_in_test")


def at(day, hour=0):
    return dt.datetime(2025, 1, day, hour)


TX = "auth_code string, ts timestamp, kind string, auth_ref string, amount int"


def run(stream, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_reversals_that_come_days_later(spark, tmp_path):
    purchases = [("p1", at(1), "compra", None, 10), ("p2", at(1), "compra", None, 20), ("p3", at(2), "compra", None, 30), ("p4", at(4), "compra", None, 40), ("p5", at(6), "compra", None, 50)]
    reversals = [("R1", at(3), "reversa", "p1", 10), ("R3", at(9), "reversa", "p3", 30), ("R9", at(5), "reversa", "px", 1), ("R4", at(6), "reversa", "p4", 40)]
    rows = sorted([*purchases, *reversals], key=lambda r: r[1]) + [("end", at(28), "compra", None, 0), ("endR", at(28), "reversa", "none", 0), ("end2", at(29), "compra", None, 0), ("end2R", at(29), "reversa", "none", 0)]
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], TX).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TX).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.cancel_late_reversals(stream.where("kind = 'compra'"), stream.where("kind = 'reversa'"))
    run(out, "cancelled", tmp_path)
    got = {r["auth_code"]: r["motivo"] for r in spark.table("cancelled").where("ts < '2025-01-20'").collect()}
    # As in a batch: p1 and p4 are reversed in time, R3 is too late and R9 names nothing.
    assert got == {"p1": "reversa", "p2": None, "p3": None, "p4": "reversa", "p5": None, "R3": "reversa_sin_compra", "R9": "reversa_sin_compra"}
    assert spark.table("cancelled").where("auth_code = 'p2'").select("amount", "kind").first()[:] == (20, "compra")


def test_upserts_in_batches_equal_one_batch(spark, tmp_path):
    rows = [(f"k{i % 7}" if i % 11 else None, (i * 37) % 100, i) for i in range(100)]
    for i in range(0, 100, 20):
        spark.createDataFrame(rows[i : i + 20], "k string, version int, price int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema, path = "k string, version int, price int", str(tmp_path / "table")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.upsert_stream(stream(), path, ["k"], ["version", "price"], str(tmp_path / "check")).awaitTermination()
    want = sorted((tuple(r) for r in prices.latest_per_key(spark.createDataFrame(rows, schema), ["k"], ["version", "price"]).collect()), key=str)
    whole = lambda: sorted((tuple(r) for r in stored.read_table(spark, path).collect()), key=str)
    assert whole() == want and stored.current_version(spark, path) == "batch-000000000004"
    # The same batches given again, as after a lost checkpoint, change nothing.
    jobs.upsert_stream(stream(), path, ["k"], ["version", "price"], str(tmp_path / "again")).awaitTermination()
    assert whole() == want and stored.current_version(spark, path) == "batch-000000000004"
