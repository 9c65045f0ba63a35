"""From a value back to its source, and fingerprints of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trace(gold: DataFrame, silver: DataFrame, readings: DataFrame, crops: DataFrame, runs: DataFrame, images: DataFrame) -> DataFrame:
    """Five left joins along the ids; missing links are named in `breaks`."""
    packed = lambda df, name: df.select(F.col("id").alias(f"_{name}_id"), F.struct(*df.columns).alias(name))
    out = gold.join(packed(silver, "silver"), F.col("silver_price_id") == F.col("_silver_id"), "left")
    out = out.join(packed(readings, "reading"), F.col("silver.price_reading_id") == F.col("_reading_id"), "left")
    out = out.join(packed(crops, "crop"), F.col("reading.image_crop_id") == F.col("_crop_id"), "left")
    out = out.join(packed(runs, "run"), F.col("reading.extraction_run_id") == F.col("_run_id"), "left")
    out = out.join(packed(images, "image"), F.col("run.image_id") == F.col("_image_id"), "left")
    breaks = F.array_compact(F.array(
        F.when(F.col("silver").isNull(), "no source price"),
        F.when(F.col("silver").isNotNull() & F.col("reading").isNull(), F.concat(F.lit("no source reading: "), F.coalesce("silver.method", F.lit("unknown")))),
        F.when(F.col("reading").isNotNull() & F.col("crop").isNull(), "no crop"),
    ))
    return out.drop("_silver_id", "_reading_id", "_crop_id", "_run_id", "_image_id").withColumn("breaks", breaks)


def trace_one(traced: DataFrame, observed_on, fuel_type: str) -> DataFrame:
    return traced.where((F.col("observed_on") == F.lit(observed_on).cast("date")) & (F.col("fuel_type") == fuel_type))


def link_gold(gold: DataFrame, silver: DataFrame, keys: tuple[str, ...] = ("observed_on", "fuel_type")) -> DataFrame:
    """Adds the silver row's id by (keys); of several brands the surest, then the first, is linked."""
    best = silver.groupBy(*keys).agg(F.max_by("id", F.struct("confidence", -F.col("id"))).alias("silver_price_id"))
    return gold.join(best, list(keys), "left")


def coverage(traced: DataFrame) -> DataFrame:
    """Rows, rows traced to an image, and their share, by method (a total row has method null)."""
    ok = F.sum(F.col("image").isNotNull().cast("long"))
    aggs = [F.count(F.lit(1)).alias("rows"), ok.alias("traceable"), F.round(100 * ok / F.count(F.lit(1)), 2).alias("pct")]
    per = traced.groupBy("method").agg(*aggs)
    return per.unionByName(traced.agg(*aggs).withColumn("method", F.lit(None).cast("string")))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that depends on the rows and not on their order: sums of two parts of each row's MD5, and a count.

    A row's text is its columns by name, joined by "|", nulls as "\\N"; give decimals and dates, whose text is the same everywhere.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in sorted(df.columns)])
    part = lambda start: F.conv(F.substring(F.md5(text), start, 13), 16, 10).cast("decimal(38,0)")
    total = lambda start: (F.sum(part(start)) % F.lit(2**61 - 1).cast("decimal(38,0)")).cast("long")
    return df.agg(total(1).alias("first_sum"), total(14).alias("second_sum"), F.count(F.lit(1)).alias("n"))


def engine_scoreboard(readings: DataFrame, truth: DataFrame, negatives: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Per engine: read, within tolerance, digits equal, and how often a value is invented where there is none.

    readings: engine, crop, value; truth: crop, expected; negatives: crop.
    """
    digits = lambda c: F.regexp_replace(F.format_number(c, 2), "[^0-9]", "")
    pos = readings.join(truth, "crop").groupBy("engine").agg(
        F.count(F.lit(1)).alias("crops"), F.sum(F.col("value").isNotNull().cast("long")).alias("read"),
        F.sum(F.coalesce((F.abs(F.col("value") - F.col("expected")) <= tolerance).cast("long"), F.lit(0))).alias("within"),
        F.sum(F.coalesce((digits("value") == digits("expected")).cast("long"), F.lit(0))).alias("digits_equal"),
    )
    neg = readings.join(negatives, "crop", "left_semi").groupBy("engine").agg(F.round(F.avg(F.col("value").isNotNull().cast("int")), 4).alias("invented_rate"))
    return pos.join(neg, "engine", "left")
