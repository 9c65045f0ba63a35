"""Price readings to dated clean prices and weekly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import fraction_to_pixels

LITRES_PER_GALLON = 3.785411784


def recover_unit_price(df: DataFrame, total: str, volume: str, unit: Column, value_range: tuple[float, float] = (10.0, 80.0), out: str = "unit_price") -> DataFrame:
    """Price per gallon from total and volume; null where it cannot be or is not plausible; marked arithmetic."""
    gallons = F.when(unit == "litre", F.col(volume) / LITRES_PER_GALLON).otherwise(F.col(volume))
    price = F.when((F.col(total) > 0) & (F.col(volume) > 0), F.round(F.col(total) / gallons, 2))
    kept = F.when(price.between(*value_range), price)
    return df.withColumn(out, kept).withColumn("method", F.when(F.col(out).isNotNull(), "arithmetic"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last-wins upsert: the row with the largest order values; null is a key value like any other."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Registry of one row per key: new rows replace old ones unless these are later in `order`."""
    return latest_per_key(existing.unionByName(new), keys, order)


def merge_photos(images: DataFrame, identity: str = "sha256", fill: tuple[str, ...] = ("source_uri", "brand", "station", "captured_at"), order: str = "id") -> DataFrame:
    """One row per content: the first arrival, its empty metadata taken from later ones."""
    rest = [c for c in images.columns if c != identity]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_r")
    later = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in fill]
    out = images.groupBy(identity).agg(first, *later)
    return out.select(identity, *[(F.coalesce(F.col("_r")[c], F.col(f"_{c}")) if c in fill else F.col("_r")[c]).alias(c) for c in rest])


def best_engine(readings: DataFrame, keys: list[str], rank: str = "engine_rank", confidence: str = "confidence", value: str = "price") -> DataFrame:
    """Most confident engine per crop; a later engine wins only if strictly surer and with a value."""
    usable = readings.where((F.col(rank) == 0) | F.col(value).isNotNull())
    rest = [c for c in readings.columns if c not in keys]
    best = usable.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(confidence), -F.col(rank))).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def clean_prices(readings: DataFrame) -> DataFrame:
    """Valid readings with a capture date, one price per day, fuel and brand (the surest, then the first reading).

    readings: reading_id, fuel_type, brand, captured_on, price, confidence, is_valid, method.
    """
    usable = readings.where(F.col("is_valid") & F.col("captured_on").isNotNull())
    best = usable.groupBy(F.col("captured_on").alias("observed_on"), "fuel_type", "brand").agg(
        F.max_by(F.struct("price", "reading_id", "method"), F.struct("confidence", -F.col("reading_id"))).alias("r")
    )
    return best.select("observed_on", "fuel_type", "brand", F.col("r.price").alias("price"), F.col("r.reading_id").alias("reading_id"), F.col("r.method").alias("method"))


def cutoff(df: DataFrame, argument=None, configured=None, date_col: str = "date") -> DataFrame:
    """One row: cut-off date (argument, then configuration, then last observation, then today) and whether it is a guess."""
    lit = lambda x: F.lit(x).cast("date")
    last = F.max(date_col).cast("date")
    return df.agg(F.coalesce(lit(argument), lit(configured), last, F.current_date()).alias("cutoff"), (F.coalesce(lit(argument), lit(configured), last).isNull()).alias("warn"))


def weekly_grid(keys: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every seventh day from start to end, for each row of keys."""
    return keys.withColumn("date", F.explode(F.sequence(start, end, F.expr("interval 7 days"))))


def overlay(grid: DataFrame, measured: DataFrame, keys: list[str], value: str = "price") -> DataFrame:
    """Measured values win over generated ones on (keys); generated rows never inherit provenance."""
    m = measured.select(*keys, F.col(value).alias("_m"), F.col("method").alias("_method"))
    joined = grid.join(m, keys, "left")
    real = F.col("_m").isNotNull()
    return joined.withColumn(value, F.coalesce(F.col("_m"), F.col(value))).withColumn("source", F.when(real, "real").otherwise("synthetic")).withColumn(
        "method", F.when(real, F.col("_method")).when(F.col(value).isNotNull(), "synthetic")
    ).drop("_m", "_method")


def panel_boxes(photos: DataFrame, assignment: DataFrame, profiles: DataFrame, default: str) -> DataFrame:
    """One row per photo and panel of its profile, with the box in pixels (null where the panel is out of frame).

    photos: file, width, height; assignment: file, profile; profiles: profile, fuel_type, box (four fractions or null).
    """
    placed = photos.join(assignment, "file", "left").withColumn("profile", F.coalesce("profile", F.lit(default)))
    return placed.join(profiles, "profile").withColumn("bbox", fraction_to_pixels(F.col("box"), F.col("width"), F.col("height")))
