"""Filling gaps in series, with a mark on every filled row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MARKS = {"interpolate": "interpolated", "median": "median_imputed", "mean": "mean_imputed"}


def fill_missing(df: DataFrame, key: str, order: str, value: str, strategy: str = "interpolate", method: str = "method", fill_edges: bool = True) -> DataFrame:
    """interpolate: linear by position per key, edges flat; median or mean of the key's known values.

    Only rows that were null and are not any more get the mark; a key without any value stays as it is.
    """
    if strategy not in MARKS:
        raise ValueError(f"unknown strategy {strategy}")
    v = F.col(value)
    if strategy == "interpolate":
        w = Window.partitionBy(key).orderBy(order)
        before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        known = F.when(F.col(value).isNotNull(), F.struct(v.alias("v"), F.col("_i").alias("i")))
        marked = df.withColumn("_i", F.row_number().over(w))
        marked = marked.withColumn("_p", F.last(known, True).over(before)).withColumn("_n", F.first(known, True).over(after))
        p, n = F.col("_p"), F.col("_n")
        inner = p["v"] + (n["v"] - p["v"]) * (F.col("_i") - p["i"]) / (n["i"] - p["i"])
        edge = F.coalesce(p["v"], n["v"]) if fill_edges else F.lit(None).cast("double")
        guess = F.when(p.isNotNull() & n.isNotNull(), inner).otherwise(edge)
        out = marked.withColumn("_g", F.when(v.isNull(), guess)).drop("_i", "_p", "_n")
    else:
        stat = F.median(v) if strategy == "median" else F.avg(v)
        out = df.withColumn("_g", F.when(v.isNull(), stat.over(Window.partitionBy(key))))
    filled = v.isNull() & F.col("_g").isNotNull()
    return out.withColumn(method, F.when(filled, MARKS[strategy]).otherwise(F.col(method))).withColumn(value, F.coalesce(v, F.col("_g"))).drop("_g")


def method_summary(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*(by or ("method",))).agg(F.count(F.lit(1)).alias("n"))
