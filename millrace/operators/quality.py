"""Typing with reasons, duplicates, reversals and row filters.  No row is lost: what is dropped keeps a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import reason_prefix


def with_reason(df: DataFrame, rules: list[tuple[str, Column]], column: str = "motivo") -> DataFrame:
    """The first rule that holds names the reason; null if none does."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        reason = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    return df.withColumn(column, reason)


def split_discards(df: DataFrame, column: str = "motivo") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(column).isNull()).drop(column), df.where(F.col(column).isNotNull())


def union_discards(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, duplicates with reason): the first row of each key in `order`."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = df.withColumn("_copy", n)
    kept = numbered.where("_copy = 1").drop("_copy")
    return kept, numbered.where("_copy > 1").drop("_copy").withColumn("motivo", F.lit("duplicado"))


def cancel_reversals(tx: DataFrame, id_col: str, ref_col: str, is_reversal: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, cancelled): reversals and every row that one names.  A reversal without a reference cancels itself alone.

    A reversal is dealt to the row that it names, so one window decides instead of a join of the table
    with itself; rows are read once, and a previous shuffle by id serves again.
    """
    reversal = F.coalesce(is_reversal, F.lit(False))
    target = F.when(reversal, F.coalesce(F.col(ref_col), F.col(id_col))).otherwise(F.col(id_col))
    # Rows without an id share no target; a hash of the row spreads them over windows of their own.
    alone = F.when(target.isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in tx.columns]))
    by_target = Window.partitionBy("_target", "_alone")
    marked = tx.withColumn("_target", target).withColumn("_alone", alone).withColumn("_cancelled", F.coalesce(F.max(reversal).over(by_target), F.lit(False)))
    # Rows without an id are named by nobody.
    gone = F.col("_cancelled") & (F.col("_target").isNotNull() | reversal)
    kept = marked.where(~gone).drop("_target", "_alone", "_cancelled")
    return kept, marked.where(gone).drop("_target", "_alone", "_cancelled").withColumn("motivo", F.lit("reversa"))


def row_filter(df: DataFrame, max_null_ratio: float, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Exact duplicates go, then rows with too many nulls, then rows outside a bound (a null is inside)."""
    columns = df.columns
    nulls = sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0))
    out = df.dropDuplicates().where(nulls / len(columns) <= max_null_ratio)
    for c, (low, high) in bounds.items():
        out = out.where(F.col(c).isNull() | F.col(c).between(low, high))
    return out


def drop_if_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def validate_readings(df: DataFrame, value_range: tuple[float, float] = (10.0, 80.0), min_confidence: float = 0.55, value: str = "price", confidence: str = "confidence") -> DataFrame:
    """Adds is_valid and invalid_reason; the price of an invalid reading becomes null."""
    v, c = F.col(value), F.col(confidence)
    reason = (
        F.when(v.isNull(), "ocr_failed")
        .when(c < min_confidence, F.concat(F.lit("low_confidence("), F.format_number(c, 2), F.lit(")")))
        .when(~v.between(*value_range), F.concat(F.lit("out_of_plausible_range("), v.cast("string"), F.lit(")")))
    )
    return df.withColumn("invalid_reason", reason).withColumn("is_valid", F.col("invalid_reason").isNull()).withColumn(value, F.when(F.col("is_valid"), v))


def reason_summary(df: DataFrame, column: str = "motivo") -> DataFrame:
    return df.groupBy(F.coalesce(reason_prefix(F.col(column)), F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def extraction_health(readings: DataFrame, target: float = 0.7) -> DataFrame:
    """Totals, valid rows, share against the target."""
    valid = F.sum(F.col("is_valid").cast("long"))
    return readings.agg(F.count(F.lit(1)).alias("readings"), F.coalesce(valid, F.lit(0)).alias("valid"), F.round(F.avg(F.col("is_valid").cast("int")), 4).alias("valid_rate")).withColumn("meets_target", F.col("valid_rate") >= target)


def contract_violations(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values outside an enumeration, with their counts."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
