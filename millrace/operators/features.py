"""Leak-free features and targets of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def price_features(df: DataFrame, key: str = "fuel_type", order: str = "date", price: str = "price", lags: int = 4, horizons: tuple[int, ...] = (1, 2, 4), threshold: float = 0.15) -> DataFrame:
    """Calendar parts, lags, mean and deviation of the previous three, recent change, future targets and trend labels."""
    w = Window.partitionBy(key).orderBy(order)
    past = w.rowsBetween(-3, -1)
    full = F.count(price).over(past) == 3
    day = F.col(order).cast("date")
    out = df.withColumns({"weekday": F.weekday(day), "month": F.month(day), "is_weekend": (F.weekday(day) >= 5).cast("int"), "iso_week": F.weekofyear(day)})
    out = out.withColumns({f"lag_{i}": F.lag(price, i).over(w) for i in range(1, lags + 1)})
    out = out.withColumns({"rolling_mean_3": F.when(full, F.avg(price).over(past)), "rolling_std_3": F.when(full, F.stddev_samp(price).over(past))})
    out = out.withColumn("recent_change", F.col("lag_1") - F.col("lag_2"))
    out = out.withColumns({f"target_price_h{h}": F.lead(price, h).over(w) for h in horizons})
    for h in horizons:
        change = F.col(f"target_price_h{h}") - F.col(price)
        out = out.withColumn(f"target_trend_h{h}", F.when(change > threshold, "up").when(change < -threshold, "down").otherwise("stable"))
    return out


def demand_features(df: DataFrame, first_day, price: str = "price_per_kg", competitor: str = "competitor_price_per_kg", date: str = "date") -> DataFrame:
    """Month, years since a first day learned from the training rows, and whether the competitor is cheaper."""
    return df.withColumns({
        "month": F.month(date), "years": F.datediff(F.col(date).cast("date"), F.lit(first_day).cast("date")) / 365.25,
        "competitor_cheaper": (F.col(competitor) < F.col(price)).cast("int"),
    })


def first_day(train: DataFrame, date: str = "date"):
    return train.agg(F.min(F.col(date).cast("date")).alias("d")).first()["d"]


def causal_features(df: DataFrame, key: str, order: str, price: str, promo: str, demand: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Stock from the price three rows ago (clipped), share of promotion over seven rows (partial frames count), previous demand."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({
        "stock": F.least(F.greatest(F.lag(price, 3).over(w), F.lit(low)), F.lit(high)), "promo_share": F.avg(promo).over(w.rowsBetween(-6, 0)), "previous_demand": F.lag(demand).over(w),
    })
