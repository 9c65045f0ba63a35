"""Splits, metrics, quality gate, recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_n_split(df: DataFrame, key: str, order: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last n rows of each key are the test."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    numbered = df.withColumn("_back", back)
    return numbered.where(F.col("_back") > n).drop("_back"), numbered.where(F.col("_back") <= n).drop("_back")


def fraction_split(df: DataFrame, order: str, test: float) -> DataFrame:
    """Adds is_test: whole days from the day at which at least `test` of the rows are left.  Only counts per day are sorted."""
    day = F.col(order).cast("date")
    per_day = df.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    from_here = F.sum("_n").over(Window.orderBy(F.col("_day").desc()))
    total = F.sum("_n").over(Window.partitionBy())
    cut = per_day.select("_day", from_here.alias("_after"), total.alias("_total")).where(F.col("_after") >= test * F.col("_total")).agg(F.max("_day").alias("cut"))
    return df.withColumn("is_test", day >= cut.scalar())


def _hash_mod(key: str, n: int) -> Column:
    return F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % n


def hash_split(df: DataFrame, key: str, weights: dict[str, int]) -> DataFrame:
    """Adds split by a hash of the key modulo 100: repeatable whatever the partitions."""
    h = _hash_mod(key, 100)
    out, upto = F.lit(None).cast("string"), 0
    edges = []
    for name, share in weights.items():
        upto += share
        edges.append((upto, name))
    for edge, name in reversed(edges):
        out = F.when(h < edge, name).otherwise(out)
    return df.withColumn("split", out)


def hash_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """Adds fold 0..k-1 by a hash of the key, so rows of one key are in one fold."""
    return df.withColumn("fold", _hash_mod(key, k).cast("int"))


def forward_folds(df: DataFrame, key: str, order: str, k: int, ranges: int = 64) -> DataFrame:
    """Adds fold 1..k+1 in time order per key, of equal size as ntile makes them; fold f is tested on what was learned from the folds before it.

    A key may hold most rows, so rows are ranked within ranges of `order` and the rows of earlier ranges are counted.
    """
    cuts = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 1000)).first()[0] or []
    within = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    ranged = df.withColumn("_range", within)
    counts = ranged.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy("_key")
    placed = counts.select("_key", "_at", (F.sum("_n").over(by_key.orderBy("_at")) - F.col("_n")).alias("_before"), F.sum("_n").over(by_key).alias("_all"))
    rows = ranged.join(placed, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(key, "_range").orderBy(order))
    size, larger = F.floor(F.col("_all") / (k + 1)), F.col("_all") % (k + 1)  # the first `larger` folds have one row more
    fold = F.when(rank <= larger * (size + 1), F.ceil(rank / (size + 1))).otherwise(larger + F.ceil((rank - larger * (size + 1)) / F.greatest(size, F.lit(1))))
    return rows.withColumn("fold", fold.cast("int")).drop("_range", "_key", "_at", "_before", "_all")


def training_rows(gold: DataFrame, keys: list[str], features: list[str], target: str, least: int) -> DataFrame:
    """Rows without a null feature or target, of keys with enough of them."""
    usable = gold.dropna(subset=[*features, target])
    enough = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return usable.join(enough.drop("_n"), keys, "left_semi")


def regression_metrics(df: DataFrame, y: str, yhat: str, by: list[str], baseline: str | None = None) -> DataFrame:
    """MAE, MAPE, WAPE, RMSE, R2, bias and improvement over a baseline, in one aggregation."""
    e, t = F.col(yhat) - F.col(y), F.col(y)
    mean = F.avg(t)
    sst = F.sum(t * t) - F.count(t) * mean * mean
    rows = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    out = [
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), (F.avg(F.when(t != 0, F.abs(e / t))) * 100).alias("mape"),
        F.when(F.sum(F.abs(t)) > 0, F.sum(F.abs(e)) / F.sum(F.abs(t)) * 100).alias("wape"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(sst > 0, 1 - F.sum(e * e) / sst).alias("r2"), F.avg(e).alias("bias"),
    ]
    if baseline:
        out.append(F.avg(F.abs(F.col(baseline) - t)).alias("mae_base"))
    result = rows.groupBy(*by).agg(*out)
    if baseline:
        result = result.withColumn("improvement", F.when(F.col("mae_base") > 0, (F.col("mae_base") - F.col("mae")) / F.col("mae_base") * 100).otherwise(0.0))
    return result


def macro_f1(df: DataFrame, y: str, yhat: str, by: list[str]) -> DataFrame:
    """Unweighted mean of F1 over the classes seen in truth or prediction; an undefined F1 is 0."""
    pairs = df.groupBy(*by, y, yhat).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(*by, F.explode(F.array(F.struct(F.col(y).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(yhat).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), (F.col(y) == F.col(yhat)).alias("hit"), "n")
    per_class = sides.groupBy(*by, F.col("s.c").alias("c")).agg(F.sum(F.when(F.col("hit"), F.col("n") * F.col("s.t")).otherwise(0)).alias("tp"), F.sum(F.col("n")).alias("both"))
    # Every row counts once as truth and once as prediction, so 2tp + fp + fn is the number of both.
    return per_class.groupBy(*by).agg(F.avg(F.when(F.col("both") > 0, 2 * F.col("tp") / F.col("both")).otherwise(0.0)).alias("macro_f1"))


def trend_of(change: Column, threshold: float = 0.15) -> Column:
    return F.when(change > threshold, "up").when(change < -threshold, "down").otherwise("stable")


def evaluate_forecasts(df: DataFrame, by: list[str], max_mae: float = 1.0, min_f1: float = 0.55) -> DataFrame:
    """Metrics against persistence, trend F1 against last change, where the data came from, and the thresholds met.

    df: by, price, recent_change, target, forecast, source.
    """
    rows = df.withColumns({"_trend": trend_of(F.col("target") - F.col("price")), "_guess": trend_of(F.col("forecast") - F.col("price")), "_base": trend_of(F.coalesce(F.col("recent_change"), F.lit(0.0)))})
    real, made = F.bool_or(F.col("source") == "real"), F.bool_or(F.col("source") == "synthetic")
    label = rows.groupBy(*by).agg(F.when(real & made, "mixed").when(real, "real").otherwise("synthetic").alias("data_source"))
    f1 = macro_f1(rows, "_trend", "_guess", by)
    base = macro_f1(rows, "_trend", "_base", by).withColumnRenamed("macro_f1", "macro_f1_base")
    out = regression_metrics(rows, "target", "forecast", by, "price").join(f1, by).join(base, by).join(label, by)
    return out.withColumns({"mae_ok": F.col("mae") <= max_mae, "f1_ok": F.col("macro_f1") >= min_f1, "beats_baseline": F.col("mae") < F.col("mae_base")})


def quality_gate(evaluation: DataFrame, by: list[str]) -> DataFrame:
    """One row per criterion: pass, warn, or fail (only for losing to the baseline on data that is not purely synthetic)."""
    cases = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("ok")) for c in ("mae_ok", "f1_ok", "beats_baseline")])
    rows = evaluation.select(*by, "data_source", F.explode(cases).alias("x")).select(*by, "data_source", "x.criterion", "x.ok")
    blocks = (F.col("criterion") == "beats_baseline") & (F.col("data_source") != "synthetic")
    return rows.withColumn("status", F.when(F.col("ok"), "pass").when(blocks, "fail").otherwise("warn")).drop("ok")


def latest_complete(df: DataFrame, key: str, order: str, needed: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    best = df.dropna(subset=needed).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(key, *[F.col("_r")[c].alias(c) for c in rest])


def recommend(df: DataFrame, hour: int, margin: float = 0.10, threshold: float = 0.15, peak: tuple[int, ...] = (6, 7, 8, 17, 18, 19)) -> DataFrame:
    """df: price, forecast, model_wins.  A losing model is replaced by persistence; rising prices say refuel now."""
    used = F.when(F.coalesce(F.col("model_wins"), F.lit(False)), F.col("forecast")).otherwise(F.col("price"))
    out = df.withColumn("used_forecast", used).withColumn("change", F.round(F.col("used_forecast") - F.col("price"), 4))
    action = F.when(F.col("change") > margin, "refuel_now").when(F.col("change") < -margin, "wait").otherwise("indifferent")
    warning = F.when(~F.coalesce(F.col("model_wins"), F.lit(False)), "persistence_used")
    return out.withColumns({"action": action, "trend": trend_of(F.col("change"), threshold), "peak_hour": F.lit(hour in peak), "warning": warning})


def overfit_label(r2_train: Column, r2_test: Column) -> Column:
    gap = r2_train - r2_test
    return F.when(gap < 0.05, "good").when(gap < 0.10, "moderate").otherwise("overfit")


def by_absolute(coefficients: DataFrame, value: str = "coefficient") -> DataFrame:
    return coefficients.orderBy(F.abs(value).desc(), *[c for c in coefficients.columns if c != value])


def cross_validation_summary(folds: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """Mean and population deviation over folds, best first."""
    out = folds.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))
    return out.orderBy(F.col("mean").desc(), *by)
