"""Registered queries on price series, readings and lineage, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import evaluate, features, gapfill, lineage, ml, prices, quality
from millrace.plans import tables as T
from millrace.sources import io, stored

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# Weekly mean unit price by return flag, in decimals so that both engines agree to the last digit; every fifth week is a gap.
SERIES_SQL = """weeks AS (SELECT l_returnflag AS fuel_type, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 100 AS full_price FROM lineitem GROUP BY 1, 2),
series AS (SELECT fuel_type, date, CASE WHEN datediff('day', DATE '1990-01-01', date) // 7 % 5 = 0 THEN NULL ELSE full_price END AS price,
  CASE WHEN datediff('day', DATE '1990-01-01', date) // 7 % 5 <> 0 THEN 'ocr' END AS method, CASE WHEN year(date) % 2 = 0 THEN 'real' ELSE 'synthetic' END AS source FROM weeks),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fuel_type ORDER BY date) AS i FROM series),
near AS (SELECT *, last_value(CASE WHEN price IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY fuel_type ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi,
  last_value(price IGNORE NULLS) OVER (PARTITION BY fuel_type ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  first_value(CASE WHEN price IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY fuel_type ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni,
  first_value(price IGNORE NULLS) OVER (PARTITION BY fuel_type ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM ranked),
filled AS (SELECT fuel_type, date, source, CASE WHEN price IS NOT NULL THEN price WHEN pi IS NULL THEN nv WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END AS price,
  CASE WHEN price IS NULL AND coalesce(pi, ni) IS NOT NULL THEN 'interpolated' ELSE method END AS method FROM near),
feat AS (SELECT *, lag(price) OVER w AS lag_1, lag(price, 2) OVER w AS lag_2, lag(price, 3) OVER w AS lag_3, lag(price, 4) OVER w AS lag_4,
  CASE WHEN count(price) OVER p = 3 THEN avg(price) OVER p END AS rolling_mean_3, CASE WHEN count(price) OVER p = 3 THEN stddev_samp(price) OVER p END AS rolling_std_3,
  lag(price) OVER w - lag(price, 2) OVER w AS recent_change, lead(price) OVER w AS t1, lead(price, 2) OVER w AS t2, lead(price, 4) OVER w AS t4 FROM filled
  WINDOW w AS (PARTITION BY fuel_type ORDER BY date), p AS (PARTITION BY fuel_type ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
test AS (SELECT fuel_type, date, source, price, recent_change, t1 AS target, rolling_mean_3 AS forecast FROM (SELECT *, row_number() OVER (PARTITION BY fuel_type ORDER BY date DESC) AS back FROM feat
  WHERE t1 IS NOT NULL AND rolling_mean_3 IS NOT NULL) WHERE back <= 60)"""
TREND = "CASE WHEN {0} > 0.15 THEN 'up' WHEN {0} < -0.15 THEN 'down' ELSE 'stable' END"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    weeks = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("fuel_type"), F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg(
        (money("l_extendedprice") / money("l_quantity") / 100).alias("full_price")
    )
    known = F.floor(F.datediff("date", F.lit("1990-01-01").cast("date")) / 7) % 5 != 0
    return weeks.select(
        "fuel_type", "date", F.when(known, F.col("full_price")).alias("price"), F.when(known, "ocr").alias("method"), F.when(F.year("date") % 2 == 0, "real").otherwise("synthetic").alias("source")
    )


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gapfill.fill_missing(series(spark, sf_dir), "fuel_type", "date", "price")


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.price_features(filled(spark, sf_dir))


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = featured(spark, sf_dir).dropna(subset=["target_price_h1", "rolling_mean_3"])
    _, test = evaluate.last_n_split(rows, "fuel_type", "date", 60)
    return test.select("fuel_type", "date", "source", "price", "recent_change", F.col("target_price_h1").alias("target"), F.col("rolling_mean_3").alias("forecast"))


@query(f"WITH {SERIES_SQL} SELECT fuel_type, date, round(price, 6) AS price, method FROM filled")
def gap_fill_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(spark, sf_dir).select("fuel_type", "date", F.round("price", 6).alias("price"), "method")


def _stat_sql(name: str, mark: str) -> str:
    return f"""WITH {SERIES_SQL} SELECT fuel_type, date, round(coalesce(price, {name}(price) OVER (PARTITION BY fuel_type)), 6) AS price,
  CASE WHEN price IS NULL THEN '{mark}' ELSE method END AS method FROM series"""


@query(_stat_sql("median", "median_imputed"))
def gap_fill_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gapfill.fill_missing(series(spark, sf_dir), "fuel_type", "date", "price", "median").select("fuel_type", "date", F.round("price", 6).alias("price"), "method")


@query(_stat_sql("avg", "mean_imputed"))
def gap_fill_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gapfill.fill_missing(series(spark, sf_dir), "fuel_type", "date", "price", "mean").select("fuel_type", "date", F.round("price", 6).alias("price"), "method")


@query(f"WITH {SERIES_SQL} SELECT method, source, count(*) AS n FROM filled GROUP BY 1, 2")
def method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gapfill.method_summary(filled(spark, sf_dir), "method", "source")


_R = lambda c: f"round({c}, 5) AS {c}"


@query(f"""WITH {SERIES_SQL} SELECT fuel_type, date, CAST(isodow(date) - 1 AS INTEGER) AS weekday, CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(weekofyear(date) AS INTEGER) AS iso_week,
  {_R('lag_1')}, {_R('lag_2')}, {_R('lag_3')}, {_R('lag_4')}, {_R('rolling_mean_3')}, {_R('rolling_std_3')}, {_R('recent_change')}, round(t1, 5) AS target_price_h1, round(t2, 5) AS target_price_h2, round(t4, 5) AS target_price_h4,
  {TREND.format('(t1 - price)')} AS target_trend_h1, {TREND.format('(t2 - price)')} AS target_trend_h2, {TREND.format('(t4 - price)')} AS target_trend_h4 FROM feat""")
def price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = ["lag_1", "lag_2", "lag_3", "lag_4", "rolling_mean_3", "rolling_std_3", "recent_change", "target_price_h1", "target_price_h2", "target_price_h4"]
    return featured(spark, sf_dir).select(
        "fuel_type", "date", "weekday", "month", "is_weekend", "iso_week", *[F.round(c, 5).alias(c) for c in rounded], "target_trend_h1", "target_trend_h2", "target_trend_h4"
    )


METRICS_SQL = f"""{SERIES_SQL}, m AS (SELECT fuel_type, count(*) AS n, avg(abs(forecast - target)) AS mae, avg(abs((forecast - target) / target)) * 100 AS mape, sum(abs(forecast - target)) / sum(abs(target)) * 100 AS wape,
  sqrt(avg((forecast - target) ** 2)) AS rmse, 1 - sum((forecast - target) ** 2) / (sum(target * target) - count(*) * avg(target) * avg(target)) AS r2, avg(forecast - target) AS bias, avg(abs(price - target)) AS mae_base FROM test GROUP BY 1)"""


@query(f"""WITH {METRICS_SQL} SELECT fuel_type, n, round(mae, 6) AS mae, round(mape, 4) AS mape, round(wape, 4) AS wape, round(rmse, 6) AS rmse, round(r2, 3) AS r2, round(bias, 6) AS bias, round(mae_base, 6) AS mae_base,
  round((mae_base - mae) / mae_base * 100, 3) AS improvement FROM m""")
def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.regression_metrics(test_rows(spark, sf_dir), "target", "forecast", ["fuel_type"], "price")
    digits = {"mae": 6, "mape": 4, "wape": 4, "rmse": 6, "r2": 3, "bias": 6, "mae_base": 6, "improvement": 3}
    return m.select("fuel_type", "n", *[F.round(c, d).alias(c) for c, d in digits.items()])


F1_SQL = f"""{METRICS_SQL}, tr AS (SELECT fuel_type, {TREND.format('(target - price)')} AS t, {TREND.format('(forecast - price)')} AS p FROM test),
cls AS (SELECT fuel_type, c, count(*) FILTER (t = c AND p = c) AS tp, count(*) FILTER (t <> c AND p = c) AS fp, count(*) FILTER (t = c AND p <> c) AS fn FROM tr, (VALUES ('up'), ('down'), ('stable')) v(c) WHERE t = c OR p = c GROUP BY 1, 2),
f1 AS (SELECT fuel_type, avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)) AS macro_f1 FROM cls GROUP BY 1)"""


@query(f"WITH {F1_SQL} SELECT fuel_type, round(macro_f1, 6) AS macro_f1 FROM f1")
def trend_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = test_rows(spark, sf_dir).withColumns({"t": evaluate.trend_of(F.col("target") - F.col("price")), "p": evaluate.trend_of(F.col("forecast") - F.col("price"))})
    return evaluate.macro_f1(rows, "t", "p", ["fuel_type"]).select("fuel_type", F.round("macro_f1", 6).alias("macro_f1"))


@query(f"""WITH {F1_SQL}, src AS (SELECT fuel_type, CASE WHEN count(DISTINCT source) = 2 THEN 'mixed' ELSE min(source) END AS data_source FROM test GROUP BY 1)
  SELECT fuel_type, data_source, criterion, CASE WHEN ok THEN 'pass' WHEN criterion = 'beats_baseline' AND data_source <> 'synthetic' THEN 'fail' ELSE 'warn' END AS status FROM (
  SELECT fuel_type, data_source, 'mae_ok' AS criterion, mae <= 1.0 AS ok FROM m JOIN src USING (fuel_type) UNION ALL SELECT fuel_type, data_source, 'f1_ok', macro_f1 >= 0.55 FROM f1 JOIN src USING (fuel_type)
  UNION ALL SELECT fuel_type, data_source, 'beats_baseline', mae < mae_base FROM m JOIN src USING (fuel_type))""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.quality_gate(evaluate.evaluate_forecasts(test_rows(spark, sf_dir), ["fuel_type"]), ["fuel_type"])


@query(f"""WITH {METRICS_SQL}, latest AS (SELECT fuel_type, arg_max(price, date) AS price, arg_max(rolling_mean_3, date) AS forecast, max(date) AS date FROM feat WHERE rolling_mean_3 IS NOT NULL GROUP BY 1),
  used AS (SELECT l.*, m.mae < m.mae_base AS wins, round(CASE WHEN m.mae < m.mae_base THEN forecast ELSE price END - price, 4) AS change FROM latest l JOIN m USING (fuel_type))
  SELECT fuel_type, date, change, CASE WHEN change > 0.10 THEN 'refuel_now' WHEN change < -0.10 THEN 'wait' ELSE 'indifferent' END AS action, {TREND.format('change')} AS trend, true AS peak_hour,
  CASE WHEN NOT wins THEN 'persistence_used' END AS warning FROM used""")
def refuel_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = evaluate.latest_complete(featured(spark, sf_dir), "fuel_type", "date", ["rolling_mean_3"]).withColumn("forecast", F.col("rolling_mean_3"))
    wins = evaluate.evaluate_forecasts(test_rows(spark, sf_dir), ["fuel_type"]).select("fuel_type", F.col("beats_baseline").alias("model_wins"))
    return evaluate.recommend(latest.join(wins, "fuel_type"), 18).select("fuel_type", "date", "change", "action", "trend", "peak_hour", "warning")


#: The same least squares by taking one feature after another out of the rest; coefficients from all but the last 60 rows of a key.
FIT_SQL = """u AS (SELECT *, count(*) OVER (PARTITION BY fuel_type) AS held, row_number() OVER (PARTITION BY fuel_type ORDER BY date DESC) AS back
    FROM (SELECT fuel_type, date, lag_1 AS x1, lag_2 AS x2, rolling_mean_3 AS x3, t1 AS y, price FROM feat) WHERE x1 + x2 + x3 + y IS NOT NULL),
  s1 AS (SELECT fuel_type, regr_slope(x2, x1) AS b2, regr_intercept(x2, x1) AS a2, regr_slope(x3, x1) AS b3, regr_intercept(x3, x1) AS a3, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM u WHERE back > 60 AND held >= 80 GROUP BY 1),
  r1 AS (SELECT u.*, x2 - a2 - b2 * x1 AS e2, x3 - a3 - b3 * x1 AS e3, a + b * x1 AS f1 FROM u JOIN s1 USING (fuel_type)),
  s2 AS (SELECT fuel_type, regr_slope(e3, e2) AS c3, regr_slope(y - f1, e2) AS c FROM r1 WHERE back > 60 GROUP BY 1),
  r2 AS (SELECT r1.*, e3 - c3 * e2 AS g3, f1 + c * e2 AS f2 FROM r1 JOIN s2 USING (fuel_type)),
  s3 AS (SELECT fuel_type, regr_slope(y - f2, g3) AS d FROM r2 WHERE back > 60 GROUP BY 1),
  p AS (SELECT r2.*, f2 + d * g3 AS yhat FROM r2 JOIN s3 USING (fuel_type) WHERE back <= 60),
  q AS (SELECT fuel_type, count(*) AS n, avg(abs(yhat - y)) AS mae, avg(abs((yhat - y) / y)) * 100 AS mape, sum(abs(yhat - y)) / sum(abs(y)) * 100 AS wape, sqrt(avg((yhat - y) * (yhat - y))) AS rmse,
    1 - sum((yhat - y) * (yhat - y)) / (var_pop(y) * count(*)) AS r2, avg(yhat - y) AS bias, avg(abs(price - y)) AS mae_base FROM p GROUP BY 1)"""


@query(f"""WITH {SERIES_SQL}, {FIT_SQL} SELECT fuel_type, n, round(mae, 4) AS mae, round(mape, 3) AS mape, round(wape, 3) AS wape, round(rmse, 4) AS rmse, round(r2, 3) AS r2, round(bias, 4) AS bias, round(mae_base, 4) AS mae_base,
  round((mae_base - mae) / mae_base * 100, 2) AS improvement FROM q""")
def forecasts_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares per fuel on lags; metrics of the last 60 weeks."""
    cols, target = ["lag_1", "lag_2", "rolling_mean_3"], "target_price_h1"
    rows = evaluate.training_rows(featured(spark, sf_dir), ["fuel_type"], cols, target, 80)
    train, test = evaluate.last_n_split(rows, "fuel_type", "date", 60)
    out = ml.predict_linear(test, ml.linear_per_key(train, ["fuel_type"], cols, target), ["fuel_type"], cols)
    m = evaluate.regression_metrics(out, target, "forecast", ["fuel_type"], "price")
    digits = {"mae": 4, "mape": 3, "wape": 3, "rmse": 4, "r2": 3, "bias": 4, "mae_base": 4, "improvement": 2}
    return m.select("fuel_type", "n", *[F.round(c, d).alias(c) for c, d in digits.items()])


GRID_SQL = """g AS (SELECT DISTINCT l_returnflag AS fuel_type FROM lineitem), grid AS (SELECT fuel_type, CAST(d AS DATE) AS date FROM g, range(DATE '1994-01-03', DATE '1998-12-29', INTERVAL 7 DAY) r(d))"""


@query(f"""WITH {SERIES_SQL}, {GRID_SQL} SELECT g.fuel_type, g.date, round(coalesce(s.price, 5.0), 6) AS price, CASE WHEN s.price IS NOT NULL THEN 'real' ELSE 'synthetic' END AS source,
  CASE WHEN s.price IS NOT NULL THEN s.method ELSE 'synthetic' END AS method FROM grid g LEFT JOIN (SELECT * FROM series WHERE price IS NOT NULL) s USING (fuel_type, date)""")
def weekly_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = series(spark, sf_dir).where("price is not null")
    keys = T.read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("fuel_type")).distinct()
    grid = prices.weekly_grid(keys, F.lit("1994-01-03").cast("date"), F.lit("1998-12-28").cast("date")).withColumn("price", F.lit(5.0))
    return prices.overlay(grid, measured, ["fuel_type", "date"]).select("fuel_type", "date", F.round("price", 6).alias("price"), "source", "method")


@query("SELECT CAST(max(l_shipdate) AS DATE) AS cutoff, false AS warn FROM lineitem")
def cutoff_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.cutoff(T.read(spark, sf_dir, "lineitem"), date_col="l_shipdate")


@query("""WITH r AS (SELECT l_shipmode_unit AS unit, CASE WHEN p BETWEEN 10 AND 2500 THEN p END AS unit_price FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'litre' ELSE 'gallon' END AS l_shipmode_unit,
  round(l_extendedprice / CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 3.785411784::DOUBLE ELSE l_quantity END, 2) AS p FROM lineitem))
  SELECT unit, CASE WHEN unit_price IS NOT NULL THEN 'arithmetic' END AS method, count(*) AS n, round(min(unit_price), 2) AS low, round(max(unit_price), 2) AS high FROM r GROUP BY 1, 2""")
def unit_price_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T.read(spark, sf_dir, "lineitem").withColumn("unit", F.when(F.col("l_linenumber") % 2 == 0, "litre").otherwise("gallon"))
    out = prices.recover_unit_price(li, "l_extendedprice", "l_quantity", F.col("unit"), (10, 2500))
    return out.groupBy("unit", "method").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("unit_price"), 2).alias("low"), F.round(F.max("unit_price"), 2).alias("high"))


READ_SQL = """rd AS (SELECT event_id AS reading_id, event_type AS fuel_type, CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(user_id % 3 AS VARCHAR) END AS brand, CASE WHEN event_id % 31 <> 0 THEN CAST(ts AS DATE) END AS captured_on,
  CASE WHEN event_id % 17 <> 0 THEN value END AS raw, (event_id * 7 % 100) / 100.0::DOUBLE AS confidence, user_id FROM events),
vd AS (SELECT *, CASE WHEN raw IS NULL THEN 'ocr_failed' WHEN confidence < 0.55 THEN 'low_confidence' WHEN NOT raw BETWEEN 10 AND 80 THEN 'out_of_plausible_range' END AS reason FROM rd)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as price readings."""
    e = T.read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("reading_id"), F.col("event_type").alias("fuel_type"), F.when(F.col("user_id") % 3 != 0, (F.col("user_id") % 3).cast("string")).alias("brand"),
        F.when(F.col("event_id") % 31 != 0, F.to_date("ts")).alias("captured_on"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("price"),
        (F.col("event_id") * 7 % 100 / 100.0).alias("confidence"), F.lit("ocr").alias("method"), "user_id",
    )


@query(f"WITH {READ_SQL} SELECT coalesce(reason, '') AS reason, count(*) AS n FROM vd GROUP BY 1")
def reading_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reason_summary(quality.validate_readings(readings(spark, sf_dir)), "invalid_reason")


@query(f"WITH {READ_SQL} SELECT count(*) AS readings, count(*) FILTER (reason IS NULL) AS valid, round(avg(CAST(reason IS NULL AS INTEGER)), 4) AS valid_rate, round(avg(CAST(reason IS NULL AS INTEGER)), 4) >= 0.7 AS meets_target FROM vd")
def extraction_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.extraction_health(quality.validate_readings(readings(spark, sf_dir)))


SILVER_SQL = f"""{READ_SQL}, silver AS (SELECT captured_on AS observed_on, fuel_type, brand, arg_max(raw, (confidence, -reading_id)) AS price, arg_max(reading_id, (confidence, -reading_id)) AS reading_id, max(confidence) AS confidence
  FROM vd WHERE reason IS NULL AND captured_on IS NOT NULL GROUP BY 1, 2, 3)"""


@query(f"WITH {SILVER_SQL} SELECT observed_on, fuel_type, brand, price, reading_id FROM silver")
def clean_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.clean_prices(quality.validate_readings(readings(spark, sf_dir))).drop("method")


@query("""SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def last_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return prices.latest_per_key(e, ["user_id", "event_type"], ["event_id"])


@query("""SELECT user_id AS sha256, min(event_id) AS id, coalesce(arg_min(CASE WHEN event_id % 4 = 0 THEN event_type END, event_id), arg_min(event_type, event_id) FILTER (event_id % 4 = 0)) AS brand FROM events GROUP BY 1""")
def photo_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "events").select(F.col("user_id").alias("sha256"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("brand"))
    return prices.merge_photos(e, fill=("brand",))


@query("""WITH r AS (SELECT user_id AS crop, event_id % 3 AS engine_rank, event_id, round(value, 0) AS confidence, CASE WHEN event_id % 5 <> 0 THEN value END AS price FROM events WHERE event_id < 3000 OR true),
  b AS (SELECT crop, engine_rank, max((confidence, -event_id)) AS k FROM r GROUP BY 1, 2),
  p AS (SELECT r.* FROM r JOIN b ON r.crop = b.crop AND r.engine_rank = b.engine_rank AND r.event_id = -b.k[2] WHERE r.engine_rank = 0 OR r.price IS NOT NULL)
  SELECT crop, arg_max(event_id, (confidence, -engine_rank)) AS event_id FROM p GROUP BY 1""")
def best_engine_per_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "events")
    r = e.select(F.col("user_id").alias("crop"), (F.col("event_id") % 3).alias("engine_rank"), "event_id", F.round("value", 0).alias("confidence"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("price"))
    # One reading per crop and engine first: the surest, then the earliest.
    one = r.groupBy("crop", "engine_rank").agg(F.max_by(F.struct("event_id", "confidence", "price"), F.struct("confidence", -F.col("event_id"))).alias("r")).select("crop", "engine_rank", "r.*")
    return prices.best_engine(one, ["crop"]).select("crop", "event_id")


def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows on every event day and fuel, traced to users as photos; every 7th reading has no crop."""
    valid = quality.validate_readings(readings(spark, sf_dir))
    silver = prices.clean_prices(valid).select(F.col("reading_id").alias("id"), "observed_on", "fuel_type", "price", F.when(F.col("reading_id") % 5 != 0, F.col("reading_id")).alias("price_reading_id"), F.lit("ocr").alias("method"))
    silver = silver.join(valid.select(F.col("reading_id").alias("id"), "confidence"), "id")
    e = T.read(spark, sf_dir, "events")
    days = e.select(F.to_date("ts").alias("observed_on"), F.col("event_type").alias("fuel_type")).distinct().withColumn("method", F.lit("gold"))
    rd = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("image_crop_id"), F.col("event_id").alias("extraction_run_id"), "value")
    crops, runs = e.select(F.col("event_id").alias("id")), e.select(F.col("event_id").alias("id"), F.col("user_id").alias("image_id"))
    images = e.select(F.col("user_id").alias("id")).distinct()
    return lineage.trace(lineage.link_gold(days, silver.drop("confidence").join(valid.select(F.col("reading_id").alias("id"), "confidence"), "id")), silver, rd, crops, runs, images)


LINEAGE_SQL = f"""{SILVER_SQL}, link AS (SELECT observed_on, fuel_type, arg_max(reading_id, (confidence, -reading_id)) AS sid FROM silver GROUP BY 1, 2),
gold AS (SELECT DISTINCT CAST(ts AS DATE) AS observed_on, event_type AS fuel_type FROM events),
traced AS (SELECT g.*, l.sid, CASE WHEN l.sid % 5 <> 0 THEN l.sid END AS rid FROM gold g LEFT JOIN link l USING (observed_on, fuel_type))"""


@query(f"""WITH {LINEAGE_SQL} SELECT observed_on, fuel_type, sid AS silver_id, rid AS reading_id, e.user_id AS image_id,
  CASE WHEN sid IS NULL THEN 'no source price' WHEN rid IS NULL THEN 'no source reading: ocr' WHEN rid % 7 = 0 THEN 'no crop' ELSE '' END AS breaks FROM traced t LEFT JOIN events e ON e.event_id = t.rid""")
def lineage_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _lineage(spark, sf_dir)
    return out.select("observed_on", "fuel_type", F.col("silver.id").alias("silver_id"), F.col("reading.id").alias("reading_id"), F.col("image.id").alias("image_id"), F.array_join("breaks", "; ").alias("breaks"))


@query(f"""WITH {LINEAGE_SQL}, c AS (SELECT 'gold' AS method, count(*) AS n_rows, count(rid) AS traceable, round(100.0::DOUBLE * count(rid) / count(*), 2) AS pct FROM traced)
  SELECT * FROM c UNION ALL SELECT NULL, n_rows, traceable, pct FROM c""")
def lineage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.coverage(_lineage(spark, sf_dir)).withColumnRenamed("rows", "n_rows")


@query("""WITH t AS (SELECT md5(concat_ws('|', coalesce(CAST(o_custkey AS VARCHAR), '\\N'), coalesce(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '\\N'), coalesce(CAST(o_orderkey AS VARCHAR), '\\N'), coalesce(o_orderpriority, '\\N'),
    coalesce(o_orderstatus, '\\N'), coalesce(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '\\N'))) AS h FROM orders)
  SELECT CAST(sum(CAST('0x' || substr(h, 1, 13) AS BIGINT)) % 2305843009213693951 AS BIGINT) AS first_sum, CAST(sum(CAST('0x' || substr(h, 14, 13) AS BIGINT)) % 2305843009213693951 AS BIGINT) AS second_sum, count(*) AS n FROM t""")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.read(spark, sf_dir, "orders")
    return lineage.fingerprint(o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), F.to_date("o_orderdate").alias("o_orderdate")))


@query("""WITH r AS (SELECT 'long' AS engine, d.doc_id AS crop, CASE WHEN d.n_chars > 300 THEN d.n_chars / 10.0::DOUBLE END AS value FROM documents d UNION ALL SELECT 'mod', doc_id, CASE WHEN doc_id % 3 <> 0 THEN n_chars % 50 + 0.0::DOUBLE END FROM documents),
  t AS (SELECT l.doc_id AS crop, d.n_chars / 10.0::DOUBLE AS expected FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1)
  SELECT * FROM (SELECT engine, count(*) AS crops, count(value) AS read, count(*) FILTER (abs(value - expected) <= 0.005) AS within, count(*) FILTER (round(value, 2) = round(expected, 2)) AS digits_equal FROM r JOIN t USING (crop) GROUP BY 1)
  LEFT JOIN (SELECT engine, round(avg(CAST(value IS NOT NULL AS INTEGER)), 4) AS invented_rate FROM r WHERE crop IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY 1) USING (engine)""")
def reader_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = T.read(spark, sf_dir, "documents"), T.read(spark, sf_dir, "labels")
    tenth = F.col("n_chars") / 10.0
    r = d.select(F.lit("long").alias("engine"), F.col("doc_id").alias("crop"), F.when(F.col("n_chars") > 300, tenth).alias("value")).unionByName(
        d.select(F.lit("mod").alias("engine"), F.col("doc_id").alias("crop"), F.when(F.col("doc_id") % 3 != 0, (F.col("n_chars") % 50).cast("double")).alias("value"))
    )
    truth = lab.where("quality = 1").join(d, "doc_id").select(F.col("doc_id").alias("crop"), tenth.alias("expected"))
    return lineage.engine_scoreboard(r, truth, lab.where("quality = 0").select(F.col("doc_id").alias("crop")))


#: Two numbers side by side and one after a label, as the given pages show them.
PAGE_PAIR, PAGE_AGO = r"(?s)track\(([0-9]+)\).*?<!-- ad ([0-9]+) -->", r"(?s)<article>.*?([0-9]+(?:\.[0-9]+)?)"


@query(f"""WITH n AS (SELECT page_id, TRY_CAST(regexp_extract(html, '{PAGE_PAIR}', 1) AS DOUBLE) AS per_litre, TRY_CAST(regexp_extract(html, '{PAGE_PAIR}', 2) AS DOUBLE) AS per_gallon,
  TRY_CAST(regexp_extract(html, '{PAGE_AGO}', 1) AS DOUBLE) AS month_ago FROM pages)
  SELECT *, CASE WHEN month_ago > 0 THEN round((per_litre - month_ago) / month_ago * 100, 2) END AS change_pct FROM n""")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.parse_price_pages(T.read(spark, sf_dir, "pages").select("page_id", "html"), "html", PAGE_PAIR, PAGE_AGO).drop("html")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://drive.google.com/uc?export=download&id=f' || CAST(page_id AS VARCHAR) WHEN page_id % 3 = 1 THEN 'https://www.dropbox.com/s/' || CAST(page_id AS VARCHAR) || '/a.jpg?dl=1' ELSE url END AS link FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page address as a shared link of one kind, every third as one of the other."""
    number, third = F.col("page_id").cast("string"), F.col("page_id") % 3
    drive, box = F.concat(F.lit("https://drive.google.com/file/d/f"), number, F.lit("/view")), F.concat(F.lit("https://www.dropbox.com/s/"), number, F.lit("/a.jpg?dl=0"))
    shared = F.when(third == 0, drive).when(third == 1, box).otherwise(F.col("url"))
    return T.read(spark, sf_dir, "pages").select("page_id", io.normalize_link(shared).alias("link"))


@query("""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS file_hash, coalesce(lang, '') AS version, coalesce(source, '') AS config FROM documents)
  SELECT doc_id FROM d WHERE NOT EXISTS (SELECT 1 FROM d k WHERE k.doc_id % 2 = 0 AND k.file_hash = d.file_hash AND k.version = d.version AND k.config = d.config)""")
def unprocessed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose content, version and configuration no earlier run has had together."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    d = T.read(spark, sf_dir, "documents").select("doc_id", F.sha2(blank("text"), 256).alias("file_hash"), blank("lang").alias("version"), blank("source").alias("config"))
    return io.pending(d, d.where("doc_id % 2 = 0"), ["file_hash", "version", "config"]).select("doc_id")


@query("""WITH k AS (SELECT page_id, sha256(coalesce(html, '')) AS cache_key FROM pages), i AS (SELECT DISTINCT cache_key FROM k WHERE page_id % 3 = 0), f AS (SELECT DISTINCT cache_key FROM k WHERE page_id % 7 = 1),
  s AS (SELECT CASE WHEN cache_key IN (FROM i) THEN 'skipped' WHEN cache_key IN (FROM f) THEN 'failed' ELSE 'downloaded' END AS status FROM k)
  SELECT v.status, count(s.status) AS n FROM (VALUES ('downloaded'), ('skipped'), ('failed')) v(status) LEFT JOIN s USING (status) GROUP BY 1""")
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = T.read(spark, sf_dir, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("cache_key"))
    return io.ingest_report(k, k.where("page_id % 3 = 0"), k.where("page_id % 7 = 1"))


@query("""WITH t AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, CASE l_partkey % 5 WHEN 0 THEN ' ' || CAST(1000 + l_partkey % 9000 AS VARCHAR) WHEN 1 THEN CAST(10 + l_partkey % 80 AS VARCHAR) || '.5 ' WHEN 2 THEN '4?.' || CAST(l_partkey % 10 AS VARCHAR)
    WHEN 3 THEN '4.0.' || CAST(l_partkey % 10 AS VARCHAR) ELSE 'Q' || CAST(1000 + l_partkey % 9000 AS VARCHAR) END AS raw FROM lineitem),
  b AS (SELECT *, regexp_replace(raw, '\\s+', '', 'g') AS bare, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM t),
  p AS (SELECT *, CASE WHEN NOT contains(bare, '?') AND len(bare) - len(replace(bare, '.', '')) < 2 THEN TRY_CAST(bare AS DOUBLE) END AS plain FROM b),
  m AS (SELECT *, plain IS NULL AND len(digits) = 4 AND NOT contains(raw, '.') AS moved FROM p)
  SELECT part % 5 AS kind, count(*) AS n, round(sum(CASE WHEN moved THEN CAST(left(digits, 2) || '.' || right(digits, 2) AS DOUBLE) ELSE plain END), 2) AS price, round(sum(CASE WHEN moved THEN 0.8::DOUBLE * 0.85::DOUBLE ELSE 0.8::DOUBLE END), 2) AS confidence FROM m GROUP BY 1""")
def price_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display readings of several kinds of trouble: bare digits, a point, an unreadable digit, two points, a letter."""
    li = T.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"))
    four, digit = (1000 + F.col("part") % 9000).cast("string"), (F.col("part") % 10).cast("string")
    cases = [F.concat(F.lit(" "), four), F.concat((10 + F.col("part") % 80).cast("string"), F.lit(".5 ")), F.concat(F.lit("4?."), digit), F.concat(F.lit("4.0."), digit), F.concat(F.lit("Q"), four)]
    raw = F.get(F.array(*cases), (F.col("part") % 5).cast("int"))
    read = li.select((F.col("part") % 5).alias("kind"), scalars.price_reading(raw, F.lit(0.8)).alias("r"))
    return read.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r.price"), 2).alias("price"), F.round(F.sum("r.confidence"), 2).alias("confidence"))


@query("""WITH f AS (SELECT p_partkey AS file, 100 + p_size AS width, 50 + p_size % 7 AS height, CASE WHEN p_partkey % 3 = 0 THEN 'wide' WHEN p_partkey % 3 = 1 THEN 'tall' ELSE 'usual' END AS profile FROM part),
  b AS (FROM (VALUES ('usual', 'diesel', 0.1::DOUBLE, 0.2::DOUBLE, 0.33::DOUBLE, 0.47::DOUBLE), ('usual', 'super', NULL, NULL, NULL, NULL), ('wide', 'diesel', 0.05::DOUBLE, 0.1::DOUBLE, 0.995::DOUBLE, 0.999::DOUBLE), ('tall', 'super', 0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.875::DOUBLE)) v(profile, fuel_type, a, b, c, d))
  SELECT file, fuel_type, CAST(trunc(a * width) AS INTEGER) AS x0, CAST(trunc(b * height) AS INTEGER) AS y0, CAST(trunc(c * width) AS INTEGER) AS x1, CAST(trunc(d * height) AS INTEGER) AS y1 FROM f JOIN b USING (profile)""")
def panel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.read(spark, sf_dir, "part")
    photos = p.select(F.col("p_partkey").alias("file"), (100 + F.col("p_size")).alias("width"), (50 + F.col("p_size") % 7).alias("height"))
    assigned = p.where("p_partkey % 3 < 2").select(F.col("p_partkey").alias("file"), F.when(F.col("p_partkey") % 3 == 0, "wide").otherwise("tall").alias("profile"))
    rows = [("usual", "diesel", [0.1, 0.2, 0.33, 0.47]), ("usual", "super", None), ("wide", "diesel", [0.05, 0.1, 0.995, 0.999]), ("tall", "super", [0.25, 0.5, 0.75, 0.875])]
    out = prices.panel_boxes(photos, assigned, spark.createDataFrame(rows, "profile string, fuel_type string, box array<double>"), "usual")
    return out.select("file", "fuel_type", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


@query("""SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$') AS name, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[A-Za-z0-9]+)$', 1)) AS extension FROM pages""")
def link_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "pages").select("page_id", scalars.file_name(F.col("url")).alias("name"), scalars.file_extension(F.col("url")).alias("extension"))


@query("""SELECT CASE WHEN page_id % 2 = 0 THEN 'sum:' || sha256(html) ELSE 'id:' || CAST(page_id AS VARCHAR) || '|' || CAST(octet_length(encode(html)) AS VARCHAR) || '|' END AS cache_key FROM pages WHERE page_id % 3 <> 0""")
def pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.read(spark, sf_dir, "pages")
    catalog = io.with_cache_key(p.select(
        F.col("page_id").alias("identifier"), F.octet_length("html").cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified_at"), F.when(F.col("page_id") % 2 == 0, F.sha2("html", 256)).alias("checksum")
    ))
    return io.pending(catalog, catalog.where("identifier % 3 = 0"), ["cache_key"]).select("cache_key")


@query("""WITH k AS (SELECT page_id, sha256(coalesce(html, '')) AS cache_key FROM pages) SELECT page_id, cache_key FROM k WHERE cache_key NOT IN (SELECT cache_key FROM k WHERE page_id % 3 = 0)""")
def pending_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose content a stored, bucketed index does not have."""
    k = T.read(spark, sf_dir, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("cache_key"))
    table = f"seen_{uuid.uuid4().hex}"
    stored.store_index(k.where("page_id % 3 = 0"), table, ["cache_key"], f"{stored.shared_dir(spark)}/{table}", 16)
    return stored.pending_by_index(k, table, ["cache_key"]).select("page_id", "cache_key")


@query(f"WITH {SERIES_SQL} SELECT fuel_type, date, round(lag_1, 5) AS lag_1, round(rolling_mean_3, 5) AS rolling_mean_3 FROM feat")
def feature_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["lag_1", "rolling_mean_3"]
    packed = io.features_to_map(featured(spark, sf_dir).select("fuel_type", "date", *names), names)
    return io.features_to_columns(packed, names).select("fuel_type", "date", *[F.round(c, 5).alias(c) for c in names])
