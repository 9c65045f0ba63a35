"""Table preparation and models with Spark ML."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_at(df: DataFrame, column: str, rank: int, few: int = 10_000, ranges: int = 64) -> float:
    """The value at a rank (from 0, nulls left out), exact: the range that holds it is cut again until it is small or one value."""
    rows, c = df.where(F.col(column).isNotNull()).select(column), F.col(column)
    while True:
        n, least, most, cuts = rows.agg(F.count(c), F.min(c), F.max(c), F.percentile_approx(c, [i / ranges for i in range(1, ranges)], 1000)).first()
        if least == most:
            return least
        if n <= few:
            return sorted(r[0] for r in rows.collect())[rank]
        edges = F.array(*[F.lit(x) for x in sorted(set(cuts))])
        # A value that is an edge has a place of its own, so a very common one ends the search.
        place = F.size(F.filter(edges, lambda e: e < c)) + F.size(F.filter(edges, lambda e: e <= c))
        counts = sorted((r["place"], r["count"]) for r in rows.groupBy(place.alias("place")).count().collect())  # at most 2 x ranges rows
        for at, held in counts:
            if rank < held:
                break
            rank -= held
        rows = rows.where(place == at)


def median(df: DataFrame, column: str) -> float | None:
    n = df.agg(F.count(column)).first()[0]
    return (value_at(df, column, (n - 1) // 2) + value_at(df, column, n // 2)) / 2 if n else None


def fit_fill(df: DataFrame, numeric: list[str], text: list[str]) -> dict:
    """Medians of numbers and modes of texts (ties to the smallest), exact, without a buffer of all values in one task."""
    modes = {c: df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first() for c in text}
    return {c: median(df, c) for c in numeric} | {c: r[0] if r else None for c, r in modes.items()}


def impute(df: DataFrame, fill: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items() if v is not None})


def scale(df: DataFrame, columns: list[str], population: bool = True) -> DataFrame:
    """Centred and scaled by the population deviation (or the sample's); a constant column becomes 0."""
    dev = F.stddev_pop if population else F.stddev_samp
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[dev(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({c: (F.col(c) - row[f"m_{c}"]) / (row[f"s_{c}"] or 1.0) for c in columns})


def one_hot(train: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Zero/one columns for the training categories; an unseen one is all zeros."""
    index = StringIndexer(inputCol=column, outputCol="_i", handleInvalid="keep", stringOrderType="alphabetAsc")
    model = Pipeline(stages=[index, OneHotEncoder(inputCol="_i", outputCol="_v", dropLast=True)]).fit(train)
    labels = model.stages[0].labels
    out = model.transform(df).withColumn("_a", vector_to_array("_v"))
    return out.withColumns({f"{column}_{x}": F.get("_a", F.lit(i)).cast("int") for i, x in enumerate(labels)}).drop("_i", "_v", "_a")


def principal_parts(df: DataFrame, columns: list[str], keep: float = 0.95) -> tuple[DataFrame, list[float], np.ndarray]:
    """Scores on the fewest components that explain `keep` of the variance, all explained shares, and the loadings (a column per component).

    Columns are centred and scaled by the sample deviation; a component's largest loading is positive.
    """
    stages = [VectorAssembler(inputCols=columns, outputCol="_f"), StandardScaler(inputCol="_f", outputCol="_s", withMean=True), PCA(k=len(columns), inputCol="_s", outputCol="_p")]
    model = Pipeline(stages=stages).fit(df)
    shares, loadings = model.stages[-1].explainedVariance.toArray().tolist(), model.stages[-1].pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(0), range(len(columns))])
    k = int(np.searchsorted(np.cumsum(shares), keep - 1e-12)) + 1
    out = model.transform(df).withColumn("_a", vector_to_array("_p"))
    return out.withColumns({f"pc{i + 1}": F.get("_a", F.lit(i)) * float(signs[i]) for i in range(k)}).drop("_f", "_s", "_p", "_a"), shares, loadings * signs


def regressor(kind: str, **params):
    made = {"linear": LinearRegression, "ridge": LinearRegression, "forest": RandomForestRegressor, "boosted": GBTRegressor}[kind]
    defaults = {"ridge": {"regParam": 0.1, "elasticNetParam": 0.0}, "forest": {"numTrees": 50, "seed": 42}, "boosted": {"seed": 42}}.get(kind, {})
    return made(featuresCol="_x", labelCol="_y", predictionCol="prediction", **(defaults | params))


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], target: str, kind: str = "linear", **params) -> tuple[DataFrame, object]:
    vec = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
    with_y = lambda df: vec.transform(df).withColumn("_y", F.col(target).cast("double"))
    model = regressor(kind, **params).fit(with_y(train.dropna(subset=[*features, target])))
    return model.transform(with_y(test)).drop("_x", "_y"), model


def coefficients(spark, model, features: list[str]) -> DataFrame:
    return spark.createDataFrame([(f, float(c)) for f, c in zip(features, model.coefficients, strict=True)], "feature string, coefficient double")


def products(df: DataFrame, features: list[str], target: str, fold: str = "fold") -> dict[int, np.ndarray]:
    """Sums of products of (1, features, target) per fold, in one aggregation: a matrix per fold, whatever the rows."""
    v = [F.lit(1.0), *[F.col(c).cast("double") for c in [*features, target]]]
    k = len(v)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = df.dropna(subset=[*features, target]).groupBy(F.col(fold).cast("int").alias("_fold")).agg(*[F.sum(v[i] * v[j]).alias(f"s{i}_{j}") for i, j in pairs])
    found = {}
    for row in sums.collect():  # one row a fold
        m = np.zeros((k, k))
        for i, j in pairs:
            m[i, j] = m[j, i] = row[f"s{i}_{j}"]
        found[row["_fold"]] = m
    return found


def solve_ridge(m: np.ndarray, penalty: float) -> np.ndarray:
    """Intercept and weights from sums of products: least squares on standardised features (population deviation) plus penalty x n x squared weights."""
    n, mean = m[0, 0], m[0] / m[0, 0]
    cov = m[1:, 1:] / n - np.outer(mean[1:], mean[1:])
    dev = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    unit = np.where(dev > 0, dev, 1.0)
    r = cov[:-1, :-1] / np.outer(unit, unit)
    b = np.linalg.lstsq(r + penalty * np.eye(len(unit)), cov[:-1, -1] / unit, rcond=None)[0] / unit
    return np.concatenate([[mean[-1] - b @ mean[1:-1]], b])


def r2_from_products(m: np.ndarray, weights: np.ndarray) -> float:
    """R2 of a linear model on the rows that the sums stand for."""
    d = np.concatenate([weights, [-1.0]])  # prediction minus target
    sst = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
    return float(1 - d @ m @ d / sst) if sst > 0 else 0.0


def fold_search(df: DataFrame, features: list[str], target: str, penalties: list[float], scheme: str = "forward", fold: str = "fold") -> DataFrame:
    """setting, penalty, fold, r2: every ridge penalty on every fold from one pass over the data.

    Sums of products add up, so the rows to learn from are the sums of the folds before (`forward`: time-ordered folds, tested from
    the second on) or all sums minus the fold's own (`kfold`).  Any number of penalties costs nothing more on the data; only
    matrices of the features are solved on the driver.
    """
    sums = products(df, features, target, fold)
    order, rows = sorted(sums), []
    for at, f in enumerate(order):
        learn = [sums[g] for g in (order[:at] if scheme == "forward" else order) if g != f]
        if not learn:
            continue
        for i, penalty in enumerate(penalties):
            rows.append((i, float(penalty), f, r2_from_products(sums[f], solve_ridge(sum(learn), penalty))))
    return df.sparkSession.createDataFrame(rows, "setting int, penalty double, fold int, r2 double")


def random_penalties(seed: int, n: int, least: float = 1e-3, most: float = 10.0) -> list[float]:
    """Penalties drawn evenly on a logarithmic scale; the same for the same seed."""
    draws = np.random.default_rng(seed).uniform(np.log(least), np.log(most), n)
    return [float(f"{x:.6g}") for x in np.exp(draws)]


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys, of which null is a value; the right side's other columns are added."""
    renamed = right.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return left.join(renamed, same, how).drop(*[f"_key{i}" for i in range(len(keys))])


def value_ranks(df: DataFrame, keys: list[str], value: str, bins: int = 1024) -> DataFrame:
    """keys, n, low, high: the two middle values of each of many keys, exact (null values are left out).

    A key's values are counted in bins between its least and largest; only the bins that hold a middle rank are looked into, by
    distinct value, so no task holds more of a key than its bins or the distinct values of one bin.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    span = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_a"), F.max("_v").alias("_z"))
    place = F.least(F.floor((F.col("_v") - F.col("_a")) / F.nullif(F.col("_z") - F.col("_a"), F.lit(0.0)) * bins), F.lit(bins - 1))
    placed = _meet(rows, span, keys).select(*keys, "_v", "n", F.coalesce(place, F.lit(0)).cast("int").alias("_bin"))
    counted = placed.groupBy(*keys, "n", "_bin", "_v").agg(F.count(F.lit(1)).alias("_c"))
    per_bin = counted.groupBy(*keys, "n", "_bin").agg(F.sum("_c").alias("_held"))
    before = F.sum("_held").over(Window.partitionBy(*keys).orderBy("_bin")) - F.col("_held")
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    holds = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_held"))
    middle = per_bin.withColumn("_before", before).where(holds(low) | holds(high)).select(*keys, "_bin", "_before")
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))
    ranked = _meet(counted, middle, [*keys, "_bin"]).withColumn("_upto", upto)
    hit = lambda r: (F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r)
    return ranked.groupBy(*keys, "n").agg(F.max(F.when(hit(low), F.col("_v"))).alias("low"), F.max(F.when(hit(high), F.col("_v"))).alias("high"))


def median_per_key(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    return value_ranks(df, keys, value).select(*keys, "n", ((F.col("low") + F.col("high")) / 2).alias(out))


def robust_scale(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, median, mad: median and median absolute deviation of each key."""
    centre = median_per_key(df, keys, value)
    away = _meet(df.select(*keys, value), centre, keys).select(*keys, F.abs(F.col(value).cast("double") - F.col("median")).alias("_away"))
    return _meet(centre, median_per_key(away, keys, "_away", "mad").drop("n"), keys)


def robust_scores(df: DataFrame, keys: list[str], value: str, scales: DataFrame) -> DataFrame:
    """Adds robust_score = 0.6745 (value - median) / mad of the row's key; null where the deviation is 0."""
    score = F.lit(0.6745) * (F.col(value) - F.col("median")) / F.nullif(F.col("mad"), F.lit(0.0))
    return _meet(df, scales.select(*keys, "median", "mad"), keys, "left").withColumn("robust_score", score).drop("median", "mad")


def linear_per_key(df: DataFrame, keys: list[str], features: list[str], target: str, ridge: float = 1e-6) -> DataFrame:
    """Least squares for each of many small keys.

    The sums of products are aggregated by Spark, with partials before the shuffle, whatever a key's
    size; only the small systems are solved in Python.
    """
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(target).cast("double")
    usable = df.dropna(subset=[*features, target])
    sums = usable.groupBy(*keys).agg(
        F.array(*[F.sum(a * b) for a in x for b in x]).alias("xx"), F.array(*[F.sum(a * y) for a in x]).alias("xy"), F.count(F.lit(1)).alias("n")
    )
    k = len(x)

    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(xx, xy, strict=True):
            m = np.array(a, float).reshape(k, k)
            out.append(np.linalg.lstsq(m + ridge * np.diag([0.0] + [1.0] * (k - 1)), np.array(b, float), rcond=None)[0].tolist())
        return pd.Series(out)

    return sums.select(*keys, "n", F.pandas_udf(solve, "array<double>")("xx", "xy").alias("weights"))


def predict_linear(df: DataFrame, weights: DataFrame, keys: list[str], features: list[str], out: str = "forecast") -> DataFrame:
    w = F.col("weights")
    value = w[0]
    for i, f in enumerate(features):
        value = value + w[i + 1] * F.col(f)
    return df.join(weights.select(*keys, "weights"), keys, "left").withColumn(out, value).drop("weights")


def accrual_anomalies(tx: DataFrame, bound: float = 0.2, points: str = "points", amount: str = "amount_gtq") -> DataFrame:
    """Points per unit of money above a fixed bound: held, not dropped."""
    return tx.withColumn("ratio", F.when(F.col(amount) > 0, F.col(points) / F.col(amount))).withColumn("held", F.coalesce(F.col("ratio") > bound, F.lit(False)))


def review_queue(df: DataFrame, score: str, capacity: int, tie: str) -> DataFrame:
    """As many rows as can be reviewed, highest score first."""
    return df.orderBy(F.col(score).desc_nulls_last(), tie).limit(capacity)


def redemption_features(events: DataFrame, key: str, ts: str, value: str, redeems, at, label_days: int = 90) -> DataFrame:
    """Point-in-time features of each key before `at`, and whether it redeems within label_days after."""
    cut = F.lit(at).cast("timestamp")
    before, after = F.col(ts) < cut, (F.col(ts) >= cut) & (F.col(ts) < cut + F.expr(f"INTERVAL {label_days} DAYS"))
    recent = before & (F.col(ts) >= cut - F.expr("INTERVAL 30 DAYS"))
    return events.groupBy(key).agg(
        F.coalesce(F.sum(F.when(before, F.col(value))), F.lit(0.0)).alias("balance"), F.sum(before.cast("long")).alias("n_before"), F.sum(recent.cast("long")).alias("n_recent"),
        F.sum((before & redeems).cast("long")).alias("redeemed_before"), F.max((after & redeems).cast("int")).alias("label"),
    ).where("n_before > 0")


def rank_auc(df: DataFrame, score: str, label: str = "label", ranges: int = 64) -> float | None:
    """Exact area under the curve as a rank sum: pairs of a positive above a negative, ties half; None without both labels.

    Scores are counted by value and ordered within ranges; only the ranges' totals are ordered as a whole.
    """
    y = F.col(label).cast("int")
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("v")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    cuts = df.agg(F.percentile_approx(F.col(score).cast("double"), [i / ranges for i in range(1, ranges)], 1000)).first()[0] or []
    place = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col("v"))) if cuts else F.lit(0)
    placed = counts.withColumn("at", place)
    per = placed.groupBy("at").agg(F.sum("neg").alias("n"))
    below = per.select(F.col("at").alias("p"), (F.sum("n").over(Window.orderBy("at")) - F.col("n")).alias("below"))  # at most `ranges` rows
    under = F.col("below") + F.sum("neg").over(Window.partitionBy("at").orderBy("v")) - F.col("neg")
    rows = placed.join(F.broadcast(below), F.col("at") == F.col("p")).withColumn("_won", F.col("pos") * (2 * under + F.col("neg")))
    won, pos, neg = rows.agg(F.sum(F.col("_won").cast("decimal(38,0)")), F.sum("pos"), F.sum("neg")).first()
    return float(won) / (2 * pos * neg) if pos and neg else None


def propensity(train: DataFrame, test: DataFrame, features: list[str], least_auc: float = 0.62) -> DataFrame:
    """AUC of a logistic fit and of ranking by balance, and whether the fit is good enough."""
    vec = VectorAssembler(inputCols=features, outputCol="_x")
    model = LogisticRegression(featuresCol="_x", labelCol="label", probabilityCol="_prob", tol=1e-10, maxIter=200).fit(vec.transform(train))
    scored = model.transform(vec.transform(test)).select("label", "balance", vector_to_array("_prob")[1].alias("_p"))
    rows = [("logistic", rank_auc(scored, "_p")), ("balance", rank_auc(scored, "balance"))]
    return train.sparkSession.createDataFrame(rows, "ranking string, auc double").withColumn("enough", F.col("auc") >= least_auc)


def data_checks(df: DataFrame, order: str, value: str, lagged: str, by: str) -> DataFrame:
    """Per series: rows, nulls, first and last day, moments, correlation with the lagged column, and whether it equals the previous value."""
    prev = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    rows = df.withColumn("_prev", prev)
    wrong = F.col("_prev").isNotNull() & ~F.col(lagged).eqNullSafe(F.col("_prev"))
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(value).isNull().cast("long")).alias("nulls"), F.min(order).alias("first_day"), F.max(order).alias("last_day"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.corr(value, lagged).alias("corr_lag"), F.sum(wrong.cast("long")).alias("lag_mismatch"),
    )
