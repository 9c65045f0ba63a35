"""Registered queries on table preparation and models, with their DuckDB twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import evaluate, features, ml, prices, quality, trees
from millrace.plans import tables as T

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


DEMAND_SQL = """demand AS (SELECT event_type AS store, CAST(ts AS DATE) AS date, count(*) AS demand, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS price_per_kg,
  CAST(sum(user_id) AS DOUBLE) / 10 AS competitor_price_per_kg, CAST(max(event_id) % 2 AS INTEGER) AS promo FROM events GROUP BY 1, 2)"""


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and day as demand, with money-like columns."""
    return T.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("store"), F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("demand"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("price_per_kg"),
        (F.sum("user_id").cast("double") / 10).alias("competitor_price_per_kg"), (F.max("event_id") % 2).cast("int").alias("promo"),
    )


@query("""WITH f AS (SELECT DISTINCT l_orderkey, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey END AS p, CASE WHEN l_partkey % 9 <> 0 THEN l_suppkey END AS s, CASE WHEN l_partkey % 2 = 0 THEN l_quantity END AS q FROM lineitem)
  SELECT count(*) AS n, count(p) AS p, count(s) AS s, count(q) AS q FROM f WHERE CAST(p IS NULL AS INTEGER) + CAST(s IS NULL AS INTEGER) + CAST(q IS NULL AS INTEGER) <= 2 AND (q IS NULL OR q BETWEEN 5 AND 40)""")
def row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T.read(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    rows = li.select("l_orderkey", F.when(part % 3 != 0, part).alias("p"), F.when(part % 9 != 0, F.col("l_suppkey")).alias("s"), F.when(part % 2 == 0, F.col("l_quantity")).alias("q"))
    return quality.row_filter(rows, 0.5, {"q": (5, 40)}).agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in "psq"])


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT day, sum(n) OVER (ORDER BY day DESC) AS after, sum(n) OVER () AS total FROM d),
  c AS (SELECT max(day) AS cut FROM r WHERE after >= 0.2 * total) SELECT CAST(o_orderdate AS DATE) >= cut AS is_test, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day FROM orders, c GROUP BY 1""")
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = evaluate.fraction_split(T.read(spark, sf_dir, "orders").select("o_orderdate"), "o_orderdate", 0.2)
    day = F.to_date("o_orderdate")
    return o.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query("""SELECT CASE WHEN h < 60 THEN 'train' WHEN h < 80 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM (SELECT CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS h FROM orders) GROUP BY 1""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.hash_split(T.read(spark, sf_dir, "orders"), "o_orderkey", {"train": 60, "validation": 20, "test": 20}).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, CAST(fold AS INTEGER) AS fold, count(*) AS n, min(o_orderkey) AS least FROM (SELECT *, ntile(6) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS fold FROM orders) GROUP BY 1, 2")
def forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = evaluate.forward_folds(T.read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", 5)
    return o.groupBy("o_orderstatus", "fold").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"))


@query("""WITH t AS (SELECT l_returnflag AS k, CASE WHEN l_partkey % 4 <> 0 THEN l_quantity END AS q, CASE WHEN l_partkey % 5 <> 0 THEN l_tax END AS tax FROM lineitem), u AS (SELECT k FROM t WHERE q IS NOT NULL AND tax IS NOT NULL)
  SELECT k, count(*) AS n FROM u GROUP BY 1 HAVING count(*) >= 100""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T.read(spark, sf_dir, "lineitem")
    t = li.select(F.col("l_returnflag").alias("k"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_quantity")).alias("q"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_tax")).alias("tax"))
    return evaluate.training_rows(t, ["k"], ["q"], "tax", 100).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DEMAND_SQL} SELECT store, date, CAST(month(date) AS INTEGER) AS month, round(datediff('day', (SELECT min(date) FROM demand), date) / 365.25::DOUBLE, 6) AS years, CAST(competitor_price_per_kg < price_per_kg AS INTEGER) AS competitor_cheaper FROM demand""")
def demand_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = demand(spark, sf_dir)
    return features.demand_features(d, features.first_day(d)).select("store", "date", "month", F.round("years", 6).alias("years"), "competitor_cheaper")


@query(f"""WITH {DEMAND_SQL} SELECT store, date, least(greatest(lag(price_per_kg, 3) OVER w, 0), 5000) AS stock, round(avg(promo) OVER (PARTITION BY store ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS promo_share,
  lag(demand) OVER w AS previous_demand FROM demand WINDOW w AS (PARTITION BY store ORDER BY date)""".replace("least(greatest(lag(price_per_kg, 3) OVER w, 0), 5000)", "CASE WHEN lag(price_per_kg, 3) OVER w IS NULL THEN 0 ELSE least(greatest(lag(price_per_kg, 3) OVER w, 0), 5000) END"))
def causal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = features.causal_features(demand(spark, sf_dir), "store", "date", "price_per_kg", "promo", "demand", 0.0, 5000.0)
    return d.select("store", "date", "stock", F.round("promo_share", 6).alias("promo_share"), "previous_demand")


@query(f"""WITH {DEMAND_SQL}, l AS (SELECT *, lag(demand) OVER (PARTITION BY store ORDER BY date) AS prev FROM demand), m AS (SELECT *, CASE WHEN day(date) % 10 = 0 THEN demand ELSE prev END AS claimed FROM l)
  SELECT store, count(*) AS n_rows, count(*) FILTER (demand IS NULL) AS nulls, min(date) AS first_day, max(date) AS last_day, round(avg(demand), 6) AS mean, round(stddev_samp(demand), 6) AS std, min(demand) AS min, max(demand) AS max,
  count(*) FILTER (prev IS NOT NULL AND claimed IS DISTINCT FROM prev) AS lag_mismatch FROM m GROUP BY 1""")
def data_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = demand(spark, sf_dir).withColumn("claimed", F.lag("demand").over(Window.partitionBy("store").orderBy("date")))
    d = d.withColumn("claimed", F.when(F.dayofmonth("date") % 10 == 0, F.col("demand")).otherwise(F.col("claimed")))
    out = ml.data_checks(d, "date", "demand", "claimed", "store")
    return out.select("store", F.col("rows").alias("n_rows"), "nulls", "first_day", "last_day", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", "lag_mismatch")


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS size, CASE WHEN p_partkey % 6 <> 0 THEN p_type END AS kind FROM part), k AS (SELECT kind FROM t WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, kind LIMIT 1)
  SELECT p_partkey, coalesce(CAST(size AS DOUBLE), (SELECT median(size) FROM t)) AS size, coalesce(kind, (SELECT kind FROM k)) AS kind FROM t""")
def imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("double")).alias("size"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_type")).alias("kind"))
    return ml.impute(t, ml.fit_fill(t, ["size"], ["kind"]))


@query("""SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer""")
def standard_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.scale(T.read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("""SELECT c_custkey, CAST(c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS seg_AUTOMOBILE, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS seg_BUILDING, CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS seg_FURNITURE FROM customer""")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    return ml.one_hot(c.where("seg <= 'FURNITURE'"), c, "seg").drop("seg")


def _orders_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T.read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double").alias("line"), "l_extendedprice", "l_shipdate")


PARTS = ["l_quantity", "l_extendedprice", "net", "gross"]
PARTS_SQL = "priced AS (SELECT *, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 + l_tax) AS gross FROM lineitem)"


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return T.read(spark, sf_dir, "lineitem").withColumns({"net": price * (1 - F.col("l_discount")), "gross": price * (1 + F.col("l_tax"))})


def _leading_sql(rounds: int = 200) -> str:
    """Power steps on the correlations of PARTS: the tables m (moments) and lead (loadings and share of the leading component)."""
    k = range(len(PARTS))
    r = lambda i, j: "1.0::DOUBLE" if i == j else f"r{min(i, j)}{max(i, j)}"
    moments = [f"corr({PARTS[i]}, {PARTS[j]}) AS r{i}{j}" for i in k for j in k if i < j] + [f"avg({c}) AS a{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(PARTS)]
    times = [" + ".join(f"{r(i, j)} * b{j}" for j in k) for i in k]
    norm = f"sqrt({' + '.join(f'({t}) * ({t})' for t in times)})"
    large = f"greatest({', '.join(f'abs(b{i})' for i in k)})"
    sign = "CASE " + " ".join(f"WHEN abs(b{i}) = {large} THEN sign(b{i})" for i in k) + " END"
    return f"""WITH RECURSIVE {PARTS_SQL}, m AS MATERIALIZED (SELECT {', '.join(moments)} FROM priced),
  b AS (SELECT 0 AS t, {', '.join(f'1.0::DOUBLE + {i} AS b{i}' for i in k)} UNION ALL SELECT t + 1, {', '.join(f'({t}) / {norm} AS b{i}' for i, t in enumerate(times))} FROM b, m WHERE t < {rounds}),
  lead AS MATERIALIZED (SELECT {', '.join(f'b{i} * {sign} AS c{i}' for i in k)}, {norm} / {len(PARTS)} AS share FROM b, m WHERE t = {rounds})"""


@query(f"{_leading_sql()} SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS line, round({' + '.join(f'({c} - a{i}) / s{i} * c{i}' for i, c in enumerate(PARTS))}, 4) AS pc1 FROM priced, m, lead")
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every row on the leading component."""
    out, _, _ = ml.principal_parts(_priced(spark, sf_dir), PARTS)
    return out.select("l_orderkey", F.col("l_linenumber").cast("double").alias("line"), F.round("pc1", 4).alias("pc1"))


@query(f"{_leading_sql()} {' UNION ALL '.join(f"SELECT '{c}' AS feature, round(c{i}, 5) AS loading, round(share, 6) AS share FROM lead" for i, c in enumerate(PARTS))}")
def leading_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, shares, loadings = ml.principal_parts(_priced(spark, sf_dir), PARTS)
    return spark.createDataFrame([(c, float(x), shares[0]) for c, x in zip(PARTS, loadings[:, 0], strict=True)], "feature string, loading double, share double").select(
        "feature", F.round("loading", 5).alias("loading"), F.round("share", 6).alias("share")
    )


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS coefficient, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders_table(spark, sf_dir)
    out, model = ml.fit_predict(rows, rows, ["l_quantity"], "l_extendedprice", solver="normal")
    m = evaluate.regression_metrics(out.withColumn("all", F.lit(1)), "l_extendedprice", "prediction", ["all"])
    return m.select(F.lit(round(float(model.coefficients[0]), 3)).alias("coefficient"), F.lit(round(float(model.intercept), 1)).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("""SELECT l_returnflag, n, round(b, 3) AS slope, round(a, 1) AS intercept FROM (SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY 1)""")
def regression_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ml.linear_per_key(T.read(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity"], "l_extendedprice", 0.0)
    return w.select("l_returnflag", "n", F.round(F.col("weights")[1], 3).alias("slope"), F.round(F.col("weights")[0], 1).alias("intercept"))


RIDGE = ["l_quantity", "l_discount", "l_tax", "line"]


def _ridge_sql(penalty: float = 0.1, rounds: int = 60) -> str:
    """The normal equations of standardised columns, (R + penalty / deviation of the target) b = r, solved by Jacobi steps."""
    k = range(len(RIDGE))
    pairs = [f"corr(x{i}, x{j}) AS r{i}{j}" for i in k for j in k if i < j]
    single = [f"corr(x{i}, y) AS y{i}, stddev_pop(x{i}) AS s{i}" for i in k]
    step = [f"(y{i} - ({' + '.join(f'r{min(i, j)}{max(i, j)} * b{j}' for j in k if j != i)})) / (1 + pen) AS b{i}" for i in k]
    out = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(b{i} * sy / s{i}, 3) AS coefficient FROM b, m WHERE t = {rounds}" for i, c in enumerate(RIDGE))
    return f"""WITH RECURSIVE x AS (SELECT l_quantity AS x0, l_discount AS x1, l_tax AS x2, CAST(l_linenumber AS DOUBLE) AS x3, l_extendedprice AS y FROM lineitem),
  m AS MATERIALIZED (SELECT {', '.join(pairs + single)}, stddev_pop(y) AS sy, {penalty}::DOUBLE / stddev_pop(y) AS pen FROM x),
  b AS (SELECT 0 AS t, {', '.join(f'0.0::DOUBLE AS b{i}' for i in k)} UNION ALL SELECT t + 1, {', '.join(step)} FROM b, m WHERE t < {rounds}) {out}"""


@query(_ridge_sql())
def ridge_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders_table(spark, sf_dir)
    _, model = ml.fit_predict(rows, rows, RIDGE, "l_extendedprice", "ridge")
    return evaluate.by_absolute(ml.coefficients(spark, model, RIDGE)).withColumn("coefficient", F.round("coefficient", 3))


@query()
def forest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.fraction_split(_orders_table(spark, sf_dir), "l_shipdate", 0.2)
    cols = ["l_quantity", "l_discount", "l_tax"]
    out, _ = ml.fit_predict(rows.where("not is_test"), rows, cols, "l_extendedprice", "forest", numTrees=10, maxDepth=4)
    m = evaluate.regression_metrics(out, "l_extendedprice", "prediction", ["is_test"])
    r2 = m.groupBy().agg(F.max(F.when(~F.col("is_test"), F.col("r2"))).alias("r2_train"), F.max(F.when(F.col("is_test"), F.col("r2"))).alias("r2_test"))
    return r2.withColumn("label", evaluate.overfit_label(F.col("r2_train"), F.col("r2_test")))


def _search_sql(rows: str, pairs: str, penalties: list[float]) -> str:
    """Ridge on two features in closed form for every penalty and fold, scored row by row.  rows: the table x (x1, x2, y, fold); pairs: how to learn for fold f."""
    given = ", ".join(f"({i}, {p!r}::DOUBLE)" for i, p in enumerate(penalties))
    return f"""{rows}, p AS (SELECT * FROM (VALUES {given}) v(setting, penalty)), folds AS (SELECT DISTINCT fold AS f FROM x),
  st AS (SELECT f, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM folds JOIN x ON {pairs} GROUP BY f),
  w AS (SELECT setting, penalty, f, m1, m2, my, ((1 + penalty) * c1 / s1 - c12 / s1 / s2 * c2 / s2) / ((1 + penalty) * (1 + penalty) - pow(c12 / s1 / s2, 2)) / s1 AS b1,
    ((1 + penalty) * c2 / s2 - c12 / s1 / s2 * c1 / s1) / ((1 + penalty) * (1 + penalty) - pow(c12 / s1 / s2, 2)) / s2 AS b2 FROM st, p),
  e AS (SELECT setting, penalty, f, 1 - sum(pow(y - my - b1 * (x1 - m1) - b2 * (x2 - m2), 2)) / (var_pop(y) * count(*)) AS r2 FROM w JOIN x ON fold = f GROUP BY ALL)
  SELECT setting, penalty, round(avg(r2), 5) AS mean, round(stddev_pop(r2), 5) AS std FROM e GROUP BY ALL"""


def _summary(scores: DataFrame) -> DataFrame:
    out = evaluate.cross_validation_summary(scores, "r2", ["setting", "penalty"])
    return out.select("setting", "penalty", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


GRID, DRAWN = [0.001, 0.01, 0.1, 1.0], ml.random_penalties(7, 6)


@query(_search_sql(f"WITH {DEMAND_SQL}, x AS (SELECT price_per_kg AS x1, competitor_price_per_kg AS x2, CAST(demand AS DOUBLE) AS y, ntile(4) OVER (PARTITION BY store ORDER BY date) AS fold FROM demand)", "fold < f", GRID))
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every penalty on time-ordered folds, each learned from the folds before it."""
    rows = evaluate.forward_folds(demand(spark, sf_dir), "store", "date", 3)
    return _summary(ml.fold_search(rows, ["price_per_kg", "competitor_price_per_kg"], "demand", GRID))


FOLD_SQL = "WITH x AS (SELECT l_quantity AS x1, l_discount AS x2, l_extendedprice AS y, CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS fold FROM lineitem)"


@query(_search_sql(FOLD_SQL, "fold <> f", DRAWN))
def random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties drawn by a seed on five folds, the lines of an order in one fold."""
    rows = evaluate.hash_folds(T.read(spark, sf_dir, "lineitem"), "l_orderkey", 5)
    return _summary(ml.fold_search(rows, ["l_quantity", "l_discount"], "l_extendedprice", DRAWN, "kfold"))


TREE = {"keys": ["l_suppkey"], "features": ["l_quantity", "l_discount"], "bins": 8, "depth": 3, "least": 20}


def _trees_sql() -> str:
    """The same splits level by level; ends with the table trees (node, n, value, f, b, gain)."""
    fs, bins = list(enumerate(TREE["features"])), TREE["bins"]
    edges = ", ".join(f"(SELECT list_transform(range(1, {bins}), lambda i: a + (z - a) * i / {bins}) FROM (SELECT min({c}) AS a, max({c}) AS z FROM lineitem)) AS e{i}" for i, c in fs)
    ctes = [
        f"ed AS MATERIALIZED (SELECT {edges})",
        f"c0 AS MATERIALIZED (SELECT l_suppkey AS k, {', '.join(f'len(list_filter(e{i}, lambda e: e < {c})) AS b{i}' for i, c in fs)}, 1 AS node, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS s FROM lineitem, ed GROUP BY ALL)",
    ]
    for level in range(TREE["depth"] + 1):
        c = f"c{level}"
        whole = f"SELECT k, node, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS DOUBLE) / CAST(sum(n) AS BIGINT) AS value FROM {c} GROUP BY 1, 2"
        if level == TREE["depth"]:
            ctes.append(f"t{level} AS (SELECT *, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS gain FROM ({whole}))")
            break
        listed = " UNION ALL ".join(f"SELECT k, node, {i} AS f, b{i} AS b, sum(n) AS n, sum(s) AS s FROM {c} GROUP BY 1, 2, b{i}" for i, _ in fs)
        ctes += [
            f"h{level} AS (SELECT k, node, f, b, CAST(sum(n) OVER u AS BIGINT) AS nl, sum(s) OVER u AS sl, CAST(sum(n) OVER a AS BIGINT) AS n, sum(s) OVER a AS s FROM ({listed}) WINDOW u AS (PARTITION BY k, node, f ORDER BY b), a AS (PARTITION BY k, node, f))",
            f"g{level} AS (SELECT *, round(CAST(sl AS DOUBLE) * CAST(sl AS DOUBLE) / nl + CAST(s - sl AS DOUBLE) * CAST(s - sl AS DOUBLE) / (n - nl) - CAST(s AS DOUBLE) * CAST(s AS DOUBLE) / n, 3) AS gain FROM h{level} WHERE nl >= {TREE['least']} AND n - nl >= {TREE['least']})",
            f"s{level} AS MATERIALIZED (SELECT * FROM g{level} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY k, node ORDER BY gain DESC, f, b) = 1)",
            f"t{level} AS (SELECT w.*, s.f, s.b, s.gain FROM ({whole}) w LEFT JOIN s{level} s USING (k, node))",
            f"c{level + 1} AS MATERIALIZED (SELECT {c}.* REPLACE (2 * node + CAST(CASE s.f {' '.join(f'WHEN {i} THEN b{i}' for i, _ in fs)} END > s.b AS INTEGER) AS node) FROM {c} JOIN s{level} s USING (k, node))",
        ]
    return f"WITH {', '.join(ctes)}, trees AS ({' UNION ALL '.join(f'SELECT * FROM t{level}' for level in range(TREE['depth'] + 1))})"


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = T.read(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice").cast("decimal(18,2)"))
    edges = trees.even_edges(li, TREE["features"], TREE["bins"])
    return li, trees.grow_trees(li, TREE["keys"], edges, "price", TREE["depth"], TREE["least"])


@query(f"{_trees_sql()} SELECT k AS l_suppkey, node, n, round(value, 9) AS value, CASE f {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(TREE['features']))} END AS feature, round(CASE f {' '.join(f'WHEN {i} THEN e{i}[b + 1]' for i in range(len(TREE['features'])))} END, 9) AS threshold, gain FROM trees, ed")
def trees_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regression tree of every supplier's prices."""
    grown = _trees(spark, sf_dir)[1]
    return grown.select("l_suppkey", "node", "n", F.round("value", 9).alias("value"), "feature", F.round("threshold", 9).alias("threshold"), "gain")


_STEP = "CASE WHEN t.f IS NULL THEN r.node ELSE 2 * r.node + CAST(CASE t.f {0} END > t.b AS INTEGER) END".format(" ".join(f"WHEN {i} THEN r.b{i}" for i in range(len(TREE["features"]))))


def _walk_sql() -> str:
    start = f"r0 AS (SELECT l_suppkey AS k, l_extendedprice AS y, 1 AS node, {', '.join(f'len(list_filter(e{i}, lambda e: e < {c})) AS b{i}' for i, c in enumerate(TREE['features']))} FROM lineitem, ed)"
    steps = [f"r{d + 1} AS (SELECT r.* REPLACE ({_STEP} AS node) FROM r{d} r JOIN trees t ON t.k = r.k AND t.node = r.node)" for d in range(TREE["depth"])]
    return f"{_trees_sql()}, {', '.join([start, *steps])}"


@query(f"{_walk_sql()} SELECT r.k AS l_suppkey, count(*) AS n, round(avg(abs(value - y)), 3) AS mae, round(1 - sum(pow(value - y, 2)) / (var_pop(y) * count(*)), 5) AS r2 FROM r{TREE['depth']} r JOIN trees t ON t.k = r.k AND t.node = r.node GROUP BY 1")
def tree_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, grown = _trees(spark, sf_dir)
    out = trees.predict_trees(li, grown, TREE["keys"], TREE["features"], TREE["depth"])
    m = evaluate.regression_metrics(out, "l_extendedprice", "forecast", ["l_suppkey"])
    return m.select("l_suppkey", "n", F.round("mae", 3).alias("mae"), F.round("r2", 5).alias("r2"))


ROBUST_SQL = """WITH c AS (SELECT o_orderpriority, count(*) AS n, median(o_totalprice) AS median FROM orders GROUP BY 1), d AS (SELECT o_orderpriority, median(abs(o_totalprice - c.median)) AS mad FROM orders JOIN c USING (o_orderpriority) GROUP BY 1)"""


@query(f"{ROBUST_SQL} SELECT o_orderpriority, n, round(median, 6) AS median, round(mad, 6) AS mad FROM c JOIN d USING (o_orderpriority)")
def robust_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ml.robust_scale(T.read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderpriority", "n", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query(f"{ROBUST_SQL} SELECT o_orderkey, round(0.6745::DOUBLE * (o_totalprice - median) / mad, 6) AS robust_score FROM orders JOIN c USING (o_orderpriority) JOIN d USING (o_orderpriority) ORDER BY robust_score DESC, o_orderkey LIMIT 50")
def robust_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty orders furthest above their category's median, to be reviewed."""
    o = T.read(spark, sf_dir, "orders")
    scored = ml.robust_scores(o, ["o_orderpriority"], "o_totalprice", ml.robust_scale(o, ["o_orderpriority"], "o_totalprice")).withColumn("robust_score", F.round("robust_score", 6))
    return ml.review_queue(scored, "robust_score", 50, "o_orderkey").select("o_orderkey", "robust_score")


@query("""WITH e AS (SELECT o_orderkey, o_totalprice * 7.7::DOUBLE AS a, CAST(floor(o_totalprice * CASE WHEN o_orderkey % 13 = 0 THEN 5 ELSE 1 END) AS BIGINT) AS p FROM orders)
  SELECT o_orderkey, round(p / a, 6) AS ratio FROM e WHERE p / a > 0.2 ORDER BY ratio DESC, o_orderkey LIMIT 50""")
def anomaly_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.read(spark, sf_dir, "orders")
    tx = o.select("o_orderkey", (F.col("o_totalprice") * 7.7).alias("amount_gtq"), F.floor(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 13 == 0, 5).otherwise(1)).cast("long").alias("points"))
    held = ml.accrual_anomalies(tx).where("held").withColumn("ratio", F.round("ratio", 6))
    return ml.review_queue(held, "ratio", 50, "o_orderkey").select("o_orderkey", "ratio")


PROPENSITY_SQL = """SELECT user_id, sum(CASE WHEN ts < TIMESTAMP '2024-01-03' THEN 1 ELSE 0 END) AS n_before, max(CASE WHEN ts >= TIMESTAMP '2024-01-03' AND event_type = 'purchase' THEN 1 ELSE 0 END) AS label FROM events GROUP BY 1"""


@query(f"SELECT user_id, CAST(n_before AS BIGINT) AS n_before, label FROM ({PROPENSITY_SQL}) WHERE n_before > 0")
def redemption_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ml.redemption_features(e, "user_id", "ts", "value", F.col("event_type") == "purchase", "2024-01-03").select("user_id", "n_before", "label")


AUC_SQL = """WITH f AS (SELECT user_id, coalesce(sum(value) FILTER (ts < TIMESTAMP '2024-01-10'), 0) AS balance, max(CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13' AND value > 150 THEN 1 ELSE 0 END) AS label,
  count(*) FILTER (ts < TIMESTAMP '2024-01-10') AS n_before FROM events GROUP BY 1),
  t AS (SELECT round(balance, 4) AS balance, label FROM f WHERE n_before > 0 AND CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 >= 70),
  r AS (SELECT label, (rank() OVER (ORDER BY balance) + rank() OVER (ORDER BY balance) + count(*) OVER (PARTITION BY balance) - 1) / 2.0::DOUBLE AS rank FROM t), k AS (SELECT sum(label) AS p, count(*) - sum(label) AS q FROM t)
  SELECT 'balance' AS ranking, round((sum(rank) FILTER (label = 1) - any_value(p) * (any_value(p) + 1) / 2.0::DOUBLE) / nullif(any_value(p) * any_value(q), 0), 6) AS auc FROM r, k"""


def _propensity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = ml.redemption_features(e, "user_id", "ts", "value", F.col("value") > 150, "2024-01-10", 3).withColumn("balance", F.round("balance", 4))
    return evaluate.hash_split(rows, "user_id", {"train": 70, "test": 30})


@query(AUC_SQL)
def balance_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the balance alone ranks who redeems, on the test split."""
    found = ml.rank_auc(_propensity_rows(spark, sf_dir).where("split = 'test'"), "balance")
    return spark.createDataFrame([("balance", found)], "ranking string, auc double").withColumn("auc", F.round("auc", 6))


@query()
def redemption_propensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _propensity_rows(spark, sf_dir)
    return ml.propensity(split.where("split = 'train'"), split.where("split = 'test'"), ["balance", "n_before", "n_recent", "redeemed_before"])


@query("""WITH r AS (SELECT user_id % 50 AS model, event_type AS horizon, event_id AS trained_at, value AS mae FROM events) SELECT model, horizon, max(trained_at) AS trained_at, arg_max(mae, trained_at) AS mae FROM r GROUP BY 1, 2""")
def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("model"), F.col("event_type").alias("horizon"), F.col("event_id").alias("trained_at"), F.col("value").alias("mae"))
    return prices.upsert(e.where("trained_at % 2 = 0"), e.where("trained_at % 2 = 1"), ["model", "horizon"], ["trained_at"])
