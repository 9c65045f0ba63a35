"""Registered queries on the points program, with their DuckDB twins."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import accrual, audit, ledger, merchants, quality
from millrace.plans import tables as T
from millrace.sources.stored import store

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH {T.RAW_SQL} {sql}" if not sql.lstrip().startswith("WITH") else sql)
        return f

    return keep


@query("SELECT category, CAST(sum(points) AS BIGINT) AS earned, CAST(sum(credited) AS BIGINT) AS credited, CAST(sum(points - credited) AS BIGINT) AS clipped FROM credited GROUP BY 1")
def credited_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = T.credited(spark, sf_dir)
    return tx.groupBy("category").agg(F.sum("points").alias("earned"), F.sum("credited").alias("credited"), F.sum(F.col("points") - F.col("credited")).alias("clipped"))


def _bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as untyped text: thousands separators, and unreadable amounts in every 97th."""
    o = T.read(spark, sf_dir, "orders")
    money = F.format_number("o_totalprice", 2)
    return o.select(
        F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 97 == 0, "n/a").otherwise(money).alias("monto"),
        F.when(F.col("o_orderkey") % 89 == 0, "someday").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("fecha"),
        F.when(F.col("o_custkey") % 2 == 0, "True").otherwise("False").alias("miembro"), F.col("o_orderpriority").alias("prioridad"),
    )


@query("""WITH b AS (SELECT CASE WHEN o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 THEN 'no_tipable' WHEN o_orderpriority = '2-HIGH' THEN 'excluido' WHEN o_custkey % 2 = 1 THEN 'tarjeta_no_acumula' END AS motivo,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount FROM orders)
  SELECT coalesce(motivo, '') AS reason, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM b GROUP BY 1""")
def typed_discards(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bronze(spark, sf_dir)
    typed = b.withColumns({"amount": scalars.to_amount(F.col("monto")), "on": scalars.to_ts(F.col("fecha")), "member": scalars.to_bool(F.col("miembro"))})
    rules = [("no_tipable", F.col("amount").isNull() | F.col("on").isNull()), ("excluido", F.col("prioridad") == "2-HIGH"), ("tarjeta_no_acumula", ~F.col("member"))]
    return quality.with_reason(typed, rules).groupBy(F.coalesce("motivo", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))


@query("SELECT n = 1 AS kept, currency, count(*) AS n_rows FROM numbered GROUP BY 1, 2")
def retry_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dupes = quality.dedupe_first(T.raw_transactions(spark, sf_dir), ["auth_code"], ["ts", "copy"])
    both = kept.select("currency", F.lit(True).alias("kept")).unionByName(dupes.select("currency", F.lit(False).alias("kept")))
    return both.groupBy("kept", "currency").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT k.auth_code IS NOT NULL AS kept, d.kind, count(*) AS n_rows FROM deduped d LEFT JOIN kept k USING (auth_code) GROUP BY 1, 2")
def reversal_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped, _ = quality.dedupe_first(T.raw_transactions(spark, sf_dir), ["auth_code"], ["ts", "copy"])
    kept, gone = quality.cancel_reversals(deduped, "auth_code", "auth_ref", F.col("kind") == "reversa")
    both = kept.select("kind", F.lit(True).alias("kept")).unionByName(gone.select("kind", F.lit(False).alias("kept")))
    return both.groupBy("kept", "kind").agg(F.count(F.lit(1)).alias("n_rows"))


@query("""SELECT coalesce(motivo, '') AS reason, count(*) AS n FROM (SELECT 'duplicado' AS motivo FROM numbered WHERE n > 1
  UNION ALL SELECT 'reversa' FROM deduped d ANTI JOIN kept k USING (auth_code) UNION ALL SELECT 'excluido' FROM categorized WHERE category = 'excluida'
  UNION ALL SELECT 'excede_tope' FROM credited WHERE points > credited) GROUP BY 1""")
def discards_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped, dupes = quality.dedupe_first(T.raw_transactions(spark, sf_dir), ["auth_code"], ["ts", "copy"])
    _, gone = quality.cancel_reversals(deduped, "auth_code", "auth_ref", F.col("kind") == "reversa")
    excluded = T.clean_transactions(spark, sf_dir).where("category = 'excluida'").withColumn("motivo", F.lit("excluido"))
    return quality.reason_summary(quality.union_discards(dupes, gone, excluded, accrual.cap_excess(T.credited(spark, sf_dir))))


@query("SELECT descr_norm, catalog_mcc FROM catalog")
def merchant_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merchants.build_catalog(T.clean_transactions(spark, sf_dir).select("descr", "mcc", "ts", "auth_code"))


@query("SELECT mcc_source, category, count(*) AS n, round(sum(amount_gtq), 0) AS spend FROM converted GROUP BY 1, 2")
def merchant_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.clean_transactions(spark, sf_dir).groupBy("mcc_source", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount_gtq"), 0).alias("spend"))


@query("""SELECT descr_norm, count(*) AS n FROM (SELECT trim(regexp_replace(upper(o_orderpriority || CAST(o_custkey % 50 AS VARCHAR)), '\\s+', ' ', 'g')) AS descr_norm,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_custkey % 50 < 30 THEN '' ELSE 'x' END AS mcc FROM orders) WHERE mcc = '' GROUP BY 1""")
def unresolved_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.read(spark, sf_dir, "orders")
    tx = o.select(
        F.concat("o_orderpriority", (F.col("o_custkey") % 50).cast("string")).alias("descr"), F.when((F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_custkey") % 50 < 30), "").otherwise("x").alias("mcc"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("auth_code"),
    )
    return merchants.unresolved_worklist(tx, merchants.build_catalog(tx))


_LIKE_NAMES = "upper(p_name || ' ' || p_brand || ' ' || p_type || ' S' || CAST(p_size % 5 AS VARCHAR))"


@query(f"""WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name || ' ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' SHOP' ELSE ' ' || p_type END) ELSE {_LIKE_NAMES} END AS name FROM part),
  u AS (SELECT DISTINCT name, list_distinct(string_split(name, ' ')) AS w FROM d WHERE p_partkey % 3 = 0), k AS (SELECT DISTINCT name AS match, list_distinct(string_split(name, ' ')) AS v, md5(name)[1:4] AS mcc FROM d WHERE p_partkey % 3 <> 0),
  s AS (SELECT name, match, mcc, len(list_intersect(w, v)) / CAST(len(w) + len(v) - len(list_intersect(w, v)) AS DOUBLE) AS score FROM u, k)
  SELECT name AS descr_norm, mcc, round(score, 6) AS confidence, match, CASE WHEN score >= 0.6::DOUBLE - 1e-9 THEN 'merged' ELSE 'review' END AS status FROM s WHERE score >= 0.5::DOUBLE - 1e-9 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, match) = 1""")
def look_alikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes proposed for descriptions that the catalogue does not have, from its most similar entry; unsure ones go to review."""
    p = T.read(spark, sf_dir, "part")
    full = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.concat(F.lit("S"), (F.col("p_size") % 5).cast("string")))
    short = F.concat_ws(" ", "p_name", "p_brand", F.when(F.col("p_partkey") % 2 == 0, "SHOP").otherwise(F.col("p_type")))
    named = p.select("p_partkey", F.upper(F.when(F.col("p_partkey") % 3 == 0, short).otherwise(full)).alias("descr_norm"))
    catalog = named.where("p_partkey % 3 <> 0").select("descr_norm", F.substring(F.md5("descr_norm"), 1, 4).alias("catalog_mcc")).distinct()
    answers = merchants.propose_codes(named.where("p_partkey % 3 = 0").select("descr_norm"), catalog)
    _, review = merchants.merge_answers(catalog, answers, 0.6 - 1e-9)
    unsure = review.select("descr_norm", F.lit("review").alias("status"))
    return answers.join(unsure, "descr_norm", "left").select("descr_norm", "mcc", F.round("confidence", 6).alias("confidence"), "match", F.coalesce("status", F.lit("merged")).alias("status"))


@query("SELECT auth_code, points, credited FROM credited")
def annual_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.credited(spark, sf_dir).select("auth_code", "points", "credited")


@query("SELECT campaign_id, auth_code, CAST(extra AS BIGINT) AS extra, extra_credited FROM campaigned")
def campaign_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.campaigned(spark, sf_dir, T.credited(spark, sf_dir)).select("campaign_id", "auth_code", "extra", "extra_credited")


NESTED = [("daily", lambda: F.to_date("ts"), 60000), ("monthly", lambda: F.trunc("ts", "MM"), 150000), ("annual", lambda: F.year("ts"), 700000)]


def _nested_sql(tail: str) -> str:
    """Each cap on what the one before it let through, row by row: the tables in0 (earned points), in1, in2, in3."""
    ctes, periods = ["in0 AS (SELECT *, points AS x0 FROM earned)"], ["CAST(ts AS DATE)", "date_trunc('month', ts)", "year(ts)"]
    for i, ((_, _, cap), period) in enumerate(zip(NESTED, periods, strict=True)):
        earlier = f"coalesce(sum(x{i}) OVER (PARTITION BY group_id, {period} ORDER BY ts, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        ctes.append(f"in{i + 1} AS (SELECT *, least(x{i}, greatest({cap} - {earlier}, 0)) AS x{i + 1} FROM in{i})")
    return f"WITH {T.RAW_SQL}, {', '.join(ctes)} {tail}"


def _nested_caps() -> list:
    return [(name, period(), F.lit(cap)) for name, period, cap in NESTED]


@query(_nested_sql("SELECT auth_code, CAST(x3 AS BIGINT) AS credited FROM in3"))
def nested_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accrual.apply_caps(T.earned_once(spark, sf_dir), ["group_id"], _nested_caps(), "points", ["ts", "key"]).select("auth_code", "credited")


@query(_nested_sql(" UNION ALL ".join(
    f"SELECT group_id, '{name}' AS cap, CAST({period} AS VARCHAR) AS period, CAST(sum(x{i}) AS BIGINT) AS used, CAST({cap} - sum(x{i}) AS BIGINT) AS room FROM in3 GROUP BY group_id, {period}"
    for i, ((name, _, cap), period) in enumerate(zip(NESTED, ["CAST(ts AS DATE)", "CAST(date_trunc('month', ts) AS DATE)", "year(ts)"], strict=True), 1)
)))
def cap_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accrual.cap_room(T.earned_once(spark, sf_dir), ["group_id"], _nested_caps(), "points", ["ts", "key"])


@query("""SELECT factor, count(*) AS n FROM (SELECT greatest(1, CASE WHEN CAST(ts AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND amount_gtq >= 100000 AND isodow(ts) = 5 THEN 2 ELSE 1 END,
  CASE WHEN CAST(ts AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND amount_gtq >= 50000 AND category = 'reducida' AND is_member THEN 3 ELSE 1 END,
  CASE WHEN CAST(ts AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND amount_gtq >= 80000 AND uses_mobile THEN 4 ELSE 1 END) AS factor FROM tx) GROUP BY 1""")
def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        {"starts": "1998-01-01", "ends": "1998-12-31", "min_ticket": 100000, "weekday": 4, "factor": 2},
        {"starts": "1997-01-01", "ends": "1999-12-31", "min_ticket": 50000, "category": "reducida", "members_only": True, "factor": 3},
        {"starts": "1996-01-01", "ends": "1998-12-31", "min_ticket": 80000, "mobile_only": True, "factor": 4},
    ]
    return accrual.promotion_factor(T.earned(spark, sf_dir), rules).groupBy("factor").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS key, (SELECT arg_max(v.state, v.valid_from) FROM (SELECT o_custkey, o_orderdate AS valid_from, arg_min(o_orderstatus, o_orderkey) AS state FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2) v
  WHERE v.o_custkey = o.o_custkey AND v.valid_from <= o.o_orderdate) AS state FROM orders o WHERE o_orderkey % 3 <> 0""")
def eligibility_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the orders are versions of their client's state, all others are purchases."""
    o = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("client_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("state"))
    versions = o.where("key % 3 = 0").groupBy("client_id", F.col("ts").alias("valid_from")).agg(F.min_by("state", "key").alias("state"))
    return accrual.eligibility_as_of(o.where("key % 3 <> 0").drop("state"), versions).select("key", "state")


@query("SELECT key, credited_on FROM dated")
def credit_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.credited(spark, sf_dir).select("key", accrual.credit_date(F.col("ts"), (2 + F.col("key") % 2).cast("int")).alias("credited_on"))


@query("SELECT origin, CAST(sum(points) AS BIGINT) AS points, count(DISTINCT group_id) AS groups, count(*) AS accruals FROM accruals WHERE points > 0 GROUP BY 1")
def accruals_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.rederivable_by_origin(T.accruals(spark, sf_dir))


@query("SELECT sha256(CAST(group_id AS VARCHAR) || '#' || CAST(period AS VARCHAR) || '#' || origin) AS lot_id, group_id, period, origin, points, available_from, expires_on FROM lots2")
def point_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lots(spark, sf_dir).select("lot_id", "group_id", "period", "origin", "points", "available_from", "expires_on")


@query(f"SELECT origin, CAST(sum(points) AS BIGINT) AS points, count(*) AS lots FROM lots2 WHERE available_from > DATE '{T.AS_OF}' GROUP BY 1")
def lots_in_transit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.in_transit(T.lots(spark, sf_dir), F.lit(T.AS_OF).cast("date"))


def _cuts(until: str = "2004-12-31") -> list:
    return [d for y in range(1996, 2005) if (d := datetime.date(y, 2, 5)) <= datetime.date.fromisoformat(until)]


def _ledger(spark: SparkSession, sf_dir: str, order: str = "fifo") -> tuple[DataFrame, DataFrame, DataFrame]:
    return ledger.run_ledger(T.lots(spark, sf_dir), T.requests(spark, sf_dir), T.groups(spark, sf_dir), _cuts(), order)


def ledger_query(sql: str, until: str | None = None, order: str = "fifo"):
    return query(f"WITH {T.RAW_SQL}, {T.ledger_sql(until, order)} {sql}")


@query(f"""SELECT CAST(group_id AS VARCHAR) AS group_id, CAST(sum(CASE WHEN expires_on >= DATE '2004-02-06' OR available_from > make_date(year(expires_on), 2, 5) THEN points ELSE 0 END) AS BIGINT) AS held,
  CAST(sum(points) AS BIGINT) AS issued, CAST(sum(CASE WHEN expires_on < DATE '2004-02-06' AND available_from <= expires_on THEN points ELSE 0 END) AS BIGINT) AS expired FROM lots2 GROUP BY 1""")
def ledger_without_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves, _, left = ledger.run_ledger(T.lots(spark, sf_dir), T.requests(spark, sf_dir).where("false"), T.groups(spark, sf_dir), _cuts())
    held = left.groupBy(F.col("group_id").cast("string").alias("group_id")).agg(F.sum("remaining").alias("held"))
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("type") == kind, F.abs("points"))), F.lit(0))
    return held.join(moves.groupBy("group_id").agg(part("acumulacion").alias("issued"), part("expiracion").alias("expired")), "group_id")


@ledger_query("SELECT * FROM moves")
def ledger_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir)[0]


@ledger_query(f"SELECT * FROM moves WHERE date > DATE '{T.AS_OF}'")
def ledger_from_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens after the reporting day, folded onto the books of that day; only later lots, cuts and requests are read."""
    lots, asked, groups, day = T.lots(spark, sf_dir), T.requests(spark, sf_dir), T.groups(spark, sf_dir), F.lit(T.AS_OF).cast("date")
    early = [c for c in _cuts() if c.isoformat() <= T.AS_OF]
    _, _, books = ledger.advance_ledger(None, lots.where(F.col("available_from") <= day), asked.where(F.col("date") <= day), groups, early)
    late = [c for c in _cuts() if c.isoformat() > T.AS_OF]
    return ledger.advance_ledger(store(books, "books"), lots.where(F.col("available_from") > day), asked.where(F.col("date") > day), groups, late)[0]


@ledger_query("SELECT result, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM steps WHERE kind = 2 GROUP BY 1", order="lifo")
def redemption_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, asked, _ = _ledger(spark, sf_dir, "lifo")
    return asked.groupBy("result").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"))


@ledger_query("""SELECT type, a.center, a.prize, CAST(-sum(m.points) AS BIGINT) AS points, round(100 * CAST(-sum(m.points) AS DOUBLE) / (SELECT sum(points) FROM moves WHERE type = 'acumulacion'), 4) AS pct_of_issued
  FROM moves m LEFT JOIN asked a USING (request_id) WHERE type <> 'acumulacion' GROUP BY 1, 2, 3""")
def point_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.point_outcomes(_ledger(spark, sf_dir)[0], T.requests(spark, sf_dir))


@ledger_query("SELECT CAST(h.group_id AS VARCHAR) AS group_id, CAST(h.n AS BIGINT) AS held, CAST(m.n AS BIGINT) AS moved FROM (SELECT group_id, sum(remaining) AS n FROM held GROUP BY 1) h JOIN (SELECT group_id, sum(points) AS n FROM moves GROUP BY 1) m ON m.group_id = CAST(h.group_id AS VARCHAR) WHERE h.n <> m.n")
def check_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No rows: every family's lots add up to its movements."""
    moves, _, left = _ledger(spark, sf_dir)
    return ledger.check_ledger(left, moves)


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots with what the ledger leaves of them on the reporting day."""
    asked = T.requests(spark, sf_dir).where(F.col("date") <= F.lit(T.AS_OF).cast("date"))
    return ledger.run_ledger(T.lots(spark, sf_dir), asked, T.groups(spark, sf_dir), _cuts(T.AS_OF))[2]


def _held_query(sql: str):
    return ledger_query(sql, T.AS_OF)


FREE = "(merged_since IS NULL OR merged_since + INTERVAL 12 MONTH <= DATE '{0}')"


@_held_query(f"""SELECT group_id, CAST(sum(remaining) AS BIGINT) AS balance, CAST(sum(CASE WHEN expires_on <= DATE '{T.NEXT_CUT}' THEN remaining ELSE 0 END) AS BIGINT) AS expires_next_cut,
  bool_and({FREE.format(T.AS_OF)}) AS may_redeem FROM held JOIN groups USING (group_id) GROUP BY 1""")
def group_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.balances(_held(spark, sf_dir), T.groups(spark, sf_dir), F.lit(T.NEXT_CUT).cast("date"), F.lit(T.AS_OF).cast("date"))
    return out.select("group_id", "balance", "expires_next_cut", "may_redeem")


@_held_query(f"""SELECT group_id, balance, expires_next_cut FROM (SELECT group_id, CAST(sum(remaining) AS BIGINT) AS balance, CAST(sum(CASE WHEN expires_on <= DATE '{T.NEXT_CUT}' THEN remaining ELSE 0 END) AS BIGINT) AS expires_next_cut,
  bool_and({FREE.format(T.AS_OF)}) AS may FROM held JOIN groups USING (group_id) GROUP BY 1) WHERE may AND expires_next_cut > 0""")
def expiry_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.balances(_held(spark, sf_dir), T.groups(spark, sf_dir), F.lit(T.NEXT_CUT).cast("date"), F.lit(T.AS_OF).cast("date"))
    return audit.expiry_notices(out).select("group_id", "balance", "expires_next_cut")


@_held_query(f"""SELECT CASE WHEN available_from > DATE '{T.AS_OF}' THEN 'acreditado' WHEN expires_on <= DATE '{T.AS_OF}' THEN 'vencido' WHEN remaining <= 0 THEN 'canjeado'
  WHEN NOT {FREE.format(T.AS_OF)} THEN 'retenido' ELSE 'disponible' END AS state, count(*) AS lots, CAST(sum(remaining) AS BIGINT) AS remaining FROM held JOIN groups USING (group_id) GROUP BY 1""")
def lot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.lot_state(_held(spark, sf_dir), T.groups(spark, sf_dir), F.lit(T.AS_OF).cast("date"))
    return out.groupBy("state").agg(F.count(F.lit(1)).alias("lots"), F.sum("remaining").alias("remaining"))


@query("SELECT DISTINCT period, round((expires_on - available_from) / 30.44::DOUBLE, 2) AS life_months FROM lots2")
def effective_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.effective_life(T.lots(spark, sf_dir))


@query("""SELECT category, round(spend, 0) AS spend, points, round(100 * spend / sum(spend) OVER (), 2) AS spend_pct, round(100 * points / sum(points) OVER (), 2) AS points_pct
  FROM (SELECT category, sum(amount_gtq) AS spend, CAST(sum(points) AS BIGINT) AS points FROM earned GROUP BY 1)""")
def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.category_share(T.earned(spark, sf_dir), 0)


def _grain_sql(grain: str, keys: str) -> str:
    return f"""SELECT '{grain}' AS grain, CAST(sum(c) AS BIGINT) AS credited, CAST(sum(points - c) AS BIGINT) AS clipped, count(DISTINCT CASE WHEN points > c THEN group_id END) AS groups_hit FROM (
  SELECT points, group_id, CASE WHEN cap IS NULL THEN points ELSE least(points, greatest(cap - coalesce(sum(points) OVER (PARTITION BY {keys}, year(ts) ORDER BY ts, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) END AS c FROM earned)"""


@query(" UNION ALL ".join(_grain_sql(*g) for g in (("client", "client_id"), ("client_product", "client_id, product"), ("group", "group_id, product"))))
def cap_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    grains = {"client": ["client_id"], "client_product": ["client_id", "product"], "group": ["group_id", "product"]}
    return audit.cap_grain_report(T.earned(spark, sf_dir).select("client_id", "group_id", "product", "cap", "points", "ts"), grains, "cap", F.year("ts"))


@query("""SELECT rate, CAST(points AS BIGINT) AS points, round((points - base) / base * 100, 4) AS pct_change FROM (SELECT rate, sum(p) AS points, CAST(any_value(b) AS DOUBLE) AS base FROM (
  SELECT r.rate, floor(CASE WHEN currency = 'USD' THEN amount ELSE amount / r.rate END * CASE category WHEN 'reducida' THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END) AS p FROM tx, (VALUES (7.60::DOUBLE), (7.65::DOUBLE), (7.70::DOUBLE), (7.75::DOUBLE), (7.80::DOUBLE)) r(rate)),
  (SELECT sum(points) AS b FROM earned) GROUP BY 1)""")
def rate_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.rate_sensitivity(T.earned(spark, sf_dir), T.RATES, T.RATE)


@query("""SELECT CAST(sum(by_cycle) AS BIGINT) AS by_cycle, CAST(sum(by_purchase) AS BIGINT) AS by_purchase, CAST(sum(by_cycle) - sum(by_purchase) AS BIGINT) AS lost FROM (
  SELECT client_id, date_trunc('month', ts) AS m, floor(round(sum(x), 6)) AS by_cycle, sum(floor(x)) AS by_purchase FROM (SELECT *, amount_usd * CASE category WHEN 'reducida' THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS x FROM earned) GROUP BY 1, 2)""")
def rounding_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.rounding_loss(T.earned(spark, sf_dir))


@_held_query(f"""SELECT CAST(sum(CASE WHEN live THEN remaining ELSE 0 END) AS BIGINT) AS outstanding, round(sum(CASE WHEN live THEN remaining ELSE 0 END) * 0.0619::DOUBLE, 2) AS money,
  CAST(sum(CASE WHEN live AND expires_on <= DATE '{T.NEXT_CUT}' THEN remaining ELSE 0 END) AS BIGINT) AS expiring, count(DISTINCT CASE WHEN live AND merged_since IS NOT NULL AND NOT {FREE.format(T.AS_OF)} THEN group_id END) AS blocked_groups,
  CAST(sum(CASE WHEN expires_on <= DATE '{T.AS_OF}' THEN remaining ELSE 0 END) AS BIGINT) AS expired FROM (SELECT *, expires_on > DATE '{T.AS_OF}' AND remaining > 0 AS live FROM held JOIN groups USING (group_id))""")
def liability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.liability(_held(spark, sf_dir), T.groups(spark, sf_dir), F.lit(T.AS_OF).cast("date"), F.lit(T.NEXT_CUT).cast("date"))


@query("""SELECT CAST(sum(CAST(mcc_source = 'sin_resolver' AS INTEGER)) AS BIGINT) AS unresolved, CAST(sum(CAST(points <> correct AS INTEGER)) AS BIGINT) AS wrong_rows, CAST(sum(points - correct) AS BIGINT) AS over_credited, CAST(sum(points) AS BIGINT) AS total,
  round(100 * CAST(sum(points - correct) AS DOUBLE) / sum(points), 4) AS pct FROM (SELECT *, CAST(floor(amount_usd * CASE WHEN key % 10 = 0 THEN 0.0::DOUBLE WHEN key % 10 < 4 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END) AS BIGINT) AS correct FROM earned)""")
def wrong_factor_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = T.earned(spark, sf_dir)
    code = F.when(F.col("o_orderkey") % 10 == 0, "6011").when(F.col("o_orderkey") % 10 < 4, "5411").otherwise("5812")
    truth = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("auth_code"), code.alias("true_mcc"))
    return audit.wrong_factor_cost(tx, truth, T.REDUCED, T.EXCLUDED)


MILES_SQL = "CASE origin WHEN 'saldo_promedio' THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END"


@_held_query(f"SELECT group_id, CAST(sum(remaining) AS BIGINT) AS balance, round(sum(remaining * {MILES_SQL}), 4) AS miles FROM held GROUP BY 1")
def group_miles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.miles_by_group(_held(spark, sf_dir), T.MILES)


@_held_query("""SELECT group_id, CAST(coalesce(sum(remaining) FILTER (origin = 'campana'), 0) AS BIGINT) AS campana, CAST(coalesce(sum(remaining) FILTER (origin = 'consumo'), 0) AS BIGINT) AS consumo,
  CAST(coalesce(sum(remaining) FILTER (origin = 'saldo_promedio'), 0) AS BIGINT) AS saldo_promedio, CAST(coalesce(sum(remaining) FILTER (origin = 'sorteo'), 0) AS BIGINT) AS sorteo FROM held GROUP BY 1""")
def balance_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.composition(_held(spark, sf_dir), T.ORIGINS)


GAPS_SQL = f"""gaps AS (SELECT lag(group_id) OVER w AS lower_group, group_id AS upper_group, round((balance - lag(balance) OVER w) / CAST(balance AS DOUBLE), 6) AS rel_gap, round(abs(miles - lag(miles) OVER w), 4) AS miles_gap
  FROM (SELECT group_id, CAST(sum(remaining) AS BIGINT) AS balance, round(sum(remaining * {MILES_SQL}), 4) AS miles FROM held GROUP BY 1) WHERE balance > 1000 WINDOW w AS (ORDER BY balance, group_id))"""


@query(f"WITH {T.RAW_SQL}, {T.ledger_sql(T.AS_OF)}, {GAPS_SQL} SELECT * FROM gaps WHERE lower_group IS NOT NULL")
def neighbour_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.neighbour_gaps(audit.miles_by_group(_held(spark, sf_dir), T.MILES))


@query(f"WITH {T.RAW_SQL}, {T.ledger_sql(T.AS_OF)}, {GAPS_SQL} SELECT * FROM gaps WHERE rel_gap < 0.2 ORDER BY miles_gap DESC, lower_group LIMIT 1")
def near_equal_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.near_equal_pair(audit.neighbour_gaps(audit.miles_by_group(_held(spark, sf_dir), T.MILES)), 0.2)


@_held_query("SELECT group_id, CAST(sum(remaining) AS BIGINT) AS balance FROM held GROUP BY 1 ORDER BY balance DESC, group_id LIMIT 10")
def top_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_balances(_held(spark, sf_dir))


@query("SELECT category, round(sum(points) * 0.0619::DOUBLE / sum(amount_gtq), 6) AS money_per_unit FROM earned GROUP BY 1")
def return_on_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.return_on_spend(T.earned(spark, sf_dir))


@query("""WITH s AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 <> 0), k AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0)
  SELECT CASE WHEN s.id IS NOT NULL AND k.id IS NOT NULL THEN 'both' WHEN s.id IS NOT NULL THEN 'not_credited' ELSE 'not_notified' END AS status, count(*) AS n FROM s FULL JOIN k USING (id) GROUP BY 1""")
def prize_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("prize_id"), F.lit(10).alias("points"))
    return audit.reconcile_prizes(c.where("prize_id % 4 <> 0"), c.where("prize_id % 5 <> 0")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT c_custkey // 4 AS family, c_custkey FROM customer) SELECT family, count(*) AS size, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS members FROM c GROUP BY 1""")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.read(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 4).alias("family"), "c_custkey")
    return audit.group_members(c, "family", "c_custkey").withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("SELECT c_mktsegment AS origin, count(*) AS cards, round(avg(CAST(c_acctbal > 0 AS INTEGER)), 6) AS accrual_rate FROM customer GROUP BY 1")
def card_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.card_rates(T.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("origin"), (F.col("c_acctbal") > 0).alias("accrues")))


@query("""SELECT 'known' AS part, count(*) AS n, CAST(sum(CAST(catalog_mcc AS BIGINT)) AS BIGINT) AS codes FROM (
    SELECT descr_norm, catalog_mcc FROM catalog WHERE ascii(right(descr_norm, 1)) % 2 = 0
    UNION ALL SELECT descr_norm, CASE WHEN ascii(right(descr_norm, 1)) % 4 = 1 THEN '5812' ELSE '5411' END FROM (SELECT DISTINCT descr_norm FROM named) WHERE ascii(right(descr_norm, 1)) % 2 = 1 AND ascii(right(descr_norm, 1)) % 3 <> 0)
  UNION ALL SELECT 'review', count(*), 0 FROM (SELECT DISTINCT descr_norm FROM named) WHERE ascii(right(descr_norm, 1)) % 3 = 0""")
def merged_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of half the descriptions, and answers for all of them of which a third is unsure."""
    deduped, _ = quality.dedupe_first(T.raw_transactions(spark, sf_dir), ["auth_code"], ["ts", "copy"])
    kept, _ = quality.cancel_reversals(deduped, "auth_code", "auth_ref", F.col("kind") == "reversa")
    last = F.ascii(F.substring("descr_norm", -1, 1))
    catalog = merchants.build_catalog(kept).where(last % 2 == 0)
    answers = kept.select(merchants.normalize_description(F.col("descr")).alias("descr_norm")).distinct().select(
        "descr_norm", F.when(last % 4 == 1, "5812").otherwise("5411").alias("mcc"), F.when(last % 3 == 0, 0.5).otherwise(0.9).alias("confidence")
    )
    known, review = merchants.merge_answers(catalog, answers)
    codes = F.sum(F.col("catalog_mcc").cast("long"))
    return known.agg(F.lit("known").alias("part"), F.count(F.lit(1)).alias("n"), codes.alias("codes")).unionByName(
        review.agg(F.lit("review").alias("part"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("codes"))
    )
