"""Driver tables as the entities of the library, and the same adapters as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.io import rule_map
from millrace.sources.stored import store

REDUCED = ["5411", "5412", "5541", "5542", "5499", "8398", "8220", "8211"]
EXCLUDED = ["6011", "6010"]
RATE, RATES = 7.70, [7.60, 7.65, 7.70, 7.75, 7.80]
CAPS = {"AUTOMOBILE": 180000, "BUILDING": 180000, "FURNITURE": 360000, "HOUSEHOLD": 420000}
CODES = {"1-URGENT": "5411", "2-HIGH": "6011", "3-MEDIUM": "5812", "4-NOT SPECIFIED": "", "5-LOW": "5732"}
MILES = {"consumo": 1.0, "campana": 1.0, "saldo_promedio": 0.4, "sorteo": 1.0}
ORIGINS = ["campana", "consumo", "saldo_promedio", "sorteo"]
NEXT_CUT, AS_OF = "2000-02-05", "1999-06-30"


def family(client: Column) -> Column:
    """Forty neighbouring clients share one account of points; families grow in number with the clients."""
    return F.floor(client / 40).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as card transactions, with retries (every 33rd) and reversals (every 50th, two days later)."""
    o = read(spark, sf_dir, "orders")
    base = o.select(
        F.col("o_orderkey").alias("key"), F.col("o_orderkey").cast("string").alias("auth_code"), F.col("o_custkey").alias("client_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderstatus") == "P", "USD").otherwise("GTQ").alias("currency"),
        F.coalesce(rule_map(CODES, F.col("o_orderpriority")), F.lit("")).alias("mcc"), F.concat(F.lit("  shop   "), (F.col("o_custkey") % 40).cast("string"), F.lit(" ")).alias("descr"),
        F.when(F.col("o_orderkey") % 41 == 0, "extrafinanciamiento").otherwise("compra").alias("kind"), F.lit(None).cast("string").alias("auth_ref"), F.lit(0).alias("copy"),
    )
    # One pass: every order becomes an array of itself, its retry and its reversal.
    row = lambda **changed: F.struct(*[changed.get(c, F.col(c)).alias(c) for c in base.columns])
    retry = F.when(F.col("key") % 33 == 0, row(copy=F.lit(1)))
    turned = {"auth_ref": F.col("auth_code"), "auth_code": F.concat(F.lit("R"), "auth_code"), "kind": F.lit("reversa"), "ts": F.col("ts") + F.expr("INTERVAL 2 DAYS")}
    reversal = F.when(F.col("key") % 50 == 0, row(**turned))
    return base.select(F.explode(F.array_compact(F.array(row(), retry, reversal))).alias("t")).select("t.*")


RAW_SQL = """
base AS (SELECT o_orderkey AS key, CAST(o_orderkey AS VARCHAR) AS auth_code, o_custkey AS client_id, o_orderdate AS ts, o_totalprice AS amount,
  CASE WHEN o_orderstatus = 'P' THEN 'USD' ELSE 'GTQ' END AS currency,
  CASE o_orderpriority WHEN '1-URGENT' THEN '5411' WHEN '2-HIGH' THEN '6011' WHEN '3-MEDIUM' THEN '5812' WHEN '5-LOW' THEN '5732' ELSE '' END AS mcc,
  '  shop   ' || CAST(o_custkey % 40 AS VARCHAR) || ' ' AS descr,
  CASE WHEN o_orderkey % 41 = 0 THEN 'extrafinanciamiento' ELSE 'compra' END AS kind, CAST(NULL AS VARCHAR) AS auth_ref, 0 AS copy FROM orders),
raw AS (SELECT * FROM base UNION ALL SELECT key, auth_code, client_id, ts, amount, currency, mcc, descr, kind, auth_ref, 1 FROM base WHERE key % 33 = 0
  UNION ALL SELECT key, 'R' || auth_code, client_id, ts + INTERVAL 2 DAY, amount, currency, mcc, descr, 'reversa', auth_code, 0 FROM base WHERE key % 50 = 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY auth_code ORDER BY ts, copy) AS n FROM raw),
deduped AS (SELECT * EXCLUDE (n) FROM numbered WHERE n = 1),
kept AS (SELECT * FROM deduped d WHERE kind <> 'reversa' AND NOT EXISTS (SELECT 1 FROM deduped r WHERE r.kind = 'reversa' AND r.auth_ref = d.auth_code)),
named AS (SELECT *, trim(regexp_replace(upper(descr), '\\s+', ' ', 'g')) AS descr_norm FROM kept),
catalog AS (SELECT descr_norm, arg_min(mcc, (ts, auth_code)) AS catalog_mcc FROM named WHERE mcc <> '' GROUP BY 1),
resolved AS (SELECT n.*, coalesce(nullif(n.mcc, ''), c.catalog_mcc) AS mcc_resolved,
  CASE WHEN n.mcc <> '' THEN 'propio' WHEN c.catalog_mcc IS NOT NULL THEN 'descripcion' ELSE 'sin_resolver' END AS mcc_source
  FROM named n LEFT JOIN catalog c USING (descr_norm)),
categorized AS (SELECT *, CASE WHEN mcc_resolved IN ('6011', '6010') OR kind = 'extrafinanciamiento' THEN 'excluida'
  WHEN mcc_resolved IN ('5411', '5412', '5541', '5542', '5499', '8398', '8220', '8211') THEN 'reducida' ELSE 'general' END AS category FROM resolved),
converted AS (SELECT *, CASE WHEN currency = 'USD' THEN amount ELSE amount / 7.70::DOUBLE END AS amount_usd,
  CASE WHEN currency = 'USD' THEN amount * 7.70::DOUBLE ELSE amount END AS amount_gtq FROM categorized),
tx AS (SELECT c.*, CAST(k.c_custkey // 40 AS BIGINT) AS group_id, k.c_mktsegment AS product, k.c_custkey % 3 = 0 AS is_member, k.c_custkey % 7 = 0 AS uses_mobile,
  CASE WHEN k.c_custkey % 2 = 0 THEN 'visa' ELSE 'mastercard' END AS brand,
  CASE k.c_mktsegment WHEN 'AUTOMOBILE' THEN 180000 WHEN 'BUILDING' THEN 180000 WHEN 'FURNITURE' THEN 360000 WHEN 'HOUSEHOLD' THEN 420000 END AS cap
  FROM converted c JOIN customer k ON c.client_id = k.c_custkey WHERE c.category <> 'excluida'),
earned AS (SELECT *, CAST(floor(amount_usd * CASE category WHEN 'reducida' THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END) AS BIGINT) AS points FROM tx),
windowed AS (SELECT *, coalesce(sum(points) OVER (PARTITION BY group_id, product, year(ts) ORDER BY ts, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM earned),
credited AS (SELECT * EXCLUDE (prior), CAST(CASE WHEN cap IS NULL THEN points ELSE least(points, greatest(cap - prior, 0)) END AS BIGINT) AS credited FROM windowed),
extras AS (SELECT t.*, c.campaign_id, c.client_cap, credited * (c.factor - 1) AS extra FROM credited t
  JOIN (VALUES ('C1', 'visa', DATE '1998-07-01', DATE '1998-09-30', 2, 15000), ('C2', 'mastercard', DATE '1999-01-01', DATE '1999-03-31', 3, 30000)) c(campaign_id, brand, starts, ends, factor, client_cap)
  ON t.brand = c.brand AND CAST(t.ts AS DATE) BETWEEN c.starts AND c.ends
  WHERE t.client_id % 5 < CASE c.campaign_id WHEN 'C1' THEN 2 ELSE 3 END),
campaigned AS (SELECT *, CAST(least(extra, greatest(client_cap - coalesce(sum(extra) OVER (PARTITION BY campaign_id, client_id ORDER BY ts, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS BIGINT) AS extra_credited FROM extras),
rolled AS (SELECT *, CAST(ts AS DATE) + CAST(CASE isodow(ts) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS INTEGER) AS d1, 2 + key % 2 AS days FROM credited),
dated AS (SELECT *, d1 + CAST(days + 2 * ((isodow(d1) - 1 + days) // 5) AS INTEGER) AS credited_on FROM rolled),
accruals AS (
  SELECT group_id, 'consumo' AS origin, credited_on, credited AS points, client_id, key FROM dated
  UNION ALL SELECT d.group_id, 'campana', d.credited_on, c.extra_credited, d.client_id, d.key FROM campaigned c JOIN dated d USING (key)
  UNION ALL SELECT CAST(c_custkey // 40 AS BIGINT), 'saldo_promedio', DATE '1998-06-30' + 2, CAST(CASE WHEN c_acctbal > CASE WHEN c_custkey % 2 = 0 THEN 500 ELSE 1000 END THEN floor(c_acctbal / 1000.0::DOUBLE * CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 2 ELSE 1 END) ELSE 0 END AS BIGINT), c_custkey, c_custkey FROM customer
  UNION ALL SELECT CAST(c_custkey // 40 AS BIGINT), 'sorteo', DATE '1999-04-03', c_custkey % 500, c_custkey, c_custkey FROM customer WHERE c_custkey % 11 = 0),
lots AS (SELECT group_id, CAST(date_trunc('month', credited_on) AS DATE) AS period, origin, CAST(sum(points) AS BIGINT) AS points FROM accruals WHERE points > 0 GROUP BY 1, 2, 3),
lots2 AS (SELECT *, last_day(period) AS available_from, make_date(year(period) + 2, 2, 5) AS expires_on FROM lots),
groups AS (SELECT DISTINCT CAST(c_custkey // 40 AS BIGINT) AS group_id, CASE WHEN c_custkey // 40 % 4 = 0 THEN DATE '1998-10-15' END AS merged_since FROM customer)
"""


def ledger_sql(until: str | None = None, order: str = "fifo") -> str:
    """The ledger as a recursion over each family's numbered events; ends with the tables steps, moves and held.

    A book is a list of lots in the order of redemption, each with its place: expiry (negated for lifo), arrival.
    until: leave out cuts and requests after that day.
    """
    at = f" WHERE d <= DATE '{until}'" if until else ""
    place = "epoch_ms(CAST({0} AS TIMESTAMP)) // 86400000" if order == "fifo" else "-(epoch_ms(CAST({0} AS TIMESTAMP)) // 86400000)"
    lot = "STRUCT(place BIGINT, arrived BIGINT, lot_id VARCHAR, expires DATE, points BIGINT)"
    before = "coalesce(list_sum(list_transform(list_slice(book, 1, j - 1), lambda y: y.points)), 0)"
    part = f"least(x.points, greatest(ask - {before}, 0))"
    return f"""
lots3 AS (SELECT *, sha256(CAST(group_id AS VARCHAR) || '#' || CAST(period AS VARCHAR) || '#' || origin) AS lot_id FROM lots2),
asked AS (SELECT CAST(o_orderkey AS VARCHAR) AS request_id, CAST(o_custkey // 40 AS BIGINT) AS group_id, CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE CAST(o_custkey // 40 AS VARCHAR) END AS client_id,
  CAST(o_orderdate AS DATE) AS d, CAST(floor(o_totalprice / 10) AS BIGINT) AS points, CASE WHEN o_orderkey % 2 = 0 THEN 'web' ELSE 'agencia' END AS center, CASE WHEN o_orderkey % 3 = 0 THEN 'viaje' ELSE 'articulo' END AS prize
  FROM orders WHERE o_orderpriority = '5-LOW'),
events AS (SELECT group_id, available_from AS d, 0 AS kind, lot_id AS id, points, expires_on, '' AS client_id FROM lots3
  UNION ALL SELECT group_id, d, 1, '', 0, NULL, '' FROM groups, (SELECT make_date(CAST(y AS INT), 2, 5) AS d FROM range(1996, 2005) r(y)){at}
  UNION ALL SELECT group_id, d, 2, request_id, points, NULL, client_id FROM asked{at}),
numbered_events AS MATERIALIZED (SELECT e.*, row_number() OVER (PARTITION BY group_id ORDER BY d, kind, id) AS i, g.merged_since FROM events e LEFT JOIN groups g USING (group_id)),
steps AS MATERIALIZED (WITH RECURSIVE s AS (
  SELECT group_id, CAST(0 AS BIGINT) AS i, CAST([] AS {lot}[]) AS book, CAST([] AS STRUCT(lot_id VARCHAR, points BIGINT)[]) AS moves, CAST(NULL AS VARCHAR) AS result FROM groups
  UNION ALL
  SELECT group_id, i, CASE kind WHEN 0 THEN list_sort(list_append(book, CAST({{'place': {place.format('expires_on')}, 'arrived': i, 'lot_id': id, 'expires': expires_on, 'points': points}} AS {lot})))
      WHEN 1 THEN list_filter(book, lambda x: x.expires > d)
      ELSE list_filter(list_transform(book, lambda x, j: {{'place': x.place, 'arrived': x.arrived, 'lot_id': x.lot_id, 'expires': x.expires, 'points': x.points - {part}}}), lambda x: x.points > 0) END,
    CASE kind WHEN 0 THEN [{{'lot_id': id, 'points': points}}]
      WHEN 1 THEN list_transform(list_filter(book, lambda x: x.expires <= d), lambda x: {{'lot_id': x.lot_id, 'points': -x.points}})
      ELSE list_filter(list_transform(book, lambda x, j: {{'lot_id': x.lot_id, 'points': -{part}}}), lambda x: x.points < 0) END,
    result
  FROM (SELECT *, CASE WHEN result = 'aprobado' THEN points ELSE 0 END AS ask FROM (
    SELECT s.group_id, e.i, s.book, e.kind, e.id, e.d, e.points, e.expires_on, CASE WHEN e.kind < 2 THEN NULL WHEN e.client_id <> CAST(s.group_id AS VARCHAR) THEN 'no_es_titular'
      WHEN e.d < e.merged_since + INTERVAL 12 MONTH THEN 'unificacion_menor_a_12_meses' WHEN coalesce(list_sum(list_transform(s.book, lambda y: y.points)), 0) < e.points THEN 'saldo_insuficiente' ELSE 'aprobado' END AS result
    FROM s JOIN numbered_events e ON e.group_id = s.group_id AND e.i = s.i + 1))
  ) SELECT s.group_id, s.moves, s.result, e.kind, e.id, e.d, e.points FROM s JOIN numbered_events e USING (group_id, i)),
moves AS (SELECT m.lot_id, CAST(group_id AS VARCHAR) AS group_id, CASE kind WHEN 0 THEN 'acumulacion' WHEN 1 THEN 'expiracion' ELSE 'canje' END AS type, d AS date, m.points, CASE WHEN kind = 2 THEN id END AS request_id
  FROM (SELECT *, unnest(moves) AS m FROM steps)),
held AS (SELECT l.*, CAST(coalesce(m.n, 0) AS BIGINT) AS remaining FROM lots3 l LEFT JOIN (SELECT lot_id, sum(points) AS n FROM moves GROUP BY 1) m USING (lot_id))"""


def clean_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated, reversal-free, resolved and categorised purchases."""
    from millrace.operators import accrual, merchants, quality

    deduped, _ = quality.dedupe_first(raw_transactions(spark, sf_dir), ["auth_code"], ["ts", "copy"])
    kept, _ = quality.cancel_reversals(deduped, "auth_code", "auth_ref", F.col("kind") == "reversa")
    resolved = merchants.resolve_code(kept, merchants.build_catalog(kept))
    return accrual.convert(merchants.categorize(resolved, EXCLUDED, REDUCED), rate=RATE)


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("client_id"), family(F.col("c_custkey")).alias("group_id"), F.col("c_mktsegment").alias("product"), (F.col("c_custkey") % 3 == 0).alias("is_member"),
        (F.col("c_custkey") % 7 == 0).alias("uses_mobile"), F.when(F.col("c_custkey") % 2 == 0, "visa").otherwise("mastercard").alias("brand"), rule_map(CAPS, F.col("c_mktsegment")).alias("cap"),
    )


def earned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators.accrual import earn_points

    tx = clean_transactions(spark, sf_dir).where("category <> 'excluida'").join(cards(spark, sf_dir), "client_id")
    return earn_points(tx)


def earned_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earned points, stored: caps read them twice, for the sums of days and for the rows."""
    return store(earned(spark, sf_dir), "earned")


def credited(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators.accrual import apply_cap

    return apply_cap(earned_once(spark, sf_dir), ["group_id", "product"], "cap", "points", ["ts", "key"], F.year("ts"))


def campaigns(spark: SparkSession) -> tuple[DataFrame, list[tuple[str, int]]]:
    rows = [("C1", "visa", "1998-07-01", "1998-09-30", 2, 15000), ("C2", "mastercard", "1999-01-01", "1999-03-31", 3, 30000)]
    table = spark.createDataFrame(rows, "campaign_id string, brand string, starts string, ends string, factor int, client_cap int")
    return table.withColumns({"starts": F.col("starts").cast("date"), "ends": F.col("ends").cast("date")}), [("C1", 2), ("C2", 3)]


def campaigned(spark: SparkSession, sf_dir: str, tx: DataFrame) -> DataFrame:
    from millrace.operators.accrual import apply_campaigns

    table, shares = campaigns(spark)
    clients = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"))
    joined = F.explode(F.array(*[F.struct(F.lit(c).alias("campaign_id"), F.lit(k).alias("k")) for c, k in shares])).alias("j")
    enrolled = clients.select("client_id", joined).where(F.col("client_id") % 5 < F.col("j.k")).select("j.campaign_id", "client_id")
    return apply_campaigns(tx, table, enrolled, ["ts", "key"])


def accruals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators import accrual

    days = (2 + F.col("key") % 2).cast("int")
    # Purchases and campaigns both read them: stored once, with the columns that either needs.
    needed = credited(spark, sf_dir).select("key", "ts", "client_id", "group_id", "brand", "credited")
    tx = store(needed, "credited").withColumn("credited_on", accrual.credit_date(F.col("ts"), days))
    buys = tx.select("group_id", F.lit("consumo").alias("origin"), "credited_on", F.col("credited").alias("points"))
    extra = campaigned(spark, sf_dir, tx).select("group_id", F.lit("campana").alias("origin"), "credited_on", F.col("extra_credited").alias("points"))
    c = read(spark, sf_dir, "customer")
    clients = cards(spark, sf_dir)
    accounts = c.select(F.col("c_custkey").alias("account_id"), F.col("c_custkey").alias("client_id"), F.when(F.col("c_custkey") % 2 == 0, "super_cuenta_ahorro").otherwise("super_cuenta_monetaria").alias("account_type"))
    months = c.select(F.col("c_custkey").alias("account_id"), F.lit("1998-06-01").cast("date").alias("month"), F.col("c_acctbal").alias("balance"))
    held = accrual.balance_points(months, accounts, clients, {"super_cuenta_ahorro": 500.0, "super_cuenta_monetaria": 1000.0}, "super_cuenta_ahorro")
    held = held.select("group_id", F.lit("saldo_promedio").alias("origin"), "credited_on", "points")
    prizes = c.where("c_custkey % 11 = 0").select(F.col("c_custkey").alias("prize_id"), F.col("c_custkey").alias("client_id"), (F.col("c_custkey") % 500).alias("points"), F.lit("1999-04-01 10:00:00").cast("timestamp").alias("notified_at"))
    won = accrual.prize_points(prizes, clients).select("group_id", F.lit("sorteo").alias("origin"), "credited_on", "points")
    return accrual.union_accruals(buys, extra, held, won)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "customer").select(family(F.col("c_custkey")).alias("group_id")).distinct()
    return g.select("group_id", F.when(F.col("group_id") % 4 == 0, F.lit("1998-10-15").cast("date")).alias("merged_since"), F.col("group_id").cast("string").alias("holder_id"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of low priority as redemption requests of their family."""
    o = read(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'")
    group = family(F.col("o_custkey"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("request_id"), group.alias("group_id"), F.when(F.col("o_orderkey") % 5 == 0, "other").otherwise(group.cast("string")).alias("client_id"),
        F.to_date("o_orderdate").alias("date"), F.floor(F.col("o_totalprice") / 10).cast("long").alias("points"),
        F.when(F.col("o_orderkey") % 2 == 0, "web").otherwise("agencia").alias("center"), F.when(F.col("o_orderkey") % 3 == 0, "viaje").otherwise("articulo").alias("prize"),
    )


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators.ledger import build_lots

    return build_lots(accruals(spark, sf_dir))
