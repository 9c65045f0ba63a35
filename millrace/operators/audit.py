"""Questions asked of the points tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.accrual import rate_of
from millrace.sources.io import rule_map
from millrace.sources.stored import store


def category_share(tx: DataFrame, digits: int = 2) -> DataFrame:
    """Share of spend and points by category; shares are taken over the few result rows."""
    sums = tx.groupBy("category").agg(F.sum("amount_gtq").alias("spend"), F.sum("points").alias("points"))
    pct = lambda c: F.round(100 * F.col(c) / F.sum(c).over(Window.partitionBy()), 2)
    return sums.select("category", F.round("spend", digits).alias("spend"), "points", pct("spend").alias("spend_pct"), pct("points").alias("points_pct"))


def cap_grain_report(tx: DataFrame, grains: dict[str, list[str]], cap: str, period: Column, points: str = "points", group: str = "group_id") -> DataFrame:
    """Credited and clipped points, and groups hit, for each grain at which the cap could be counted.

    All grains from one aggregation of the purchases: what a cap lets through in a period is min(cap, points).  The keys of
    a grain determine the cap and the group.
    """
    used = sorted({k for keys in grains.values() for k in keys} | {group})
    sums = tx.withColumn("_period", period).groupBy(*used, cap, "_period").agg(F.sum(points).alias("_points"))
    key = lambda keys: F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys])
    listed = F.array(*[F.struct(F.lit(grain).alias("grain"), key(keys).alias("_key")) for grain, keys in grains.items()])
    rows = sums.select(F.col(group).alias("_group"), F.col(cap).alias("_cap"), "_period", "_points", F.inline(listed))
    by_key = rows.groupBy("grain", "_key", "_period").agg(F.sum("_points").alias("_points"), F.max("_cap").alias("_cap"), F.max("_group").alias("_group"))
    through = F.least("_points", F.coalesce("_cap", "_points"))
    return by_key.groupBy("grain").agg(
        F.sum(through).alias("credited"), F.sum(F.col("_points") - through).alias("clipped"), F.count_distinct(F.when(F.col("_points") > through, F.col("_group"))).alias("groups_hit"),
    )


def rate_sensitivity(tx: DataFrame, rates: list[float], reference: float) -> DataFrame:
    """Total points at each exchange rate; all rates in one pass over the purchases."""
    usd = lambda r: F.when(F.col("currency") == "USD", F.col("amount")).otherwise(F.col("amount") / F.lit(r))
    sums = tx.agg(*[F.sum(F.floor(usd(r) * rate_of(F.col("category")))).cast("long").alias(f"r{i}") for i, r in enumerate([*rates, reference])])
    listed = F.array(*[F.struct(F.lit(r).alias("rate"), F.col(f"r{i}").alias("points")) for i, r in enumerate(rates)])
    return sums.select(F.explode(listed).alias("x"), F.col(f"r{len(rates)}").alias("base")).select(
        "x.rate", "x.points", F.round((F.col("x.points") - F.col("base")) / F.col("base") * 100, 4).alias("pct_change")
    )


def rounding_loss(tx: DataFrame, card: str = "client_id") -> DataFrame:
    """Points lost by flooring each purchase instead of each card and month."""
    exact = F.col("amount_usd") * rate_of(F.col("category"))
    cycles = tx.groupBy(card, F.trunc("ts", "MM").alias("month")).agg(F.floor(F.round(F.sum(exact), 6)).alias("by_cycle"), F.sum(F.floor(exact)).alias("by_purchase"))
    return cycles.agg(F.sum("by_cycle").cast("long").alias("by_cycle"), F.sum("by_purchase").cast("long").alias("by_purchase")).withColumn("lost", F.col("by_cycle") - F.col("by_purchase"))


def rederivable_by_origin(accruals: DataFrame) -> DataFrame:
    return accruals.groupBy("origin").agg(F.sum("points").alias("points"), F.count_distinct("group_id").alias("groups"), F.count(F.lit(1)).alias("accruals"))


def liability(lots: DataFrame, groups: DataFrame, as_of: Column, next_cut: Column, value: float = 0.0619) -> DataFrame:
    """Outstanding points and their money value, what expires next, blocked groups, what has expired."""
    live = (F.col("expires_on") > as_of) & (F.col("remaining") > 0)
    pts = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("remaining"))), F.lit(0))
    blocked = F.col("merged_since").isNotNull() & (F.add_months("merged_since", 12) > as_of)
    return lots.join(groups.select("group_id", "merged_since"), "group_id").agg(
        pts(live).alias("outstanding"), F.round(pts(live) * value, 2).alias("money"), pts(live & (F.col("expires_on") <= next_cut)).alias("expiring"),
        F.count_distinct(F.when(live & blocked, F.col("group_id"))).alias("blocked_groups"), pts(F.col("expires_on") <= as_of).alias("expired"),
    )


def wrong_factor_cost(tx: DataFrame, truth: DataFrame, reduced: list[str], excluded: list[str], key: str = "auth_code") -> DataFrame:
    """Purchases credited at another rate than their true code gives.  truth: key, true_mcc."""
    true_category = F.when(F.col("true_mcc").isin(excluded), "excluida").when(F.col("true_mcc").isin(reduced), "reducida").otherwise("general")
    rows = tx.join(truth, key).withColumn("correct", F.floor(F.col("amount_usd") * rate_of(true_category)).cast("long"))
    wrong = F.col("points") != F.col("correct")
    return rows.agg(
        F.sum((F.col("mcc_source") == "sin_resolver").cast("long")).alias("unresolved"), F.sum(wrong.cast("long")).alias("wrong_rows"),
        F.coalesce(F.sum(F.when(wrong, F.col("points") - F.col("correct"))), F.lit(0)).alias("over_credited"), F.sum("points").alias("total"),
    ).withColumn("pct", F.round(100 * F.col("over_credited") / F.col("total"), 4))


def miles_by_group(lots: DataFrame, rates: dict[str, float], column: str = "remaining") -> DataFrame:
    return lots.groupBy("group_id").agg(F.sum(column).alias("balance"), F.round(F.sum(F.col(column) * rule_map(rates, F.col("origin"))), 4).alias("miles"))


def composition(lots: DataFrame, origins: list[str], column: str = "remaining") -> DataFrame:
    """Balance per group, a column per origin."""
    return lots.groupBy("group_id").pivot("origin", origins).agg(F.sum(column)).na.fill(0)


def neighbour_gaps(miles: DataFrame, least: int = 1000, partitions: int | None = None) -> DataFrame:
    """Consecutive groups by balance: relative balance gap and miles gap.

    Balances are dealt in ranges and each partition looks back within itself; its first row takes the
    last row of the nearest earlier partition with rows, from a table of one row per partition.
    """
    rows = miles.where(F.col("balance") > least).select("group_id", "balance", "miles")
    # Stored, so that a task that is run again cannot deal rows otherwise than the table of ends was made.
    dealt = store(rows.repartitionByRange(*([partitions] if partitions else []), "balance", "group_id").withColumn("part", F.spark_partition_id()), "ranged")
    order = Window.partitionBy("part").orderBy("balance", "group_id")
    last = dealt.groupBy("part").agg(F.max(F.struct("balance", "group_id", "miles")).alias("end"))
    carry = last.withColumn("carried", F.lag("end").over(Window.orderBy("part"))).select(F.col("part").alias("p"), "carried")
    me = F.struct("balance", "group_id", "miles")
    looked = dealt.withColumn("prev", F.lag(me).over(order)).join(F.broadcast(carry), F.col("part") == F.col("p"), "left")
    prev = F.coalesce("prev", "carried")
    return looked.select("group_id", "balance", "miles", prev.alias("prev")).where("prev is not null").select(
        F.col("prev.group_id").alias("lower_group"), F.col("group_id").alias("upper_group"), F.round((F.col("balance") - F.col("prev.balance")) / F.col("balance"), 6).alias("rel_gap"),
        F.round(F.abs(F.col("miles") - F.col("prev.miles")), 4).alias("miles_gap"),
    )


def near_equal_pair(gaps: DataFrame, most: float = 0.02) -> DataFrame:
    """The pair of near-equal balances with the largest miles gap; ties to the first group."""
    return gaps.where(F.col("rel_gap") < most).orderBy(F.col("miles_gap").desc(), "lower_group").limit(1)


def top_balances(lots: DataFrame, n: int = 10) -> DataFrame:
    return lots.groupBy("group_id").agg(F.sum("remaining").alias("balance")).orderBy(F.col("balance").desc(), "group_id").limit(n)


def reconcile_prizes(sent: DataFrame, credited: DataFrame, key: str = "prize_id") -> DataFrame:
    """Notices against credits in both directions: both, not_credited, not_notified."""
    a, b = sent.select(key, F.col("points").alias("sent_points")), credited.select(key, F.col("points").alias("credited_points"))
    status = F.when(F.col("sent_points").isNotNull() & F.col("credited_points").isNotNull(), "both").when(F.col("sent_points").isNotNull(), "not_credited").otherwise("not_notified")
    return a.join(b, key, "full_outer").withColumn("status", status)


def point_outcomes(movements: DataFrame, requests: DataFrame) -> DataFrame:
    """Points redeemed and expired by origin of nothing else than the movement, by channel and prize, and their share of all issued."""
    issued = movements.where("type = 'acumulacion'").agg(F.sum("points").alias("issued"))
    used = movements.where("type <> 'acumulacion'").join(requests.select("request_id", "center", "prize"), "request_id", "left")
    sums = used.groupBy("type", "center", "prize").agg((-F.sum("points")).alias("points"))
    return sums.withColumn("pct_of_issued", F.round(100 * F.col("points") / issued.scalar(), 4))


def expiry_notices(balance: DataFrame) -> DataFrame:
    """Groups to be told before the cut: points expire and they may redeem."""
    return balance.where((F.col("expires_next_cut") > 0) & F.col("may_redeem"))


def return_on_spend(tx: DataFrame, value: float = 0.0619) -> DataFrame:
    return tx.groupBy("category").agg(F.round(F.sum("points") * value / F.sum("amount_gtq"), 6).alias("money_per_unit"))


def group_members(clients: DataFrame, group: str = "group_id", client: str = "client_id") -> DataFrame:
    """Size and members of each family group.  Families are small; for corporate groups select the size alone."""
    return clients.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list(client)).alias("members"))


def card_rates(cards: DataFrame, by: str = "origin", accrues: str = "accrues") -> DataFrame:
    """Cards, and the share of them that earn points, per origin."""
    return cards.groupBy(by).agg(F.count(F.lit(1)).alias("cards"), F.round(F.avg(F.col(accrues).cast("int")), 6).alias("accrual_rate"))
