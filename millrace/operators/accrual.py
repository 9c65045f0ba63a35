"""Points: conversion, earning, caps, campaigns, balances, prizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from millrace.functions.scalars import add_business_days
from millrace.sources.io import rule_map


def convert(df: DataFrame, amount: str = "amount", currency: str = "currency", rate: float = 7.70) -> DataFrame:
    """Adds amount_usd and amount_gtq."""
    a = F.col(amount).cast("double")
    is_usd = F.col(currency) == "USD"
    return df.withColumn("amount_usd", F.when(is_usd, a).otherwise(a / F.lit(rate))).withColumn("amount_gtq", F.when(is_usd, a * F.lit(rate)).otherwise(a))


def rate_of(category: Column, base: float = 1.0, reduced: float = 0.1) -> Column:
    return F.when(category == "reducida", F.lit(reduced)).when(category == "general", F.lit(base)).otherwise(F.lit(0.0))


def earn_points(df: DataFrame, base: float = 1.0, reduced: float = 0.1) -> DataFrame:
    return df.withColumn("points", F.floor(F.col("amount_usd") * rate_of(F.col("category"), base, reduced)).cast("long"))


Cap = tuple[str, Column, Column]  # name, period, points; null points: no limit


def _days(df: DataFrame, keys: list[str], caps: list[Cap], points: str, order: list[str], segment: Column | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows with their account, segment and periods, one row per account and segment with its points and what each cap has let through before, account columns).

    An account is one value of the keys (null is a value).  The sums of a segment are aggregated with partials before the shuffle, and
    only segments are ordered within an account.  Under each cap, what the inner cap lets through is an input, and the points let through up
    to now are min(cap, inputs up to now); such clamps compose, so a segment needs nothing of the earlier ones but `_b0`, `_b1`, ...
    """
    text = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    account = F.concat_ws("\x1f", *[text(F.col(k)) for k in keys])
    if segment is None:
        dated = isinstance(df.schema[order[0]].dataType, (DateType, TimestampType, TimestampNTZType))
        segment = F.to_date(order[0]) if dated else F.lit(None).cast("date")
    day = F.coalesce(segment, F.lit("0001-01-01").cast("date"))
    n, at = range(len(caps)), ["_account", "_day"]
    rows = df.withColumns({"_account": account, "_day": day} | {f"_p{i}": text(p) for i, (_, p, _) in enumerate(caps)} | {f"_c{i}": c.cast("long") for i, (_, _, c) in enumerate(caps)})
    limited = F.greatest(*[F.col(f"_c{i}").isNotNull() for i in n]) if len(caps) > 1 else F.col("_c0").isNotNull()
    # Rows that no cap holds for neither use up a cap nor are limited by one.
    rows = rows.withColumn("_in", F.when(limited, F.col(points)).otherwise(0).cast("long"))
    sums = rows.groupBy(*at, *[f"_p{i}" for i in n]).agg(F.sum("_in").alias("_o"), *[F.max(f"_c{i}").alias(f"_c{i}") for i in n])
    for i in n:
        earlier = Window.partitionBy("_account", f"_p{i}").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn(f"_b{i}", F.coalesce(F.sum("_o").over(earlier), F.lit(0)))
        sums = sums.withColumn("_o", _through(F.col("_o"), i)).withColumn(f"_o{i}", F.col("_o"))
    return rows, sums, at


def _through(amount: Column, i: int) -> Column:
    """What cap i lets through of an amount that comes after `_b{i}` earlier points of its period."""
    clamp = lambda x: F.least(F.col(f"_c{i}"), x)
    return F.when(F.col(f"_c{i}").isNull(), amount).otherwise(clamp(F.col(f"_b{i}") + amount) - clamp(F.col(f"_b{i}")))


def apply_caps(df: DataFrame, keys: list[str], caps: list[Cap], points: str, order: list[str], out: str = "credited", segment: Column | None = None) -> DataFrame:
    """credited = what a chain of caps on the same keys lets through of each row; each cap counts what the one before it let through.

    caps: innermost first; a cap is constant within an account and period.  A period is made of whole segments: the day of the first
    order column, the date that `segment` gives, or without either the whole account.  An account may hold most rows: its segments are scanned as sums, and rows are ordered
    within one segment only, so the largest task is one segment of one account.  Points are not negative.
    """
    rows, sums, at = _days(df, keys, caps, points, order, segment)
    offsets = sums.select(*at, *[f"_b{i}" for i in range(len(caps))])
    # The join and the window share one exchange, by account and segment.
    joined = rows.join(offsets, at)
    before = F.coalesce(F.sum("_in").over(Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = lambda x: [x := _through(x, i) for i in range(len(caps))][-1]
    done = joined.withColumn("_before", before).withColumn(out, (upto(F.col("_before") + F.col(points)) - upto(F.col("_before"))).cast("long"))
    return done.select(*[f"`{c}`" for c in df.columns if c != out], out)


def apply_cap(df: DataFrame, keys: list[str], cap: str, points: str, order: list[str], period: Column | None = None, out: str = "credited", segment: Column | None = None) -> DataFrame:
    """One cap: credited = what is left of the cap of the row's key and period after all earlier rows; all of it without a cap."""
    return apply_caps(df, keys, [(cap, F.lit("") if period is None else period, F.col(cap))], points, order, out, segment)


def cap_room(df: DataFrame, keys: list[str], caps: list[Cap], points: str, order: list[str], segment: Column | None = None) -> DataFrame:
    """keys, cap, period, used, room: what each cap has let through and what is left, from the segments' sums alone."""
    rows, sums, _ = _days(df, keys, caps, points, order, segment)
    names = rows.groupBy("_account").agg(*[F.first(k).alias(k) for k in keys])
    each = [F.struct(F.lit(name).alias("cap"), F.substring(f"_p{i}", 2, 100).alias("period"), F.col(f"_o{i}").alias("used"), F.col(f"_c{i}").alias("most")) for i, (name, _, _) in enumerate(caps)]
    used = sums.select("_account", F.inline(F.array(*each))).where("most is not null").groupBy("_account", "cap", "period").agg(F.sum("used").alias("used"), F.max("most").alias("most"))
    return used.join(names, "_account").select(*keys, "cap", "period", "used", (F.col("most") - F.col("used")).alias("room"))


def cap_excess(df: DataFrame, points: str = "points", credited: str = "credited") -> DataFrame:
    """The part over the cap as discards; the purchase itself stays."""
    return df.where(F.col(points) > F.col(credited)).withColumn("excess", F.col(points) - F.col(credited)).withColumn("motivo", F.lit("excede_tope"))


def apply_campaigns(tx: DataFrame, campaigns: DataFrame, enrolments: DataFrame, order: list[str], points: str = "credited") -> DataFrame:
    """Extra points of purchases in a campaign that the client joined, under the campaign's cap per client.

    campaigns: campaign_id, brand, starts, ends (inclusive days), factor, client_cap; enrolments: campaign_id, client_id.
    """
    day = F.col("ts").cast("date")
    inside = tx.alias("t").join(campaigns.alias("c"), (F.col("t.brand") == F.col("c.brand")) & day.between(F.col("c.starts"), F.col("c.ends")))
    rows = inside.select("t.*", "c.campaign_id", "c.factor", "c.client_cap").join(enrolments.select("campaign_id", "client_id").distinct(), ["campaign_id", "client_id"], "left_semi")
    rows = rows.withColumn("extra", (F.col(points) * (F.col("factor") - 1)).cast("long"))
    return apply_cap(rows, ["campaign_id", "client_id"], "client_cap", "extra", order, out="extra_credited")


def credit_date(ts: Column, days: Column) -> Column:
    return add_business_days(ts.cast("date"), days)


def balance_points(balances: DataFrame, accounts: DataFrame, clients: DataFrame, thresholds: dict[str, float], doubled: str, unit: float = 1000.0) -> DataFrame:
    """Points of monthly balances strictly above the account's threshold; doubled for members on one kind of account.

    balances: account_id, month, balance; accounts: account_id, client_id, account_type; clients: client_id, group_id, is_member.
    """
    rows = balances.join(accounts, "account_id").join(clients, "client_id")
    over = F.col("balance") > rule_map(thresholds, F.col("account_type"))
    factor = F.when((F.col("account_type") == doubled) & F.col("is_member"), 2).otherwise(1)
    return rows.withColumn("points", F.when(over, F.floor(F.col("balance") / unit * factor)).otherwise(0).cast("long")).withColumn(
        "credited_on", add_business_days(F.last_day("month"), F.lit(2))
    )


def prize_points(prizes: DataFrame, clients: DataFrame, hours: int = 48) -> DataFrame:
    """prizes: prize_id, client_id, points, notified_at."""
    return prizes.join(clients, "client_id").withColumn("credited_on", (F.col("notified_at") + F.expr(f"INTERVAL {hours} HOURS")).cast("date"))


def promotion_factor(tx: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds the best factor of the promotions that apply to a purchase, 1 if none.

    A rule has starts, ends, min_ticket, factor, and optionally weekday (0 Monday), category,
    members_only, mobile_only.  Rules are few and become one expression.
    """
    day = F.col("ts").cast("date")
    factors = [F.lit(1)]
    for r in rules:
        holds = day.between(F.lit(r["starts"]).cast("date"), F.lit(r["ends"]).cast("date")) & (F.col("amount_gtq") >= r["min_ticket"])
        if r.get("weekday") is not None:
            holds &= F.weekday(day) == r["weekday"]
        if r.get("category"):
            holds &= F.col("category") == r["category"]
        if r.get("members_only"):
            holds &= F.col("is_member")
        if r.get("mobile_only"):
            holds &= F.col("uses_mobile")
        factors.append(F.when(holds, F.lit(r["factor"])).otherwise(1))
    return tx.withColumn("factor", F.greatest(*factors) if rules else factors[0])


def eligibility_as_of(tx: DataFrame, versions: DataFrame, key: str = "client_id", at: str = "ts", state: str = "state") -> DataFrame:
    """State of the key that was valid at each row's time.  versions: key, valid_from, state.

    Union and last-known value: one shuffle and one sort by key, no pair of rows is made.
    """
    a = tx.withColumn("_at", F.col(at)).withColumn("_kind", F.lit(1))
    b = versions.select(key, F.col("valid_from").alias("_at"), F.col(state).alias("_state"), F.lit(0).alias("_kind"))
    by = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(state, F.last("_state", ignorenulls=True).over(by))
    return both.where("_kind = 1").drop("_at", "_kind", "_state")


def union_accruals(*streams: DataFrame) -> DataFrame:
    """Streams of group_id, origin, credited_on, points; only positive points stay."""
    out = streams[0].select("group_id", "origin", "credited_on", "points")
    for s in streams[1:]:
        out = out.unionByName(s.select("group_id", "origin", "credited_on", "points"))
    return out.where("points > 0")
