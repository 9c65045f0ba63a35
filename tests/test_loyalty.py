import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import accrual, audit, ledger, merchants, quality

D = dt.date


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_typing_and_reasons(spark):
    df = spark.createDataFrame([("1,200.50", "True"), ("x", "False"), (None, None)], "monto string, m string")
    typed = df.select(scalars.to_amount(F.col("monto")).cast("string").alias("a"), scalars.to_bool(F.col("m")).alias("b"))
    assert rows(typed, "a", "b") == [("1200.50", True), (None, False), (None, None)]
    kept, gone = quality.split_discards(quality.with_reason(typed, [("no_tipable", F.col("a").isNull()), ("excluido", ~F.col("b"))]))
    assert kept.count() == 1 and rows(gone, "motivo") == [("no_tipable",)] * 2


def test_retries_and_reversals(spark):
    tx = spark.createDataFrame([("A", None, "compra", 1), ("A", None, "compra", 2), ("A", None, "compra", 3), ("B", None, "compra", 1), ("R", "B", "reversa", 4), ("S", None, "reversa", 5)], "id string, ref string, kind string, n int")
    kept, dupes = quality.dedupe_first(tx, ["id"], ["n"])
    assert kept.count() == 4 and rows(dupes, "motivo") == [("duplicado",)] * 2
    alive, gone = quality.cancel_reversals(kept, "id", "ref", F.col("kind") == "reversa")
    assert rows(alive, "id") == [("A",)] and sorted(rows(gone, "id")) == [("B",), ("R",), ("S",)]


def test_merchant_codes(spark):
    tx = spark.createDataFrame([(1, "a", " shop  one", "5411", "compra"), (2, "b", "SHOP ONE ", "", "compra"), (3, "c", "unknown", "", "compra"), (4, "d", "cash", "6011", "compra"), (5, "e", "x", None, "extrafinanciamiento")], "ts int, auth_code string, descr string, mcc string, kind string")
    catalog = merchants.build_catalog(tx)
    out = merchants.categorize(merchants.resolve_code(tx, catalog), ["6011"], ["5411"]).orderBy("ts")
    assert rows(out, "mcc_source", "category") == [("propio", "reducida"), ("descripcion", "reducida"), ("sin_resolver", "general"), ("propio", "excluida"), ("sin_resolver", "excluida")]
    assert rows(merchants.unresolved_worklist(tx, catalog).orderBy("descr_norm"), "descr_norm", "n") == [("UNKNOWN", 1), ("X", 1)]


def test_caps(spark):
    tx = spark.createDataFrame([("g", i, p, 100) for i, p in enumerate((60, 30, 30, 5))] + [("free", 0, 500, None)], "g string, ts int, points long, cap long")
    out = accrual.apply_cap(tx, ["g"], "cap", "points", ["ts"])
    assert rows(out.where("g = 'g'").orderBy("ts"), "credited") == [(60,), (30,), (10,), (0,)]
    assert rows(out.where("g = 'free'"), "credited") == [(500,)]
    assert rows(accrual.cap_excess(out).orderBy("ts"), "excess") == [(20,), (5,)]


def test_campaign_cap(spark):
    tx = spark.createDataFrame([(i, "c1", "visa", dt.datetime(2025, 7, d), p) for i, (d, p) in enumerate(((1, 1000), (15, 400), (31, 300)))] + [(9, "c1", "visa", dt.datetime(2025, 8, 1), 50), (8, "c2", "visa", dt.datetime(2025, 7, 2), 50)], "key int, client_id string, brand string, ts timestamp, credited long")
    camp = spark.createDataFrame([("C", "visa", D(2025, 7, 1), D(2025, 7, 31), 2, 1500)], "campaign_id string, brand string, starts date, ends date, factor int, client_cap int")
    out = accrual.apply_campaigns(tx, camp, spark.createDataFrame([("C", "c1")], "campaign_id string, client_id string"), ["ts", "key"])
    assert rows(out.orderBy("key"), "extra_credited") == [(1000,), (400,), (100,)]


@pytest.mark.parametrize("start, n, end", [(D(2025, 8, 1), 2, D(2025, 8, 5)), (D(2025, 8, 2), 2, D(2025, 8, 6)), (D(2025, 7, 31), 3, D(2025, 8, 5))])
def test_business_days(spark, start, n, end):
    import numpy as np

    got = spark.range(1).select(scalars.add_business_days(F.lit(start), F.lit(n)).alias("d")).first()["d"]
    assert got == np.busday_offset(start, n, roll="forward").astype(object)
    del end


def test_balance_threshold_is_strict(spark):
    balances = spark.createDataFrame([("a", D(2025, 1, 1), 500.0), ("b", D(2025, 1, 1), 2500.0)], "account_id string, month date, balance double")
    accounts = spark.createDataFrame([("a", "x", "super_cuenta_ahorro"), ("b", "x", "super_cuenta_ahorro")], "account_id string, client_id string, account_type string")
    clients = spark.createDataFrame([("x", "g", True)], "client_id string, group_id string, is_member boolean")
    out = accrual.balance_points(balances, accounts, clients, {"super_cuenta_ahorro": 500.0}, "super_cuenta_ahorro").orderBy("account_id")
    assert rows(out, "points") == [(0,), (5,)]


def test_as_of_state(spark):
    tx = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "client_id string, ts int")
    versions = spark.createDataFrame([("a", 2, "v1"), ("a", 5, "v2")], "client_id string, valid_from int, state string")
    assert sorted(rows(accrual.eligibility_as_of(tx, versions), "client_id", "ts", "state"), key=str) == [("a", 1, None), ("a", 5, "v2"), ("b", 3, None)]


def fold(order, requests, merged=None, cuts=()):
    lots = [("L24", D(2024, 1, 31), D(2026, 2, 5), 100), ("L25", D(2025, 1, 31), D(2027, 2, 5), 100)]
    out = ledger.fold_group(lots, [(r, day, client, points) for r, client, day, points in requests], "h", merged, list(cuts), order)
    left = {"L24": 0, "L25": 0} | {x[0]: x[3] for x in out if x[1] == "saldo"}
    moved = sum(x[3] for x in out if x[1] in ("acumulacion", "expiracion", "canje"))
    assert sum(left.values()) == moved
    return left, [x[5] for x in out if x[1] == "solicitud"]


def test_ledger_orders_and_reasons():
    ask = [("r", "h", D(2025, 6, 1), 120)]
    assert fold("fifo", ask) == ({"L24": 0, "L25": 80}, ["aprobado"])
    assert fold("lifo", ask) == ({"L24": 80, "L25": 0}, ["aprobado"])
    assert fold("fifo", [("r", "z", D(2025, 6, 1), 999)], D(2025, 1, 1))[1] == ["no_es_titular"]
    assert fold("fifo", [("r", "h", D(2025, 6, 1), 999)], D(2024, 7, 2))[1] == ["unificacion_menor_a_12_meses"]
    assert fold("fifo", [("r", "h", D(2025, 6, 1), 999)])[1] == ["saldo_insuficiente"]
    # On the day of the cut expired lots are gone before the request is judged.
    assert fold("fifo", [("r", "h", D(2026, 2, 5), 150)], cuts=[D(2026, 2, 5)]) == ({"L24": 0, "L25": 100}, ["saldo_insuficiente"])


def test_ledger_in_spark(spark):
    acc = spark.createDataFrame([("g", "consumo", D(2024, 1, 10), 60), ("g", "consumo", D(2024, 1, 20), 40), ("g", "campana", D(2024, 12, 1), 100)], "group_id string, origin string, credited_on date, points long")
    lots = ledger.build_lots(acc)
    assert {r["expires_on"] for r in lots.collect()} == {D(2026, 2, 5)} and lots.count() == 2
    groups = spark.createDataFrame([("g", "h", None)], "group_id string, holder_id string, merged_since date")
    asked = spark.createDataFrame([("r1", "g", "h", D(2025, 3, 1), 120)], "request_id string, group_id string, client_id string, date date, points long")
    moves, results, left = ledger.run_ledger(lots, asked, groups, [D(2026, 2, 5)])
    assert rows(results, "result") == [("aprobado",)] and ledger.check_ledger(left, moves).count() == 0
    assert moves.agg(F.sum("points")).first()[0] == 0


def test_neighbour_gaps_match_a_global_window(spark):
    miles = spark.createDataFrame([(i, 1000 + (i * 7919) % 5000, float(i % 13)) for i in range(60)], "group_id int, balance long, miles double")
    got = sorted(rows(audit.neighbour_gaps(miles, 1000, 7), "lower_group", "upper_group", "miles_gap"))
    order = sorted((r for r in rows(miles, "balance", "group_id", "miles") if r[0] > 1000))
    assert got == sorted((a[1], b[1], abs(b[2] - a[2])) for a, b in zip(order, order[1:]))


def test_row_filter(spark):
    df = spark.createDataFrame([(1, 2, 3, 4), (1, 2, 3, 4), (None, None, None, 1), (None, None, 3, 1), (11, 1, 1, 1), (None, 1, 1, 1)], "a int, b int, c int, d int")
    assert quality.row_filter(df, 0.5, {"a": (0, 10)}).count() == 3


def test_columns_are_dropped_where_they_are(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert quality.drop_if_present(df, ["b", "nope"]).columns == ["a", "c"] and quality.drop_if_present(df, []).columns == ["a", "b", "c"]


def test_promotions_of_members_and_phones(spark):
    tx = spark.createDataFrame([(D(2025, 1, 3), 100.0, "general", True, True), (D(2025, 1, 3), 100.0, "general", True, False), (D(2025, 1, 3), 9.0, "general", True, True)], "ts date, amount_gtq double, category string, is_member boolean, uses_mobile boolean")
    rule = {"starts": "2025-01-01", "ends": "2025-01-31", "min_ticket": 10, "mobile_only": True, "factor": 4}
    assert rows(accrual.promotion_factor(tx, [rule]), "factor") == [(4,), (1,), (1,)] and rows(accrual.promotion_factor(tx, []), "factor") == [(1,)] * 3


@pytest.mark.parametrize("seed", range(8))
def test_ledger_invariants(seed):
    """FIFO and LIFO redeem the same in total when nothing expires, and lots always equal movements."""
    import random

    rng = random.Random(seed)
    lots = [(f"L{i}", D(2024, 1 + i % 12, 28), D(2030, 2, 5), rng.randint(1, 90)) for i in range(12)]
    asked = [(f"r{i}", D(2024, rng.randint(1, 12), rng.randint(1, 28)), "h", rng.randint(1, 150)) for i in range(15)]
    spent = {}
    for order in ("fifo", "lifo"):
        out = ledger.fold_group(lots, asked, "h", None, [], order)
        spent[order] = sum(x[3] for x in out if x[1] == "canje")
        left = {x[0]: x[3] for x in out if x[1] == "saldo"}
        per_lot = {}
        for x in out:
            if x[1] in ("acumulacion", "canje"):
                per_lot[x[0]] = per_lot.get(x[0], 0) + x[3]
        assert {k: n for k, n in per_lot.items() if n} == left and min(per_lot.values()) >= 0
    assert spent["fifo"] == spent["lifo"]


def history(seed, families=9):
    """Lots and requests of several years, some without a family, some families without attributes."""
    import random

    rng = random.Random(seed)
    day = lambda: D(rng.randint(2022, 2026), rng.randint(1, 12), rng.randint(1, 28))
    family = lambda: rng.choice([f"g{i}" for i in range(families)] + [None])
    lots = [(f"L{i}", family(), (d := day()), D(d.year + 2, 2, 5), rng.randint(1, 90)) for i in range(150)]
    asked = [(f"r{i}", (g := family()), g if rng.random() < 0.8 else "other", day(), rng.randint(1, 120)) for i in range(150)]
    groups = [(f"g{i}", f"g{i}", day() if i % 3 == 0 else None) for i in range(families - 1)]
    return lots, asked, groups


@pytest.mark.parametrize("order", ["fifo", "lifo"])
def test_ledger_folded_month_by_month_equals_folded_once(spark, order):
    lots, asked, groups = history(3)
    tables = lambda lots, asked: (spark.createDataFrame(lots, "lot_id string, group_id string, available_from date, expires_on date, points long"), spark.createDataFrame(asked, "request_id string, group_id string, client_id string, date date, points long"))
    known = spark.createDataFrame(groups, "group_id string, holder_id string, merged_since date")
    cuts = [D(y, 2, 5) for y in range(2023, 2029)]
    moves, results, left = ledger.run_ledger(*tables(lots, asked), known, cuts, order)
    want = sorted(rows(moves, "lot_id", "group_id", "type", "date", "points", "request_id"), key=str), sorted(rows(results, "request_id", "group_id", "date", "points", "result"), key=str)
    assert len(set(rows(results, "result"))) == 4 and ledger.check_ledger(left, moves).count() == 0
    books, got_moves, got_results = None, [], []
    edges = [D(2000, 1, 1), D(2023, 2, 4), D(2024, 2, 5), D(2025, 6, 30), D(2026, 3, 31), D(2030, 1, 1)]
    for after, until in zip(edges, edges[1:]):
        part = tables([x for x in lots if after < x[2] <= until], [x for x in asked if after < x[3] <= until])
        some, judged, books = ledger.advance_ledger(books, *part, known, [c for c in cuts if after < c <= until], order)
        got_moves += rows(some, "lot_id", "group_id", "type", "date", "points", "request_id")
        got_results += rows(judged, "request_id", "group_id", "date", "points", "result")
        books = spark.createDataFrame(books.collect(), ledger.BOOKS)  # the stored books
    assert (sorted(got_moves, key=str), sorted(got_results, key=str)) == want
    held = {x[0]: x[1] for x in rows(left, "lot_id", "remaining") if x[1]}
    assert held == dict(rows(books, "lot_id", "remaining"))


def test_requests_without_a_family_are_refused(spark):
    lots = spark.createDataFrame([("L", None, D(2024, 1, 31), D(2026, 2, 5), 10)], "lot_id string, group_id string, available_from date, expires_on date, points long")
    asked = spark.createDataFrame([("r", None, None, D(2024, 5, 1), 5)], "request_id string, group_id string, client_id string, date date, points long")
    groups = spark.createDataFrame([(None, "h", None)], "group_id string, holder_id string, merged_since date")
    moves, results, left = ledger.run_ledger(lots, asked, groups, [])
    assert rows(results, "result") == [("no_es_titular",)] and rows(left, "remaining") == [(10,)] and moves.count() == 1
    empty = ledger.run_ledger(lots.where("false"), asked.where("false"), groups.where("false"), [D(2026, 2, 5)])
    assert [x.count() for x in empty] == [0, 0, 0]


def test_caps_of_a_heavy_account_equal_one_by_one(spark):
    """One account holds 90 % of the rows; caps feed each other; null keys, null caps, null days."""
    import random

    rng = random.Random(5)
    data = []
    for i in range(4000):
        account = "heavy" if rng.random() < 0.9 else rng.choice(["a", "b", None])
        data.append((i, account, D(2024, rng.randint(1, 4), rng.randint(1, 28)) if rng.random() < 0.99 else None, rng.choice([0, 1, 5, 40, 300])))
    tx = spark.createDataFrame(data, "key int, who string, ts date, points long")
    caps = [("day", F.to_date("ts"), 700), ("month", F.trunc("ts", "MM"), 9000), ("ever", F.lit(1), 25000)]
    got = {r["key"]: r["credited"] for r in accrual.apply_caps(tx, ["who"], [(n, p, F.lit(c)) for n, p, c in caps], "points", ["ts", "key"]).collect()}
    used, want = {}, {}
    for key, who, ts, points in sorted(data, key=lambda x: (x[2] is not None, x[2] or D(1, 1, 1), x[0])):
        for name, period, cap in (("day", ts, 700), ("month", ts and (ts.year, ts.month), 9000), ("ever", 1, 25000)):
            taken = used.get((who, name, period), 0)
            points = min(points, cap - taken)
            used[who, name, period] = taken + points
        want[key] = points
    assert got == want and len(got) == 4000
    room = {(r["who"], r["cap"], r["period"]): (r["used"], r["room"]) for r in accrual.cap_room(tx, ["who"], [(n, p, F.lit(c)) for n, p, c in caps], "points", ["ts", "key"]).collect()}
    limit = {"day": 700, "month": 9000, "ever": 25000}
    period = lambda p: "" if p is None else str(p) if not isinstance(p, tuple) else f"{p[0]}-{p[1]:02d}-01"
    assert room == {(who, name, period(p)): (n, limit[name] - n) for (who, name, p), n in used.items()}
    single = accrual.apply_cap(tx.withColumn("cap", F.when(F.col("who") != "a", 500)), ["who"], "cap", "points", ["ts", "key"])
    sums = {r["who"]: (r["p"], r["c"]) for r in single.groupBy("who").agg(F.sum("points").alias("p"), F.sum("credited").alias("c")).collect()}
    assert sums["a"][0] == sums["a"][1] and sums["heavy"][1] == 500 and sums[None][0] == sums[None][1]


def test_no_task_holds_a_whole_heavy_account(spark):
    tx = spark.range(40_000).select(F.col("id").alias("key"), F.lit("one").alias("who"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("ts"), F.lit(1).alias("points"), F.lit(30_000).alias("cap"))
    out = accrual.apply_cap(tx, ["who"], "cap", "points", ["ts", "key"], F.year("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        most = max(r["count"] for r in out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert most < 20_000 and out.agg(F.sum("credited")).first()[0] == 30_000
