import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import evaluate, features, gapfill, lineage, ml, prices, quality
from millrace.sources import io
from millrace.streaming import jobs

D = dt.date


def series(spark, values, key="regular"):
    return spark.createDataFrame([(key, D(2026, 1, 5) + dt.timedelta(7 * i), v, "ocr" if v is not None else None) for i, v in enumerate(values)], "fuel_type string, date date, price double, method string")


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_gap_fill(spark):
    out = gapfill.fill_missing(series(spark, [None, 1.0, None, None, 4.0, None]), "fuel_type", "date", "price")
    assert column(out, "price") == [1, 1, 2, 3, 4, 4]
    assert column(out, "method") == ["interpolated", "ocr", "interpolated", "interpolated", "ocr", "interpolated"]
    inner = gapfill.fill_missing(series(spark, [None, 40.0, None, 42.0]), "fuel_type", "date", "price", fill_edges=False)
    assert column(inner, "price") == [None, 40, 41, 42]
    two = series(spark, [40.0, None]).unionByName(series(spark, [60.0, 62.0], "diesel")).unionByName(series(spark, [None], "super"))
    out = gapfill.fill_missing(two, "fuel_type", "date", "price", "median")
    assert column(out.where("fuel_type = 'regular'"), "price") == [40, 40] and column(out.where("fuel_type = 'super'"), "method") == [None]
    with pytest.raises(ValueError):
        gapfill.fill_missing(two, "fuel_type", "date", "price", "guess")


def test_features_do_not_leak(spark):
    out = features.price_features(series(spark, [30.0 + i for i in range(10)]))
    assert column(out, "lag_1")[4] == 33 and column(out, "target_price_h1")[0] == 31 and column(out, "target_price_h1")[-1] is None
    assert column(out, "rolling_mean_3")[:4] == [None, None, None, 31] and column(out, "target_trend_h1")[-1] == "stable"


@pytest.mark.parametrize("total, volume, unit, expected", [(197.5, 5.0, "gallon", 39.5), (197.5, 18.927, "litre", 39.5), (1975.0, 5.0, "gallon", None), (5.0, 5.0, "gallon", None), (None, 5.0, "gallon", None), (197.5, None, "gallon", None), (197.5, 0.0, "gallon", None), (-10.0, 5.0, "gallon", None)])
def test_recovery(spark, total, volume, unit, expected):
    df = spark.createDataFrame([(total, volume, unit)], "t double, v double, u string")
    got = prices.recover_unit_price(df, "t", "v", F.col("u")).first()
    assert (got["unit_price"] is None) == (expected is None) and (expected is None or abs(got["unit_price"] - expected) <= 0.02)
    assert got["method"] == (None if expected is None else "arithmetic")


def test_validation_order(spark):
    df = spark.createDataFrame([(None, 0.1), (40.0, 0.5), (90.0, 0.9), (40.0, 0.9)], "price double, confidence double")
    out = quality.validate_readings(df)
    assert [r["invalid_reason"] for r in out.collect()] == ["ocr_failed", "low_confidence(0.50)", "out_of_plausible_range(90.0)", None]
    assert [r["price"] for r in out.collect()] == [None, None, None, 40.0]


def test_decimal_place(spark):
    df = spark.createDataFrame([("4009",), ("40.09",), ("409",), ("4?09",)], "t string")
    got = [r["x"]["text"] for r in df.select(scalars.place_decimal(F.col("t"), only_if_unparsed=False).alias("x")).collect()]
    assert got == ["40.09", "40.09", "409", "4?09"]


def test_overlay_measured_wins(spark):
    grid = spark.createDataFrame([("a", D(2026, 1, 5), 1.0), ("a", D(2026, 1, 12), 1.0)], "fuel_type string, date date, price double")
    measured = spark.createDataFrame([("a", D(2026, 1, 5), 9.0, "ocr")], "fuel_type string, date date, price double, method string")
    out = prices.overlay(grid, measured, ["fuel_type", "date"])
    assert column(out, "price") == [9, 1] and column(out, "source") == ["real", "synthetic"] and column(out, "method") == ["ocr", "synthetic"]


def test_cutoff_precedence(spark):
    df = spark.createDataFrame([(D(2026, 1, 5),)], "date date")
    first = lambda *a: prices.cutoff(df, *a).first()["cutoff"]
    assert first("2026-03-01", "2026-02-01") == D(2026, 3, 1) and first(None, "2026-02-01") == D(2026, 2, 1) and first() == D(2026, 1, 5)
    assert prices.cutoff(df.where("false")).first()["warn"]


def test_forecast_evaluation(spark):
    s = series(spark, [30 + 0.08 * i for i in range(44)]).withColumn("source", F.lit("real"))
    rows = evaluate.training_rows(features.price_features(s), ["fuel_type"], ["lag_1", "rolling_mean_3"], "target_price_h1", 20)
    train, test = evaluate.last_n_split(rows, "fuel_type", "date", 6)
    assert test.count() == 6
    out = ml.predict_linear(test, ml.linear_per_key(train, ["fuel_type"], ["lag_1"], "target_price_h1"), ["fuel_type"], ["lag_1"]).withColumn("target", F.col("target_price_h1"))
    scored = evaluate.evaluate_forecasts(out, ["fuel_type"])
    assert scored.first()["mae"] < 1e-3 and scored.first()["data_source"] == "real"
    assert {r["status"] for r in evaluate.quality_gate(scored, ["fuel_type"]).collect()} == {"pass"}


def test_recommendation(spark):
    got = evaluate.recommend(spark.createDataFrame([(35.0, 35.5, True), (35.0, 35.5, False)], "price double, forecast double, model_wins boolean"), 18).collect()
    assert (got[0]["action"], got[0]["trend"], got[0]["peak_hour"]) == ("refuel_now", "up", True) and got[1]["warning"] == "persistence_used"


def test_lineage(spark):
    gold = spark.createDataFrame([(D(2026, 8, 15), "regular", "ocr", 1), (D(2026, 8, 22), "regular", "median_imputed", None), (D(2026, 8, 29), "super", "arithmetic", 2)], "observed_on date, fuel_type string, method string, silver_price_id long")
    silver = spark.createDataFrame([(1, 10, "ocr"), (2, None, "arithmetic")], "id long, price_reading_id long, method string")
    readings = spark.createDataFrame([(10, 5, 7)], "id long, image_crop_id long, extraction_run_id long")
    crops, runs, images = (spark.createDataFrame(r, s) for r, s in (([(5,)], "id long"), ([(7, 3)], "id long, image_id long"), ([(3, "IMG.jpg")], "id long, original_name string")))
    out = lineage.trace(gold, silver, readings, crops, runs, images)
    assert [r["breaks"] for r in out.orderBy("observed_on").collect()] == [[], ["no source price"], ["no source reading: arithmetic"]]
    assert lineage.trace_one(out, "2026-08-15", "regular").first()["image"]["original_name"] == "IMG.jpg"
    assert lineage.coverage(out.where("fuel_type = 'regular'")).where("method is null").first()["pct"] == 50.0


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    f = lambda df: lineage.fingerprint(df).first()
    assert f(a) == f(a.orderBy("b", ascending=False)) and f(a) != f(a.limit(1))


def test_sources(spark, tmp_path):
    (tmp_path / "b.csv").write_text("id,monto\n1,\n2,\"1,5\"\n")
    assert sorted(r["monto"] for r in io.read_bronze_csv(spark, str(tmp_path / "b.csv"), ["id", "monto"]).collect()) == ["", "1,5"]
    record = {"file": "a.jpg", "sha256": "s", "readings": [{"fuel_type": "diesel", "price_gtq_per_gallon": 40.5}, {"fuel_type": "super"}]}
    (tmp_path / "r.json").write_text(json.dumps(record, indent=1))
    assert io.explode_readings(io.read_extractions(spark, str(tmp_path / "r.json"))).count() == 2
    (tmp_path / "img").mkdir()
    for name in ("a.HEIC", "b.txt"):
        (tmp_path / "img" / name).write_bytes(b"x")
    assert [r["name"] for r in io.file_catalog(spark, str(tmp_path / "img"), [".heic"]).collect()] == ["a.HEIC"]
    texts = spark.createDataFrame([("# note\nhttp://x/a.jpg\nhttp://x/b.txt",), ('["http://x/c.png"]',), ('{"images": ["http://x/d.jpeg?dl=0"]}',)], "value string")
    assert sorted(r["name"] for r in io.parse_manifest(texts).collect()) == ["a.jpg", "c.png", "d.jpeg"]
    links = spark.createDataFrame([("https://drive.google.com/file/d/AbC-1/view",), ("https://www.dropbox.com/s/q/a.jpg?dl=0",), ("http://x/a.jpg",)], "u string")
    assert [r[0] for r in links.select(io.normalize_link(F.col("u"))).collect()] == ["https://drive.google.com/uc?export=download&id=AbC-1", "https://www.dropbox.com/s/q/a.jpg?dl=1", "http://x/a.jpg"]
    cell = '<td align="center">%s</td>'
    shown = "<tr><td>GTQ</td>" + cell % "10.67" + "\n " + cell % "40.38" + "</tr><tr><td>Hace un mes</td>" + cell % "10.60" + "</tr>"
    page = spark.createDataFrame([(shown,), (shown.replace("10.60", "0"),), ("<p>nothing</p>",), (None,)], "html string")
    got = io.parse_price_pages(page).collect()
    assert (got[0]["per_litre"], got[0]["per_gallon"], got[0]["month_ago"], got[0]["change_pct"]) == (10.67, 40.38, 10.6, 0.66)
    assert got[1]["change_pct"] is None and got[2]["per_litre"] is None and got[3]["per_gallon"] is None
    catalog = io.with_cache_key(spark.createDataFrame([("i", 5, None, "abc"), ("j", 6, None, None)], "identifier string, size long, modified_at timestamp, checksum string"))
    assert [r["cache_key"] for r in catalog.orderBy("identifier").collect()] == ["sum:abc", "id:j|6|"]
    assert io.pending(catalog, catalog.where("identifier = 'i'"), ["cache_key"], 3).count() == 1


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("A", dt.datetime(2026, 1, 1)), ("A", dt.datetime(2026, 1, 1, 1)), ("B", dt.datetime(2026, 1, 2))], "auth_code string, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.ingest_files(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "ck"), 1).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    stream = jobs.dedupe_retries(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("deduped").count() == 2


def test_writer_replaces_the_whole_table(spark, tmp_path):
    path = str(tmp_path / "silver")
    df = lambda rows: spark.createDataFrame(rows, "k string, v int")
    io.write_table(df([("a", 1), ("b", 2)]), path, ["k"])
    assert (tmp_path / "silver" / "k=a").is_dir()
    io.write_table(df([("c", 3)]), path, ["k"])
    assert [tuple(r) for r in spark.read.parquet(path).select("k", "v").collect()] == [("c", 3)]
    io.write_table(df([("d", 4)]), str(tmp_path / "csv"), fmt="csv")
    assert spark.read.csv(str(tmp_path / "csv")).count() == 1


def test_price_texts(spark):
    df = spark.createDataFrame([("40.09",), (" 40 . 09",), ("Q4009",), ("4?09",), ("4.0.9",), ("4609",), (None,)], "t string")
    got = [tuple(r["r"]) for r in df.select(scalars.price_reading(F.col("t"), F.lit(0.8)).alias("r")).collect()]
    assert got == [(40.09, 0.8), (40.09, 0.8), (40.09, pytest.approx(0.68)), (None, 0.8), (None, 0.8), (4609.0, 0.8), (None, 0.8)]
    words = spark.createDataFrame([("SUPERM. LA TORRE",), ("GAS. X",), (None,)], "t string")
    assert [r[0] for r in words.select(scalars.expand_abbreviations(F.col("t"), {"SUPERM.": "SUPERMERCADO", "GAS.": "GASOLINERA"})).collect()] == ["SUPERMERCADO LA TORRE", "GASOLINERA X", None]


def test_panel_boxes_cut_off_and_fall_back(spark):
    photos = spark.createDataFrame([("a", 101, 51), ("new", 100, 50)], "file string, width int, height int")
    profiles = spark.createDataFrame([("usual", "diesel", [0.1, 0.2, 0.999, 0.99]), ("usual", "super", None), ("wide", "diesel", [0.5, 0.5, 1.0, 1.0])], "profile string, fuel_type string, box array<double>")
    out = prices.panel_boxes(photos, spark.createDataFrame([("a", "wide")], "file string, profile string"), profiles, "usual")
    got = {(r["file"], r["fuel_type"]): r["bbox"] for r in out.collect()}
    assert tuple(got["a", "diesel"]) == (50, 25, 101, 51) and tuple(got["new", "diesel"]) == (10, 10, 99, 49) and got["new", "super"] is None and len(got) == 3


def test_ingest_counts(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "cache_key string")
    report = lambda *a: {r["status"]: r["n"] for r in io.ingest_report(*a).collect()}
    assert report(keys("a", "b", "c"), keys("x"), keys("c")) == {"downloaded": 2, "skipped": 0, "failed": 1}
    assert report(keys("a", "b", "c"), keys("a", "b", "c"), keys()) == {"downloaded": 0, "skipped": 3, "failed": 0}


def test_fingerprint_ignores_order_and_sees_every_cell(spark):
    rows = [(1, "a", None), (2, None, "b"), (2, None, "b")]
    mark = lambda r: tuple(lineage.fingerprint(spark.createDataFrame(r, "k int, a string, b string")).first())
    assert mark(rows) == mark(rows[::-1]) and len({mark(rows), mark(rows[:2]), mark([(1, "a", ""), *rows[1:]]), mark([(1, None, "a"), *rows[1:]])}) == 4


def test_forward_folds_are_those_of_ntile(spark):
    from pyspark.sql import Window

    rows = [("a", i * 7919 % 1009) for i in range(500)] + [("b", i) for i in range(3)] + [(None, i) for i in range(11)]
    df = spark.createDataFrame(rows, "k string, t int")
    got = evaluate.forward_folds(df, "k", "t", 4, 16)
    want = df.withColumn("fold", F.ntile(5).over(Window.partitionBy("k").orderBy("t")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
    assert evaluate.forward_folds(df.where("false"), "k", "t", 4).count() == 0


def test_exact_median_and_mode(spark):
    rows = [(float(i * 7919 % 1009), "ab"[i % 2]) for i in range(501)] + [(300.0, None)] * 400 + [(None, "b")]
    df = spark.createDataFrame(rows, "v double, t string").repartition(3)
    values = sorted(v for v, _ in rows if v is not None)
    assert all(ml.value_at(df, "v", k, few=10, ranges=5) == values[k] for k in (0, 7, 450, len(values) - 1))
    assert ml.median(df, "v") == (values[450] + values[(len(values)) // 2]) / 2
    assert ml.fit_fill(df, ["v"], ["t"]) == {"v": ml.median(df, "v"), "t": "b" if sum(t == "b" for _, t in rows) > sum(t == "a" for _, t in rows) else "a"}
    assert ml.fit_fill(df.where("false"), ["v"], ["t"]) == {"v": None, "t": None}
