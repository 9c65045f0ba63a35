"""Readers, catalogues and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import file_extension, file_name

READING = (
    "struct<fuel_type:string,price_gtq_per_gallon:double,confidence:double,ocr_engine:string,raw_text:string,is_valid:boolean,"
    "invalid_reason:string,crop_path:string,bbox:struct<x0:int,y0:int,x1:int,y1:int>,detection_method:string>"
)
EXTRACTION = f"file string, sha256 string, captured_at string, blurred_faces int, width int, height int, readings array<{READING}>"


def read_bronze_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every column as text, empty text kept, with the file's name and the time of ingest."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).csv(path, header=True)
    return raw.select(*columns, F.col("_metadata.file_name").alias("_archivo"), F.current_timestamp().alias("_ingestado_en")).na.fill("", subset=columns)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Replaces a derived table whole."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXTRACTION).json(path, multiLine=True)


def explode_readings(records: DataFrame) -> DataFrame:
    """One row per reading; a photo without readings keeps one row."""
    flat = records.select("file", "sha256", "captured_at", F.explode_outer("readings").alias("r"))
    return flat.select("file", "sha256", "captured_at", "r.*")


def file_catalog(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """Name, size, time and content hash of files; the content itself is dropped in the same projection."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = files.where(file_extension(F.col("path")).isin([e.lower() for e in extensions]))
    return kept.select("path", file_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("checksum"))


def parse_manifest(texts: DataFrame, column: str = "value", extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".heic")) -> DataFrame:
    """Whole manifest texts: plain lines with # comments, a JSON array, or {"images": [...]}; image links in order."""
    body = F.trim(F.col(column))
    plain = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    links = F.when(body.startswith("["), F.from_json(body, "array<string>")).when(body.startswith("{"), F.from_json(body, "images array<string>")["images"]).otherwise(plain)
    listed = texts.select(F.posexplode(links).alias("position", "link"))
    return listed.withColumn("name", file_name(F.col("link"))).where(file_extension(F.col("link")).isin(list(extensions)))


def normalize_link(url: Column) -> Column:
    """Shared-file links of three shapes to direct download; others unchanged."""
    ident = F.coalesce(F.nullif(F.regexp_extract(url, r"/file/d/([\w-]+)", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"[?&]id=([\w-]+)", 1), F.lit("")))
    boxed = F.regexp_replace(F.regexp_replace(url, r"([?&])dl=0", "$1dl=1"), r"^(https?://)www\.(dropbox\.com)", "$1www.$2")
    return F.when(url.contains("drive.google.com") & ident.isNotNull(), F.concat(F.lit("https://drive.google.com/uc?export=download&id="), ident)).when(url.contains("dropbox.com"), boxed).otherwise(url)


def with_cache_key(catalog: DataFrame) -> DataFrame:
    key = F.when(F.coalesce(F.col("checksum"), F.lit("")) != "", F.concat(F.lit("sum:"), F.col("checksum"))).otherwise(
        F.concat(F.lit("id:"), F.concat_ws("|", F.col("identifier"), F.coalesce(F.col("size").cast("string"), F.lit("")), F.coalesce(F.col("modified_at").cast("string"), F.lit(""))))
    )
    return catalog.withColumn("cache_key", key)


def pending(catalog: DataFrame, index: DataFrame, keys: list[str], limit: int | None = None, order: str = "identifier") -> DataFrame:
    """What the index does not have yet; `limit` is a feature: the batch size asked for."""
    fresh = catalog.join(index.select(*keys).distinct(), keys, "left_anti")
    return fresh.orderBy(order).limit(limit) if limit else fresh


#: How a reference-price page shows its figures. A number is a centred cell; the current price per litre and
#: per gallon are two such cells side by side after the currency, the price of a month ago follows its label.
PRICE_CELL = r'align="center">([\d.]+)</td>'
PRICE_PAIR = rf"(?s)GTQ.*?{PRICE_CELL}\s*<td[^>]*{PRICE_CELL}"
MONTH_AGO = rf"(?s)Hace un mes.*?{PRICE_CELL}"


def parse_price_pages(pages: DataFrame, html: str = "html", pair: str = PRICE_PAIR, ago: str = MONTH_AGO) -> DataFrame:
    """Per-litre, per-gallon and month-ago price of a page, and the change in percent; null where a page does not show them.

    pair: pattern with two groups, per litre and per gallon; ago: pattern with one.
    """
    found = lambda pattern, group: F.regexp_extract(html, pattern, group).try_cast("double")
    litre, before = found(pair, 1), found(ago, 1)
    change = F.when(before > 0, F.round((litre - before) / before * 100, 2))
    return pages.withColumns({"per_litre": litre, "per_gallon": found(pair, 2), "month_ago": before, "change_pct": change})


def ingest_report(catalog: DataFrame, index: DataFrame, failures: DataFrame, key: str = "cache_key") -> DataFrame:
    """How many files of the catalogue are new (downloaded), known already (skipped) and lost (failed), with all three rows always there."""
    known, lost = index.select(key).distinct().withColumn("_known", F.lit(True)), failures.select(key).distinct().withColumn("_lost", F.lit(True))
    status = F.when(F.col("_known"), "skipped").when(F.col("_lost"), "failed").otherwise("downloaded")
    counted = catalog.join(known, key, "left").join(lost, key, "left").select(status.alias("status")).agg(
        *[F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("downloaded", "skipped", "failed")]
    )
    return counted.select(F.explode(F.create_map(*[x for s in counted.columns for x in (F.lit(s), F.coalesce(s, F.lit(0)))])).alias("status", "n"))


def features_to_map(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.withColumn(out, F.map_from_entries(F.array(*pairs))).drop(*columns)


def features_to_columns(df: DataFrame, keys: list[str], column: str = "features") -> DataFrame:
    return df.withColumns({k: F.try_element_at(F.col(column), F.lit(k)) for k in keys}).drop(column)


def rule_map(rules: dict, key: Column) -> Column:
    """Value of a small rule table for a key, null where it has none."""
    literal = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    return F.try_element_at(literal, key)
