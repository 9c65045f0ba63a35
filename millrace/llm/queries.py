"""The numbered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe_stream, lang_crf, multiprobe, oracles, periodic_runs, phrases, quality_model, quality_rules, secret_scan, simhash, source_mix, token_pack, url_rules, warc

#: Explicit rules on URLs: verdict, host, start of the path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.nearest(_read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"))


def op3_lang_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_crf.identify(_read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_read(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_report(_read(spark, sf_dir, "documents"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_read(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op9_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_documents(_read(spark, sf_dir, "documents"))


def op10_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_pack.pack_documents(_read(spark, sf_dir, "documents"))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_read(spark, sf_dir, "pages"), URL_RULES)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    found = [op1_multiprobe, op2_quality_rules, op3_lang_crf, op4_warc, op5_simhash, op6_source_mix, op7_quality_model, op8_secret_scan, op9_bpe_stream, op10_token_pack]
    found += [op11_url_rules, op12_phrases, op13_periodic_runs]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; the others are tested against brute force."""
    return {
        "op2_quality_rules": oracles.quality_rules_sql(), "op4_warc": oracles.WARC_SQL, "op6_source_mix": oracles.MIX_SQL,
        "op11_url_rules": oracles.url_rules_sql(URL_RULES), "op12_phrases": oracles.phrases_sql(),
    }
