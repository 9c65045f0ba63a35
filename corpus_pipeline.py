"""Documents to tokens: quality rules, near-duplicates, secrets, source mix, byte-pair encoding.

Each stage takes (spark, docs, sf_dir), calls one operator of millrace.llm, and returns a table that is
written as Parquet and read again as the next stage's docs.  All but the last return the columns of
documents, with the stage's decisions carried out: rejected documents and surplus near-duplicates are
gone, secrets are masked in the text, documents occur as often as the mix takes them.

Defined cases: null and wordless texts fail the quality rules; null ids are carried, and in a group of
near-duplicates a row with an id stays before one without; repeated rows are near-duplicates of one
another; extra columns are carried to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe_stream, near_copies, quality_rules, secret_scan, source_mix
from millrace.llm.common import materialize, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mix_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The stages' workers stay beside full heaps: they remember a quarter of what they do when they encode alone.
    return bpe_stream.encode_documents(docs, with_ids=True, share=0.25)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("source_mix", mix_stage),
    ("bpe_encode", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as written:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            # What the stage wrote for itself, and the stage before, are not read again.
            kept = written.pop()
            written += [stored] if stored else []
        stored = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: Byte-pair encoding has no SQL form and DuckDB no XXH64; tests compare run() with a brute-force version.
ORACLE_SQL = None


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
