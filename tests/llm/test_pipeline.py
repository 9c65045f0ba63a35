"""The pipeline against a brute-force version on a small corpus."""

import collections
import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe_stream, quality_rules, secret_scan, source_mix

from .test_near_copies import brute_keep
from .test_operators import WORD, brute_mix, brute_spans, documents


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()
    keep = set(brute_keep([(r["doc_id"], r["text"]) for r in first]))
    alive = [r for r in first if r["doc_id"] in keep]
    assert all(not brute_spans(r["text"]) for r in alive)
    size, target = brute_mix(alive)
    library = Tokenizer.from_file(bpe_stream.tokenizer_file())
    text = {r["doc_id"]: r for r in alive}
    words, longest = collections.Counter(), collections.Counter()
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for r in out:
        ids = library.encode(text[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]]["text"].encode()).hexdigest()
        n = len(WORD.findall(text[r["doc_id"]]["text"]))
        words[text[r["doc_id"]]["source"]] += n
    for r in alive:
        longest[r["source"]] = max(longest[r["source"]], len(WORD.findall(r["text"])))
    for s in size:
        assert abs(words[s] - target[s]) <= longest[s] / 2 + 1e-6
    assert max(collections.Counter(r["doc_id"] for r in out).values()) <= 3


def test_pipeline_rows_without_id_repeats_and_empty_tables(spark, tmp_path):
    docs = documents(spark)  # null ids, repeated rows, clashing columns
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() > 10
    (tmp_path / "none").mkdir()
    docs.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_on_empty_tables_and_their_own_names(spark):
    """Each stage's function with columns named like its helpers, and without rows."""
    docs = documents(spark)
    for name in ("quality_stats", "quality_votes", "secret_scan", "copies_key", "copies_root", "copies_m", "copies_n", "mix_size", "mix_rows", "votes", "f", "s"):
        docs = docs.withColumn(name, F.lit(1))
    for stage in (quality_rules.keep_good, secret_scan.redact, source_mix.mix_documents, lambda d: corpus_pipeline.near_duplicate_stage(spark, d, "")):
        assert stage(docs.where("false")).count() == 0
        got = stage(docs)
        assert got.columns == docs.columns and got.count() > 0
