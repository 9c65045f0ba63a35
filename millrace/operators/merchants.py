"""Merchant codes: catalogue by description, resolution, categories, work list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import normalize_description


def build_catalog(tx: DataFrame, description: str = "descr", code: str = "mcc", order: tuple[str, ...] = ("ts", "auth_code")) -> DataFrame:
    """First code seen for each normalised description.  Rows without a code go first, so '' is never a hot key."""
    coded = tx.where(F.coalesce(F.col(code), F.lit("")) != "")
    first = F.min_by(code, F.struct(*order))
    return coded.groupBy(normalize_description(F.col(description)).alias("descr_norm")).agg(first.alias("catalog_mcc"))


def resolve_code(tx: DataFrame, catalog: DataFrame, description: str = "descr", code: str = "mcc") -> DataFrame:
    """Adds mcc_resolved and mcc_source: propio, descripcion or sin_resolver.  Spark broadcasts the catalogue while it is small."""
    named = tx.withColumn("descr_norm", normalize_description(F.col(description)))
    own = F.nullif(F.col(code), F.lit(""))
    source = F.when(own.isNotNull(), "propio").when(F.col("catalog_mcc").isNotNull(), "descripcion").otherwise("sin_resolver")
    joined = named.join(catalog, "descr_norm", "left")
    return joined.withColumn("mcc_source", source).withColumn("mcc_resolved", F.coalesce(own, F.col("catalog_mcc"))).drop("catalog_mcc")


def categorize(tx: DataFrame, excluded: list[str], reduced: list[str], code: str = "mcc_resolved", kind: str = "kind", out: str = "category") -> DataFrame:
    """excluida > reducida > general; a null code is general."""
    within = lambda codes: F.coalesce(F.col(code).isin(codes), F.lit(False))
    is_excluded = within(excluded) | F.coalesce(F.col(kind) == "extrafinanciamiento", F.lit(False))
    return tx.withColumn(out, F.when(is_excluded, "excluida").when(within(reduced), "reducida").otherwise("general"))


def unresolved_worklist(tx: DataFrame, catalog: DataFrame, description: str = "descr", code: str = "mcc") -> DataFrame:
    """Descriptions that no code is known for, most frequent first."""
    blank = tx.where(F.coalesce(F.col(code), F.lit("")) == "").withColumn("descr_norm", normalize_description(F.col(description)))
    return blank.join(catalog, "descr_norm", "left_anti").groupBy("descr_norm").agg(F.count(F.lit(1)).alias("n"))


def merge_answers(catalog: DataFrame, answers: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(catalogue with confident answers added, answers to review).  answers: descr_norm, mcc, confidence; what is known stays."""
    sure = answers.where(F.col("confidence") >= threshold).groupBy("descr_norm").agg(F.max_by("mcc", F.struct("confidence", "mcc")).alias("catalog_mcc"))
    added = sure.join(catalog, "descr_norm", "left_anti")
    return catalog.unionByName(added.select(*catalog.columns)), answers.where(~F.coalesce(F.col("confidence") >= threshold, F.lit(False)))


def look_alikes(unknown: DataFrame, known: DataFrame, least: float = 0.5, name: str = "descr_norm") -> DataFrame:
    """descr_norm, match, score: for each unknown description the known one with the most similar words, if similarity is `least` or more.

    Similarity is the Jaccard index of the sets of words; ties go to the first name.  Two sets this similar share a word among the rarest
    n - ceil(least n) + 1 of each, so descriptions meet only on these words (words in order of their number of descriptions),
    never on common ones as long as a rarer one is left.  Repeated descriptions are one.
    """
    words = F.array_distinct(F.filter(F.split(F.col(name), r"\s+"), lambda x: x != ""))
    side = lambda df, s: df.select(name).where(F.col(name).isNotNull()).distinct().select(F.lit(s).alias("side"), name, words.alias("words"))
    both = side(unknown, 0).unionByName(side(known, 1)).where(F.size("words") > 0)
    held = both.select("side", name, F.explode("words").alias("word"))
    frequency = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ordered = held.join(frequency, "word").groupBy("side", name).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("words"))
    size = F.size("words")
    prefix = F.slice("words", F.lit(1), (size - F.ceil(F.lit(least) * size - 1e-9) + 1).cast("int"))
    filed = ordered.withColumn("word", F.explode(prefix))
    a = filed.where("side = 0").select("word", F.col(name).alias("a"), F.col("words").alias("aw"))
    b = filed.where("side = 1").select("word", F.col(name).alias("b"), F.col("words").alias("bw"))
    shared = F.size(F.array_intersect("aw", "bw"))
    longer, shorter = F.greatest(F.size("aw"), F.size("bw")), F.least(F.size("aw"), F.size("bw"))
    met = a.join(b, "word").where(shorter >= F.lit(least) * longer - 1e-9)
    scored = met.withColumn("score", shared / (F.size("aw") + F.size("bw") - shared)).where(F.col("score") >= least - 1e-9)
    best = scored.groupBy("a").agg(F.max("score").alias("score"), F.min_by("b", F.struct(-F.col("score"), "b")).alias("match"))
    return best.select(F.col("a").alias(name), "match", "score")


def propose_codes(unknown: DataFrame, catalog: DataFrame, least: float = 0.5) -> DataFrame:
    """Answers (descr_norm, mcc, confidence) for `merge_answers`: the code of the most similar known description and its similarity."""
    found = look_alikes(unknown, catalog, least)
    codes = catalog.select(F.col("descr_norm").alias("match"), F.col("catalog_mcc").alias("mcc"))
    return found.join(codes, "match").select("descr_norm", "mcc", F.col("score").alias("confidence"), "match")
