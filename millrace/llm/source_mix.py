"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words by weight; no source is repeated more than `max_repeat`
times, and what a capped source cannot take goes to the others by weight (water filling).  Within a
source with target/size = r, every document gets floor(r) certain whole copies; the words still missing
come from a sample of fixed size with unequal probabilities.  A document's inclusion probability p grows
with the square root of its size class (sizes from 4^j to 4^(j+1) - 1 weigh 2^j), scaled so that the
expected words of the sample are the words missing; classes whose p would exceed 1 are certain, and the
rest is scaled again (water filling once more, over the few size classes of a source).

The sample is drawn by Pareto order sampling: documents are ranked by q = (u / (1 - u)) / (p / (1 - p)),
u uniform from a hash of the id (of the text where there is none), and taken in rank order until the
words reach those missing; the sample ends at the document nearest to them.  Certain documents have q = 0.

The ranking is never sorted in one task: q / (1 + q) is cut into CUTS equal steps, words per (source,
cut) are pre-aggregated, running sums over those few rows find the one cut in which the sample ends, and
only that cut's rows are ranked.  It ends near q = 1, where a cut holds about 1/CUTS of a source's rows.

Defined cases: null or wordless text has size 0 and is taken 0 words; null source is a source of its
own, last in order; a source without words has target 0; repeated rows are separate documents, equal
ranks go by id, then size; documents alike in id, source, size and u share their copies in the order of
all their columns; an empty table gives an empty result; other columns are ignored by `mix_report` and
carried unchanged by `mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize, small, unused_name, words_of

#: Cuts of the rank.
CUTS = 4096
_UNIT = float(1 << 52)


def uniform_from_id(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """Number in (0, 1) that depends on the id alone (on the text where the id is null): 52 bits of an MD5."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    digest = F.md5(F.concat(F.lit(seed + ":"), key))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(_UNIT)


def with_sizes(docs: DataFrame, size: str, u: str) -> DataFrame:
    """Adds the number of words and the uniform number of every document."""
    return docs.withColumn(size, F.size(words_of(F.col("text"))).cast("long")).withColumn(u, uniform_from_id(F.col("doc_id"), F.col("text")))


def size_class(size: Column) -> Column:
    """The j with 4^j <= size < 4^(j+1); 0 for size 0."""
    return F.floor((F.length(F.bin(size)) - 1) / 2).cast("int")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """One row per source: source, source_size, target.  sizes: source, size."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights) + 1
    table = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank.cast("int")))
    # Sources reach their cap in order of cap / weight; those before the first one that fits are capped.
    # The level grows up to that one and falls after it, so the largest level that fits is its level.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.lit(max_repeat) * F.col("source_size")
    table = (
        table.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped_before", F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_from", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_from"))
        .withColumn("fits", F.col("weight") * F.col("level") <= cap)
        .withColumn("final_level", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("fits"), F.col("weight") * F.col("final_level")).otherwise(cap.cast("double"))
    return table.select("source", "source_size", F.least(target, cap.cast("double")).alias("target"))


def inclusion(plan: DataFrame, sizes: DataFrame) -> DataFrame:
    """plan: one row per source, with rest.  One row per source and size class, with p, the inclusion probability.

    Classes are few (an integer's bits), so a source's window has a few rows however many documents it has.
    """
    classes = sizes.groupBy(F.col("source").alias("of"), size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    table = classes.join(plan, F.col("of").eqNullSafe(F.col("source"))).drop("of").withColumn("weight", F.pow(F.lit(2.0), F.col("class")).cast("long"))
    # Larger classes reach certainty first; those before the first one that fits are certain.
    down = Window.partitionBy("source").orderBy(F.col("class").desc())
    table = (
        table.withColumn("certain_words", F.sum("words").over(down) - F.col("words"))
        .withColumn("open_weight", F.sum(F.col("words") * F.col("weight")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", F.when(F.col("open_weight") > 0, (F.col("rest") - F.col("certain_words")) / F.col("open_weight")).otherwise(0.0))
        .withColumn("fits", F.col("weight") * F.col("level") <= 1)
        .withColumn("final", F.max(F.when(F.col("fits"), F.struct("class", "level"))).over(Window.partitionBy("source"))["level"])
    )
    p = F.when(F.col("fits"), F.greatest(F.col("weight") * F.col("final"), F.lit(1e-12))).otherwise(1.0)
    return table.select(*plan.columns, "class", p.alias("p"))


def mix_sizes(sizes: DataFrame, weights=(5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """sizes: doc_id, source, size, u (read several times, so pass a stored table).

    Returns doc_id, source, size, u, source_size, target, copies.
    """
    targets = source_targets(sizes, weights, max_repeat)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("whole", F.floor(ratio + 1e-12).cast("long")).withColumn(
        "rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    )
    # Few rows a source; rows of documents stay where they are, so a hot source is no hot task.
    classes = small(materialize(inclusion(plan, sizes), "mix-classes"))
    of_class = F.col("s.source").eqNullSafe(F.col("p.source")) & (size_class(F.col("s.size")) == F.col("p.class"))
    ranked = sizes.alias("s").join(classes.alias("p"), of_class).select("s.*", *[f"p.{c}" for c in ("source_size", "target", "whole", "rest", "p")])
    q = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    ranked = ranked.withColumn("q", q).withColumn("cut", F.floor(F.col("q") / (1 + F.col("q")) * CUTS).cast("int"))
    ranked = materialize(ranked, "mix-ranked")
    per_cut = ranked.groupBy("source", "cut").agg(F.sum("size").alias("cut_words"), F.first("rest").alias("rest"))
    running = per_cut.withColumn("before", F.sum("cut_words").over(Window.partitionBy("source").orderBy("cut")) - F.col("cut_words"))
    # One row per source: the cut in which the sample ends, and the words before it.
    ends = running.where(F.col("before") + F.col("cut_words") > F.col("rest")).groupBy("source").agg(F.min(F.struct("cut", "before")).alias("end"))
    ends = small(materialize(ends, "mix-ends"))
    joined = ranked.alias("k").join(ends.alias("e"), F.col("k.source").eqNullSafe(F.col("e.source")), "left").select("k.*", "e.end")
    # Only the cut in which the sample ends is ranked row by row.
    open_cut = F.coalesce(F.col("cut") == F.col("end.cut"), F.lit(False))
    rank = Window.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_last(), "size")
    inside = joined.where(open_cut).withColumn("prior", F.col("end.before") + F.sum("size").over(rank.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    taken_inside = F.when(F.col("prior") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)
    taken_outside = F.when(F.coalesce(F.col("cut") < F.col("end.cut"), F.lit(True)), 1).otherwise(0)
    keep = ["doc_id", "source", "size", "u", "source_size", "target"]
    return inside.select(*keep, (F.col("whole") + taken_inside).alias("copies")).unionByName(
        joined.where(~open_cut).select(*keep, (F.col("whole") + F.when(F.col("rest") > 0, taken_outside).otherwise(0)).alias("copies"))
    )


def mix_report(docs: DataFrame, weights=(5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of documents."""
    sizes = materialize(with_sizes(docs.select("doc_id", "source", "text"), "size", "u").drop("text"), "mix-sizes")
    mixed = mix_sizes(sizes, weights, max_repeat)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights=(5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """The mixed corpus itself: every document as often as the mix takes it, columns unchanged.

    Copies are joined back by (doc_id, source, size, u); rows alike in all of them are told apart by
    their other columns, so each is repeated as planned.
    """
    size, u, n, rows = (unused_name(docs, f"mix_{x}") for x in ("size", "u", "copies", "rows"))
    sized = with_sizes(docs, size, u)
    sizes = materialize(sized.select("doc_id", "source", F.col(size).alias("size"), F.col(u).alias("u")), "mix-sizes")
    plan = (
        mix_sizes(sizes, weights, max_repeat)
        .groupBy("doc_id", "source", "size", "u")
        .agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
        .where((F.col("copies") > 0) & (F.col("size") > 0))
    )
    d, p = sized.alias("d"), plan.alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col(f"d.`{size}`") == F.col("p.size")) & (F.col(f"d.`{u}`") == F.col("p.u"))
    joined = d.join(p, same).select("d.*", F.col("p.copies").alias(n), F.col("p.rows").alias(rows))
    # Rows alike share their copies evenly: the first `copies mod rows` of them get one more.
    others = [F.to_json(F.struct(f"`{c}`")) for c in docs.columns if c not in ("doc_id", "source", "text")]
    alike = Window.partitionBy("doc_id", "source", size, u).orderBy(F.col("text"), *others)
    single = joined.where(F.col(rows) == 1)
    many = joined.where(F.col(rows) > 1).withColumn(n, F.floor(F.col(n) / F.col(rows)) + F.when(F.row_number().over(alike) <= F.col(n) % F.col(rows), 1).otherwise(0))
    both = single.unionByName(many).where(F.col(n) > 0)
    out = both.withColumn(n, F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int"))))
    return out.select(*[f"`{c}`" for c in docs.columns])
