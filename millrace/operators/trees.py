"""Regression trees of many keys at once, grown level by level on binned features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.stored import store


def _bin(value: Column, edges: list[float]) -> Column:
    """Number of edges that the value is above."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < value))


def even_edges(df: DataFrame, features: list[str], bins: int = 16) -> dict[str, list[float]]:
    """Edges of bins of equal width between each feature's least and largest value; one aggregation."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(features) for n, f in (("a", F.min), ("b", F.max))]).first()
    found = {}
    for i, c in enumerate(features):
        a, b = row[f"a_{i}"], row[f"b_{i}"]
        found[c] = [a + (b - a) * k / bins for k in range(1, bins)] if a is not None and b > a else []
    return found


def grow_trees(df: DataFrame, keys: list[str], edges: dict[str, list[float]], target: str, depth: int = 3, least: int = 20) -> DataFrame:
    """keys, node, n, value, feature, threshold, gain: one regression tree for each of very many keys.

    Rows meet once: they are aggregated to cells (key and one bin per feature) with count and sum of the target, with partials before
    the shuffle.  Every level is one aggregation of the cells of all keys by (key, node, feature, bin); the best split of each
    node has the largest gain of sum^2 / n, at least `least` rows on both sides, ties to the first feature, then the lowest edge.  Node 1
    is the root, node k has the children 2k (value <= threshold) and 2k + 1.  A key's cells number at most the product of its bins,
    whatever its rows.  Rows with a null feature or target are left out; a decimal target is summed exactly.  Leaves have no feature.
    """
    names = list(edges)
    usable = df.dropna(subset=[*names, target])
    cells = usable.groupBy(*keys, *[_bin(F.col(c).cast("double"), edges[c]).alias(f"_b{i}") for i, c in enumerate(names)]).agg(F.count(F.lit(1)).alias("_n"), F.sum(target).alias("_s"))
    cells = store(cells.withColumn("_node", F.lit(1)), "tree-cells")
    made = None
    for level in range(depth + 1):
        whole = cells.groupBy(*keys, "_node").agg(F.sum("_n").alias("n"), F.sum("_s").cast("double").alias("s"))
        if level == depth or not any(edges.values()):
            found = whole.select(*keys, F.col("_node").alias("node"), "n", (F.col("s") / F.col("n")).alias("value"), F.lit(None).cast("int").alias("f"), F.lit(None).cast("int").alias("b"), F.lit(None).cast("double").alias("gain"))
        else:
            found = _best_splits(cells, whole, keys, edges, least)
        found = store(found, "tree-level")
        made = found if made is None else made.unionByName(found)
        if level < depth:
            split = found.where("f is not null").select(*keys, F.col("node").alias("_node"), "f", "b")
            side = F.array(*[F.col(f"_b{i}") for i in range(len(names))])[F.col("f")] > F.col("b")
            below = cells.join(split, [*keys, "_node"]).withColumn("_node", 2 * F.col("_node") + side.cast("int"))
            cells = store(below.select(cells.columns), "tree-cells")
    feature = F.get(F.array(*[F.lit(c) for c in names]), F.col("f"))
    every = F.array(*[F.array(*[F.lit(float(e)) for e in edges[c]]) if edges[c] else F.array().cast("array<double>") for c in names])
    return made.select(*keys, "node", "n", "value", feature.alias("feature"), F.get(F.get(every, F.col("f")), F.col("b")).alias("threshold"), "gain")


def _best_splits(cells: DataFrame, whole: DataFrame, keys: list[str], edges: dict[str, list[float]], least: int) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"_b{i}").alias("b")) for i in range(len(edges))])
    bins = cells.select(*keys, "_node", "_n", "_s", F.inline(pairs)).groupBy(*keys, "_node", "f", "b").agg(F.sum("_n").alias("n"), F.sum("_s").alias("s"))
    by = Window.partitionBy(*keys, "_node", "f")
    upto = by.orderBy("b")
    run = bins.select(*keys, "_node", "f", "b", F.sum("n").over(upto).alias("nl"), F.sum("s").over(upto).cast("double").alias("sl"), F.sum("n").over(by).alias("n"), F.sum("s").over(by).cast("double").alias("s"), F.sum("s").over(upto).alias("_exact"), F.sum("s").over(by).alias("_all"))
    run = run.withColumn("nr", F.col("n") - F.col("nl")).withColumn("sr", (F.col("_all") - F.col("_exact")).cast("double"))
    gain = F.round(F.col("sl") * F.col("sl") / F.col("nl") + F.col("sr") * F.col("sr") / F.col("nr") - F.col("s") * F.col("s") / F.col("n"), 3)
    tried = run.where((F.col("nl") >= least) & (F.col("nr") >= F.greatest(F.lit(least), F.lit(1)))).withColumn("gain", gain).where("gain > 0")
    best = tried.groupBy(*keys, "_node").agg(F.max_by(F.struct("f", "b", "gain"), F.struct("gain", -F.col("f"), -F.col("b"))).alias("x"))
    joined = whole.join(best, [*keys, "_node"], "left")
    return joined.select(*keys, F.col("_node").alias("node"), "n", (F.col("s") / F.col("n")).alias("value"), "x.f", "x.b", "x.gain")


def predict_trees(df: DataFrame, trees: DataFrame, keys: list[str], features: list[str], depth: int, out: str = "forecast") -> DataFrame:
    """Adds the value of the leaf that each row falls into; null for keys without a tree and rows with a null feature.

    A key's tree is one map of at most 2^(depth + 1) nodes, so rows meet their tree in one join and then walk it.
    """
    node = F.struct("node", F.struct("feature", "threshold", "value").alias("at"))
    walk = trees.groupBy(*keys).agg(F.map_from_entries(F.collect_list(node)).alias("_tree"))
    joined = df.join(walk, keys, "left")

    def step(at: Column, _: Column) -> Column:
        here = F.element_at("_tree", at)
        value = F.coalesce(*[F.when(here["feature"] == c, F.col(c).cast("double")) for c in features])
        return F.when(here["feature"].isNull(), at).otherwise(2 * at + (value > here["threshold"]).cast("int"))

    at = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)
    known = F.lit(True)
    for c in features:
        known &= F.col(c).isNotNull()
    return joined.withColumn("_at", at).withColumn(out, F.when(known, F.element_at("_tree", F.col("_at"))["value"])).drop("_tree", "_at")
