"""Near copies by shared word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with equal sets are one node from the start.  SimHash comes first: the 64-bit majority votes of the sets meet at the
anchors of `simhash`, which link those that differ in two bits or fewer.  Sets at 0.8 differ in about nine bits, so
the links that fingerprints miss are added by min-wise hashing: 80 minima
in 20 bands of 4, so a pair at similarity 0.8 shares a band with probability 1 - (1 - 0.8^4)^20, which
misses 3 in 100,000, and more similar pairs are missed less.  Every candidate pair of either is settled by
the Jaccard similarity of the whole sets (shingles as 32-bit hashes), so no pair below the threshold
is linked.  Nodes of a band are first compared with three hubs of it, chosen by hash, unless the anchors' pairs settled that.  Pairs of a band
that are then still in different components are all settled too: in bands of at most FEW nodes one by
one, in larger ones block by block inside tasks, which return a spanning forest of the links found.  Thus
pairs inside a group are never listed, no task holds more than two blocks, and no candidate pair is left
open.

Defined cases: words are separated by blanks and compare without ASCII case; null, empty and wordless
texts are copies of one another; texts with fewer words than a shingle give one shingle of all words;
repeated shingles count once; of a component the row with the smallest id stays (of rows sharing it,
the smallest text); rows with a null id stay only where their component has no id; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import join_unique, materialize, scratch, unused_name
from millrace.llm.simhash import _Forest, components, link_prints

WIDTH, SIMILARITY, BANDS, ROWS, HUBS = 5, 0.8, 20, 4, 3
#: Nodes of a band whose pairs are joined; nodes of a block in larger bands; columns of the table of shingles held at once.
FEW, BLOCK, COLUMNS = 24, 256, 1 << 13


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct 64-bit shingle hashes of one text, in order."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    last = ends[min(width, len(words)) :]
    return np.unique(np.fromiter((xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(ends[:n], last, strict=True)), np.uint64, n))


def print_of(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a set of hashes, as a signed integer: a bit is 1 if set in over half of them; of none it is zero."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        some = np.ascontiguousarray(hashes[at : at + (1 << 14)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def _factors(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    odd, shift = (rng.integers(0, 1 << 64, bands * rows, np.uint64) for _ in range(2))
    return odd | np.uint64(1), shift


def band_keys(hashes: np.ndarray, odd: np.ndarray, shift: np.ndarray, bands: int) -> list[int]:
    """One signed key per band, of the band's minima."""
    from xxhash import xxh64_intdigest

    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):  # bounded memory for very long texts
        some = hashes[at : at + 2048]
        np.minimum(least, (odd[:, None] * (some ^ some >> np.uint64(29))[None, :] + shift[:, None]).min(1), out=least)
    digests = [xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(bands, -1))]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id, text_key, node (equal for equal sets), fp (SimHash of the set), size, bands and items (32-bit shingle hashes) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        odd, shift = _factors(BANDS, ROWS)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                nodes, prints, sizes, bands, items = [], [], [], [], []
                for text in batch.column(2).to_pylist():
                    hashes = shingles(text)
                    few = np.unique((hashes >> np.uint64(32)).astype(np.uint32)).view(np.int32)
                    nodes.append(xxh64_intdigest(hashes.tobytes(), 1))
                    prints.append(print_of(hashes))
                    sizes.append(len(few))
                    bands.append(band_keys(hashes, odd, shift, BANDS) if len(few) else [])
                    items.append(few)
                made = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "text_key", "node", "fp", "size", "bands", "items"])

    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("text_key"), "text")
    return narrow.mapInArrow(sketch, f"id {kind}, text_key long, node long, fp long, size int, bands array<bigint>, items array<int>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets reach the similarity."""
    mine = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    yours = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    both = pairs.join(mine, "a").join(yours, "b")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return both.where(shared >= F.lit(similarity) * (F.size("items_a") + F.size("items_b") - shared) - 1e-9).select("a", "b")


def _in_reach(one: str, other: str, similarity: float) -> Column:
    """Sizes alone do not rule out the similarity."""
    return F.least(one, other) >= F.lit(similarity) * F.greatest(one, other) - 1e-9


def anchor_pairs(sketched: DataFrame, rows: int | None = None) -> DataFrame:
    """Pairs a, b of nodes whose fingerprints SimHash links, far fewer than all: each node with the first of its fingerprint, and these along the anchors' links."""
    prints = materialize(sketched.where("size > 0").select("node", "fp").distinct(), "copies-prints", rows)
    held = materialize(prints.groupBy("fp").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")), "copies-anchored", rows)
    same = join_unique(prints, held.where("n > 1"), "fp", "n").where("node <> rep").select("rep", "node")
    links = materialize(link_prints(held), "copies-anchors", rows)
    of = lambda c: held.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}"))
    every = same.unionByName(links.join(of("a"), "a").join(of("b"), "b").select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("node")))
    return every.select(F.least("rep", "node").alias("a"), F.greatest("rep", "node").alias("b")).distinct()


def link_sketches(sketched: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """sketched (stored); nodes: node, n.  Links a, b that connect what is connected."""
    n = nodes.count()  # links, roots and sets are about as many
    anchored = materialize(anchor_pairs(sketched, n), "copies-anchored", n)
    every = sketched.select("node", "size", F.explode("bands").alias("band")).distinct()
    hub = lambda i: F.min(F.struct(F.xxhash64("node", F.lit(i)), "node", "size"))
    held = every.groupBy("band").agg(F.count(F.lit(1)).alias("many"), *[hub(i).alias(f"hub{i}") for i in range(HUBS)]).where("many > 1")
    hubs = materialize(held.select("band", "many", F.array_distinct(F.array(*[F.struct(F.col(f"hub{i}.node").alias("node"), F.col(f"hub{i}.size").alias("size")) for i in range(HUBS)])).alias("hubs")), "copies-hubs", n)
    places = hubs.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    met = materialize(join_unique(every, hubs, "band", "many"), "copies-bands", places)
    linked = anchored.select(F.explode(F.array("a", "b")).alias("node"))
    candidates = met.select("node").unionByName(linked).distinct().join(nodes, "node")
    rows = join_unique(sketched.select("node", "items", "bands"), candidates, "node", "n")
    sets = materialize(rows.dropDuplicates(["node"]), "copies-sets", n)
    pairs = met.select("node", "size", F.explode("hubs").alias("hub")).where((F.col("node") != F.col("hub.node")) & _in_reach("size", "hub.size", similarity))
    pairs = pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    pairs = pairs.join(anchored, ["a", "b"], "left_anti").unionByName(anchored)
    first = materialize(_similar(pairs, sets, similarity), "copies-links", n)

    # What the hubs left in different components of a band is compared pair by pair.
    stars = materialize(components(first, "copies-stars", rows=n), "copies-roots", n)
    placed = met.select("band", "node", "size").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialize(placed, "copies-placed", places)
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("held")).where("low <> high").select("band", "held")
    open_ = materialize(placed.join(mixed, "band"), "copies-open", places)
    x, y = (open_.where(F.col("held") <= FEW).select("band", *[F.col(c).alias(c + side) for c in ("node", "size", "root")]) for side in ("_x", "_y"))
    crossed = x.join(y, "band").where((F.col("node_x") < F.col("node_y")) & (F.col("root_x") != F.col("root_y")) & _in_reach("size_x", "size_y", similarity))
    crossed = crossed.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()
    few = materialize(_similar(crossed, sets, similarity), "copies-links", n)
    return first.unionByName(few).unionByName(_block_links(open_.where(F.col("held") > FEW), sets, similarity))


def _block_links(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between nodes of different components in large bands; cells of two blocks by hash, so a cell is bounded however large the band."""
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    own = open_.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("band", "node", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(sets, "node")

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        bands, size, root = np.stack(cell["bands"].to_numpy()), cell["items"].map(len).to_numpy(), cell["root"].to_numpy()
        own, node, n = cell["own"].to_numpy(), cell["node"].to_numpy(), len(cell)
        here = int(np.flatnonzero(bands[0] == cell["band"].iloc[0])[0])
        apart = cell["i"].iloc[0] != cell["j"].iloc[0]
        wanted = np.triu(root[:, None] != root[None, :], 1) & ((own[:, None] != own[None, :]) | (not apart))
        wanted &= np.minimum(size[:, None], size[None, :]) >= similarity * np.maximum(size[:, None], size[None, :]) - 1e-9
        for k in range(here):  # the first band that two nodes share settles them
            wanted &= bands[:, None, k] != bands[None, :, k]
        forest = _Forest()
        if wanted.any():
            row = np.repeat(np.arange(n), size)
            code = np.unique(np.concatenate(cell["items"].to_numpy()), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            row, code = row[order], code[order]
            shared = np.zeros((n, n), np.float32)
            for at in range(0, int(code[-1]) + 1, COLUMNS):
                a, b = np.searchsorted(code, [at, at + COLUMNS])
                some = np.zeros((n, COLUMNS), np.float32)
                some[row[a:b], code[a:b] - at] = 1
                shared += some @ some.T
            alike = wanted & (shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-9)
            for a, b in zip(*np.nonzero(alike), strict=True):
                forest.join(int(node[a]), int(node[b]))
        return pd.DataFrame(forest.new, columns=["a", "b"]).astype("int64")

    return cells.groupBy("band", "i", "j").applyInPandas(compare, "a long, b long")


def _alive(docs: DataFrame, similarity: float) -> DataFrame:
    """id, text_key, root, rows of the rows that may stay; rows: how many share id and root."""
    sketched = materialize(sketches(docs), "copies-sketches")
    rows = sketched.count()
    nodes = materialize(sketched.groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "copies-nodes", rows)
    linked = materialize(components(link_sketches(sketched, nodes.select("node", "n"), similarity), "copies-components", rows=rows), "copies-linked", rows)
    least = linked.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("least"))
    joined = nodes.join(linked.join(least, "root"), "node", "left")
    owner = F.when(F.col("root").isNotNull(), F.col("least")).otherwise(F.col("rep"))
    placed = materialize(joined.select("node", "n", owner.alias("owner"), F.coalesce("root", "node").alias("root")), "copies-owners", rows)
    narrow = join_unique(sketched.select("id", "text_key", "node"), placed, "node", "n").where(F.col("id").eqNullSafe(F.col("owner")))
    by_text = narrow.groupBy("id", "text_key", "root").agg(F.count(F.lit(1)).alias("m"))
    same = by_text.groupBy("id", "root").agg(F.sum("m").alias("rows"))
    both = by_text.alias("t").join(same.alias("s"), F.col("t.id").eqNullSafe(F.col("s.id")) & (F.col("t.root") == F.col("s.root")))
    return both.select("t.id", "t.text_key", "t.root", "s.rows")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component of near copies."""
    names = {c: unused_name(docs, f"copies_{c}") for c in ("key", "root", "m", "n")}
    with scratch(docs.sparkSession) as written:
        alive = materialize(_alive(docs, similarity), "copies-alive")
        written.pop()  # all that is left of the search
    alive = alive.select("id", "text_key", F.col("root").alias(names["root"]), F.col("rows").alias(names["m"])).alias("s")
    # The survivors' ids pick the whole documents, which move once.
    d = docs.withColumn(names["key"], F.xxhash64("text")).alias("d")
    kept = d.join(alive, F.col("d.doc_id").eqNullSafe(F.col("s.id")) & (F.col(f"d.`{names['key']}`") == F.col("s.text_key")))
    kept = kept.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col(f"s.`{names['root']}`"), F.col(f"s.`{names['m']}`"))
    others = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy("doc_id", names["root"]).orderBy(F.col("text").asc_nulls_first(), *others)
    repeated = kept.where(F.col(names["m"]) > 1).withColumn(names["n"], F.row_number().over(first)).where(F.col(names["n"]) == 1)
    columns = [f"`{c}`" for c in docs.columns]
    return kept.where(F.col(names["m"]) == 1).select(*columns).unionByName(repeated.select(*columns))
