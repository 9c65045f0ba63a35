"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit majority votes of shingle hashes.  Two of them are linked when they differ in
at most two bits.  All links are found with anchors: the first 46 bits are two blocks of 23, and the
codewords of the perfect [23,12] Golay code (covering radius 3) are the anchors of a block.  A
fingerprint's home is the pair of codewords within radius 3 of its blocks; it also visits every pair
of codewords that a fingerprint within two bits could have as its home, that is those whose distances
exceed the radius by two at most in total.  Linked fingerprints therefore meet at both homes, and each
comparison is of one home fingerprint with one visitor of the same anchor.

Equal fingerprints are one node from the start, so groups of copies cost nothing.  An anchor's links
are reduced to a spanning forest where they are found, never listed as pairs of a group; components
are then found by large-star / small-star rounds over tables written to the shared folder.

Defined cases: null, empty and wordless texts have fingerprint zero, which links like any other;
texts with fewer words than a shingle give one shingle of all words; texts of any length are read
whole; rows with a null id have a fingerprint and a component, which is null if no linked row has an
id; repeated ids are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, join_unique, materialize, scratch, unused_name

BLOCK, RADIUS, MOST = 23, 3, 2
#: Generator polynomial of the Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint of one text, as a signed integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    last = ends[min(width, len(words)) :]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):  # bounded memory for very long texts
        hashes = np.fromiter((xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(ends[at : min(n, at + (1 << 14))], last[at:], strict=False)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, out: str = "fingerprint", width: int = 3) -> DataFrame:
    """Adds the fingerprint of `text` as a long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.withColumn(out, of(F.col("text")))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, ...]:
    """By syndrome: offsets into the error patterns of weight RADIUS + MOST at most, patterns, excess over RADIUS."""

    def remainder(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(BLOCK - 1, 10, -1):
            x ^= np.where(x >> bit & 1, GOLAY << (bit - 11), 0)
        return x

    patterns = [np.zeros(1, np.int64)]
    tops = [np.full(1, -1)]
    for _ in range(RADIUS + MOST):  # add a bit above the highest one
        grown = [(p | 1 << b, b) for b in range(BLOCK) for p in patterns[-1][tops[-1] < b].tolist()]
        patterns.append(np.array([p for p, _ in grown], np.int64))
        tops.append(np.array([b for _, b in grown]))
    every = np.concatenate(patterns)
    excess = np.concatenate([np.full(len(p), max(0, w - RADIUS)) for w, p in enumerate(patterns)])
    syndrome = remainder(every)
    order = np.lexsort((excess, syndrome))
    offsets = np.searchsorted(syndrome[order], np.arange(2**11 + 1))
    low, high = remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12)
    return offsets, every[order], excess[order], low, high


def _near(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block value all codewords in reach: row index, codeword, excess distance."""
    offsets, patterns, excess, low, high = _tables()
    syndrome = low[block & 0xFFF] ^ high[block >> 12]
    n = offsets[syndrome + 1] - offsets[syndrome]
    row = np.repeat(np.arange(len(block)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + offsets[syndrome][row]
    return row, block[row] ^ patterns[at], excess[at]


def anchors_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row index, anchor and whether it is the home, for every anchor that each fingerprint visits."""
    value = prints.view(np.uint64)
    first, second = ((value >> np.uint64(s) & np.uint64((1 << BLOCK) - 1)).astype(np.int64) for s in (0, BLOCK))
    row_a, code_a, over_a = _near(first)
    row_b, code_b, over_b = _near(second)
    n_b = np.bincount(row_b, minlength=len(prints))
    start_b = np.cumsum(n_b) - n_b
    reps = n_b[row_a]
    pick_a = np.repeat(np.arange(len(row_a)), reps)
    pick_b = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + start_b[row_a[pick_a]]
    over = over_a[pick_a] + over_b[pick_b]
    near = over <= MOST
    pick_a, pick_b = pick_a[near], pick_b[near]
    return row_a[pick_a], code_a[pick_a] << BLOCK | code_b[pick_b], over[near] == 0


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 4096):
            row, anchor, home = anchors_of(np.ascontiguousarray(prints[at : at + 4096]))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(~home), pa.array(prints[at + row])], ["anchor", "visits", "fp"])


class _Forest:
    """Union-find over numbers as they come; keeps the unions that were new."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.new: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.new.append((x, y))


def _compare(forest: _Forest, rows: np.ndarray, homes: np.ndarray) -> None:
    """Joins every row with every home fingerprint within MOST bits, in steps that grow as roots settle."""
    own = homes.view(np.int64).tolist()
    at, step = 0, 16
    while at < len(rows):
        step = max(1, min(step, (1 << 20) // len(homes)))
        roots = np.array([forest.root(x) for x in own])
        near = np.bitwise_count(rows[at : at + step, None] ^ homes[None, :]) <= MOST
        hit = np.flatnonzero(near.any(1))
        near = near[hit]
        values = rows[at + hit].view(np.int64).tolist()
        for value, j in zip(values, near.argmax(1).tolist(), strict=True):
            forest.join(value, own[j])
        if len(hit):
            # A row whose homes have one root already needs no more than the link to its first.
            low, high = np.where(near, roots, np.iinfo(np.int64).max).min(1), np.where(near, roots, np.iinfo(np.int64).min).max(1)
            for r in np.flatnonzero(low != high).tolist():
                for j in np.flatnonzero(near[r]).tolist():
                    forest.join(values[r], own[j])
        at, step = at + step, step * 2


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by anchor, homes before visitors: a spanning forest of the links that this partition shows.

    Only an anchor's home fingerprints are held, eight bytes each; visitors stream past.
    """
    homes, current, forest = np.empty(0, np.uint64), None, _Forest()
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, visits, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp = np.ascontiguousarray(fp).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        ends = np.r_[starts[1:], len(anchor)]
        n_home = np.add.reduceat((~visits.astype(bool)).astype(np.int64), starts)
        carried = current is not None and anchor[0] == current
        # Groups of one row, or of visitors alone, have nothing to compare.
        busy = (n_home > 0) & (ends - starts > 1)
        busy[0] |= carried
        pair = busy & (ends - starts == 2)
        pair[0] &= not carried
        two = starts[pair]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= MOST]
        for x, y in zip(fp[two].view(np.int64).tolist(), fp[two + 1].view(np.int64).tolist(), strict=True):
            forest.join(x, y)
        for g in np.flatnonzero(busy & ~pair).tolist():
            own = fp[starts[g] : starts[g] + n_home[g]]
            own = np.r_[homes, own] if g == 0 and carried else own
            if len(own):
                _compare(forest, fp[starts[g] : ends[g]], own)
        last = fp[starts[-1] : starts[-1] + n_home[-1]]
        homes = np.r_[homes, last] if carried and len(starts) == 1 else last.copy()
        current = anchor[-1]
        new, forest.new = forest.new, []
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in new], pa.int64()) for i in (0, 1)], ["a", "b"])


def link_prints(prints: DataFrame) -> DataFrame:
    """prints: fp long, distinct.  Returns links a, b that connect what is connected, far fewer than all pairs."""
    visits = prints.select("fp").mapInArrow(_visits, "anchor long, visits boolean, fp long")
    dealt = visits.repartition("anchor").sortWithinPartitions("anchor", "visits")
    return dealt.mapInArrow(_links, "a long, b long")


def components(links: DataFrame, label: str = "components", most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """links: a, b (about `rows`, if known).  Returns node, root for every node that has a link; root is the smallest node of its component.

    Alternating large-star and small-star rounds; each is an aggregation with map-side partials and a
    join, written to the shared folder.
    """
    spark = links.sparkSession
    with scratch(spark) as written:
        edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label, rows)
        before = None
        for _ in range(most_rounds):
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            small_least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(small_least, "u").select(F.col("v").alias("x"), F.col("m").alias("v")).where("x <> v").withColumnRenamed("x", "u")
            edges = materialize(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), label, rows)
            discard(spark, written.pop(0))
            state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == before:
                break
            before, rows = state, None if rows is None else state[0]
        else:
            raise RuntimeError("components did not settle")
        written.clear()  # the last round is what the result reads
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def component_ids(printed: DataFrame, fp: str, id_col: str) -> DataFrame:
    """printed (stored).  One row per fingerprint: fp, n (its rows), component_id (smallest id of its component)."""
    nodes = materialize(printed.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    linked = components(link_prints(nodes), "simhash-links").withColumnRenamed("node", "fp").join(nodes.select("fp", "rep"), "fp")
    linked = materialize(linked, "simhash-linked")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    rooted = nodes.join(linked.select("fp", "root").join(least, "root"), "fp", "left")
    component = F.when(F.col("root").isNotNull(), F.col("least")).otherwise(F.col("rep"))
    return materialize(rooted.select("fp", "n", component.alias("component_id")), "simhash-components")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    printed = materialize(fingerprints(docs.select("doc_id", "text"), "fp", width).select("doc_id", "fp"), "simhash-prints")
    rooted = component_ids(printed, "fp", "doc_id")
    hexed: Column = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return join_unique(printed, rooted, "fp", "n").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """One document of each component: the one with the smallest id (of rows sharing it, the smallest text)."""
    fp = unused_name(docs, "simhash_fp")
    printed = materialize(fingerprints(docs, fp, width), "simhash-docs")
    # Only narrow rows meet the components; the survivors' ids then pick the whole documents.
    narrow = join_unique(printed.select("doc_id", F.col(fp).alias("fp")), component_ids(printed.select("doc_id", fp), fp, "doc_id"), "fp", "n")
    alive = narrow.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    m, n = unused_name(printed, "simhash_m"), unused_name(printed, "simhash_n")
    survivors = alive.groupBy(F.col("doc_id").alias("id"), F.col("fp").alias("print")).agg(F.count(F.lit(1)).alias(m)).alias("s")
    d = printed.alias("d")
    kept = d.join(survivors, F.col("d.doc_id").eqNullSafe(F.col("s.id")) & (F.col(f"d.`{fp}`") == F.col("s.print"))).select("d.*", F.col(f"s.`{m}`"))
    # Only rows that share id and fingerprint have to be told apart; the others move once.
    others = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy("doc_id", fp).orderBy(F.col("text").asc_nulls_first(), *others)
    repeated = kept.where(F.col(m) > 1).withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).drop(n)
    return kept.where(F.col(m) == 1).unionByName(repeated).select(*[f"`{c}`" for c in docs.columns])
