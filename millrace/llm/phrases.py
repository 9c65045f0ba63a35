"""Phrase collocations by top-order marginalisation: longest windows are counted once, a rollup gives all shorter ones.

Every word leads one window of itself and the words after it in its piece, at most `longest`, padded with
empty words.  Only these padded windows are counted; Spark's ROLLUP over (language, w0, w1, ...) sums them
to the counts of all shorter prefixes, so every contiguous phrase of every length is counted without an
explosion of n-grams per length.

A window ends before a pair of neighbouring words that occurs fewer than `least` times: no phrase across it
can occur `least` times, so all counts of `least` or more stay exact.  Which pairs are rare is known from a
bit table: pairs are counted by a 64-bit hash, and the bits of the frequent hashes are set.  The table has
32 bits per frequent pair and at most 2^27 bits (16 MB) at any size of the corpus; a bit set for another pair only
makes a window longer, and all final counts are made on the words themselves.

A candidate is a phrase of 2 to `longest` words with `least` occurrences.  Its score is the least over its cuts of
floor(2000000 a / (l + r)), in 38-digit decimals.  Candidates inside a longer one with `share` percent of their
count are dropped; `most` of each language are ranked.

Scale: texts are read twice and never shuffled; tasks send distinct pairs, then distinct windows, each counted per
chunk before they leave the task, so frequent words, lines and passages arrive once per chunk.  Counted windows are cut back to
prefixes that are frequent before the rollup, so it and all later tables hold frequent phrases only.

Defined cases: null texts are empty, null languages are `und`; ties of scores go by count, then by the phrase's bytes;
repeated rows count as often as they occur; texts of any length are read whole; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize, scratch

CHUNK, PART, LEAST_BITS, MOST_BITS = 1 << 21, 1 << 18, 16, 27
#: Pieces end at . , ; : ! ? and line breaks; a tab is a blank; A-Z are lower-cased.
_BYTES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Chunk:
    """Words of one language as numbers in order (0: end of a piece), with their spelling."""

    def __init__(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.known[b"\n"]
        self.ids: list[np.ndarray] = [np.zeros(1, np.int32)]
        self.size = 0

    def add(self, text: bytes) -> None:
        known = self.known
        # A long text is split at the end of a piece, so its words are never all spelled out at once.
        for part in _parts(text.translate(_BYTES)):
            tokens = part.replace(b"\n", b" \n ").split(b" ")
            self.ids += [np.fromiter((known[w] for w in tokens if w), np.int32), self.ids[0]]
        self.size += len(text)

    def whole(self, lang: str) -> tuple[str, list[bytes], np.ndarray]:
        return lang, list(self.known), np.concatenate(self.ids).astype(np.int64)


def _parts(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > PART and (cut := data.find(b"\n", at + PART)) >= 0:
        yield data[at:cut]
        at = cut + 1
    yield data[at:] if at else data


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """Texts of one language, about CHUNK bytes at once; at most twice as much is held for all languages."""
    held: dict[str, _Chunk] = {}
    total = 0
    for batch in batches:
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = data.as_py()
            chunk = held.setdefault(lang, _Chunk())
            chunk.add(text)
            total += len(text)
            if chunk.size >= CHUNK or total >= 2 * CHUNK:
                most = max(held, key=lambda x: held[x].size)
                total -= held[most].size
                yield held.pop(most).whole(most)
    while held:
        lang, chunk = held.popitem()
        yield chunk.whole(lang)


def _pair_hashes(lang: str, words: list[bytes], ids: np.ndarray) -> np.ndarray:
    """64-bit hash of the language and the words at i and i + 1, for every i but the last."""
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))[ids]
    h = each[:-1] * np.uint64(0x9E3779B97F4A7C15) + (each[1:] ^ np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), 7)))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, words, ids in _chunks(batches):
        inside = (ids[:-1] > 0) & (ids[1:] > 0)
        pairs, n = np.unique(_pair_hashes(lang, words, ids)[inside], return_counts=True)
        for a in range(0, len(pairs), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[a : a + (1 << 17)].view(np.int64)), pa.array(n[a : a + (1 << 17)])], ["pair", "n"])


def windows_of(lang: str, words: list[bytes], ids: np.ndarray, bits: np.ndarray, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct padded windows, as columns of word numbers (0: padding), and how often each occurs."""
    h = _pair_hashes(lang, words, ids)
    bit = h & np.uint64(64 * len(bits) - 1)
    goes = (ids[:-1] > 0) & (ids[1:] > 0) & (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    lead = np.flatnonzero(ids > 0)
    goes = np.append(goes, np.zeros(longest, bool))
    columns, on = [ids[lead]], np.ones(len(lead), bool)
    following = np.append(ids, np.zeros(longest, ids.dtype))
    for k in range(1, longest):
        on = on & goes[lead + k - 1]
        columns.append(np.where(on, following[lead + k], 0))
    alone = columns[1] == 0 if longest > 1 else np.ones(len(lead), bool)
    single = np.bincount(columns[0][alone], minlength=len(words))
    word = np.flatnonzero(single)
    many = [c[~alone] for c in columns]
    code = many[0]
    for c in many[1:]:
        distinct, code = np.unique(code * len(words) + c, return_inverse=True)
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return [np.concatenate([word if k == 0 else np.zeros_like(word), c[first]]) for k, c in enumerate(many)], np.concatenate([single[word], n])


def _bit_table(pairs: DataFrame, least: int) -> np.ndarray:
    """Bits of the hashes of frequent pairs, at most 2^MOST_BITS."""
    frequent = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("pair"), "phrase-pairs")
    size = 1 << min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(32 * frequent.count() + 1))))
    bit = F.col("pair").bitwiseAND(F.lit(size - 1))
    words = frequent.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pair & 63))")).alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[words["at"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint64)


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4) -> DataFrame:
    """lang, m (words), phrase, f: all words of each language (m = 0, no phrase) and every phrase of 1 to `longest` words with f >= least."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    bits = spark.sparkContext.broadcast(_bit_table(texts.mapInArrow(_count_pairs, "pair long, n long"), least))
    w = [f"w{k}" for k in range(longest)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids in _chunks(batches):
            columns, n = windows_of(lang, words, ids, bits.value, longest)
            spelled = pa.array([b"", *words[1:]], pa.binary())
            for a in range(0, len(n), 1 << 16):
                some = slice(a, a + (1 << 16))
                each = [spelled.take(pa.array(c[some])).view(pa.string()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(each[0])), *each, pa.array(n[some])], ["lang", *w, "n"])

    windows = texts.mapInArrow(count, f"lang string, {', '.join(f'{c} string' for c in w)}, n long")
    rolled = _shortened(windows, w, least).rollup("lang", *w).agg(F.sum("n").alias("f"), F.grouping_id().alias("gid"))
    # The grouping id has one bit per column summed away: 2^(longest - m) - 1 for prefixes of m words.
    level = F.lit(longest) - F.length(F.regexp_replace(F.bin("gid"), "0", ""))
    last = F.array(F.lit("all"), *w)[level]
    rows = rolled.where(f"gid < {(1 << longest + 1) - 1}").withColumn("m", level).where((F.col("m") == 0) | (F.col("f") >= least) & (last != ""))
    return rows.select("lang", "m", F.array_join(F.slice(F.array(*w), F.lit(1), F.col("m")), " ").alias("phrase"), "f")


def _shortened(windows: DataFrame, w: list[str], least: int) -> DataFrame:
    """Counted windows, each cut back to its longest prefix with `least` occurrences: longer prefixes would only be summed to be dropped.

    Windows are dealt by their first two words, so the sums of all prefixes of two words and more are made where they are.
    """
    counted = windows.repartition("lang", *w[:2]).groupBy("lang", *w).agg(F.sum("n").alias("n"))
    for k in range(len(w) - 1, 0, -1):
        of_prefix = F.col("n") if k == len(w) - 1 else F.sum("n").over(Window.partitionBy("lang", *w[: k + 1]))
        counted = counted.withColumn(f"f{k}", of_prefix)
    return counted.select("lang", w[0], *[F.when(F.col(f"f{k}") >= least, F.col(w[k])).otherwise("").alias(w[k]) for k in range(1, len(w))], "n")


def mine(docs: DataFrame, least: int = 30, longest: int = 4, share: int = 80, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `most` phrases of each language."""
    with scratch(docs.sparkSession) as written:
        counts = materialize(phrase_counts(docs, least, longest), "phrase-counts")
        found = materialize(rank_phrases(counts, share, most), "phrases")
        written.pop()
    return found


def rank_phrases(counts: DataFrame, share: int = 80, most: int = 2000) -> DataFrame:
    """Scores, drops and ranks, from the table of `phrase_counts`."""
    phrases, total = counts.where("m > 0"), counts.where("m = 0").select("lang", F.col("f").alias("n"))
    part = lambda first, n: F.array_join(F.slice(F.split("phrase", " "), first, n), " ")
    candidates = phrases.where("m > 1")
    # Both parts of every cut look up their counts in one join; parts of very many candidates are spread by its skew handling.
    sides = F.array(F.struct(F.lit(0).alias("side"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), part(F.col("k") + 1, F.col("m")).alias("part")))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).select("lang", "phrase", "f", "k", F.inline(sides))
    held = cuts.join(phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("held")), ["lang", "part"])
    by_cut = held.groupBy("lang", "phrase", "f", "k").agg(F.max(F.when(F.col("side") == 0, F.col("held"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("held"))).alias("r"))
    score = F.expr("cast(cast(f as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r) as bigint)")
    scored = by_cut.groupBy("lang", "phrase", F.col("f").alias("a")).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # A candidate's largest count within longer ones: each of these names the phrases inside it.
    starts = F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1))
    inside = candidates.where("m > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("m") - 1))).withColumn("at", starts)
    longer = inside.groupBy("lang", part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("longer"))
    free = scored.join(longer, ["lang", "phrase"], "left").where(F.expr(f"not (coalesce(cast(longer as decimal(20, 0)), 0) * 100 >= cast(a as decimal(20, 0)) * {share})"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = free.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return rows.join(total, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
