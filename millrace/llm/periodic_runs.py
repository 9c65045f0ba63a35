"""Periodic runs of words: difference-cover LCE, sparse-table minima, harmonic-grid enumeration.

A run is a stretch of consecutive words with smallest period q, at least `times` periods and `least`
words long, that no neighbouring word extends keeping period q.  For every period p the pairs
(i, i + p) are tried at the grid i = 0, s, 2s, ... with s = (times - 1) p, about n log n / s pairs in all:
in a run of period p at least s neighbouring words equal the word p further on, so each run meets its
grid.  How far the two suffixes agree, forwards and backwards, gives the run.

Longest common extensions (`Extensions`): the suffixes at positions whose remainder mod 31 lies in a
difference cover are sorted, first by 31 words, then by doubling; any two positions reach two sampled
ones after at most 30 words, so a query compares these few words and then takes one range minimum over
the sorted suffixes' common prefixes.  The index of a document is built only once a pair outlives its
few words; it takes about 30 bytes a word.

Each document is one row and is worked on alone, without a shuffle.  Words are the bytes between
ASCII blanks.  Defined cases: null and wordless texts have no runs and collapse to the empty text; repeated
rows are treated alike; null ids are carried; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let, words_of

#: Every difference mod 31 is the difference of two of these remainders.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
_IN = np.isin(np.arange(MODULUS), COVER)
#: Words to pass before i and j = i + d are both sampled, by i mod 31 and d mod 31.
_SYNC = np.array([[next(t for t in range(MODULUS) if _IN[(i + t) % MODULUS] and _IN[(i + d + t) % MODULUS]) for d in range(MODULUS)] for i in range(MODULUS)])
_WHICH = np.cumsum(_IN) - 1
PAIRS = 1 << 20


def _ranks(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
    """Rank from 1 of each element, given the sorted order and where a neighbour in it differs from the one before."""
    out = np.empty(len(order), np.int64)
    out[order] = 1 + np.concatenate([[0], np.cumsum(differs)])
    return out


class Extensions:
    """Longest common extensions of suffixes of one sequence of positive integers."""

    def __init__(self, ids: np.ndarray) -> None:
        self.n = len(ids)
        self.x = np.concatenate([ids, np.zeros(2 * MODULUS, ids.dtype)])
        self.built = False

    def _build(self) -> None:
        """Sort the sampled suffixes; `place` is the sorted place of each, `table` the minima of neighbours' prefixes."""
        self.built = True
        at = (np.arange(0, self.n + 1, MODULUS)[:, None] + np.array(COVER)).ravel()
        at = at[at <= self.n]
        order = np.arange(len(at))
        for c in range(MODULUS - 1, -1, -1):
            order = order[np.argsort(self.x[at[order] + c], kind="stable")]
        differs = np.zeros(len(at) - 1, bool)
        for c in range(MODULUS):
            column = self.x[at[order] + c]
            differs |= column[1:] != column[:-1]
        levels, step = [_ranks(order, differs)], len(COVER)
        # Sample k + 6 starts 31 words after sample k.
        while levels[-1].max(initial=0) < len(at) and step < len(at):
            rank = levels[-1]
            then = np.zeros_like(rank)
            then[:-step] = rank[step:]
            key = rank * (len(at) + 1) + then
            order = np.argsort(key, kind="stable")
            levels.append(_ranks(order, np.diff(key[order]) != 0))
            step *= 2
        a, b = order[:-1], order[1:]
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            far, jump = len(at), len(COVER) << k
            rank = np.concatenate([levels[k], [0]])
            same = (a < far) & (b < far) & (rank[np.minimum(a, far)] == rank[np.minimum(b, far)])
            common += same * (MODULUS << k)
            a, b = a + same * jump, b + same * jump
        p, q = at[order[:-1]] + common, at[order[1:]] + common
        alive = np.ones(len(p), bool)
        for _ in range(MODULUS):
            alive &= (p < self.n) & (q < self.n) & (self.x[np.minimum(p, self.n)] == self.x[np.minimum(q, self.n)])
            if not alive.any():
                break
            common, p, q = common + alive, p + alive, q + alive
        self.place = np.empty(len(at), np.int64)
        self.place[order] = np.arange(len(at))
        self.table = [common.astype(np.int32)]
        while 2 << len(self.table) - 1 <= len(common):
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefixes of sampled suffixes, by range minimum."""
        if not self.built:
            self._build()
        index = lambda s: self.place[s // MODULUS * len(COVER) + _WHICH[s % MODULUS]]
        a, b = index(i), index(j)
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1  # floor of the logarithm
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            some = level == k
            out[some] = np.minimum(self.table[k][low[some]], self.table[k][high[some] - (1 << int(k))])
        return out

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For i < j: how many words the suffixes at i and j have in common."""
        out, live, sync = np.zeros(len(i), np.int64), np.arange(len(i)), _SYNC[i % MODULUS, (j - i) % MODULUS]
        for d in range(MODULUS):
            meet = sync[live] == d
            if meet.any():
                these = live[meet]
                # At the end of the sequence the words differ; only pairs before it are looked up.
                out[these] = d + self._sampled(i[these] + d, j[these] + d)
                live = live[~meet]
            same = self.x[i[live] + d] == self.x[j[live] + d]
            out[live[~same]] = d
            live = live[same]
            if not len(live):
                break
        return out


def _grid(n: int, times: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, p) of the harmonic grid in blocks."""
    period = np.arange(1, n // times + 1)
    count = -(-(n - period) // ((times - 1) * period))
    ends = np.cumsum(count)
    a = 0
    while a < len(period):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        some, p = count[a:b], np.repeat(period[a:b], count[a:b])
        step = np.arange(len(p)) - np.repeat(np.cumsum(some) - some, some)
        yield step * (times - 1) * p, p
        a = b


def runs_of(ids: np.ndarray, times: int = 4, least: int = 6) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of positive integers, by start, then period."""
    n = len(ids)
    if n < max(least, times):
        return np.zeros((0, 3), np.int64)
    forward, backward, found = Extensions(ids), None, []
    for i, p in _grid(n, times, least):
        hit = forward.x[i] == forward.x[i + p]
        if not hit.any():
            continue
        i, p = i[hit], p[hit]
        if backward is None:
            backward = Extensions(ids[::-1])
        after, before = forward.lce(i, i + p), backward.lce(n - i - p, n - i)
        # The word i + p itself is known to match, so `after` is at least one.
        long = (after + before >= (times - 1) * p) & (after + before + p >= least)
        found.append(np.stack([i - before, after + before + p, p], 1)[long])
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    # A multiple of the smallest period gives the same stretch; the smallest comes first.
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """False for words that lie in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def find_runs(docs: DataFrame, times: int = 4, least: int = 6) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and the collapsed text for every row.

    The collapsed text keeps the first period of every run, its words joined by one space.
    """
    kind = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                texts, every, sizes = [], [], []
                for data in some.column(1):
                    words, known = (data.as_py() or b"").split(), {}
                    ids = np.fromiter((known.setdefault(w, len(known) + 1) for w in words), np.int64, len(words))
                    runs = runs_of(ids, times, least)
                    if len(runs):
                        words = [words[k] for k in np.flatnonzero(kept_words(len(words), runs))]
                    texts.append(b" ".join(words))
                    every.append(runs)
                    sizes.append(len(runs))
                flat = np.concatenate(every)
                listed = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), listed)
                yield pa.RecordBatch.from_arrays([some.column(0), runs, pa.array(texts, pa.binary()).view(pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(search, kind)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for one document in ten one whose words repeat from a word on; both set by crc32 of the id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i, s: F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int")
        spelled = let(F.struct(a.alias("a"), p.alias("p"), words.alias("w")), lambda s: F.array_join(F.transform(s["w"], lambda w, i: F.get(s["w"], at(i, s))), " "))
        return F.when(n > 0, spelled).otherwise(F.lit(""))

    return F.when(h % 10 == 0, let(words_of(text), repeat)).otherwise(text)


def run_report(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests of runs and collapsed text, over texts with planted repeats."""
    found = find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    top = found.select("doc_id", "runs", "collapsed", longest.alias("longest"))
    out = top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return out.withColumn("exponent_milli", F.expr("1000 * length div period"))
