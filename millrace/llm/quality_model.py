"""Quality classifier from weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Eight overlapping labellers vote good, bad or abstain on every document.  Expectation-maximisation over
the vote patterns of the whole corpus estimates how often each labeller votes bad on good documents and
on each kind of junk in KINDS (a kind is what sets off the same labellers); the posterior probability
of the good class is the soft label of a pattern's documents.  The rates have Beta priors that weigh as
much as a small share of the corpus, and no other bounds.  A linear scorer is then fitted to the
soft labels: hashed byte trigrams (relative frequencies) and hashed bins of the labellers' measures.
Every document is scored over its whole text; `kept` is score >= threshold.

All documents enter the fit of the accuracies, as counts of at most 3**8 patterns.  The scorer's
training sample is bounded: `per_class` documents for each side of the posterior, the first by a hash
of the text, so it depends on neither order nor partitions.

Defined cases: null and wordless texts have score 0 and are not kept; texts of any length are read
whole, in pieces; repeated rows score alike; an empty table gives an empty result; null ids are
carried; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize

LABELLERS = ("length", "symbols", "bars", "lines", "variety", "capitals", "shouts", "letters")
BUCKETS, BINS, PIECE = 1 << 16, 16, 1 << 20
#: Labellers that a kind of junk sets off; short text is no kind of its own.
KINDS = {"repetition": ("lines", "variety"), "shouting": ("capitals", "shouts"), "noise": ("symbols", "letters"), "tables": ("bars",)}
#: Beta priors: mean rate of bad votes on good documents, on junk by its own labellers, on junk by others; weights as shares of the corpus.
ALARM = {"length": 0.02, "symbols": 0.005, "bars": 0.005, "lines": 0.005, "variety": 0.005, "capitals": 0.01, "shouts": 0.01, "letters": 0.01}
CATCH, STRAY, PRIOR_SHARE, KIND_SHARE = 0.5, 0.05, 0.01, 0.001


def measures(text: str) -> np.ndarray:
    """One number per labeller."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(len(LABELLERS))
    counts = np.zeros(256, np.int64)
    data = text.encode("utf-8", "replace")
    for at in range(0, len(data), PIECE):
        counts += np.bincount(np.frombuffer(data[at : at + PIECE], np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x.strip()]
    lower, upper = counts[97:123].sum(), counts[65:91].sum()
    letters, size = lower + upper + counts[128:].sum(), len(data) - counts[[9, 10, 11, 12, 13, 32]].sum()
    of = lambda chars: sum(int(counts[ord(c)]) for c in chars)
    # Distinct words fall with length even in good text; the root takes most of that out.
    variety = len(set(words)) / n ** 0.75
    return np.array([n, of("#*$%&<>") / n, of("|") / n, 1 - len(set(lines)) / len(lines), variety, upper / max(1, lower + upper), of("!") / n, letters / max(1, size)])


def votes_of(m: np.ndarray) -> list[int]:
    bad = [m[0] < 3, m[1] > 0.25, m[2] > 0.2, m[3] > 0.35, m[4] < 0.5, m[5] > 0.4, m[6] > 0.4, m[7] < 0.6]
    good = [m[0] >= 50, m[1] < 0.02, m[2] < 0.02, m[3] < 0.1, m[4] > 1.0, m[5] < 0.15, m[6] < 0.05, m[7] > 0.8]
    return [-1 if b else int(g) for b, g in zip(bad, good, strict=True)]


def prior_rates() -> np.ndarray:
    """Mean rate of bad votes by class (good first) and labeller."""
    return np.array([list(ALARM.values()), *([CATCH if x in own else STRAY for x in LABELLERS] for own in KINDS.values())])


def fit_accuracies(votes: np.ndarray, n: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """votes: patterns x labellers, n: documents of each pattern.

    Posterior probability of good, per pattern, and the fitted rates of bad votes by class and labeller.
    Starts from the labellers' kinds: a bad vote makes its kind twenty times as likely as a good document.
    """
    bad, cast, prior = (votes == -1).astype(float), (votes != 0).astype(float), prior_rates()
    own = prior[1:] == CATCH
    state = np.concatenate([np.ones((len(votes), 1)), 0.02 + 20 * bad @ own.T], axis=1)
    state /= state.sum(1, keepdims=True)
    weight = n.sum() * np.array([PRIOR_SHARE] + [KIND_SHARE] * len(KINDS))[:, None]
    for _ in range(rounds):
        held = n[:, None] * state
        rates = (held.T @ bad + weight * prior) / (held.T @ cast + weight)
        shares = (held.sum(0) + 1) / (n.sum() + len(prior))
        score = np.log(shares) + bad @ np.log(rates).T + (cast - bad) @ np.log(1 - rates).T
        state = np.exp(score - score.max(1, keepdims=True))
        state /= state.sum(1, keepdims=True)
    return state[:, 0], rates


def _trigrams(data: bytes) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams, a piece at a time."""
    for at in range(0, max(0, len(data) - 2), PIECE):
        b = np.frombuffer(data[at : at + PIECE + 2], np.uint8).astype(np.uint32)
        yield ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def _bins(m: np.ndarray) -> np.ndarray:
    """A bucket above the trigrams' for each labeller's measure, by its logarithm."""
    level = np.clip(np.round(2 * np.log2(m + 0.01)).astype(int) + 13, 0, BINS - 1)
    return BUCKETS + np.arange(len(LABELLERS)) * BINS + level


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of one text: buckets and values.  Trigram frequencies are scaled to weigh as much as the bins."""
    data, total = text.encode("utf-8", "replace"), np.zeros(BUCKETS, np.int64)
    for some in _trigrams(data):
        total += np.bincount(some, minlength=BUCKETS)
    at = np.flatnonzero(total)
    m = _bins(measures(text))
    return np.concatenate([at, m]), np.concatenate([len(LABELLERS) * total[at] / max(1, total.sum()), np.ones(len(m))])


def score_text(text: str, weights: np.ndarray, bias: float) -> float:
    data, total, n = text.encode("utf-8", "replace"), 0.0, 0
    for some in _trigrams(data):
        total += float(weights[some].sum())
        n += len(some)
    z = bias + len(LABELLERS) * total / max(1, n) + float(weights[_bins(measures(text))].sum())
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """rows: buckets, values, soft label."""
    size = BUCKETS + len(LABELLERS) * BINS
    weights, bias, squares, bias_sq = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    label = np.array([r[2] for r in rows])
    for _ in range(rounds):
        z = bias + np.bincount(doc, weights[at] * value, len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - label) / len(rows)
        g = np.bincount(at, error[doc] * value, size) + decay * weights
        squares += g * g
        weights -= rate * g / np.sqrt(squares)
        bias_sq += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(bias_sq)
    return weights.astype(np.float32), float(bias)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes = [votes_of(measures(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.list_(pa.int32()))], ["key", "votes"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at, value = sparse(text)
            yield pa.RecordBatch.from_pylist([{"key": key, "at": at.astype(np.int32), "value": value.astype(np.float32)}])


def classify(docs: DataFrame, threshold: float = 0.5, per_class: int = 1000) -> DataFrame:
    """doc_id, score, kept for every row."""
    spark = docs.sparkSession
    worded = docs.where(F.col("text").rlike(r"\S")).select(F.xxhash64("text").alias("key"), "text")
    voted = materialize(worded.mapInArrow(_vote, "key long, votes array<int>"), "model-votes")
    patterns = voted.groupBy("votes").count().orderBy("votes").collect()  # at most 3**8 rows
    if not patterns:
        weights, bias = np.zeros(BUCKETS + len(LABELLERS) * BINS, np.float32), 0.0
    else:
        good, _ = fit_accuracies(np.array([r["votes"] for r in patterns]), np.array([r["count"] for r in patterns], float))
        posterior = F.broadcast(spark.createDataFrame([(r["votes"], float(g)) for r, g in zip(patterns, good, strict=True)], "votes array<int>, p_good double"))
        side = Window.partitionBy(F.col("p_good") >= 0.5).orderBy("key")
        # A first thinning by hash leaves a few times the distinct texts wanted on each side; only these are ranked.
        distinct = {tuple(r["votes"]): r["n"] for r in voted.groupBy("votes").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()}
        n_good, n_bad = (max(1, sum(distinct[tuple(r["votes"])] for r, g in zip(patterns, good, strict=True) if (g >= 0.5) == s)) for s in (True, False))
        rate = F.when(F.col("p_good") >= 0.5, F.lit(8.0 * per_class / n_good)).otherwise(F.lit(8.0 * per_class / n_bad))
        thinned = voted.join(posterior, "votes").where(F.pmod(F.col("key"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < rate)
        chosen = thinned.groupBy("key").agg(F.min("p_good").alias("p_good"))
        chosen = chosen.withColumn("n", F.row_number().over(side)).where(F.col("n") <= per_class)
        soft = {r["key"]: r["p_good"] for r in chosen.select("key", "p_good").collect()}  # at most 2 x per_class rows
        keys = F.broadcast(spark.createDataFrame([(k,) for k in soft], "key long"))
        texts = worded.join(keys, "key", "left_semi").dropDuplicates(["key"])
        rows = sorted(texts.mapInArrow(_sampled, "key long, at array<int>, value array<float>").collect(), key=lambda r: r["key"])
        weights, bias = fit_scorer([(np.array(r["at"]), np.array(r["value"]), soft[r["key"]]) for r in rows])
    shared = spark.sparkContext.broadcast((weights, bias))  # a quarter of a MB whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([score_text(t, *shared.value) if t and not t.isspace() else 0.0 for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(scores >= threshold)], ["doc_id", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double, kept boolean")
