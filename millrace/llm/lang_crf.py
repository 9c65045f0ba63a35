"""Language of words and documents by a linear-chain conditional random field.

Every word of a text is labelled: its emission scores come from affixes (the first and last two to
four bytes), character n-grams of two to four bytes, and a lexicon of frequent words, all with learned
weights; learned transition weights join neighbouring labels; forward-backward gives each word's
label probabilities.  A text is read in windows of CHAIN words, each with MARGIN words of context on both
sides whose own labels come from the neighbouring windows.  A document's language is the label with the
largest mean probability over all its words, and its score is that mean.

Training maximises the likelihood of labelled words.  Its sample is bounded: at most `docs_per_lang`
documents of each language, chosen by a hash of the text, and of each `words_per_doc` words in runs
spread over the whole text.  Runs of different documents are joined in one chain, so that transitions
between languages are learned as well.  Prediction reads every word of every text.

Defined cases: null text, and text without a letter, is `und` with score 0; null languages teach
nothing; if nothing can be learned every text is `und`; texts of any length are read whole, piece by
piece; repeated rows get equal results; ties go to the first language by name; an empty table gives an
empty result; null ids are carried (their remainder counts as not held out).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, CHAIN, MARGIN, LEXICON = 1 << 15, 48, 6, 2000
#: Texts are decoded in pieces of about so many words together.
PIECE = 60_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0x100000001B3)
_SALTS = {"gram": 1, "prefix": 2, "suffix": 3}


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def word_bytes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case UTF-8 bytes with one blank at both ends, and the start and end of each word in them.

    A word is a run of ASCII letters and bytes above 127.
    """
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    inside = ((data >= 97) & (data <= 122)) | (data >= 128)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return data, edge[::2], edge[1::2]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * _MIX
    return x ^ (x >> np.uint64(29))


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index and bucket of every affix and n-gram feature (words in order), and a 64-bit hash of each word."""
    wide = data.astype(np.uint64)
    length = end - start
    row, place = [], []
    packed = wide.copy()
    for n in (2, 3, 4):
        packed = packed[:-1] << np.uint64(8) | wide[n - 1 :]  # the n bytes from each position
        has = length >= n
        for name, at in (("prefix", start), ("suffix", end - n)):
            rows = np.flatnonzero(has)
            row.append(rows)
            place.append(_mixed(packed[at[rows]], 8 * n + _SALTS[name]) % np.uint64(BUCKETS))
        count = np.maximum(length - n + 1, 0)
        rows = np.repeat(np.arange(len(start)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[rows]
        row.append(rows)
        place.append(_mixed(packed[at], 8 * n + _SALTS["gram"]) % np.uint64(BUCKETS))
    # A whole word's hash is a polynomial in its bytes, from running sums over the text.
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(data), _ODD))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * power)])
        inverse = np.cumprod(np.full(len(data), np.uint64(pow(int(_ODD), -1, 1 << 64))))
        words = _mixed((total[end] - total[start]) * inverse[start] + length.astype(np.uint64), 7)
    return np.concatenate(row), np.concatenate(place).astype(np.int64), words


class Crf:
    """Weights of a trained model."""

    def __init__(self, langs: list[str], lexicon: np.ndarray) -> None:
        k = len(langs)
        self.langs, self.lexicon = langs, lexicon  # lexicon: sorted word hashes
        self.weights = np.zeros((BUCKETS, k), np.float32)
        self.words = np.zeros((len(lexicon) + 1, k), np.float32)  # the last row: not in the lexicon
        self.steps, self.begin = np.zeros((k, k)), np.zeros(k)

    def lexicon_rows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, at, len(self.lexicon))

    def emissions(self, row: np.ndarray, place: np.ndarray, entry: np.ndarray) -> np.ndarray:
        k, n = len(self.langs), len(entry)
        scores = self.words[entry].astype(np.float64)
        for j in range(k):
            scores[:, j] += np.bincount(row, self.weights[place, j], n)
        return scores

    def forward_backward(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """scores: chains x steps x labels, padded.  Label and label-pair probabilities, and the log partition sum."""
        n, t, k = scores.shape
        top = scores.max(2, keepdims=True)
        emit = np.exp(scores - top)
        step, begin = np.exp(self.steps), np.exp(self.begin)
        live = np.arange(t)[None, :] < lengths[:, None]
        alpha, beta, scale = np.empty((n, t, k)), np.ones((n, t, k)), np.ones((n, t))
        for i in range(t):
            a = emit[:, i] * (begin if i == 0 else alpha[:, i - 1] @ step)
            s = a.sum(1)
            alpha[:, i], scale[:, i] = a / s[:, None], s
        for i in range(t - 2, -1, -1):
            b = ((beta[:, i + 1] * emit[:, i + 1]) @ step.T) / scale[:, i + 1, None]
            beta[:, i] = np.where(live[:, i + 1, None], b, 1.0)
        both = alpha * beta
        both /= both.sum(2, keepdims=True)
        pairs = np.zeros((k, k))
        for i in range(1, t):
            on = live[:, i]
            right = beta[on, i] * emit[on, i] / scale[on, i, None]
            pairs += step * (alpha[on, i - 1].T @ right)
        return both, pairs, live, float((np.log(scale) * live).sum() + (top[:, :, 0] * live).sum())


def _chains(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index (chains x CHAIN, last chain padded with its first word) of n words in order, and chain lengths."""
    n_chains = -(-n // CHAIN)
    index = np.arange(n_chains * CHAIN).reshape(n_chains, CHAIN)
    lengths = np.full(n_chains, CHAIN)
    lengths[-1] = n - (n_chains - 1) * CHAIN
    return np.where(index < n, index, index[:, :1]), lengths


def _windows(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index (windows x width, padded with the last word) of n words in order, window lengths, and which places give labels."""
    first = np.arange(0, n, CHAIN)
    start, end = np.maximum(first - MARGIN, 0), np.minimum(first + CHAIN + MARGIN, n)
    index = start[:, None] + np.arange(CHAIN + 2 * MARGIN)[None, :]
    own = (index >= first[:, None]) & (index < np.minimum(first + CHAIN, n)[:, None])
    return np.minimum(index, n - 1), end - start, own


def train(runs: list[tuple[str, str]], rounds: int = 40, rate: float = 0.5, decay: float = 1e-4) -> Crf:
    """runs: (language, words joined by blanks), in the order in which chains join them."""
    langs = sorted({lang for lang, _ in runs})
    label = {lang: i for i, lang in enumerate(langs)}
    parts = [word_bytes(text) for _, text in runs]
    truth = np.concatenate([np.full(len(s), label[lang]) for (lang, _), (_, s, _) in zip(runs, parts, strict=True)])
    shift = np.cumsum([0] + [len(d) for d, _, _ in parts[:-1]])
    data = np.concatenate([d for d, _, _ in parts])
    start, end = (np.concatenate([p[i] + a for p, a in zip(parts, shift, strict=True)]) for i in (1, 2))
    row, place, hashes = features(data, start, end)
    known, counts = np.unique(hashes, return_counts=True)
    frequent = known[np.argsort(-counts, kind="stable")[:LEXICON]]
    model, k, n = Crf(langs, np.sort(frequent[np.isin(frequent, known[counts >= 5])])), len(langs), len(truth)
    entry = model.lexicon_rows(hashes)
    index, lengths = _chains(n)
    live = np.arange(CHAIN)[None, :] < lengths[:, None]
    gold = np.zeros((n, k))
    gold[np.arange(n), truth] = 1
    gold_pairs = np.zeros((k, k))
    pair_on = live[:, 1:]
    np.add.at(gold_pairs, (truth[index[:, :-1]][pair_on], truth[index[:, 1:]][pair_on]), 1)
    gold_begin = np.bincount(truth[index[:, 0]], minlength=k)
    squares = [np.full_like(p, 1e-8, dtype=np.float64) for p in (model.weights, model.words, model.steps, model.begin)]
    for _ in range(rounds):
        both, pairs, _, _ = model.forward_backward(model.emissions(row, place, entry)[index], lengths)
        error = np.empty((n, k))
        error[index[live]] = both[live]
        error -= gold
        slopes = [
            np.stack([np.bincount(place, error[row, j], BUCKETS) for j in range(k)], 1) / n,
            np.stack([np.bincount(entry, error[:, j], len(model.words)) for j in range(k)], 1) / n,
            (pairs - gold_pairs) / n, (both[:, 0].sum(0) - gold_begin) / n,
        ]
        for p, g, sq in zip((model.weights, model.words, model.steps, model.begin), slopes, squares, strict=True):
            g += decay * p
            sq += g * g
            p -= (rate * g / np.sqrt(sq)).astype(p.dtype)
    return model


def training_runs(docs: DataFrame, docs_per_lang: int = 300, words_per_doc: int = 192, run: int = 16) -> list[tuple[str, str]]:
    """The bounded sample: (language, run of words), shuffled by a hash.  docs: text, lang, already without held-out rows."""
    usable = docs.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("h", F.xxhash64("text"))
    # A first thinning by hash leaves a few times the distinct texts wanted, however many there are; only these are ranked.
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    thin = counts.select(F.col("lang").alias("known"), (F.lit(4.0 * docs_per_lang) / F.col("n")).alias("rate"))
    uniform = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = usable.join(F.broadcast(thin), F.col("lang") == F.col("known")).where(uniform < F.col("rate")).dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy("h", F.md5("text"))
    chosen = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_lang)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for lang, h, text in zip(batch["lang"], batch["h"], batch["text"], strict=True):
                words = re.findall(r"[^\W\d_]+", text)
                n_runs = max(1, min(words_per_doc, len(words)) // run)
                for i in range(n_runs):  # runs spread evenly over the text
                    a = (len(words) - min(run, len(words))) * i // max(1, n_runs - 1)
                    if some := words[a : a + run]:
                        rows.append((lang, (h * 31 + i * 0x9E3779B9) & 0x7FFFFFFF, " ".join(some)))
            yield pd.DataFrame(rows, columns=["lang", "h", "words"])

    found = chosen.select("lang", "h", "text").mapInPandas(cut, "lang string, h long, words string").collect()
    return [(r["lang"], r["words"]) for r in sorted(found, key=lambda r: (r["h"], r["lang"], r["words"]))]


def word_probabilities(texts: list[str], model: Crf) -> Iterator[tuple[int, np.ndarray]]:
    """(text index, words x labels) for pieces of the texts in order; chains never cross a text."""
    held: list[tuple[int, tuple]] = []
    n_held = 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        data = np.concatenate([p[0] for _, p in held])
        shift = np.cumsum([0] + [len(p[0]) for _, p in held[:-1]])
        start, end = (np.concatenate([p[i] + a for (_, p), a in zip(held, shift, strict=True)]) for i in (1, 2))
        row, place, hashes = features(data, start, end)
        scores = model.emissions(row, place, model.lexicon_rows(hashes))
        counts = np.array([len(p[1]) for _, p in held])
        first = np.cumsum(counts) - counts
        blocks = [_windows(c) for c in counts if c]
        index = np.concatenate([b[0] + a for b, a in zip(blocks, first[counts > 0], strict=True)])
        own = np.concatenate([b[2] for b in blocks])
        both, _, _, _ = model.forward_backward(scores[index], np.concatenate([b[1] for b in blocks]))
        flat = np.empty_like(scores)
        flat[index[own]] = both[own]
        for (i, _), a, c in zip(held, first, counts, strict=True):
            yield i, flat[a : a + c]

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):  # a very long text comes in pieces that end at a blank
            stop = len(text) if len(text) - at <= 8 * PIECE else max(text.rfind(" ", at, at + 8 * PIECE), at) + 1
            stop = at + 8 * PIECE if stop == at + 1 and len(text) - at > 8 * PIECE else stop
            part = word_bytes(text[at:stop])
            at = stop
            if len(part[1]):
                held.append((i, part))
                n_held += len(part[1])
            if n_held >= PIECE:
                yield from flush()
                held, n_held = [], 0
    if n_held:
        yield from flush()


def predict(texts: list[str | None], model: Crf | None) -> list[tuple[str, float]]:
    k = len(model.langs) if model else 0
    sums, counts = np.zeros((len(texts), max(k, 1))), np.zeros(len(texts))
    lettered = [bool(t) and (re.search("[A-Za-z]", t) is not None or any(map(str.isalpha, t))) for t in texts]
    if k:
        for i, p in word_probabilities([t if ok else "" for t, ok in zip(texts, lettered, strict=True)], model):
            sums[i] += p.sum(0)
            counts[i] += len(p)
    means = sums / np.maximum(counts, 1)[:, None]
    best = means.argmax(1)
    return [(model.langs[b], float(min(1.0, m[b]))) if k and ok and c else ("und", 0.0) for b, m, ok, c in zip(best, means, lettered, counts, strict=True)]


def identify(docs: DataFrame, rounds: int = 40) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from rows that are not held out."""
    runs = training_runs(docs.where(~held_out(F.col("doc_id"))))
    model = train(runs, rounds) if runs else None
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages weights: a few MB whatever the corpus

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = predict(part.column(2).to_pylist(), shared.value)
                guess = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *guess], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")
