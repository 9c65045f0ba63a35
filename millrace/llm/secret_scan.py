"""Secret scans: three patterns, and a randomness test battery for strings that no pattern names.

A candidate is a long run of token characters that no pattern has claimed, with digits and letters
mixed.  Its encoding is inferred from the characters (hex, base32, base64), which gives the alphabet;
three tests then ask whether it could be random over that alphabet: a chi-squared test of uniformity
over equal bins of the alphabet, a runs test of high and low symbols, and a test of serial
correlation of symbol ranks.  Fisher's method combines the three into one p-value, the battery's score.

Ordinary words can look random by chance, and short ones do so often, so the score alone decides
nothing.  The letters of every document are cut, for each length class, into consecutive runs of that
length, from the first letter to the last whole run; the scores of all of them are the distribution of
the score for text of that length.  A candidate's p-value against text is its tail there, and the
Benjamini-Hochberg step-up within each length class bounds the share of false discoveries.  Both
distributions are counted over all documents, in at most LENGTHS x BINS cells.

Defined cases: null and empty texts have no spans; texts of any length are scanned whole; offsets are
code points, end exclusive; repeated rows are scanned alike; an empty table gives an empty result;
null ids are carried; other columns are ignored by `scan` and carried unchanged by `redact`.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, unused_name

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Cheap signs without which the first two patterns cannot match.
_ASSIGN_SIGNS, _ACCESS_SIGN = ("passw", "secret", "token", "apikey", "api_key"), "AKIA"
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
#: Length classes 16-19, 20-23, 24-31, 32-47, 48-95, 96 and more; cells of the score; level of false discovery.
_CLASSES = (20, 24, 32, 48, 96)
_LEAST = (16, *_CLASSES)
LENGTHS, BINS, LEVEL = len(_CLASSES) + 1, 256, 0.01
CELLS = LENGTHS * BINS
#: Letters scored at once, a multiple of every length, so that a long text's runs stay the same.
LETTERS = 273 * math.lcm(*_LEAST)
_NO_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the three patterns, by start and kind."""
    lowered, found = text.lower(), []
    if any(sign in lowered for sign in _ASSIGN_SIGNS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if _ACCESS_SIGN in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # A run of hex digits lies within a run of token characters.
    for run in _RUN.finditer(text):
        if run.end() - run.start() >= 32:
            found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, run.start(), run.end())]
    return sorted(found)


def alphabet(run: str) -> str:
    """The encoding inferred from a run's characters."""
    body = run.rstrip("=")
    if re.fullmatch("[0-9a-f]+", body):
        return "0123456789abcdef"
    if re.fullmatch("[0-9A-F]+", body):
        return "0123456789ABCDEF"
    if re.fullmatch("[A-Z2-7]+", body):
        return _BASE32
    if re.fullmatch("[A-Za-z]+", body):
        return _BASE64[26:52] if body.islower() else _BASE64[:52]
    return _BASE64[:62] if body.isalnum() else _BASE64


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared, by the Wilson-Hilferty cube root."""
    return 0.5 * math.erfc((((x / df) ** (1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)) / math.sqrt(2))


def randomness(run: str) -> float:
    """Fisher's combined p-value of the three tests: near 0 for text, uniform for random strings."""
    symbols = alphabet(run)
    rank = {c: i for i, c in enumerate(symbols)}
    x = np.array([rank[c] for c in run if c in rank], float)
    n, size = len(x), len(symbols)
    if n < 8:
        return 0.0
    bins = min(size, n // 2)  # as fine as the length allows: letters of text differ most one by one
    share = np.bincount(np.arange(size) * bins // size, minlength=bins) / size
    seen = np.bincount((x.astype(int) * bins) // size, minlength=bins)
    uniform = _chi_tail(float(((seen - n * share) ** 2 / (n * share)).sum()) + 1e-9, bins - 1)
    high = x >= size / 2
    up = int(high.sum())
    down = n - up
    if up and down:
        mean = 1 + 2 * up * down / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = _two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(max(var, 1e-9)))
    else:
        runs = 2.0 ** (1 - n)
    y = x - x.mean()
    spread = float((y * y).sum())
    serial = _two_sided((float((y[1:] * y[:-1]).sum()) / spread + 1 / n) * math.sqrt(n)) if spread else 0.0
    # A letter case or digit share unlike the alphabet's shows in the same table of bins, so three tests are enough.
    stat = -2 * sum(math.log(max(p, 1e-12)) for p in (uniform, runs, serial))
    return math.exp(-stat / 2) * (1 + stat / 2 + (stat / 2) ** 2 / 2)


def length_class(n: int) -> int:
    return sum(n >= c for c in _CLASSES)


def score_bin(p: float) -> int:
    """Bin of a score, finer towards 0: by its square root."""
    return min(BINS - 1, int(math.sqrt(p) * BINS))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Candidate (start, end, length class, score bin)."""
    found = []
    for m in _RUN.finditer(text):
        run, start, end = m[0], m.start(), m.end()
        mixed = any(c.isdigit() for c in run) and any(c.isalpha() for c in run)
        if mixed and not any(a < end and start < b for a, _, b in taken):
            found.append((start, end, length_class(end - start), score_bin(randomness(run))))
    return found


def _erfc(z: np.ndarray) -> np.ndarray:
    """The complementary error function of numbers from 0 on, to 1.2e-7 of its value (Chebyshev fit of Numerical Recipes)."""
    t = 1 / (1 + 0.5 * z)
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    total = np.zeros_like(t)
    for c in reversed(fit):
        total = total * t + c
    return t * np.exp(total - z * z)


def randomness_rows(x: np.ndarray, size: int) -> np.ndarray:
    """`randomness` of every row of ranks in an alphabet of so many symbols."""
    m, n = x.shape
    bins = min(size, n // 2)
    of = np.arange(size) * bins // size
    share = np.bincount(of, minlength=bins) / size
    seen = np.bincount((of[x] + bins * np.arange(m)[:, None]).ravel(), minlength=m * bins).reshape(m, bins)
    chi = (((seen - n * share) ** 2 / (n * share)).sum(1) + 1e-9) / (bins - 1)
    z = (np.cbrt(chi) - (1 - 2 / (9 * (bins - 1)))) / math.sqrt(2 / (9 * (bins - 1))) / math.sqrt(2)
    uniform = _erfc(np.abs(z)) / 2
    uniform = np.where(z < 0, 1 - uniform, uniform)
    high = x >= size / 2
    up = high.sum(1)
    mean = 1 + 2 * up * (n - up) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = _erfc(np.abs(1 + (high[:, 1:] != high[:, :-1]).sum(1) - mean) / np.sqrt(2 * np.maximum(var, 1e-9)))
    runs = np.where((up > 0) & (up < n), runs, 2.0 ** (1 - n))
    y = x - x.mean(1, keepdims=True)
    spread = np.einsum("ij,ij->i", y, y)
    lag = np.einsum("ij,ij->i", y[:, 1:], y[:, :-1])
    serial = np.where(spread > 0, _erfc(np.abs(lag / np.where(spread > 0, spread, 1) + 1 / n) * math.sqrt(n / 2)), 0)
    half = -sum(np.log(np.maximum(p, 1e-12)) for p in (uniform, runs, serial))
    return np.exp(-half) * (1 + half + half * half / 2)


def _letter_bins(runs: np.ndarray) -> np.ndarray:
    """Score bins of rows of ASCII letters, each over the alphabet inferred from it."""
    low, top, found = runs.min(1), runs.max(1), np.zeros(len(runs), np.int64)
    lower, upper = low >= ord("a"), top <= ord("Z")
    kind = np.select([lower & (top <= ord("f")), lower, upper & (top <= ord("F")), upper], [0, 1, 2, 3], 4)
    for k in np.unique(kind):
        here = np.flatnonzero(kind == k)
        symbols = alphabet(runs[here[0]].tobytes().decode())
        rank = np.zeros(256, np.int64)
        rank[list(symbols.encode())] = np.arange(len(symbols))
        scores = randomness_rows(rank[runs[here]], len(symbols))
        found[here] = np.minimum(BINS - 1, (np.sqrt(scores) * BINS).astype(np.int64))
    return found


def own_scores(texts: list[str]) -> list[list[int]]:
    """For each text the cells of all runs of its own letters, as cell + CELLS * (how many - 1)."""
    cells: list[list[int]] = [[] for _ in texts]
    pieces: list[tuple[int, np.ndarray]] = []
    held = 0

    def settle() -> None:
        keys = []
        for c, n in enumerate(_LEAST):
            many = np.array([len(letters) // n for _, letters in pieces])
            if many.any():
                runs = np.concatenate([letters[: k * n] for (_, letters), k in zip(pieces, many.tolist(), strict=True)]).reshape(-1, n)
                keys.append(np.repeat([i for i, _ in pieces], many) * CELLS + c * BINS + _letter_bins(runs))
        if keys:
            key, count = np.unique(np.concatenate(keys), return_counts=True)
            for i, cell in zip((key // CELLS).tolist(), (key % CELLS + CELLS * (count - 1)).tolist(), strict=True):
                cells[i].append(cell)
        pieces.clear()

    for i, text in enumerate(texts):
        letters = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(None, _NO_LETTERS), np.uint8)
        for at in range(0, len(letters), LETTERS):
            pieces.append((i, letters[at : at + LETTERS]))
            held += len(pieces[-1][1])
            if held >= LETTERS:
                settle()
                held = 0
    settle()
    return cells


_SCANNED = (
    "struct<n_assign:long, n_access:long, n_hex:long, base:string, base_sha256:string, "
    "found:array<struct<start:int,end:int,class:int,bin:int>>, plain:array<bigint>>"
)


def _scan_text(text: str) -> tuple:
    spans = base_spans(text)
    base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    found = candidates(text, spans)
    count = [sum(k == i for _, k, _ in spans) for i in range(3)]
    return (*count, base, hashlib.sha256(base.encode()).hexdigest(), [dict(zip(("start", "end", "class", "bin"), f, strict=True)) for f in found])


_COLUMNS = ["n_assign", "n_access", "n_hex", "base", "base_sha256", "found", "plain"]


def _scan_batch(texts: pd.Series) -> pd.DataFrame:
    texts = [t or "" for t in texts]
    return pd.DataFrame([(*_scan_text(t), plain) for t, plain in zip(texts, own_scores(texts), strict=True)], columns=_COLUMNS)


def _scanned(text: Column) -> Column:
    return F.pandas_udf(_scan_batch, _SCANNED)(text)


def _least_bins(scans: DataFrame, s: str) -> list[int]:
    """For each length class the lowest score bin that is a discovery (BINS: none), from counts over all documents.

    Two aggregations of at most LENGTHS x BINS rows each.
    """
    per = lambda df: {(r["c"], r["b"]): r["n"] for r in df.groupBy("c", "b").agg(F.sum("n").alias("n")).collect()}
    cell = F.col("cell")
    cells = scans.select(F.explode(f"{s}.plain").alias("cell"))
    plain = per(cells.select(F.floor(cell % CELLS / BINS).alias("c"), (cell % BINS).alias("b"), (1 + F.floor(cell / CELLS)).alias("n")))
    found = per(scans.select(F.explode(f"{s}.found").alias("f")).select(F.col("f.class").alias("c"), F.col("f.bin").alias("b"), F.lit(1).alias("n")))
    tails = lambda t, c: np.cumsum([t.get((c, b), 0) for b in range(BINS)][::-1])[::-1]
    least = []
    for c in range(LENGTHS):
        # Too few texts of a length to tell: shorter runs stand in; they look random more often, not less.
        text = tails(plain, c)
        for shorter in range(c - 1, -1, -1):
            if text[0] >= 100:
                break
            text = text + tails(plain, shorter)
        p, mine = (text + 1) / (text[0] + 1), tails(found, c)
        good = np.flatnonzero((mine > 0) & (p * max(mine[0], 1) <= LEVEL * mine))
        least.append(int(good[0]) if len(good) else BINS)
    return least


def _random_spans(s: Column, least: list[int]) -> Column:
    limits = F.array(*[F.lit(x) for x in least])
    return F.filter(s["found"], lambda f: f["bin"] >= F.get(limits, f["class"]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random for every row."""
    scans = materialize(docs.select("doc_id", _scanned(F.col("text")).alias("s")), "secret-scans")
    least = _least_bins(scans, "s")
    s = F.col("s")
    as_text = lambda f: F.concat(F.lit("random:"), f["start"], F.lit(":"), f["end"])
    listed = F.filter(F.split(s["base"], ","), lambda x: x != "")
    order = lambda x: F.split(x, ":")[1].cast("int")
    kind = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.split(x, ":")[0]).cast("int")
    every = F.concat(listed, F.transform(_random_spans(s, least), as_text))
    ordered = F.transform(F.sort_array(F.transform(every, lambda x: F.struct(order(x).alias("a"), kind(x).alias("k"), x.alias("x")))), lambda r: r["x"])
    return scans.select(
        "doc_id", s["n_assign"].alias("n_assign"), s["n_access"].alias("n_access"), s["n_hex"].alias("n_hex"), s["base_sha256"].alias("base_sha256"),
        F.array_join(ordered, ",").alias("spans"), F.size(_random_spans(s, least)).cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Documents with every span replaced by `mask`; n_chars, where present, follows the new text."""
    name = unused_name(docs, "secret_scan")
    scans = materialize(docs.withColumn(name, _scanned(F.col("text"))), "secret-docs")
    least = _least_bins(scans, name)

    @F.pandas_udf("string")
    def masked(texts: pd.Series, base: pd.Series, found: pd.Series) -> pd.Series:
        def one(text, listed, extra):
            spans = [tuple(map(int, x.split(":")[1:])) for x in listed.split(",") if x] + [(f["start"], f["end"]) for f in extra]
            out, at = [], 0
            for a, b in sorted(spans):
                if a >= at:
                    out += [text[at:a], mask]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return pd.Series([t if t is None or not (b or len(f)) else one(t, b, f) for t, b, f in zip(texts, base, found, strict=True)])

    hit = (F.col(f"{name}.base") != "") | (F.size(_random_spans(F.col(name), least)) > 0)
    new = masked(F.col("text"), F.col(f"{name}.base"), _random_spans(F.col(name), least))
    out = scans.withColumn("text", F.when(hit, new).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])
