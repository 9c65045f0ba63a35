"""The randomness battery and its false-discovery control against slow versions."""

import collections
import math
import random
import re

import pytest

from millrace.llm import secret_scan as s


def gamma_tail(a, x):
    """Upper regularised gamma by summing the density in small steps of its logarithm-free form."""
    steps, top = 20_000, max(x, a) + 40 * math.sqrt(max(a, 1)) + 40
    width = (top - x) / steps
    return sum(math.exp((a - 1) * math.log(t) - t - math.lgamma(a)) for i in range(steps) if (t := x + (i + 0.5) * width) > 0) * width


def slow_randomness(run):
    """Each test as its definition says, symbol by symbol."""
    symbols = s.alphabet(run)
    x = [symbols.index(c) for c in run if c in symbols]
    n, size = len(x), len(symbols)
    if n < 8:
        return 0.0
    bins = min(size, n // 2)
    held = {b: sum(1 for k in range(size) if k * bins // size == b) for b in range(bins)}
    chi = 0.0
    for b in range(bins):
        want = n * held[b] / size
        chi += (sum(1 for k in x if k * bins // size == b) - want) ** 2 / want
    uniform = gamma_tail((bins - 1) / 2, chi / 2)
    side = [k >= size / 2 for k in x]
    up, down = side.count(True), side.count(False)
    if up and down:
        runs = 1 + sum(1 for a, b in zip(side, side[1:]) if a != b)
        mean = 2 * up * down / n + 1
        var = 2 * up * down * (2 * up * down - n) / (n * n * (n - 1))
        p_runs = math.erfc(abs(runs - mean) / math.sqrt(max(var, 1e-9)) / math.sqrt(2))
    else:
        p_runs = 2 * 0.5**n
    average = sum(x) / n
    spread = sum((k - average) ** 2 for k in x)
    r1 = sum((a - average) * (b - average) for a, b in zip(x, x[1:])) / spread if spread else 0.0
    serial = math.erfc(abs(r1 + 1 / n) * math.sqrt(n) / math.sqrt(2)) if spread else 0.0
    fisher = sum(-2 * math.log(max(p, 1e-12)) for p in (uniform, p_runs, serial))
    return gamma_tail(3, fisher / 2)


@pytest.mark.parametrize("symbols", ["0123456789abcdef", "0123456789ABCDEF", s._BASE32, s._BASE64, s._BASE64[:62], "abc1", "a1"])
def test_battery_equals_its_definition(symbols):
    rng = random.Random(len(symbols))
    for n in (9, 16, 24, 40, 64, 120):
        for _ in range(4):
            run = "".join(rng.choice(symbols) for _ in range(n))
            got, want = s.randomness(run), slow_randomness(run)
            # The cube-root approximation of chi-squared is good to a few thousandths.
            assert abs(got - want) < 0.02 + 0.05 * want, (run, got, want)


def test_random_strings_score_evenly_and_words_do_not():
    rng = random.Random(3)
    scores = [s.randomness("".join(rng.choice(s._BASE64) for _ in range(48))) for _ in range(400)]
    assert 0.3 < sum(scores) / 400 < 0.7 and sum(p < 0.05 for p in scores) < 50
    words = ["thereading", "nationsand", "whichother", "aboutthese"]
    assert all(s.randomness("".join(rng.choice(words) for _ in range(5))[:48]) < 0.05 for _ in range(50))


def slow_step_up(plain, found, level):
    """Benjamini-Hochberg over single candidates: p is the share of the text's own scores that are as high, its class alone."""
    kept = set()
    for c in range(s.LENGTHS):
        text = [b for k, b in plain if k == c]
        shorter = c - 1
        while len(text) < 100 and shorter >= 0:
            text += [b for k, b in plain if k == shorter]
            shorter -= 1
        mine = sorted(((sum(b >= bin for b in text) + 1) / (len(text) + 1), -bin, i) for i, (k, bin) in enumerate(found) if k == c)
        last = max((r for r, (p, _, _) in enumerate(mine, 1) if p <= level * r / len(mine)), default=0)
        kept |= {i for p, bin, i in mine if last and bin <= mine[last - 1][1]}
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_step_up_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    plain = [(rng.randrange(s.LENGTHS) if seed else 0, min(s.BINS - 1, int(rng.expovariate(0.15)))) for _ in range(900)]
    found = [(rng.randrange(s.LENGTHS), rng.randrange(s.BINS) if rng.random() < 0.5 else rng.randrange(20)) for _ in range(120)]
    rows = [([{"class": c, "bin": b}], [k * s.BINS + x for k, x in plain[i::120]]) for i, (c, b) in enumerate(found)]
    scans = spark.createDataFrame([(r,) for r in rows], "s struct<found: array<struct<class: int, bin: int>>, plain: array<int>>")
    least = s._least_bins(scans, "s")
    got = {i for i, (c, b) in enumerate(found) if b >= least[c]}
    assert got == slow_step_up(plain, found, s.LEVEL) and (got or seed)


def test_all_letters_of_all_texts_are_scored(spark, monkeypatch):
    """Every run of a text's own letters counts, at its end too, whatever is scored at once."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(rng.choice(["abcdef", "etaoinshrdlu", "ABCDEF", "AbCxYz"])) for _ in range(rng.randint(1, 30)))
    texts = ["", "é1", "abc", " ".join(word() for _ in range(900)), "face " * 60, "FACE " * 60, "QUEUE" * 30, "e" * 700] + [" 7-é".join(word() for _ in range(30)) for _ in range(20)]

    def slow(text):
        letters, cells = re.sub("[^A-Za-z]+", "", text), []
        for c, n in enumerate(s._LEAST):
            cells += [c * s.BINS + s.score_bin(s.randomness(letters[a : a + n])) for a in range(0, len(letters) - n + 1, n)]
        return collections.Counter(cells)

    for at_once in (s.LETTERS, 480):
        monkeypatch.setattr(s, "LETTERS", at_once)
        for text, got in zip(texts, s.own_scores(texts), strict=True):
            counted = collections.Counter()
            for x in got:
                counted[x % s.CELLS] += 1 + x // s.CELLS
            assert counted == slow(text), text[:50]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(s._scanned(s.F.col("text")).alias("s"))
    cells = [x for r in df.select("s.plain").collect() for x in r["plain"]]
    assert sum(1 + x // s.CELLS for x in cells) == sum(sum(slow(t).values()) for t in texts)
