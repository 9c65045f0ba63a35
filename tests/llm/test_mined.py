"""URL rules, phrases and periodic runs against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import periodic_runs, phrases, queries, url_rules

from .test_operators import WORD, documents

# periodic runs


def brute_runs(x, times=4, least=6):
    n, out = len(x), set()
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(least, times * p) and not any(all(x[k] == x[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                out.add((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        n, k = rng.choice([0, 1, 5, 6, 7, 30, 90, 250]), rng.choice([1, 2, 3, 12])
        x = [rng.randint(1, k) for _ in range(n)]
        if n > 20 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 4))
            x[a:] = [x[a + (i - a) % p] for i in range(a, n)]
        yield x


def test_runs_equal_brute_force():
    found = 0
    for x in sequences(1, 400):
        got = [tuple(map(int, r)) for r in periodic_runs.runs_of(np.array(x, np.int64))]
        assert got == brute_runs(x)
        found += len(got)
    assert found > 100
    for x in sequences(2, 60):
        assert [tuple(map(int, r)) for r in periodic_runs.runs_of(np.array(x, np.int64), times=2, least=2)] == brute_runs(x, 2, 2)


def test_extensions_equal_brute_force():
    rng = random.Random(4)
    for x in sequences(3, 200):
        if len(x) < 6:
            continue
        i = [rng.randrange(len(x) - 1) for _ in range(30)]
        j = [rng.randrange(a + 1, len(x)) for a in i]
        want = [next((k for k in range(len(x)) if b + k >= len(x) or x[a + k] != x[b + k]), 0) for a, b in zip(i, j)]
        assert periodic_runs.Extensions(np.array(x, np.int64)).lce(np.array(i), np.array(j)).tolist() == want


def test_difference_cover():
    m, cover = periodic_runs.MODULUS, periodic_runs.COVER
    assert {(a - b) % m for a in cover for b in cover} == set(range(m))


def planted_words(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_run_report(spark):
    docs = documents(spark).where("length(text) < 3000 or text is null")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 2000))
    want = collections.Counter()
    for r in docs.collect():
        words = planted_words(r["doc_id"], r["text"])
        runs = brute_runs(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[(r["doc_id"], len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2], sha("".join("%d,%d,%d\n" % x for x in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))] += 1
    out = periodic_runs.run_report(docs)
    got = collections.Counter(tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in out.collect())
    assert got == want and sum(k[1] for k in want) > 10
    assert periodic_runs.run_report(docs.where("false")).count() == 0


def test_long_text_of_one_word(spark):
    docs = spark.createDataFrame([(1, "x " * 300_000)], "doc_id long, text string")
    (row,) = periodic_runs.find_runs(docs).collect()
    assert [tuple(r) for r in row["runs"]] == [(0, 300_000, 1)] and row["collapsed"] == "x"


# phrases


def brute_phrases(rows, least, longest=4, share=80, most=2000):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        found = []
        for p, a in good.items():
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= share * a for q, b in good.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def say_phrases(seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "über", "niño", "a-b", "x", "Z"]
    said = ["New York City", "new york", "the city of x", "Z z Z z Z z"]
    for i in range(300):
        parts = [rng.choice(said) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randrange(25))]
        yield rng.choice(["en", "de", None]), "".join(p + rng.choice([" ", " ", "\t", "  ", ", ", ".\n", "!\r"]) for p in parts)
    yield from [("en", None), ("en", ""), (None, "   "), ("fr", "alone"), ("de", "of the " * 40_000), ("de", "a b c d.\n" * 60_000)]


def test_phrases_equal_brute_force(spark):
    rows = list(say_phrases(5))
    docs = spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], "doc_id long, lang string, text string, n long, w0 string").repartition(5)
    for least, most in ((5, 2000), (30, 7)):
        got = sorted(tuple(r) for r in phrases.mine(docs, least=least, most=most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == brute_phrases(rows, least, most=most) and len(got) > 15
    assert phrases.mine(docs.where("false")).count() == 0


def test_phrases_with_a_crowded_bit_table(spark, monkeypatch):
    """Bits that other pairs set make windows longer and change nothing."""
    rows = list(say_phrases(6))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(phrases, "LEAST_BITS", 6)
    monkeypatch.setattr(phrases, "MOST_BITS", 6)
    got = sorted(tuple(r) for r in phrases.mine(docs, least=6).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute_phrases(rows, 6)


def test_phrase_scores_beyond_64_bits(spark):
    """Counts of 10^13 and more times 2,000,000."""
    counts = spark.createDataFrame([("en", 0, "", 4 * 10**18), ("en", 1, "a", 10**18), ("en", 1, "b", 10**18 + 1), ("en", 2, "a b", 10**18 - 1)], "lang string, m int, phrase string, f long")
    (row,) = phrases.rank_phrases(counts, 80, 10).collect()
    assert row["score"] == 2000000 * (10**18 - 1) // (2 * 10**18 + 1) and row["a"] == 10**18 - 1


# URL rules


def brute_url(url):
    host, _, rest = ("", "", "") if url is None or "://" not in url else (lambda r: (re.match(r"[^/?#]*", r)[0], "", r))(url.split("://", 1)[1])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + s), v, h + s) for v, h, s in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(s)]
    best = max(fits, default=(0, None, None))
    return host, path, best[2], best[1]


URLS = ["https://A.Example.ORG/es/5", "http://example.org/en/17?x=1#a", "http://notexample.org/en/1", "https://org", "https://org/", "ftp://x.com/de/?q=/fr/", "http://x.com/fr/a/b", "http://xcom/fr/", None, "", "no scheme/fr/", "a://b://c.com/de/", "http://c.com?/de/", "http://é.com/de/é"]


def test_explicit_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)] + [(None, URLS[0], "", "")], "page_id long, url string, host string, path string")
    got = url_rules.judge(pages, queries.URL_RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        if r["page_id"] is not None:
            host, path, rule, verdict = brute_url(URLS[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)
    assert url_rules.judge(pages.where("false"), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, [], otherwise="block").collect()} == {"block"}


def brute_mine(baskets, min_support, min_confidence):
    held, says = collections.Counter(), collections.Counter()
    for tokens, verdict in baskets:
        for k in range(1, len(tokens) + 1):
            for some in itertools.combinations(sorted(tokens), k):
                held[some] += 1
                says[some, verdict] += 1
    found = [(items, v, n / held[items]) for (items, v), n in says.items() if n >= min_support * len(baskets) and n / held[items] >= min_confidence]
    return {(i, v) for i, v, c in found if not any(w == v and len(j) < len(i) and set(j) <= set(i) and d >= c for j, w, d in found)}


def test_mined_rules_equal_every_subset_counted(spark):
    rng = random.Random(8)
    words = ["a", "b", "c", "d", "e", "f"]
    baskets = []
    for _ in range(400):
        tokens = sorted(rng.sample(words, rng.randint(1, 5)))
        bad = ("a" in tokens and "b" in tokens) or "f" in tokens and rng.random() < 0.9
        baskets.append((tokens, "block" if bad else "allow"))
    table = spark.createDataFrame(baskets, "tokens array<string>, verdict string").repartition(3)
    got = url_rules.mine_rules(table, 0.02, 0.85)
    assert {(r[0], r[1]) for r in got} == brute_mine(baskets, 0.02, 0.85) and (("a", "b"), "block") in {(r[0], r[1]) for r in got}
    assert [(-r[2], -r[3]) for r in got] == sorted((-r[2], -r[3]) for r in got)
    index = url_rules.Index(got)
    for tokens, _ in baskets:
        fits = [r for r in got if set(r[0]) <= set(tokens)]
        best = index.best(tokens)
        assert (best is None and not fits) or best[2:4] == (fits[0][1], " ".join(fits[0][0]))


def test_mined_rules_judge_held_out_urls(spark):
    """Hosts with a bad word are blocked under the ruled domain; the same words elsewhere are judged by the mined rules."""
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        bad = rng.random() < 0.3
        top = rng.choice(["org", "net"])
        rows.append((i, f"http://{'casino' if bad else rng.choice(['news', 'shop', 'blog'])}.{rng.choice('klmn')}.{top}/{'win' if bad else rng.choice(['a', 'b', 'c'])}/{i}", bad, top))
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean, top string")
    rules = [("block", f"casino.{x}.org", "/") for x in "klmn"] + [("allow", "org", "/")]
    out = url_rules.judge(pages, rules).join(pages.select("page_id", "bad", "top"), "page_id")
    assert out.where("(verdict = 'block') <> bad").count() == 0 and out.where("top = 'net' and mined_rule is null").count() == 0


@pytest.mark.parametrize("kind", ["host", "path"])
def test_tokens(spark, kind):
    url = F.lit("https://www.site7.example.net/en/123.html?utm=1&Page=2#top9")
    host, path = url_rules.host_path(url)
    tokens = spark.range(1).select(url_rules.tokens_of(url, host, path).alias("t")).first()["t"]
    want = {"host": ["host:net", "host:example", "host:site#", "host:www"], "path": ["path:en", "path:#.html"]}[kind]
    assert [t for t in tokens if t.startswith(kind)] == want and {"query:utm", "query:Page", "fragment:top#", "scheme:https"} < set(tokens)


def brute_rules(rows, min_support, min_confidence):
    """All kept rules, from every subset of every row's tokens."""
    held, with_verdict = collections.Counter(), collections.Counter()
    for tokens, verdict in rows:
        for k in range(1, len(tokens) + 1):
            for items in itertools.combinations(sorted(tokens), k):
                held[items] += 1
                with_verdict[items, verdict] += 1
    strong = {key: n / held[key[0]] for key, n in with_verdict.items() if n >= min_support * len(rows) and n / held[key[0]] >= min_confidence}
    special = lambda a, v, c: any(w == v and len(b) < len(a) and set(b) <= set(a) and d >= c for (b, w), d in strong.items())
    return {(a, v, round(c, 9)) for (a, v), c in strong.items() if not special(a, v, c)}


def test_rules_from_all_tokens_of_long_urls(spark):
    """What decides stands behind the sixteenth token, in paths of any length."""
    rng = random.Random(12)
    long_path = [f"path:{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rows = []
    for i in range(120):
        bad = i % 3 == 0
        rows.append((long_path + [f"path:w{rng.randrange(4)}", "path:zbad" if bad else "path:zgood"], "block" if bad else "allow"))
    got = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    assert {(r[0], r[1]) for r in got if r[2] == 1.0} == {(("path:zbad",), "block"), (("path:zgood",), "allow")}
    pages = [(i, f"http://h.org/{'/'.join('abcdefghijklmnopqrstu'[: 18 + i % 3])}/{'bad' if i % 2 else 'fine'}") for i in range(80)]
    pages += [(100 + i, f"http://other.net/x/{'bad' if i % 2 else 'fine'}") for i in range(10)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    rules = [("block", "h.org", "/" + "/".join("abcdefghijklmnopqrstu"[: 18 + k]) + "/bad") for k in range(3)] + [("allow", "h.org", "/")]
    verdict = {r["page_id"]: r["verdict"] for r in url_rules.judge(df, rules, otherwise="none").collect()}
    assert all(verdict[i] == ("block" if i % 2 else "allow") for i in [*range(80), *range(100, 110)])


def test_rules_with_tokens_that_come_together_equal_brute_force(spark):
    rng = random.Random(13)
    for _ in range(2):
        rows = []
        for _ in range(90):
            tokens = {t for t in "abcd" if rng.random() < 0.5}
            tokens |= {"a2", "a3"} if "a" in tokens else set()
            tokens |= {"b2"} if "b" in tokens else set()
            rows.append((sorted(tokens), "block" if ("a" in tokens) + ("c" in tokens) + (rng.random() < 0.3) >= 2 else "allow"))
        got = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.03, 0.7)
        assert {(r[0], r[1], round(r[2], 9)) for r in got} == brute_rules(rows, 0.03, 0.7) and any("a3" in r[0] for r in got)
        assert got == sorted(got, key=lambda r: (-r[2], -r[3], " ".join(r[0]), r[1]))
