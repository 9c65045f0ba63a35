"""URL filter by association rules: FP-growth over labelled URLs' tokens, pruned rules, an inverted index.

Explicit rules (verdict, host, path) come first: one fits its host and all subdomains where the URL's path starts with
its path, and the longest wins.  URLs that an explicit rule judges are the labelled ones.  Each becomes a basket of tokens
(scheme, labels of the host, path segments and query names and fragment with digits as `#`) and its verdict; Spark's FP-growth mines
itemsets of at least `min_support` of these baskets, and rules `tokens -> verdict` of at least `min_confidence` are kept unless a
rule of fewer of the same tokens says the same with no less confidence.  The other URLs take the verdict of the
most confident rule whose tokens they have (then of most support, then first by text), and `otherwise` without one.

Rules are found through an inverted index: each is filed under its rarest token, a URL looks up its own tokens
and checks the rules filed there.  The fit takes all tokens of every labelled URL.  Frequent tokens that the same labelled URLs have
stand for one another: FP-growth sees one of them (a set with two of them says what it says without one, so it makes no
rule that is kept), and each kept rule is then written out with every one of them; so long paths that always come together cost
one item, not 2^length itemsets.  With a support that is a share, the number of rules does not grow with the table, and at most
`most_rules` (most confident first, special cases dropped before) are broadcast.  URLs are judged on all their tokens, in one pass without a shuffle.

Defined cases: a null URL or one without `://` has empty host and path, no tokens, no rule and the verdict `otherwise`;
repeated rows are judged alike; without labelled URLs there are no mined rules; null ids and extra columns are
ignored or carried; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby, product

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]
_JUDGED = "mined_verdict string, mined_rule string, mined_confidence double"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; empty for null and for URLs without `://`."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def explicit(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null if none fits."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(start))
        found, verdict = F.when(fits, F.lit(at + start)).otherwise(found), F.when(fits, F.lit(says)).otherwise(verdict)
    return found, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: host labels from the right, then path segments, query names, fragment and scheme."""
    shape = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    named = lambda parts, kind: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), shape(x)))
    tail = F.regexp_extract(url, r"(?s)://[^?#]*(.*)$", 1)
    query, fragment = F.regexp_extract(tail, r"^\?([^#]*)", 1), F.regexp_extract(tail, r"(?s)#(.*)$", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    every = F.concat(named(F.reverse(F.split(host, r"\.")), "host"), named(F.split(path, "/"), "path"), named(names, "query"), named(F.array(fragment), "fragment"), named(F.array(scheme), "scheme"))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def same_urls(labelled: DataFrame, min_support: float) -> dict[str, list[str]]:
    """Frequent tokens that exactly the same rows have: under the first of them, all of them.

    Rows are told by two 64-bit hashes of their tokens, summed by exclusive or over the distinct ones.
    """
    sets = labelled.groupBy(F.array_sort("tokens").alias("tokens")).agg(F.count(F.lit(1)).alias("n"))
    least = math.ceil(min_support * labelled.count())
    rows = sets.select("n", F.xxhash64("tokens").alias("h"), F.xxhash64(F.lit(1), "tokens").alias("g"), F.explode("tokens").alias("token"))
    held = rows.groupBy("token").agg(F.sum("n").alias("n"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g")).where(F.col("n") >= least)
    alike = held.groupBy("n", "h", "g").agg(F.array_sort(F.collect_list("token")).alias("tokens")).where(F.size("tokens") > 1)
    return {r["tokens"][0]: r["tokens"] for r in alike.collect()}


def mine_rules(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8, most_rules: int = 10_000) -> list[tuple[tuple[str, ...], str, float, float]]:
    """labelled: tokens, verdict.  Rules (tokens, verdict, confidence, support), most confident first, general ones instead of their special cases."""
    if labelled.isEmpty():
        return []
    alike = same_urls(labelled, min_support)
    first = {t: one for one, tokens in alike.items() for t in tokens}
    stands = F.broadcast(labelled.sparkSession.createDataFrame([(first,)], "stands map<string,string>"))
    one = lambda t: F.coalesce(F.try_element_at("stands", t), t)
    tokens = F.array_distinct(F.transform("tokens", one))
    baskets = labelled.crossJoin(stands).select(F.concat(tokens, F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    rules = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).associationRules
    verdict = F.col("consequent")[0]
    kept = rules.where(F.startswith(verdict, F.lit("=")) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit("="))))
    kept = kept.select(F.array_sort("antecedent").alias("items"), F.substring(verdict, 2, 100).alias("verdict"), "confidence", "support")
    # Special cases of a rule with one token less go before the most confident are taken, the others after.
    less = kept.where(F.size("items") > 1).select("items", "verdict", "confidence", F.explode(F.transform("items", lambda t: F.array_remove("items", t))).alias("fewer"))
    general = kept.select(F.col("items").alias("fewer"), "verdict", F.col("confidence").alias("reached"))
    special = less.join(general, ["fewer", "verdict"]).where("reached >= confidence").select("items", "verdict").distinct()
    kept = kept.join(special, ["items", "verdict"], "left_anti").select("items", "verdict", "confidence", "support")
    kept = kept.withColumn("text", F.array_join("items", " ")).orderBy(F.desc("confidence"), F.desc("support"), "text", "verdict").limit(most_rules)
    found = [(tuple(r["items"]), r["verdict"], r["confidence"], r["support"]) for r in kept.collect()]
    return written_out(prune(found), alike, most_rules)


def written_out(rules: list[tuple[tuple[str, ...], str, float, float]], alike: dict[str, list[str]], most_rules: int) -> list[tuple[tuple[str, ...], str, float, float]]:
    """Every rule with each of the tokens that stand for one another, in the order of rules."""
    out: list[tuple[tuple[str, ...], str, float, float]] = []
    for (confidence, support), some in groupby(rules, key=lambda r: r[2:]):
        every = ((tuple(sorted(items)), r[1]) for r in some for items in product(*[alike.get(t, [t]) for t in r[0]]))
        texts = heapq.nsmallest(most_rules - len(out), every, key=lambda x: (" ".join(x[0]), x[1]))
        out += [(items, verdict, confidence, support) for items, verdict in texts]
    return out


def prune(rules: list[tuple[tuple[str, ...], str, float, float]]) -> list[tuple[tuple[str, ...], str, float, float]]:
    """Drops a rule if some of its tokens alone give its verdict with no less confidence."""
    by_verdict: dict[tuple[str, frozenset], float] = {(v, frozenset(items)): c for items, v, c, _ in rules}
    sized = sorted({len(items) for items, *_ in rules})

    def special(items: tuple[str, ...], verdict: str, confidence: float) -> bool:
        from itertools import combinations

        return any(by_verdict.get((verdict, frozenset(some)), -1.0) >= confidence for k in sized if k < len(items) for some in combinations(items, k))

    return [r for r in rules if not special(r[0], r[1], r[2])]


class Index:
    """Mined rules filed under their rarest token, the one that the fewest rules hold."""

    def __init__(self, rules: list[tuple[tuple[str, ...], str, float, float]]) -> None:
        held: dict[str, int] = {}
        for items, *_ in rules:
            for t in items:
                held[t] = held.get(t, 0) + 1
        self.filed: dict[str, list[tuple]] = {}
        for place, (items, verdict, confidence, _) in enumerate(rules):
            self.filed.setdefault(min(items, key=lambda t: (held[t], t)), []).append((place, frozenset(items), verdict, " ".join(items), confidence))

    def best(self, tokens: list[str]) -> tuple | None:
        """The first rule, in their order, whose tokens are all there."""
        own, least = set(tokens), None
        for t in own:
            for rule in self.filed.get(t, ()):
                if (least is None or rule[0] < least[0]) and rule[1] <= own:
                    least = rule
        return least


def judge(pages: DataFrame, rules: list[Rule], min_support: float = 0.01, min_confidence: float = 0.8, otherwise: str = "allow", most_rules: int = 10_000) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule and its confidence where one decides."""
    host, path = host_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), "url")
    rule, said = explicit(F.col("host"), F.col("path"), rules)
    known = parts.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    mined = mine_rules(known.where("said is not null").select("tokens", F.col("said").alias("verdict")), min_support, min_confidence, most_rules)
    index = pages.sparkSession.sparkContext.broadcast(Index(mined))

    @F.pandas_udf(_JUDGED)
    def matched(baskets: pd.Series) -> pd.DataFrame:
        best = [index.value.best(tokens) for tokens in baskets]
        return pd.DataFrame([(None, None, None) if b is None else b[2:] for b in best], columns=[c.split()[0] for c in _JUDGED.split(", ")])

    free = F.col("said").isNull()
    out = known.withColumn("m", matched(F.when(free, F.col("tokens")).otherwise(F.array().cast("array<string>"))))
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "m.mined_verdict", F.lit(otherwise)).alias("verdict"), "m.mined_rule", F.round("m.mined_confidence", 6).alias("mined_confidence"))
