"""Quality rules under weak supervision, in DataFrame functions only.

Eight overlapping rules read counts of the whole text and vote good (1), bad (-1) or abstain (0); all abstain on texts of
fewer than LEAST words, which the base rule settles.  Their thresholds are near what good documents show, so single votes err.  Junk comes in
kinds, each of which sets off its own rules: a latent class model has one class of good documents and
one for each kind in KINDS, and in each class every rule has a rate of voting bad when it votes at all.
Rates and class shares are fitted to the votes by expectation-maximisation; a document is kept when its
posterior probability of the good class reaches `threshold`.  So a bad vote of a rule that often fires beside good
votes, such as those on length, lines and headlines, is outvoted unless others join it, and one of a rule that hardly ever fires
on good documents decides.  Which votes go with good documents is learned: where most texts with repeated lines are junk in
other ways too, the others with repeated lines go with them.  The rates have Beta priors that weigh as much as PRIOR_SHARE of the corpus; nothing
else bounds them.  Votes of all documents enter the fit: they are counted by vote pattern first, at most
3**8 patterns however large the corpus, and the whole fit is one expression over that table.

Defined cases: null or wordless text has all counts 0 and fails the base rule; texts of any length
are counted whole; repeated rows are judged alike; an empty table gives an empty result; null ids
are carried; other columns are ignored by `judge` and carried unchanged by `keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let, materialize, unused_name, words_of

#: Each rule's measure (a count over another), and the values beyond which it votes bad and good; `length` and `word_length` are ranges.
THRESHOLDS = {
    "symbols": ("n_symbols", "n_words", 0.25, 0.02), "lines": ("n_dup_lines", "n_lines", 0.1, 0.02), "repeats": ("n_repeat_words", "n_words", 0.45, 0.1),
    "capitals": ("n_capitals", "word_chars", 0.4, 0.1), "shouts": ("n_shouts", "n_words", 0.2, 0.02), "headlines": ("n_capitals", "word_chars", 0.05, 0.03),
}
#: Fewer words are short, more are long enough; words of a mean length outside the first range are odd, inside the second usual.
LENGTHS, WORD_LENGTHS, LEAST = (80, 120), ((3.8, 7.0), (4.3, 6.0)), 50
RULES = ("length", "symbols", "lines", "repeats", "word_length", "capitals", "shouts", "headlines")
#: Rules that a kind of junk sets off.  Short texts are no kind of their own: length is judged by how it goes with the rest.
KINDS = {"repetition": ("repeats",), "shouting": ("capitals", "shouts"), "noise": ("symbols", "word_length")}
#: Beta priors: mean rate of bad votes on good documents; on junk by rules of its kind, and by others; their weight.
ALARM = {"length": 0.1, "symbols": 0.005, "lines": 0.05, "repeats": 0.005, "word_length": 0.01, "capitals": 0.01, "shouts": 0.01, "headlines": 0.03}
CATCH, STRAY = 0.5, 0.05
#: Weight of the priors of the good class and of a kind of junk, as shares of the corpus.
PRIOR_SHARE, KIND_SHARE = 0.01, 0.001
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts")


#: Up to so many different repeated windows are looked up one by one; beyond, windows are sorted with their places.
FEW_REPEATS = 32


def _repeat_words(windows: Column) -> Column:
    """Words covered by a three-word window that occurs at least twice; windows: their 64-bit hashes in order.

    Texts without a repeat end at the distinct count.  In the others sorted hashes give the repeated
    ones, and their places are looked up if they are few, else found by sorting hashes with places.
    """

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + i + 3 - F.greatest(i, acc["end"])).cast("long").alias("n"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    def looked_up(repeated: Column) -> Column:
        at = F.transform(windows, lambda h, i: F.when(F.array_contains(repeated, h), i))
        return covered(F.filter(at, lambda i: i.isNotNull()))

    def sorted_with_places(pairs: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
        marked = F.filter(pairs, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return covered(F.sort_array(F.transform(marked, lambda x: x["i"])))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda h, k: h == F.get(s, k - 1))))
    repeats = let(again, lambda r: F.when(F.size(r) <= FEW_REPEATS, looked_up(r)).otherwise(let(pairs, sorted_with_places)))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(repeats)


def with_stats(docs: DataFrame, out: str) -> DataFrame:
    """Adds the struct `out` of the counts that the rules read.

    The steps are columns of their own, so that sorting and distinct run on plain arrays of longs.
    """
    text, words, lines, windows = (unused_name(docs, f"{out}_{x}") for x in ("text", "words", "lines", "windows"))
    as_long = lambda c, name: c.cast("long").alias(name)
    left = lambda unwanted: F.length(F.regexp_replace(text, unwanted, ""))
    staged = (
        docs.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
        .withColumn(words, words_of(F.col(text)))
        .withColumn(lines, F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn(
            windows,
            F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
                F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.size(words) - 2)
            ),
        )
    )
    stats = F.struct(
        as_long(F.size(words), "n_words"), as_long(F.length(F.array_join(words, "")), "word_chars"),
        as_long(F.length(text) - left(r"[#*$%&|<>]+"), "n_symbols"), as_long(F.size(lines) - F.size(F.array_distinct(lines)), "n_dup_lines"),
        _repeat_words(F.col(windows)).alias("n_repeat_words"), as_long(F.size(lines), "n_lines"),
        as_long(F.length(text) - left(r"\p{Lu}+"), "n_capitals"), as_long(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), "n_shouts"),
    )
    return staged.select(*[f"`{c}`" for c in docs.columns], stats.alias(out))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def votes(s: Column) -> Column:
    """Array of one vote per rule, in the order of RULES; all abstain on short texts."""
    per = lambda name, whole: s[name] / F.greatest(s[whole], F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    word, (odd, usual) = per("word_chars", "n_words"), WORD_LENGTHS
    cast = {name: vote(per(count, whole) > bad, per(count, whole) < good) for name, (count, whole, bad, good) in THRESHOLDS.items()}
    cast["length"] = vote(s["n_words"] < LENGTHS[0], s["n_words"] >= LENGTHS[1])
    cast["word_length"] = vote((word < odd[0]) | (word > odd[1]), (word > usual[0]) & (word < usual[1]))
    return F.when(s["n_words"] < LEAST, F.array(*[F.lit(0) for _ in RULES])).otherwise(F.array(*[cast[x] for x in RULES]))


def prior_rates() -> list[list[float]]:
    """Mean rate of bad votes by class (good first) and rule."""
    return [list(ALARM.values())] + [[CATCH if rule in own else STRAY for rule in RULES] for own in KINDS.values()]


def fit_votes(patterns: DataFrame, rounds: int = 25) -> DataFrame:
    """patterns: votes array<int>, n long, one row per pattern.  Adds p_good, the posterior.

    Starts from the rules' kinds: a bad vote makes its kind twenty times as likely as a good document.
    """
    rates = F.array(*[F.array(*[F.lit(x) for x in row]) for row in prior_rates()])
    classes, rules = (F.sequence(F.lit(0), F.lit(k - 1)) for k in (1 + len(KINDS), len(RULES)))
    weigh = lambda own: 0.02 + sum((F.when(F.get(F.col("votes"), RULES.index(r)) == -1, 20.0).otherwise(0.0) for r in own), F.lit(0.0))
    begun = F.array(F.lit(1.0), *[weigh(own) for own in KINDS.values()])
    table = F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"), begun.alias("begun"))))
    summed = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    shares = lambda values: let(summed(values), lambda s: F.transform(values, lambda x: x / s))

    def fit(t: Column) -> Column:
        everything = summed(F.transform(t, lambda p: p["n"]))

        def step(state: Column) -> Column:
            total = lambda pick: summed(F.zip_with(t, state, pick))

            def rate(c: Column, j: Column) -> Column:
                cast = lambda vote: total(lambda p, r: F.when(F.get(p["votes"], j) == vote, p["n"] * F.get(r, c)).otherwise(0.0))
                weight = everything * F.when(c == 0, PRIOR_SHARE).otherwise(KIND_SHARE)
                counts = F.struct(cast(-1).alias("bad"), cast(1).alias("good"), weight.alias("weight"))
                # Null only where there are no documents at all.
                return let(counts, lambda s: F.try_divide(s["bad"] + s["weight"] * F.get(F.get(rates, c), j), s["bad"] + s["good"] + s["weight"]))

            share = lambda c: F.log((total(lambda p, r: p["n"] * F.get(r, c)) + 1) / (everything + len(KINDS) + 1))
            model = F.transform(classes, lambda c: F.struct(share(c).alias("share"), F.transform(rules, lambda j: rate(c, j)).alias("rates")))
            pull = lambda v, x: F.when(v == -1, F.log(x)).when(v == 1, F.log(1 - x)).otherwise(0.0)

            def posterior(m: Column) -> Column:
                scores = lambda p: F.transform(m, lambda k: F.aggregate(F.zip_with(p["votes"], k["rates"], pull), k["share"], lambda a, x: a + x))
                relative = lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
                return F.transform(t, lambda p: let(let(scores(p), relative), shares))

            return let(model, posterior)

        start = F.transform(t, lambda p: let(p["begun"], shares))
        final = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda state, _: step(state))
        return F.zip_with(t, final, lambda p, r: F.struct(p["votes"].alias("votes"), F.get(r, F.lit(0)).alias("p_good")))

    return patterns.agg(let(table, fit).alias("fitted")).select(F.explode("fitted").alias("f")).select("f.votes", "f.p_good")


def _posteriors(voted: DataFrame, votes_col: Column) -> DataFrame:
    """One row per vote pattern, at most 3**8: the size that bounds the broadcast."""
    patterns = voted.groupBy(votes_col.alias("votes")).agg(F.count(F.lit(1)).alias("n"))
    return materialize(fit_votes(patterns), "quality-votes")


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, counts, base_failed, kept and quality_prob for every row of documents."""
    stats = materialize(with_stats(docs.select("doc_id", "text"), "s").select("doc_id", "s"), "quality-stats")
    voted = stats.withColumn("votes", votes(F.col("s")))
    fitted = F.broadcast(_posteriors(voted, F.col("votes")))
    s, joined = F.col("s"), voted.join(fitted, "votes", "left")
    return joined.select(
        "doc_id", *[s[c].alias(c) for c in STATS[:5]], base_failed(s).alias("base_failed"),
        (~base_failed(s) & (F.col("p_good") >= threshold)).alias("kept"), F.round("p_good", 6).alias("quality_prob"),
    )


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that `judge` keeps, all columns unchanged."""
    s, v = unused_name(docs, "quality_stats"), unused_name(docs, "quality_votes")
    stored = materialize(with_stats(docs, s), "quality-docs")
    voted = stored.withColumn(v, votes(F.col(s)))
    fitted = F.broadcast(_posteriors(stored, votes(F.col(s)))).alias("f")
    kept = voted.alias("d").join(fitted, F.col(f"d.`{v}`") == F.col("f.votes"), "left").where(~base_failed(F.col(f"d.`{s}`")) & (F.col("f.p_good") >= threshold))
    return kept.select(*[F.col(f"d.`{c}`") for c in docs.columns])
