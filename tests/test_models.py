"""Trees per key, fold searches, robust scores, rank AUC, look-alikes against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from millrace.operators import evaluate, merchants, ml, trees


def brute_tree(rows, edges, depth, least, node=1):
    """rows: (x..., y); {node: (n, value, feature, threshold)}."""
    n, total = len(rows), sum(r[-1] for r in rows)
    best = None
    if depth:
        for f, cuts in enumerate(edges):
            for b, cut in enumerate(cuts):
                left = [r[-1] for r in rows if r[f] <= cut]
                if least <= len(left) <= n - max(least, 1):
                    right = total - sum(left)
                    gain = round(sum(left) ** 2 / len(left) + right**2 / (n - len(left)) - total**2 / n, 3)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, f, cut
    found = {node: (n, round(total / n, 6), best and best[1], best and best[2])}
    if best:
        _, f, cut = best
        found |= brute_tree([r for r in rows if r[f] <= cut], edges, depth - 1, least, 2 * node)
        found |= brute_tree([r for r in rows if r[f] > cut], edges, depth - 1, least, 2 * node + 1)
    return found


def test_trees_of_many_keys_equal_one_by_one(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 20), float(rng.randint(0, 9)), rng.randint(0, 3)) for k in ["a"] * 900 + ["b"] * 60 + ["c"] * 12]
    rows = [(k, x, y, 100 * (x > 7) + 40 * (y > 4 and x > 7) + noise) for k, x, y, noise in rows]
    df = spark.createDataFrame([*rows, ("a", None, 1.0, 5), ("a", 1, 1.0, None)], "k string, x int, y double, t int").repartition(5)
    edges = {"x": [float(i) for i in range(1, 20, 3)], "y": [2.0, 4.0, 6.0]}
    grown = trees.grow_trees(df, ["k"], edges, "t", depth=2, least=10)
    want = {(k, node): v for k in "abc" for node, v in brute_tree([r[1:] for r in rows if r[0] == k], list(edges.values()), 2, 10).items()}
    names = dict(enumerate(edges))
    got = {(r["k"], r["node"]): (r["n"], round(r["value"], 6), r["feature"], r["threshold"]) for r in grown.collect()}
    assert got == {at: (n, v, names.get(f), cut) for at, (n, v, f, cut) in want.items()} and want["a", 1][2] == 0

    def leaf(k, x, y):
        node = 1
        while want[k, node][2] is not None:
            node = 2 * node + ((x, y)[want[k, node][2]] > want[k, node][3])
        return want[k, node][1]

    out = trees.predict_trees(df.unionByName(spark.createDataFrame([("z", 1, 1.0, 0)], df.schema)), grown, ["k"], ["x", "y"], 2).collect()
    assert all(r["forecast"] is None if r["k"] == "z" or r["x"] is None else round(r["forecast"], 6) == leaf(r["k"], r["x"], r["y"]) for r in out) and len(out) == len(rows) + 3
    assert trees.grow_trees(df.where("false"), ["k"], edges, "t").count() == 0
    assert trees.even_edges(df.where("false"), ["x"]) == {"x": []} and trees.even_edges(df, ["x"], 4)["x"] == [5.0, 10.0, 15.0]


def test_boosted_trees_for_a_large_key(spark):
    df = spark.range(3000).select((F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z")).withColumn("y", F.when(F.col("x") > 20, 10.0).otherwise(0.0) + F.col("z"))
    out, _ = ml.fit_predict(df, df, ["x", "z"], "y", "boosted", maxIter=5, maxDepth=3)
    m = evaluate.regression_metrics(out.withColumn("one", F.lit(1)), "y", "prediction", ["one"]).first()
    assert m["r2"] > 0.9


@pytest.mark.parametrize("scheme", ["forward", "kfold"])
def test_fold_search_equals_a_fit_per_setting_and_fold(spark, scheme):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) * [1, 5, 0] + [0, 2, 7]  # the third feature is constant
    y = x @ [2, -1, 0] + rng.normal(size=400)
    fold = rng.integers(0, 4, 400)
    df = spark.createDataFrame([(*map(float, r), float(t), int(f)) for r, t, f in zip(x, y, fold)], "a double, b double, c double, y double, fold int")
    got = {(r["setting"], r["fold"]): r["r2"] for r in ml.fold_search(df, ["a", "b", "c"], "y", [0.01, 1.0], scheme).collect()}
    want = {}
    for f in range(4):
        learn = fold < f if scheme == "forward" else fold != f
        if not learn.any():
            continue
        mean, dev = x[learn].mean(0), np.where(x[learn].std(0) > 0, x[learn].std(0), 1)
        s = (x[learn] - mean) / dev
        for i, penalty in enumerate([0.01, 1.0]):
            b = np.linalg.lstsq(s.T @ s / learn.sum() + penalty * np.eye(3), s.T @ (y[learn] - y[learn].mean()) / learn.sum(), rcond=None)[0]
            e = y[fold == f] - y[learn].mean() - (x[fold == f] - mean) / dev @ b
            want[i, f] = 1 - (e**2).sum() / ((y[fold == f] - y[fold == f].mean()) ** 2).sum()
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert ml.random_penalties(3, 5) == ml.random_penalties(3, 5) != ml.random_penalties(4, 5)


def test_one_pass_for_any_grid(spark, monkeypatch):
    """As many Spark jobs for fifty penalties as for one."""
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("y"), (F.col("id") % 3).alias("fold"))
    calls = []
    plain = ml.products
    monkeypatch.setattr(ml, "products", lambda *x: calls.append(1) or plain(*x))
    assert ml.fold_search(df, ["a"], "y", [0.1 * i for i in range(1, 51)], "kfold").count() == 150 and len(calls) == 1


def test_medians_of_skewed_keys(spark):
    rng = random.Random(4)
    rows = [("heavy", rng.choice([1.0, 1.0, 1.0, rng.random() * 1e6])) for _ in range(3000)] + [("even", float(i)) for i in range(10)] + [("one", 5.0), (None, 3.0), (None, 4.0), ("none", None), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for bins in (4, 1024):
        got = {r["k"]: r["median"] for r in ml.median_per_key(df, ["k"], "v").collect()} if bins == 1024 else {r["k"]: (r["low"] + r["high"]) / 2 for r in ml.value_ranks(df, ["k"], "v", bins).collect()}
        assert got == {k: statistics.median([v for j, v in rows if j == k]) for k in ("heavy", "even", "one", None, "same")}
    scale = {r["k"]: (r["median"], r["mad"]) for r in ml.robust_scale(df, ["k"], "v").collect()}
    for k, (centre, mad) in scale.items():
        assert mad == statistics.median([abs(v - centre) for j, v in rows if j == k])
    scored = ml.robust_scores(df, ["k"], "v", ml.robust_scale(df, ["k"], "v"))
    assert scored.where("k = 'same' and robust_score is not null").count() == 0 and scored.count() == len(rows)
    top = scored.where("k = 'even'").agg(F.max("robust_score")).first()[0]
    assert abs(top - 0.6745 * (9 - 4.5) / 2.5) < 1e-12


def test_rank_auc_counts_pairs(spark):
    rng = random.Random(6)
    rows = [(rng.choice([0.0, 1.0, 2.0, rng.random() * 3]), int(rng.random() < 0.3)) for _ in range(300)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    df = spark.createDataFrame([*rows, (None, 1), (1.0, None)], "s double, label int").repartition(3)
    assert abs(ml.rank_auc(df, "s") - want) < 1e-12 and abs(ml.rank_auc(df, "s", ranges=3) - want) < 1e-12
    assert ml.rank_auc(df.where("label = 1"), "s") is None


def test_logistic_fit_has_no_gradient_left(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 2))
    label = (rng.random(500) < 1 / (1 + np.exp(-(x @ [1.5, -1] + 0.3)))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(y)) for (a, b), y in zip(x, label)], "balance double, n double, label int")
    out = ml.propensity(df, df, ["balance", "n"]).collect()
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(featuresCol="_x", labelCol="label", tol=1e-10, maxIter=200).fit(VectorAssembler(inputCols=["balance", "n"], outputCol="_x").transform(df))
    p = 1 / (1 + np.exp(-(x @ model.coefficients.toArray() + model.intercept)))
    assert np.abs(np.column_stack([x, np.ones(500)]).T @ (p - label)).max() / 500 < 1e-6
    order = {r["ranking"]: r["auc"] for r in out}
    assert order["logistic"] > order["balance"] > 0.5 and all(r["enough"] == (r["auc"] >= 0.62) for r in out)


def test_look_alikes_lose_no_pair(spark):
    rng = random.Random(11)
    words = ["SHOP", "CAFE", "CENTRO", "ZONA"] + [f"W{i}" for i in range(25)]
    say = lambda: " ".join(rng.choice(words[:4] if rng.random() < 0.5 else words) for _ in range(rng.randint(1, 6)))
    unknown, known = [say() for _ in range(120)] + [None, ""], sorted({say() for _ in range(150)})
    want = {}
    for a in {x for x in unknown if x}:
        best = max(((len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())), b) for b in known), key=lambda s: (round(s[0], 12), [-ord(c) for c in s[1]]))
        for least in (0.5, 0.8):
            if best[0] >= least - 1e-9:
                want[least, a] = round(best[0], 9)
    a, b = (spark.createDataFrame([(x,) for x in rows], "descr_norm string") for rows in (unknown, known))
    for least in (0.5, 0.8):
        got = merchants.look_alikes(a, b, least).collect()
        assert {(least, r["descr_norm"]): round(r["score"], 9) for r in got} == {k: v for k, v in want.items() if k[0] == least}
        ties = {r["descr_norm"]: r["match"] for r in got}
        for x, match in ties.items():
            score = lambda y: round(len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split())), 9)
            assert match == min(y for y in known if score(y) == max(map(score, known)))
    codes = spark.createDataFrame([(x, str(i)) for i, x in enumerate(known)], "descr_norm string, catalog_mcc string")
    merged, review = merchants.merge_answers(codes, merchants.propose_codes(a, codes), 0.8)
    fresh = sum(1 for k in want if k[0] == 0.8 and k[1] not in known)
    assert merged.count() == len(known) + fresh and review.where("confidence >= 0.8").count() == 0
