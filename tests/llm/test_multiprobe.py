"""Clustered vectors, where few buckets are visited, against brute force."""

import numpy as np

from millrace.llm import multiprobe


def test_small_clusters_get_all_neighbours(spark):
    """A cluster of three and an outlier far from a large cluster: both tables find the same few candidates."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(24)
    near = lambda at, n: at + 0.01 * rng.standard_normal((n, 24))
    vectors = np.concatenate([near(centre, 40), near(-centre, 3), rng.standard_normal((1, 24))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in multiprobe.nearest(df, lambda i: i >= 40).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(40, 43):
        cos = unit @ unit[q]
        cos[q] = -2
        assert [got[q].get(k) for k in range(1, 6)] == np.argsort(-cos, kind="stable")[:5].tolist()
    assert sorted(got[43]) == [1, 2, 3, 4, 5]


def test_structure_lets_most_of_the_table_go_unseen(spark, monkeypatch):
    """On clusters the chosen buckets hold far less than half of the table, and recall stays."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((60, 24))
    vectors = np.concatenate([c + 0.25 * rng.standard_normal((50, 24)) for c in centres])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    nearness = multiprobe._sample_nearness(unit, 5)
    chosen = multiprobe._choose_hashes(unit, len(unit), nearness, 2, 2.5, 1 - 0.03**0.5, 7)
    assert multiprobe._choose_hashes(unit, 10**9, nearness, 2, 2.5, 1 - 0.03**0.5, 7) >= chosen  # more vectors, no fewer projections
    table = multiprobe.Tables(24, 2, chosen, 2.5, 7)
    seen = []
    for t in range(2):
        x, slots = table.slots(unit, t)
        bucket = table.bucket(slots)
        seen += [np.isin(bucket, table.probes(x[i], t, nearness, 1 - 0.03**0.5)).mean() for i in range(0, len(unit), 100)]
    assert np.mean(seen) < 0.4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    # Small blocks: every bucket and its queries are cut.
    got = {}
    for r in multiprobe.nearest(df, lambda i: i % 50 == 0, block=16, asked=4).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in got:
        cos = unit @ unit[q]
        cos[q] = -2
        hits += len(set(np.argsort(-cos, kind="stable")[:5].tolist()) & set(got[q]))
    assert len(got) == 60 and hits / 300 >= 0.9
