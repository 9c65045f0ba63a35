"""Near copies against all pairs by brute force, and in the pipeline's stage."""

import random

import corpus_pipeline
from millrace.llm import near_copies, simhash

from .test_operators import documents


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_keep(rows):
    sets = [brute_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or len(a & b) >= 0.8 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted(least.values())


def test_stage_drops_near_copies(spark, tmp_path):
    """Copies with a few words changed, in chains and groups: far more than two bits of a fingerprint apart."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [None, "", " ", "one two", "One  TWO", "one two three"]
    for group in range(25):
        base = [word() for _ in range(rng.randint(60, 250))]
        texts.append(" ".join(base))
        for _ in range(12 if group < 3 else 3):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if rng.random() < 0.4:
                base = copy  # a chain: its ends may be less than 0.8 alike
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, df, str(tmp_path)).collect())
    assert got == brute_keep(rows)


def test_stage_rows_and_columns(spark, tmp_path):
    """Clashing columns, repeated ids, null ids and an empty table."""
    docs = documents(spark)
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()]
    assert sorted(i for i in ids if i is not None) == brute_keep(rows)
    assert near_copies.keep_one(docs.where("false")).count() == 0


def test_large_bands_are_settled_block_by_block(spark, monkeypatch):
    """Copies of copies that share bands with all others but reach the similarity only with some; tiny blocks."""
    monkeypatch.setattr(near_copies, "FEW", 3)
    monkeypatch.setattr(near_copies, "BLOCK", 5)
    monkeypatch.setattr(near_copies, "COLUMNS", 64)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(200)]
    texts = []
    for _ in range(70):
        copy = list(base)
        for _ in range(rng.randint(2, 9)):  # two copies are between 0.5 and 0.9 alike
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sketched = near_copies.sketches(df).cache()
    nodes = sketched.groupBy("node").agg({"id": "count"}).withColumnRenamed("count(id)", "n")
    found = {(r["a"], r["b"]) for r in near_copies.link_sketches(sketched, nodes).collect()}
    node = {r["id"]: r["node"] for r in sketched.collect()}
    sets = {node[i]: brute_set(t) for i, t in rows}
    assert found and all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in found)
    assert sorted(r["doc_id"] for r in near_copies.keep_one(df).collect()) == brute_keep(rows)


def test_stage_links_by_simhash_first(spark, tmp_path, monkeypatch):
    """Fingerprints are majority votes of the sets; the anchors' links alone drop copies that differ in two bits or fewer."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(20):
        base = [word() for _ in range(400)]
        texts += [" ".join(base), " ".join([*base, word()]), " ".join(base[1:])]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sketched = near_copies.sketches(df).cache()
    fp, node = {}, {}
    for r in sketched.collect():
        hashes = near_copies.shingles(texts[r["id"]]).tolist()
        votes = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
        assert r["fp"] & (1 << 64) - 1 == votes
        fp[r["node"]], node[r["id"]] = votes, r["node"]
    pairs = {(r["a"], r["b"]) for r in near_copies.anchor_pairs(sketched).collect()}
    assert pairs and all((fp[a] ^ fp[b]).bit_count() <= simhash.MOST for a, b in pairs)
    forest = simhash._Forest()
    for a, b in pairs:
        forest.join(a, b)
    ids = list(fp)
    assert all(forest.root(a) == forest.root(b) for a in ids for b in ids if (fp[a] ^ fp[b]).bit_count() <= simhash.MOST)
    monkeypatch.setattr(near_copies, "band_keys", lambda hashes, *_: [hash(hashes.tobytes()) + i for i in range(near_copies.BANDS)])  # bands that nobody shares
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, df, str(tmp_path)).collect()}
    by_prints = simhash._Forest()
    for i in range(60):
        for j in range(i):
            if (fp[node[i]] ^ fp[node[j]]).bit_count() <= simhash.MOST:
                by_prints.join(i, j)
    assert left == {by_prints.root(i) for i in range(60)} and len(left) < 60
