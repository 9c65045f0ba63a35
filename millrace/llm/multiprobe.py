"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one, so that Euclidean and cosine order agree.  A table hashes a vector
to the slots floor((a.v + b) / width) of `hashes` Gaussian (2-stable) projections.  A query visits
perturbed buckets in the order of their estimated success: a neighbour at cosine c projects, given
the query's projection x, to a normal number with mean c x and variance 1 - c^2, so the probability
that it lies in a bucket is a product of normal masses over the slots.  Buckets are visited until
these probabilities sum to a table's share of `success`; with independent tables a neighbour at
cosine c is then found with that probability, and a nearer one with a higher one.  c is the fifth
best cosine within a bounded sample (`sample` vectors, first by hash), which is below what the whole
table offers.  Candidates of all tables are merged and ranked by exact cosine in double precision.

Tables, projections, width and success are chosen together: every one of SETTINGS is tried on queries of the sample, at each
of SUCCESS, and the cheapest is taken whose recall within the sample is at least `recall`.  Cost counts a comparison for every candidate
and VISIT comparisons for every bucket visited, in a table of the real size.  So buckets multiply as the table grows, as far as the vectors have structure to be found.  A
query whose order of buckets would be too long to list is treated as one without candidates.

Equal vectors are one class, of which the `neighbours` + 1 smallest ids are enough for any query.
A bucket is cut into blocks of about `block` classes and its queries into blocks of about `asked`; a
task compares one block with one other and returns only the best few of each query, so neither a full
bucket nor one that all queries visit lands in one task.  Queries for which the visited buckets held
too few candidates are compared with every bucket of the first table.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
do rows without an id; vectors meet only those of their own dimension; equal scores go to the smaller
id; a repeated (id, vector) row counts once; with fewer candidates than `neighbours`, all are returned;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import join_unique, materialize


#: Numbers of projections to choose from; a visit costs as much as so many comparisons; most buckets in a query's list.
HASHES, VISIT, LONGEST = (2, 4, 6, 8, 10, 12), 256, 1 << 14
#: Tables, projections and width to choose from, estimated success, and queries of the sample that are tried.
SETTINGS = ((2, 2, 2.5), (2, 4, 2.5), (3, 6, 1.5), (4, 6, 1.5), (4, 8, 2.0), (4, 10, 2.0), (4, 12, 2.5))
SUCCESS, TRIED = (0.8, 0.85, 0.88, 0.9, 0.92, 0.95, 0.97), 48


class Tables:
    """Projections of one dimension; the same on every machine."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int) -> None:
        rng = np.random.default_rng([seed, dim])
        self.n, self.m, self.width = tables, hashes, width
        self.lines = rng.standard_normal((tables, hashes, dim))
        self.shift = rng.uniform(0, width, (tables, hashes))
        #: Slots that hold all but a millionth of the normal distribution; what is beyond joins the last ones.
        self.reach = math.ceil(5 / width) + 1

    def slots(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        x = unit @ self.lines[table].T
        return x, np.clip(np.floor((x + self.shift[table]) / self.width), -self.reach, self.reach).astype(np.int64) + self.reach

    def bucket(self, slots: np.ndarray) -> np.ndarray:
        return slots @ (2 * self.reach + 1) ** np.arange(self.m, dtype=np.int64)

    def probes(self, x: np.ndarray, table: int, nearness: float, success: float) -> np.ndarray:
        """Buckets of one query by estimated success, until these sum to `success`; none if the list would be too long."""
        code, reached = self.order(x, table, nearness)
        return code[: int(np.searchsorted(reached, success)) + 1] if reached[-1] >= success else code[:0]

    def order(self, x: np.ndarray, table: int, nearness: float) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest buckets of one query, by estimated success, and the sums of it."""
        edges = (np.arange(-self.reach, self.reach + 2) * self.width)[None, :] - self.shift[table][:, None]
        edges[:, 0], edges[:, -1] = -np.inf, np.inf
        z = (edges - nearness * x[:, None]) / math.sqrt(1 - nearness**2)
        mass = np.diff(np.vectorize(math.erf)(z / math.sqrt(2)) / 2, axis=1)
        # The product of the slots' masses, line by line; only the most likely beginnings are carried on.
        joint, code = np.ones(1), np.zeros(1, np.int64)
        for j in range(self.m):
            joint = (joint[:, None] * mass[j][None, :]).ravel()
            code = (code[:, None] + np.arange(mass.shape[1])[None, :] * (2 * self.reach + 1) ** j).ravel()
            if len(joint) > LONGEST:
                best = np.argpartition(-joint, LONGEST)[:LONGEST]
                joint, code = joint[best], code[best]
        order = np.argsort(-joint, kind="stable")
        return code[order], np.cumsum(joint[order])


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (doubles) of the rows that take part, and the 128-bit hash of the vector."""
    vec = F.col(vec_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    rows = rows.where(~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0))
    return rows.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), F.reverse("vec")))


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: h1, h2, its `keep` smallest ids in order, vec."""
    first = Window.partitionBy("h1", "h2").orderBy("id")
    few = rows.withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= keep)
    return few.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.first("vec").alias("vec"))


def _unit(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)  # no overflow in the squares
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def nearest(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", neighbours: int = 5, recall: float = 0.94,
    block: int = 1024, asked: int = 256, sample: int = 4096, seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id, score.  is_query: condition on the id as a Column function."""
    spark = vectors.sparkSession
    rows = materialize(_usable(vectors, id_col, vec_col), "ann-rows")
    classes = materialize(_classes(rows, neighbours + 1), "ann-classes")
    queries = materialize(rows.where(is_query(F.col("id"))).select("id", "h1", "h2").distinct(), "ann-queries")
    sought = classes.join(queries.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "vec")

    # Thinned by hash to a few times the sample before the smallest hashes are taken.
    n_classes = classes.count()
    thin = F.pmod(F.col("h1"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < 4.0 * sample / max(1, n_classes)
    picked = [r["vec"] for r in classes.where(thin).orderBy("h1", "h2").limit(sample).select("vec").collect()]
    unit = _common_unit(picked)
    nearness = _sample_nearness(unit, neighbours)
    tables, hashes, width, success = choose(unit, n_classes, nearness, neighbours, recall, seed)
    per_table = 1 - (1 - success) ** (1 / tables)

    def by_dim(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
        sizes = pa.compute.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes):
            yield batch.filter(pa.array(sizes == dim)) if (sizes != dim).any() else batch

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for whole in batches:
            for batch in by_dim(whole, 3):
                unit = _unit(batch.column(3))
                t = Tables(unit.shape[1], tables, hashes, width, seed)
                for table in range(tables):
                    bucket = t.bucket(t.slots(unit, table)[1])
                    key = [pa.array(np.full(len(unit), unit.shape[1])), pa.array(np.full(len(unit), table)), pa.array(bucket)]
                    yield pa.RecordBatch.from_arrays([*key, batch.column(0), batch.column(1), batch.column(2), batch.column(3)], ["dim", "t", "bucket", "h1", "h2", "ids", "vec"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for whole in batches:
            for batch in by_dim(whole, 2):
                unit = _unit(batch.column(2))
                t = Tables(unit.shape[1], tables, hashes, width, seed)
                for table in range(tables):
                    x, _ = t.slots(unit, table)
                    visits = [t.probes(x[i], table, nearness, per_table) for i in range(len(x))]
                    at = pa.array(np.repeat(np.arange(len(x)), [len(v) for v in visits]))
                    key = [pa.array(np.full(len(at), unit.shape[1])), pa.array(np.full(len(at), table)), pa.array(np.concatenate(visits))]
                    yield pa.RecordBatch.from_arrays([*key, batch.column(0).take(at), batch.column(1).take(at)], ["dim", "t", "bucket", "q1", "q2"])

    index = materialize(classes.select("h1", "h2", "ids", "vec").mapInArrow(hashed, "dim long, t long, bucket long, h1 long, h2 long, ids array<bigint>, vec array<double>"), "ann-index")
    sizes = index.groupBy("dim", "t", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n_classes"))
    visits = materialize(sought.mapInArrow(probed, "dim long, t long, bucket long, q1 long, q2 long"), "ann-visits")
    found = materialize(_compare(index, sizes, visits, sought, neighbours, asked), "ann-found")

    # Too few candidates in the visited buckets: these queries see every bucket of the first table.  An id that both
    # tables found counts once, and more than `neighbours` of them leave enough when the query's own is one of them.
    met = found.select("q1", "q2", F.explode("ids").alias("id")).distinct()
    enough = met.groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > neighbours)
    short = sought.join(enough, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")), "left_anti")
    short = short.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.size("vec").cast("long").alias("dim"))
    rest = short.join(sizes.where("t = 0").select("dim", "t", "bucket"), "dim").select("dim", "t", "bucket", "q1", "q2")
    rest = materialize(rest, "ann-rest")
    found = found.unionByName(_compare(index, sizes, rest, sought, neighbours, asked)).dropDuplicates(["q1", "q2", "h1", "h2"])

    listed = found.select("q1", "q2", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("q1", "q2").orderBy(F.col("score").desc(), "vec_id")
    listed = listed.withColumn("n", F.row_number().over(best)).where(F.col("n") <= neighbours + 1).drop("n")
    own = queries.select(F.col("id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"))
    answers = own.join(listed, ["q1", "q2"]).where(F.col("vec_id") != F.col("query_id"))
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def _common_unit(vectors: list[list[float]]) -> np.ndarray:
    """The sampled vectors of the commonest dimension, scaled to length one."""
    dims = [len(v) for v in vectors]
    common = max(set(dims), key=dims.count) if dims else 0
    same = [v for v in vectors if len(v) == common]
    unit = np.array(same, float).reshape(len(same), common)
    if len(unit):
        unit /= np.abs(unit).max(1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    return unit


def _sample_nearness(unit: np.ndarray, neighbours: int) -> float:
    """Lower quartile, over some of the sample, of the cosine of the last neighbour within the sample."""
    if len(unit) <= neighbours:
        return 0.1
    cos = np.sort(unit[:256] @ unit.T, axis=1)[:, -1 - neighbours]
    return float(np.clip(np.quantile(cos, 0.25), 0.05, 0.95))


def choose(unit: np.ndarray, n: int, nearness: float, neighbours: int, recall: float, seed: int) -> tuple[int, int, float, float]:
    """Tables, projections, width and success that cost least in a table of n vectors, of those with enough recall on the sample."""
    asked = unit[:TRIED]
    if len(unit) <= neighbours + 1:
        return (*SETTINGS[0], SUCCESS[-1])
    cosine = asked @ unit.T
    cosine[np.arange(len(asked)), np.arange(len(asked))] = -2
    wanted = np.argsort(-cosine, axis=1, kind="stable")[:, :neighbours]
    found = []
    for tables, hashes, width in [s for s in SETTINGS if s is SETTINGS[0] or 8 << s[1] <= n]:  # finer buckets would be empty
        t = Tables(unit.shape[1], tables, hashes, width, seed)
        per = [1 - (1 - s) ** (1 / tables) for s in SUCCESS]
        hits, share, visits = (np.zeros(len(SUCCESS)) for _ in range(3))
        slots = [t.slots(unit, table) for table in range(tables)]
        held = [np.unique(t.bucket(x), return_inverse=True) for _, x in slots]
        for i in range(len(asked)):
            # The first success at which each vector of the sample is a candidate.
            first = np.full(len(unit), len(SUCCESS))
            for table, (buckets, place) in enumerate(held):
                code, reached = t.order(slots[table][0][i], table, nearness)
                needed = np.searchsorted(per, np.concatenate([[0.0], reached[:-1]]), "right")
                needed[np.searchsorted(per, reached[-1], "right") <= needed] = len(SUCCESS)
                visits += [min(len(code), np.searchsorted(reached, p) + 1) for p in per]
                at = np.minimum(np.searchsorted(buckets, code), len(buckets) - 1)
                level = np.full(len(buckets), len(SUCCESS))
                level[at[buckets[at] == code]] = needed[buckets[at] == code]
                first = np.minimum(first, level[place])
            for k in range(len(SUCCESS)):
                hits[k] += (first[wanted[i]] <= k).mean()
                share[k] += (first <= k).mean()
        hits, share, visits = hits / len(asked), share / len(asked), visits / len(asked)
        found += [(n * share[k] + VISIT * visits[k], (tables, hashes, width, SUCCESS[k])) for k in range(len(SUCCESS)) if hits[k] >= recall]
    return min(found)[1] if found else (*SETTINGS[0], SUCCESS[-1])


def _choose_hashes(unit: np.ndarray, n: int, nearness: float, tables: int, width: float, success: float, seed: int) -> int:
    """The number of projections that costs least for the sample's queries, in a table of n vectors."""
    costs = {}
    for m in HASHES if len(unit) else HASHES[:1]:
        t = Tables(unit.shape[1], tables, m, width, seed)
        x, slots = t.slots(unit, 0)
        bucket = t.bucket(slots)
        visits = [t.probes(x[i], 0, nearness, success) for i in range(min(32, len(unit)))]
        if m == HASHES[0] or all(map(len, visits)):
            costs[m] = sum(n * np.isin(bucket, v).mean() + VISIT * len(v) for v in visits)
    return min(costs, key=costs.get)


def _compare(index: DataFrame, sizes: DataFrame, visits: DataFrame, sought: DataFrame, neighbours: int, asked: int) -> DataFrame:
    """q1, q2, h1, h2, ids, score: the best classes of each query in each block that it visits.  visits: stored."""
    key = ["dim", "t", "bucket"]
    # Both sides of a bucket are cut by hash: b numbers its blocks of classes, a its blocks of queries.
    met = visits.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / asked).cast("int").alias("askers"), F.count(F.lit(1)).alias("n_visits"))
    cuts = materialize(sizes.join(met, key), "ann-cuts")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    cut = join_unique(index, cuts.drop("n_visits"), key, "n_classes").withColumn("b", of("blocks", "h1", "h2")).withColumn("a", numbers("askers"))
    at = join_unique(visits, cuts.drop("n_classes"), key, "n_visits").withColumn("a", of("askers", "q1", "q2")).withColumn("b", numbers("blocks"))
    held = sought.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), "vec")
    left = at.join(held, ["q1", "q2"]).select(*key, "a", "b", "q1", "q2", "vec")

    def best(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(ours) or not len(theirs):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("q1", "q2", "h1", "h2", "ids", "score")})
        a, b = (np.stack(x["vec"].to_numpy()) for x in (ours, theirs))
        a, b = (x / np.abs(x).max(1, keepdims=True) for x in (a, b))
        na, nb = (np.sqrt((x * x).sum(1)) for x in (a, b))
        first = theirs["ids"].map(lambda x: x[0]).to_numpy(np.int64)
        out = []
        for s in range(0, len(a), 512):
            cos = (a[s : s + 512] @ b.T) / na[s : s + 512, None] / nb[None, :]
            k = min(neighbours + 1, len(b))
            least = np.partition(cos, len(b) - k, axis=1)[:, len(b) - k] - 1e-12
            i, j = np.nonzero(cos >= least[:, None])
            exact = (a[s + i] * b[j]).sum(1) / (na[s + i] * nb[j])
            order = np.lexsort((first[j], -exact, i))
            place = np.arange(len(i)) - np.searchsorted(i[order], i[order], "left")
            order = order[place < k]
            out.append((s + i[order], j[order], exact[order]))
        i, j, score = (np.concatenate([o[c] for o in out]) for c in range(3))
        cols = {"q1": ours["q1"].to_numpy()[i], "q2": ours["q2"].to_numpy()[i], "h1": theirs["h1"].to_numpy()[j], "h2": theirs["h2"].to_numpy()[j]}
        return pd.DataFrame(cols | {"ids": theirs["ids"].to_numpy()[j], "score": score})

    groups = [*key, "a", "b"]
    return left.groupBy(*groups).cogroup(cut.select(*groups, "h1", "h2", "ids", "vec").groupBy(*groups)).applyInPandas(
        best, "q1 long, q2 long, h1 long, h2 long, ids array<bigint>, score double"
    )
