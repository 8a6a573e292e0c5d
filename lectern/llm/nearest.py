"""Approximate nearest neighbours: stable projections, kd-trees, a chi-square stopping test.

Vectors are projected by ``m`` Gaussian directions. For a pair at true squared distance d2, the
squared distance of the projections is d2 times a chi-square variable with m degrees of freedom. A
search takes points in the order of their projected distance, verifies them exactly, and stops once
the next projected squared distance exceeds q times the k-th best true one, q being the chi-square
quantile of ``confidence``: a nearer point would have been met before with that probability.

Largest inner product is nearest Euclidean neighbour after one more coordinate is added, the root of
M^2 - |x|^2 for points (M: the largest norm) and 0 for queries.

Projected space is cut by a kd-tree, made from a sample of projections (16 for each region, at least
``sample`` and at most 2 ** 20), into at most ``max_regions`` regions of about ``region_size`` points; every
vector is indexed in its region, under a kd-tree of leaves. A region's points beyond region_size go to
further tasks, and so do its queries beyond ``block_rows``, so no task grows with the table or with a region
that all queries reach. Queries search their home region first; the bound found there tells which other
regions the stopping test still admits. Within a region, a block of queries goes through the leaves from
the nearest on; a leaf's points are compared with all queries of the block that it is still open to in one
product. Equal vectors are one point that keeps its k + 1 smallest ids, so copies, however many, neither
overfill a region nor multiply work.

Defined cases: vectors that are null, zero, hold null or non-finite components, or differ from the
commonest length take no part; so do null ids; repeated ids count as one; ties go to the smaller id;
fewer candidates than k give all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

_LEAF = 512
_BLOCK = 128  # queries that go through the leaves together
_MOST_SAMPLED = 1 << 20  # projections of m numbers each


def chi_square_quantile(p: float, m: int) -> float:
    """For an even number of degrees of freedom."""
    def below(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - total

    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class Cuts:
    """A kd-tree over projected space whose leaves are numbered regions."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.axis, self.at, self.depth = np.zeros(2**depth, int), np.zeros(2**depth), depth
        self._cut(1, sample, depth)

    def _cut(self, node: int, points: np.ndarray, depth: int) -> None:
        if not depth:
            return
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        self.axis[node] = int(spread.argmax())
        self.at[node] = float(np.median(points[:, self.axis[node]])) if len(points) else 0.0
        left = points[:, self.axis[node]] <= self.at[node] if len(points) else np.zeros(0, bool)
        self._cut(2 * node, points[left], depth - 1)
        self._cut(2 * node + 1, points[~left], depth - 1)

    def region(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (p[np.arange(len(p)), self.axis[node]] > self.at[node])
        return node - 2**self.depth


def _leaves(p: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree by medians."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        rows = todo.pop()
        if len(rows) <= _LEAF:
            out.append(rows)
            continue
        axis = np.ptp(p[rows], axis=0).argmax()
        order = rows[np.argpartition(p[rows, axis], len(rows) // 2)]
        todo += [order[: len(rows) // 2], order[len(rows) // 2:]]
    return out


def _unpack(blobs, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(-1, width)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best: largest score, then smallest id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q, "left") < k]


def search(ids: np.ndarray, x: np.ndarray, p: np.ndarray, queries: np.ndarray, pq: np.ndarray, bound: np.ndarray, base: np.ndarray, k: int, q: float):
    """The k best points of each query (largest inner product, then smallest id) that the test admits, as
    arrays (query, id, score). bound: squared distances that a point must beat; base: squared distance is
    base - 2 x.q."""
    leaves = _leaves(p)
    low, high = np.array([p[r].min(axis=0) for r in leaves]), np.array([p[r].max(axis=0) for r in leaves])
    out = []
    for at in range(0, len(queries), _BLOCK):
        own, near = queries[at:at + _BLOCK], pq[at:at + _BLOCK]
        away = np.maximum(np.maximum(low[None] - near[:, None], near[:, None] - high[None]), 0)
        away = np.einsum("qlm,qlm->ql", away, away)
        limit, top = bound[at:at + _BLOCK].copy(), np.full((len(own), k), -np.inf)
        found = []
        for leaf in np.argsort(away.min(axis=0), kind="stable"):
            open_to = np.flatnonzero(away[:, leaf] <= q * limit)
            if not len(open_to):
                continue
            rows = leaves[leaf]
            score = own[open_to] @ x[rows].T
            d = near[open_to, None] - p[rows][None]
            score[np.einsum("qlm,qlm->ql", d, d) > q * limit[open_to, None]] = -np.inf
            both = np.hstack([top[open_to], score])
            top[open_to] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k:]
            least = top[open_to].min(axis=1)
            i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            found.append((open_to[i] + at, ids[rows[j]], score[i, j]))
            beaten = np.where(least > -np.inf, np.maximum(0.0, base[at + open_to] - 2 * least) * (1 + 1e-9) + 1e-12, np.inf)
            limit[open_to] = np.minimum(limit[open_to], beaten)
        if found:
            block = [np.concatenate(c) for c in zip(*found)]
            kept = _best(*block, k)
            out.append([c[kept] for c in block])
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def nearest(vectors: DataFrame, query_ids, k: int = 20, m: int = 8, confidence: float = 0.97, region_size: int = 16_384, max_regions: int = 65_536,
            sample: int = 20_000, block_rows: int = 2_000, seed: int = 11) -> DataFrame:
    """vectors: (vec_id, embedding); query_ids: a condition on vec_id. Returns (query_id, rank, vec_id,
    score): the k rows found with the largest inner product with each query, without itself."""
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(
        "vec_id is not null and v is not null and forall(v, c -> coalesce(not isnan(c) and abs(c) < double('infinity'), false)) and exists(v, c -> c <> 0)"
    )
    out_schema = "query_id long, rank int, vec_id long, score double"
    sizes = good.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out_schema)
    width = sizes[0]["n"]
    good = good.filter(F.size("v") == width)
    order = Window.partitionBy("v").orderBy("vec_id")
    # Spark limits the ranks before it shuffles, so a vector with any number of copies sends few rows.
    ranked = good.withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= k + 1)
    classes = materialise(
        ranked.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("cid"), "v", "ids"), "vectors"
    )
    asked = good.filter(query_ids).select("vec_id", "v").distinct()
    queries = materialise(asked.join(classes.select("cid", "v"), "v").select("vec_id", "cid"), "queries")
    facts = classes.agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).alias("norm")).first()
    n, norm = facts["n"], facts["norm"]
    directions = np.random.default_rng(seed).normal(size=(width + 1, m))
    depth = max(0, math.ceil(math.log2(max(1, min(max_regions, n / region_size)))))

    def extended(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, norm * norm - (x * x).sum(axis=1)))[:, None]])

    def projected(batches):
        for b in batches:
            x = np.asarray(b.column(0).flatten(), np.float64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in extended(x) @ directions], pa.binary())], ["p"])

    wanted_rows = min(_MOST_SAMPLED, max(sample, 16 * 2**depth))
    picked = classes.filter(F.pmod(F.xxhash64("cid"), F.lit(max(1, n // wanted_rows))) == 0).select("v")
    cuts = Cuts(_unpack((r["p"] for r in picked.mapInArrow(projected, "p binary").toLocalIterator()) if depth else (), m, "f8"), depth)

    def place(as_query: bool):
        def run(batches):
            for b in batches:
                x = np.asarray(b.column(1).flatten(), np.float64).reshape(-1, width)
                p = (np.hstack([x, np.zeros((len(x), 1))]) if as_query else extended(x)) @ directions
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(cuts.region(p)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in p], pa.binary())],
                    ["cid", "region", "x", "p"],
                )
        return run

    placed = "cid long, region long, x binary, p binary"
    index = materialise(classes.select("cid", "v").mapInArrow(place(False), placed), "index")
    wanted = classes.join(queries.select("cid").distinct(), "cid", "left_semi").select("cid", "v")
    home = materialise(wanted.mapInArrow(place(True), placed).withColumn("bound", F.lit(float("inf"))), "home")
    q = chi_square_quantile(confidence, m)
    found_schema = "qid long, cid long, score double"
    keep = k + 1

    def in_region(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(ask):
            return pd.DataFrame({"qid": pd.Series(dtype="int64"), "cid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        qx = _unpack(ask["x"], width, "f8")
        base = norm * norm + (qx * qx).sum(axis=1)
        i, ids, score = search(
            own["cid"].to_numpy(), _unpack(own["x"], width, "f8"), _unpack(own["p"], m, "f8"), qx, _unpack(ask["p"], m, "f8"), ask["bound"].to_numpy(), base, keep, q
        )
        return pd.DataFrame({"qid": ask["cid"].to_numpy()[i], "cid": ids, "score": score})

    # At most max_regions rows, here and in searched().
    boxes = index.mapInArrow(_boxes(m), "region long, n long, low array<double>, high array<double>").groupBy("region").agg(
        F.sum("n").alias("n"), *(F.min(F.col("low")[j]).alias(f"low{j}") for j in range(m)), *(F.max(F.col("high")[j]).alias(f"high{j}") for j in range(m))
    ).toPandas()
    chunks = dict(zip(boxes["region"].tolist(), (-(-boxes["n"] // region_size)).tolist()))

    # A region's points go in chunks, its queries in parts, and every chunk meets every part in a task of its own.
    def searched(asks: DataFrame) -> DataFrame:
        parts = {r["region"]: -(-r["n"] // block_rows) for r in asks.groupBy("region").agg(F.count("*").alias("n")).collect()}
        plan = F.broadcast(spark.createDataFrame([(r, chunks[r], parts[r]) for r in parts if r in chunks], "region long, chunks int, parts int"))

        def own(side: DataFrame, mine: str, other: str, name: str, others: str) -> DataFrame:
            dealt = side.join(plan, "region").withColumn(name, F.pmod(F.xxhash64("cid"), F.col(mine)).cast("int"))
            return dealt.withColumn(others, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("chunks", "parts")

        key = ["region", "chunk", "part"]
        return own(index, "chunks", "parts", "chunk", "part").groupBy(*key).cogroup(own(asks, "parts", "chunks", "part", "chunk").groupBy(*key)).applyInPandas(in_region, found_schema)

    first = materialise(searched(home), "first")
    result = first
    if depth:
        regions = boxes["region"].to_numpy()
        low, high = (boxes[[f"{s}{j}" for j in range(m)]].to_numpy() for s in ("low", "high"))
        top_first = Window.partitionBy("qid").orderBy(F.desc("score"))
        best_first = first.withColumn("r", F.row_number().over(top_first)).filter(F.col("r") <= keep)
        reached = best_first.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        ask = home.join(reached, F.col("cid") == F.col("qid"), "left").select("cid", "region", "x", "p", F.when(F.col("n") >= keep, F.col("least")).alias("least"))

        def further(batches):
            for b in batches:
                x, p = _unpack(b.column(2).to_pylist(), width, "f8"), _unpack(b.column(3).to_pylist(), m, "f8")
                least = b.column(4).to_numpy(zero_copy_only=False)
                bound = np.where(np.isnan(least), np.inf, np.maximum(0, norm * norm + (x * x).sum(axis=1) - 2 * np.nan_to_num(least)) * (1 + 1e-9) + 1e-12)
                home_of = b.column(1).to_numpy()
                for i in range(b.num_rows):
                    away = np.maximum(np.maximum(low - p[i], p[i] - high), 0)
                    to = regions[((away * away).sum(axis=1) <= q * bound[i]) & (regions != home_of[i])]
                    one = b.slice(i, 1)
                    if len(to):
                        again = pa.array(np.zeros(len(to), np.int64))
                        yield pa.RecordBatch.from_arrays(
                            [one.column(0).take(again), pa.array(to), one.column(2).take(again), one.column(3).take(again), pa.array(np.full(len(to), bound[i]))],
                            ["cid", "region", "x", "p", "bound"],
                        )

        more = materialise(ask.mapInArrow(further, placed + ", bound double"), "further")
        result = first.unionByName(searched(more))
    # k + 1 classes of at most k + 1 ids each for a query; the best k + 1 of their ids hold the answer.
    top = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    few = result.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= keep).select("qid", "cid", "score")
    named = few.join(classes.select("cid", "ids"), "cid")
    answers = named.groupBy("qid").agg(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id")))).alias("l")).select(
        "qid", F.slice(F.array_sort(F.flatten("l")), 1, keep).alias("l")
    )
    told = queries.join(answers, F.col("cid") == F.col("qid")).select("vec_id", F.expr(f"slice(filter(l, x -> x.id <> vec_id), 1, {k})").alias("l"))
    return told.select(F.col("vec_id").alias("query_id"), F.posexplode("l").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score")
    )


def _boxes(m: int):
    def run(batches):
        for b in batches:
            p, region = _unpack(b.column(3).to_pylist(), m, "f8"), b.column(1).to_numpy()
            seen = np.unique(region)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen), pa.array([int((region == r).sum()) for r in seen]), pa.array([p[region == r].min(axis=0).tolist() for r in seen], pa.list_(pa.float64())),
                 pa.array([p[region == r].max(axis=0).tolist() for r in seen], pa.list_(pa.float64()))], ["region", "n", "low", "high"]
            )
    return run


def query(spark, sf_dir):
    from .common import table

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
