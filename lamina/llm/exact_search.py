"""Exact top-k inner product search: cover trees over blocks of queries and data, searched in pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import staged, table

#: Rows of a block of data, and queries of a block, about; blocks that differ in place.
DATA_BLOCK, QUERY_BLOCK, MOST_PIVOTS = 4096, 4096, 512
#: Rows from which the pivots of the blocks are drawn.
SAMPLE = 20_000
#: Radius of a child's cover as a share of its parent's; points of a node that is not split, of data and of queries.
SHRINK, LEAF, QUERY_LEAF = 0.75, 48, 8
#: Points that make a leaf of their own if they lie within this share of their node's radius.
FEW, TIGHT = 4, 0.25
NONE = np.iinfo(np.int64).min
#: Stand for scores beyond 64 bits, which is an error only if they are wanted.
TOO_LOW, TOO_HIGH = NONE + 2, np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor holds null or non-finite components."""
    return vector.isNotNull() & F.forall(F.coalesce(vector, F.array()), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


class CoverNode:
    """A centre, the radius that covers all its rows, and children of smaller covers; a node without children is a leaf."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, centre: np.ndarray | None = None, leaf: int = LEAF) -> None:
        self.rows, self.centre = rows, x[rows[0]] if centre is None else centre
        self.radius = float(np.sqrt(((x[rows] - self.centre) ** 2).sum(1)).max())
        self.children: list[CoverNode] = []
        if len(rows) <= leaf or self.radius == 0 or centre is not None:
            return
        lone, left, reach = [], rows, self.radius * SHRINK
        while len(left):
            away = np.sqrt(((x[left] - x[left[0]]) ** 2).sum(1))
            near = away <= reach
            if near.sum() > leaf or (near.sum() >= FEW and away[near].max() <= self.radius * TIGHT):
                self.children.append(CoverNode(x, left[near], leaf=leaf))
            else:  # too few and too wide for a cover of their own: a leaf around this node's centre
                lone.append(left[near])
            left = left[~near]
        if lone and self.children:
            self.children.append(CoverNode(x, np.concatenate(lone), self.centre))


class _Search:
    """Best k rows of one block of data for each query of one block, by both trees together."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, worst: np.ndarray | None = None) -> None:
        self.q, self.q_ids, self.x, self.ids = q, q_ids, x, ids
        self.score = np.full((len(q), k), NONE)
        self.best = np.full((len(q), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(q), NONE) if worst is None else worst
        self.k, self.products_done = k, 0
        self.repeats = len(np.unique(ids)) < len(ids)
        most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
        self.huge = most >= 2**63  # then products are made as whole numbers of any size
        self.exact = most < 2**53  # then every sum is an exact double
        self.slack = 1e-9 * most + 1e-6
        self.qf, self.xf = q.astype(float), x.astype(float)

    def products(self, qs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        self.products_done += len(qs) * len(rows)
        if self.huge:
            return np.clip(self.q[qs].astype(object) @ self.x[rows].astype(object).T, TOO_LOW, TOO_HIGH).astype(np.int64)
        return (self.qf[qs] @ self.xf[rows].T).astype(np.int64) if self.exact else self.q[qs] @ self.x[rows].T

    def offer(self, qs: np.ndarray, rows: np.ndarray) -> None:
        score = self.products(qs, rows)
        ids = np.broadcast_to(self.ids[rows], score.shape)
        score = np.where(ids == self.q_ids[qs][:, None], NONE, score)
        score, ids = np.hstack([self.score[qs], score]), np.hstack([self.best[qs], ids])
        if self.repeats:  # of an id's rows the best one only takes a place
            order = np.lexsort((-np.maximum(score, NONE + 1), ids), axis=1)
            score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
            score[:, 1:][ids[:, 1:] == ids[:, :-1]] = NONE
        order = np.lexsort((ids, -np.maximum(score, NONE + 1)), axis=1)[:, : self.k]
        self.score[qs], self.best[qs] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)

    def worst(self, group: CoverNode) -> int:
        """The least kth score of the group's queries, here or known from elsewhere: no row below it is wanted."""
        return int(np.maximum(self.score[group.rows, -1], self.floor[group.rows]).min())

    def bound(self, group: CoverNode, node: CoverNode) -> float:
        return float(upper_bound(group.centre, group.radius, node.centre, node.radius)) + self.slack

    def run(self, group: CoverNode, node: CoverNode) -> None:
        """Searches a node for a group of queries: a pair whose bound is below the group's worst kth score is pruned whole."""
        if self.bound(group, node) < self.worst(group):
            return
        if not group.children and not node.children:
            self.offer(group.rows, node.rows)
        elif group.children and (not node.children or group.radius >= node.radius):
            for child in group.children:
                self.run(child, node)
        else:
            for child in sorted(node.children, key=lambda c: -self.bound(group, c)):
                self.run(group, child)


def upper_bound(centre, radius, other, reach):
    """No inner product of a point within `radius` of a centre and one within `reach` of another is larger."""
    norm, away = np.linalg.norm(centre, axis=-1), np.linalg.norm(other, axis=-1)
    return (centre * other).sum(-1) + norm * reach + radius * (away + reach)


def _block_search(k: int):
    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if not len(queries) or not len(data):
            return out
        q, x = (np.stack(f["v"].to_numpy()).reshape(len(f), -1) for f in (queries, data))
        search = _Search(q, queries["vec_id"].to_numpy(), x, data["vec_id"].to_numpy(), k, queries["worst"].to_numpy())
        search.run(CoverNode(search.qf, np.arange(len(q)), leaf=QUERY_LEAF), CoverNode(search.xf, np.arange(len(x))))
        found = search.score != NONE
        return pd.DataFrame({"query_id": np.repeat(search.q_ids, k)[found.ravel()], "vec_id": search.best[found], "score": search.score[found]})

    return run


def _pivots(vectors: DataFrame, dim: int, many: int, seed: int) -> np.ndarray:
    """Centres of the blocks: far apart from each other among a bounded sample of the vectors of one length."""
    rows = vectors.filter(F.size("v") == dim).orderBy(F.xxhash64(F.lit(seed), "vec_id", "v")).limit(SAMPLE).select("v").toPandas()
    x = np.stack(rows["v"].to_numpy()).reshape(len(rows), -1).astype(float)
    chosen, away = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(many, len(x)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _in_blocks(vectors: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """vec_id, v, block (nearest pivot) and away (distance to it) of the vectors of one length."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    fields = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("block", pa.int32()), ("away", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            if len(b):
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1).astype(float)
                apart = np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1), 0)
                at = apart.argmin(1)
                away = np.sqrt(((x - p[at]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int32()), pa.array(away)], schema=fields)

    rows = vectors.filter(F.size("v") == dim).select(F.col("vec_id").cast("long"), "v")
    return rows.mapInArrow(run, "vec_id long, v array<long>, block int, away double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `vectors` with the largest integer inner product.

    Both have vec_id and v (array of longs, none null). A query's own vec_id is no candidate; ties go
    to the smaller vec_id; vectors of another length are no candidates. Pivots from a bounded sample are the top of
    both trees: they cut queries and data into blocks with a centre and a radius. Each
    block of queries is searched first in the data of its own pivot; the kth scores found there prune pairs of blocks by
    their bounds, and only rows of the pairs left are shipped, each pair of parts to a task of
    its own, where two cover trees are searched together. A block's k best per query meet in a window of few rows.
    Repeated rows of a vec_id count once for a query, by their best score. Empty tables give no rows. Products may
    pass 64 bits; only if one of the k largest does is it an error.
    """
    data, asked = staged(vectors.select("vec_id", "v").distinct(), "vectors"), staged(queries.select("vec_id", "v").distinct(), "queries")
    dims = [r[0] for r in asked.select(F.size("v").alias("d")).distinct().collect()]
    found = [f for f in (_top_k_of_length(data, asked, d, k, seed) for d in dims) if f is not None]
    best = reduce(DataFrame.union, found) if found else data.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    lost = F.raise_error(F.lit("one of the largest inner products does not fit in 64 bits")).cast("long")
    score = F.when(F.col("score").isin(int(TOO_LOW), int(TOO_HIGH)), lost).otherwise(F.col("score"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def _top_k_of_length(data: DataFrame, asked: DataFrame, dim: int, k: int, seed: int) -> DataFrame | None:
    rows = data.filter(F.size("v") == dim).count()
    if not rows:
        return None
    spark = data.sparkSession
    pivots = _pivots(data, dim, min(MOST_PIVOTS, -(-rows // DATA_BLOCK)), seed)
    right, left = staged(_in_blocks(data, pivots, dim), "data-blocks"), staged(_in_blocks(asked, pivots, dim), "query-blocks")
    d_size, q_size, d_reach, q_reach = (np.zeros(len(pivots)) for _ in range(4))
    for frame, size, reach in ((right, d_size, d_reach), (left, q_size, q_reach)):
        for block, n, r in frame.groupBy("block").agg(F.count("*"), F.max("away")).collect():
            size[block], reach[block] = n, r

    def searched(pairs: list[tuple[int, int]], worst: DataFrame) -> DataFrame:
        """Results of the queries of each pair's first block among the data of its second, both cut into parts by hash."""
        parts = [(q, d, int(-(-q_size[q] // QUERY_BLOCK)), int(-(-d_size[d] // DATA_BLOCK))) for q, d in pairs]
        pair, same = (spark.createDataFrame(parts, "qb int, db int, qn int, dn int") for _ in range(2))
        part = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        a = left.join(worst, "vec_id", "left").join(pair, F.col("block") == F.col("qb")).select("vec_id", "v", F.coalesce("worst", F.lit(int(NONE))).alias("worst"), "qb", "db", part("qn").alias("qp"), every("dn").alias("dp"))
        b = right.join(same, F.col("block") == F.col("db")).select("vec_id", "v", "qb", "db", part("dn").alias("dp"), every("qn").alias("qp"))
        keys = ["qb", "db", "qp", "dp"]
        return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(lambda key, x, y: _block_search(k)(x, y), "query_id long, vec_id long, score long")

    some = [b for b in range(len(pivots)) if q_size[b]]
    none = spark.createDataFrame([], "vec_id long, worst long")
    own = staged(searched([(b, b) for b in some if d_size[b]], none), "own-blocks")
    kth = own.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    worst = staged(kth.filter(F.size("s") >= k).select(F.col("query_id").alias("vec_id"), F.col("s")[k - 1].alias("worst")), "worst")
    least = {b: w for b, n, w in left.join(worst, "vec_id", "left").groupBy("block").agg(F.count_if(F.col("worst").isNull()), F.min("worst")).collect() if not n}
    rest = []
    for q in some:
        bound = upper_bound(pivots[q], q_reach[q], pivots, d_reach)
        slack = 1e-9 * np.abs(bound) + 1e-3
        rest += [(q, int(d)) for d in np.flatnonzero((d_size > 0) & (bound + slack >= least.get(q, -np.inf))) if d != q]
    return own.union(searched(rest, worst)) if rest else own


def op8_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every fiftieth embedding; null vectors and such with null or non-finite components take no part."""
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)
