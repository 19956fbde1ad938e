"""Approximate nearest neighbours: a forest of random-projection trees with one shared priority queue."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import record_batch, staged, table
from lamina.llm.exact_search import usable

#: Rows of a group of neighbouring leaves that one task compares, about; larger groups are cut by hash.
CHUNK = 65_536


@dataclass
class Forest:
    """Trees in heap order: node i has normal[t, i] and cut[t, i], children 2i+1 and 2i+2; leaves lie below."""

    normal: np.ndarray
    cut: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.normal)), np.int64)
        for t in range(len(self.normal)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = (x * self.normal[t, node]).sum(1) > self.cut[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def probes(self, q: np.ndarray, most: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the `most` leaves nearest to a query, over all trees in one queue.

        The queue holds open nodes by the sum of squared distances to the planes crossed on the way to them.
        """
        gap = np.einsum("tnd,d->tn", self.normal, q) - self.cut
        queue = [(0.0, t, 0) for t in range(len(gap))]
        found, inner = [], (1 << self.depth) - 1
        while queue and len(found) < most:
            far, t, node = heapq.heappop(queue)
            while node < inner:
                g = gap[t, node]
                side = int(g > 0)
                heapq.heappush(queue, (far + g * g, t, 2 * node + 2 - side))
                node = 2 * node + 1 + side
            found.append((t, node - inner))
        return found


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
    """Random projections cut at the median of the sample; an empty part takes a cut of 0."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    nodes = (1 << depth) - 1
    normal, cut = np.zeros((trees, max(nodes, 1), dim)), np.zeros((trees, max(nodes, 1)))
    for t in range(trees):
        parts = {0: np.arange(len(sample))}
        for i in range(nodes):
            rows = parts.pop(i)
            v = rng.standard_normal(dim)
            if len(rows) > 1:
                a, b = sample[rng.choice(rows, 2, replace=False)]
                if np.linalg.norm(a - b) > 0:
                    v = a - b  # the direction between two rows parts them better than a blind one
            normal[t, i] = v / max(np.linalg.norm(v), 1e-12)
            along = sample[rows] @ normal[t, i]
            cut[t, i] = np.median(along) if len(rows) else 0.0
            high = (sample[rows] * normal[t, i]).sum(1) > cut[t, i]
            parts[2 * i + 1], parts[2 * i + 2] = rows[~high], rows[high]
    return Forest(normal, cut, depth)


def _leaf_search(k: int):
    """Best k rows of each query among the rows of its leaves, of one group of leaves."""

    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(queries) or not len(data):
            return out
        order = np.lexsort((data["vec_id"].to_numpy(), data["leaf"].to_numpy()))
        ids, leaf, x = data["vec_id"].to_numpy()[order], data["leaf"].to_numpy()[order], np.stack(data["v"].to_numpy())[order]
        most = k * int(np.unique(ids, return_counts=True)[1].max())  # rows of an id take one place
        found = []
        for q_id, q, leaves in zip(queries["vec_id"], queries["v"], queries["leaves"], strict=True):
            low, high = np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, side="right")
            rows = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
            rows = rows[ids[rows] != q_id]
            rough = x[rows] @ q
            if len(rows) > most:  # what rounding might put among the best stays for the exact comparison
                rows = rows[rough >= np.partition(rough, -most)[-most] - 1e-9 * (1 + np.abs(rough).max())]
            score = np.cumsum(x[rows] * q, axis=1)[:, -1]  # summed in the order of the components, whatever the block
            best = np.lexsort((ids[rows], -score))
            _, first = np.unique(ids[rows][best], return_index=True)
            best = best[np.sort(first)[:k]]
            found.append((np.full(len(best), q_id), ids[rows][best], score[best]))
        return pd.DataFrame(dict(zip(out.columns, map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return run


def needed_probes(forest: Forest, sample: np.ndarray, k: int, recall: float, most: int, queries: int = 100) -> int:
    """Least number of probes, at most `most`, with which the forest finds the share `recall` of the k nearest of a sample.

    Rows of the sample stand for queries. In all of the data neighbours are nearer than in a sample of
    it, so the recall there is not lower as a rule.
    """
    q = sample[: min(queries, len(sample))]
    score = q @ sample.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    true = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
    leaf = forest.leaves(sample)
    first = []
    for i in range(len(q)):
        at = {p: n for n, p in enumerate(forest.probes(q[i], most))}
        first += [min(at.get((t, leaf[j, t]), most) for t in range(leaf.shape[1])) for j in true[i]]
    return int(np.sort(first)[min(len(first) - 1, int(np.ceil(recall * len(first))))]) + 1 if first else most


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 16, leaf_rows: int = 128, recall: float = 0.95, sample_rows: int = 20_000, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: up to k rows with the largest inner product among the leaves searched.

    Both frames have vec_id and v (array of doubles, none null). The forest is fitted on
    at most `sample_rows` rows, those with the least hash of their id; its depth follows the number of rows (leaves of about
    `leaf_rows`, as far as the sample goes), and every row is in a leaf of every tree. A query's leaves come from one
    priority queue over all trees, as many as find the share `recall` of the neighbours within the
    sample; its candidates there are compared exactly. If there are k other rows or fewer, all are found.
    Leaves are cut by hash into chunks, so a leaf that holds a large part of the rows is no one
    task's. Ties go to the smaller vec_id; repeated rows of a vec_id count once, by the best of those
    searched. Vectors of another length are no candidates. Empty tables give no rows.
    """
    data, asked = staged(vectors.select("vec_id", "v").distinct(), "vectors"), queries.select("vec_id", "v").distinct()
    dims = [r[0] for r in asked.select(F.size("v").alias("d")).distinct().collect()]
    found = [_found_of_length(data, asked, d, k, trees, leaf_rows, recall, sample_rows, seed) for d in dims]
    found = [f for f in found if f is not None]
    if not found:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = reduce(DataFrame.union, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found_of_length(data: DataFrame, asked: DataFrame, dim: int, k: int, trees: int, leaf_rows: int, recall: float, sample_rows: int, seed: int) -> DataFrame | None:
    """Pairs (query_id, vec_id, score) of the queries of one length with the best of their leaves."""
    data, asked = data.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    rows = data.count()
    sample = data.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample_rows).select("v").toPandas()
    if not rows or not dim:
        return None
    x = np.stack(sample["v"].to_numpy()).astype(float)
    depth = max(0, min(int(np.log2(max(1, rows / leaf_rows))), int(np.log2(max(1, len(x) / 16)))))
    forest = fit_forest(x, trees, depth, seed)
    probes = needed_probes(forest, x, k, recall, trees << depth) if rows > k + 1 else trees
    shared = data.sparkSession.sparkContext.broadcast(forest)
    fields = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("leaves", pa.list_(pa.int64()))])

    def unpacked(b: pa.RecordBatch) -> np.ndarray:
        return b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                leaf = shared.value.leaves(unpacked(b)) + (np.arange(trees) << depth)
                yield record_batch(fields, [b.column(0), b.column(1), pa.ListArray.from_arrays(np.arange(len(b) + 1, dtype=np.int32) * trees, leaf.ravel())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = unpacked(b)
                found = [[(t << depth) + leaf for t, leaf in shared.value.probes(x[i], probes)] for i in range(len(x))]
                yield record_batch(fields, [b.column(0), b.column(1), found])

    kind = "vec_id long, v array<double>, leaves array<long>"
    # Neighbouring leaves of a tree are searched together, so that a query has one list for each group it meets.
    shift = max(0, depth - int(np.ceil(np.log2(max(1, rows / CHUNK)))))
    group = F.call_function("shiftright", F.col("leaf"), F.lit(shift))
    placed = staged(data.select("vec_id", "v").mapInArrow(place, kind), "leaves").select("vec_id", "v", F.explode("leaves").alias("leaf")).withColumn("part", group)
    probed = asked.select("vec_id", "v").mapInArrow(probe, kind)
    every = F.array_distinct(F.transform("leaves", lambda leaf: F.call_function("shiftright", leaf, F.lit(shift))))
    of = F.filter("leaves", lambda leaf: F.call_function("shiftright", leaf, F.lit(shift)) == F.col("part"))
    probed = probed.select("vec_id", "v", "leaves", F.explode(every).alias("part")).select("vec_id", "v", "part", of.alias("leaves"))
    cuts = placed.groupBy("part").count().select("part", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))  # at most trees x leaves of the sample
    left = probed.join(F.broadcast(cuts), "part").select("vec_id", "v", "leaves", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    right = placed.join(F.broadcast(cuts), "part").select("vec_id", "v", "leaf", "part", F.pmod(F.xxhash64("vec_id", "v"), F.col("chunks")).cast("int").alias("chunk"))
    keys = ["part", "chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda key, a, b: _leaf_search(k)(a, b), "query_id long, vec_id long, score double")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of every twentieth embedding; null and zero vectors and such with null or non-finite components take no part."""
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    vectors = rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
