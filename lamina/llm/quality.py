"""Quality classifier: a generalised additive model with pairwise interactions over text features.

Cyclic boosting of shallow trees learns one lookup table of bins for each feature and each chosen
pair; a score is the sum of a few table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import byte_class, find_words, map_texts, mix, record_batch, span_hash, table, text_slices

#: Byte classes whose shares of a text are features.
CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "stop": b".,;:?'\"()-",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"%&*$#@^~=+<>[]{}\\/_`",
    "line": b"\n",
    "high": bytes(range(128, 256)),
}
FEATURES = (*CLASSES, "words", "word_length", "distinct", "distinct_pairs", "distinct_triples", "top_word", "marked_words", "short_words", "line_words")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a slice; a text without words has zeros for what needs words."""
    rows = len(offsets) - 1
    size = np.maximum(1, np.diff(offsets))
    out = np.zeros((rows, len(FEATURES)))
    for i, members in enumerate(CLASSES.values()):
        seen = np.concatenate([[0], np.cumsum(byte_class(members)[data])])
        out[:, i] = (seen[offsets[1:]] - seen[offsets[:-1]]) / size
    lines = out[:, list(CLASSES).index("line")] * size + 1
    start, end, row = find_words(data, offsets)
    n = np.bincount(row, minlength=rows)
    some = np.maximum(1, n)
    word = span_hash(data, start, end) if len(start) else np.zeros(0, np.uint64)
    at = len(CLASSES)
    out[:, at] = np.log1p(n)
    out[:, at + 1] = np.bincount(row, end - start, rows) / some
    lone = mix(row.astype(np.uint64) + np.uint64(1))
    for k in range(3):
        run = word[: len(word) - k].copy() if k < len(word) else np.zeros(0, np.uint64)
        for j in range(1, k + 1):
            run = mix(run * np.uint64(3) + word[j : len(word) - k + j] if k < len(word) else run)
        ok = row[: len(run)] == row[k : len(run) + k]
        where = row[: len(run)][ok]
        _, first, times = np.unique((run ^ lone[: len(run)])[ok], return_index=True, return_counts=True)
        out[:, at + 2 + k] = np.bincount(where[first], minlength=rows) / np.maximum(1, n - k)
        if k == 0:
            top = np.zeros(rows)
            np.maximum.at(top, where[first], times)
            out[:, at + 5] = top / some
    if len(start):
        marks = byte_class(CLASSES["symbol"] + b"!|")
        out[:, at + 6] = np.bincount(row, marks[data[end - 1]], rows) / some
        out[:, at + 7] = np.bincount(row, end - start <= 2, rows) / some
    out[:, at + 8] = np.log1p(n / lines)
    return out


def _leaves(grad: np.ndarray, hess: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Values of a shallow regression tree over ordered bins, fitted to gradient and hessian sums."""
    total_g, total_h = grad.sum(), hess.sum()
    flat = np.full(len(grad), total_g / (total_h + 1.0))
    if depth == 0 or len(grad) < 2:
        return flat
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    ok = (h >= least) & (total_h - h >= least)
    if not ok.any():
        return flat
    gain = np.where(ok, g * g / (h + 1.0) + (total_g - g) ** 2 / (total_h - h + 1.0), -1.0)
    cut = int(gain.argmax()) + 1
    return np.concatenate([_leaves(grad[:cut], hess[:cut], depth - 1, least), _leaves(grad[cut:], hess[cut:], depth - 1, least)])


def _quadrants(grad: np.ndarray, hess: np.ndarray, least: float) -> np.ndarray:
    """Values of a tree of two levels over a grid: a cut of one axis, then one of the other on each side."""
    best, out = -1.0, np.zeros_like(grad)
    for flip in (False, True):
        g, h = (grad.T, hess.T) if flip else (grad, hess)
        for cut in range(1, len(g)):
            parts = [_leaves(s_g.sum(0), s_h.sum(0), 1, least) for s_g, s_h in ((g[:cut], h[:cut]), (g[cut:], h[cut:]))]
            made = np.concatenate([np.repeat(parts[0][None], cut, 0), np.repeat(parts[1][None], len(g) - cut, 0)])
            gain = float((made * (2 * g - made * h)).sum())
            if gain > best:
                best, out = gain, made.T if flip else made
    return out


@dataclass
class AdditiveModel:
    """Intercept, bin edges of each feature, a table for each feature and for each chosen pair."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for i, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, i], side="right")]
        for (i, j), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, bins: int = 32, pairs: int = 6, pair_rounds: int = 60) -> AdditiveModel:
    """Fits the model; with no rows, or rows of one label, it scores the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    quantile = lambda k: [np.unique(np.quantile(x[:, i], np.linspace(0, 1, k + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(x.shape[1])]
    edges, coarse = quantile(bins), quantile(8)
    model = AdditiveModel(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], coarse)
    if len(y) == 0 or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)]
    total = np.full(len(y), model.intercept)
    least = max(1.0, 0.0005 * len(y))

    def slopes(cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(cells, y - p, n), np.bincount(cells, p * (1 - p), n)

    for _ in range(rounds):
        for i, cells in enumerate(at):
            step = rate * _leaves(*slopes(cells, len(model.tables[i])), 2, least)
            model.tables[i] += step
            total += step[cells]
    near = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(coarse)]

    def grid(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return near[i] * shape[1] + near[j], shape

    def gain(pair: tuple[int, int]) -> float:
        cells, shape = grid(*pair)
        g, h = slopes(cells, shape[0] * shape[1])
        return float((g * g / (h + 1.0)).sum())

    model.pairs = sorted(combinations(range(x.shape[1]), 2), key=gain, reverse=True)[:pairs]
    cells = [grid(*p) for p in model.pairs]
    model.pair_tables = [np.zeros(shape) for _, shape in cells]
    for _ in range(pair_rounds):
        for k, (where, shape) in enumerate(cells):
            g, h = slopes(where, shape[0] * shape[1])
            step = rate * _quadrants(g.reshape(shape), h.reshape(shape), least)
            model.pair_tables[k] += step
            total += step.ravel()[where]
    return model


def featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` (longs) and x, the features of the whole text as an array."""
    fields = pa.schema([(c, pa.int64()) for c in keep] + [("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in text_slices(b.column(len(keep))):
                x = features(data, offsets)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
                yield record_batch(fields, [*(b.column(i).slice(at, len(x)) for i in range(len(keep))), lists])

    source = docs.select(*[docs[c].cast("long").alias(c) for c in keep], docs["text"].cast("binary").alias("text"))
    return map_texts(source, run, ", ".join(f"{c} long" for c in keep) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, seed: int = 11) -> AdditiveModel:
    """Fits the model on at most `max_rows` labelled documents, those with the least hash of their id.

    `labels` has doc_id and label 0 or 1; null labels and ids are left out, of repeated ids the least
    label counts. The bound keeps what is broadcast and what comes to the driver (one row of 18
    numbers each) the same at every size of the corpus.
    """
    known = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows)
    rows = featured(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ["doc_id", "label"]).select("label", "x").toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["label"].to_numpy().astype(float))


def scored(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts are scored by their zero features.

    Repeated rows and ids are scored each, texts of any length whole; an empty table gives no rows. Other
    columns are not carried, so none clashes.
    """
    fields = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in text_slices(b.column(1)):
                score = shared.value.score(features(data, offsets))
                yield record_batch(fields, [b.column(0).slice(at, len(score)), score])

    return map_texts(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("binary")), run, "doc_id long, score double")


def held_out(parts: int, part: int):
    """Whether a document is in the part kept from learning, by the CRC of its id as text."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> AdditiveModel:
    labels = table(spark, sf_dir, "labels").filter(~held_out(4, 2)).select("doc_id", F.col("quality").alias("label"))
    return train(docs, labels)


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = 0.7) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns as they were, whatever they are called."""
    fields = [f.name for f in docs.schema.fields]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in text_slices(b.column(fields.index("text"))):
                good = shared.value.score(features(data, offsets)) >= threshold
                yield b.slice(at, len(good)).filter(pa.array(good))

    return map_texts(docs, run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; null and empty texts are scored by their zero features, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, quality_model(spark, sf_dir, docs))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
