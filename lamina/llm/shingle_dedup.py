"""Near duplicates by Jaccard similarity of word shingles: SimHash (popcount grid) and then MinHash bands propose pairs, the shingles themselves decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import find_words, map_texts, mix, record_batch, signed, span_hash, staged, text_slices
from lamina.llm.components import components
from lamina.llm.simhash_dedup import near_pairs, with_fingerprints

#: Bands and hashes of a band. A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^5)^24 = 0.99993, one of 0.1 with 0.0002.
BANDS, BAND = 24, 5
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_RNG = np.random.default_rng(17)
_XOR, _TIMES = (_RNG.integers(0, 1 << 32, BANDS * BAND, np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle of `size` words, ASCII letters in lower case; a shorter text's words are one shingle."""
    start, end, row = find_words(data, offsets)
    if not len(start):
        return row, np.zeros(0, np.uint64)
    word = span_hash(_LOWER[data], start, end)
    last = np.cumsum(np.bincount(row, minlength=len(offsets) - 1))[row]  # end of each word's row
    at = np.arange(len(row))
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    first = np.flatnonzero((at + size <= last) | new)
    return row[first], span_hash(word, first, np.minimum(first + size, last[first]))


def band_keys(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """The keys of each row's bands, shape (rows, BANDS). Rows without a word have equal keys."""
    least = np.zeros((BANDS * BAND, rows), np.uint64)
    if len(row):
        new = np.ones(len(row), bool)
        new[1:] = row[1:] != row[:-1]
        begin = np.flatnonzero(new)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(BANDS * BAND):
            least[i, row[begin]] = np.minimum.reduceat((short ^ _XOR[i]) * _TIMES[i], begin) + np.uint64(1)
    out = np.empty((rows, BANDS), np.uint64)
    for k in range(BANDS):
        key = np.full(rows, k, np.uint64)
        for j in range(BAND):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[k * BAND + j])
        out[:, k] = key
    return out


def _keyed(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, node (hash of the text) and keys (of its bands) of each row; null counts as empty."""
    fields = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in text_slices(b.column(2), 1 << 20):
                n = len(offsets) - 1
                keys = signed(band_keys(*shingles(data, offsets, shingle), n))
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, keys.ravel())
                yield record_batch(fields, [b.column(0).slice(at, n), b.column(1).slice(at, n), lists])

    source = docs.select(docs["doc_id"].cast("long"), _node(), docs["text"].cast("binary"))
    return map_texts(source, run, "doc_id long, node long, keys array<long>")


def _node():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("node")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets of shingles have the Jaccard similarity; two texts without words have it."""
    fields = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        for _, data, offsets in text_slices(column):
            row, hashes = shingles(data, offsets, shingle)
            edges = np.searchsorted(row, np.arange(len(offsets)))
            out += [np.unique(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for s, t in zip(sets(b.column(2)), sets(b.column(3)), strict=True):
                common = len(np.intersect1d(s, t, assume_unique=True))
                good.append(common >= similarity * (len(s) + len(t) - common) - 1e-9)
            yield record_batch(fields, [c.filter(pa.array(good, pa.bool_())) for c in b.columns[:2]])

    s, t = (texts.select(F.col("node").alias(k), F.col("text").alias(name)) for k, name in (("u", "s"), ("v", "t")))
    return map_texts(pairs.join(s, "u").join(t, "v").select("u", "v", "s", "t"), run, "u long, v long")


def simhash_pairs(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """Pairs (u, v) of texts by op4's method: SimHash fingerprints of their shingles, within `radius` bits by the grid of popcounts.

    Of texts with one fingerprint the least node stands for all: it is paired with each of them, and with those of near fingerprints.
    """
    prints = staged(with_fingerprints(docs.select(_node().alias("doc_id"), "text"), shingle).distinct(), "near-prints")
    hubs = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("hub")), "near-hubs")
    equal = prints.join(hubs, "fp").filter("doc_id != hub").select(F.col("hub").alias("u"), F.col("doc_id").alias("v"))
    first, other = (hubs.select(F.col("fp").alias(k), F.col("hub").alias(n)) for k, n in (("a", "u"), ("b", "v")))
    return equal.union(near_pairs(hubs.select("fp"), radius).join(first, "a").join(other, "b").select("u", "v"))


def linked_texts(docs: DataFrame, unique: DataFrame, shingle: int, similarity: float, radius: int = 2) -> DataFrame:
    """node and component of the texts (node, keys; one row each) that link to others.

    SimHash comes first: what it proposes and the shingles confirm makes groups. Its `radius` bits reach
    only the closest copies, so MinHash bands then propose pairs of texts in different groups. As in line_dedup, all texts under a key are first compared with one of them, the hub, and then only
    those of different groups with each other, so that a large group of copies costs a star.
    """
    keyed = unique.select(F.explode("keys").alias("key"), "node")
    hubs = keyed.groupBy("key").agg(F.min("node").alias("u"), F.count("*").alias("n")).filter("n > 1").select("key", "u")
    close = staged(keyed.join(hubs, "key"), "near-close")
    alike = staged(simhash_pairs(docs, shingle, radius), "near-alike")
    wanted = close.select("node").union(alike.select("u")).union(alike.select("v")).distinct()
    texts = docs.select(_node(), F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = staged(texts, "near-texts")
    same = staged(_confirmed(alike, texts, shingle, similarity), "near-edges")
    found = staged(components(same, "near-groups"), "near-groups")
    p, q = (found.select(F.col("node").alias(n), F.col("component").alias(g)) for n, g in (("u", "p"), ("v", "q")))
    tried = close.filter("u != node").select("u", F.col("node").alias("v")).distinct().join(p, "u", "left").join(q, "v", "left")
    tried = staged(tried.filter(F.coalesce("p", "u") != F.coalesce("q", "v")).select("u", "v"), "near-pairs")
    stars = staged(same.union(_confirmed(tried, texts, shingle, similarity)), "near-edges")
    parts = components(stars, "near-groups").select("node", "component")
    placed = staged(close.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part")), "near-close")
    a, b = (placed.select("key", F.col("node").alias(n), F.col("part").alias(p)) for n, p in (("u", "p"), ("v", "q")))
    across = a.join(b, "key").filter("u < v and p != q").select("u", "v").distinct().join(tried, ["u", "v"], "left_anti")
    bridges = staged(_confirmed(across, texts, shingle, similarity), "near-edges")
    return components(stars.union(bridges), "near-groups")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies, with its columns as they were.

    Texts link if the Jaccard similarity of their sets of `shingle`-word shingles is `similarity` or
    more; texts without a word are copies of each other. The row with the least doc_id stays, one
    without a doc_id only if the group has no other. Rows are told apart by doc_id and text, so null
    and repeated doc_ids need no care; of rows that agree in both one stays.
    """
    keyed = staged(_keyed(docs, shingle), "near-keys")
    unique = keyed.groupBy("node").agg(F.first("keys").alias("keys"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"))
    unique = staged(unique, "near-unique")
    groups = linked_texts(docs, unique.select("node", "keys"), shingle, similarity)
    named = unique.select("node", "least").join(groups, "node", "left")
    best = named.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min(F.struct("least", "node")).alias("best"))
    kept = best.select(_row(F.col("best.least.doc_id"), F.col("best.node")).alias("_row"))
    rows = docs.withColumn("_row", _row(F.col("doc_id").cast("long"), _node()))
    return rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


def _row(doc_id, node):
    return F.xxhash64(F.coalesce(doc_id, F.lit(0).cast("long")), doc_id.isNull(), node)
