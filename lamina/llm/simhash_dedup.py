"""SimHash near-dedup by segment-popcount embedding, grid range-join and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import map_texts, record_batch, staged, table
from lamina.llm.components import components

#: Bits of the segments whose set bits are counted: 15 counts of at most 8, which with offsets fit 4 bits each.
WIDTHS = (4,) * 14 + (8,)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """64-bit SimHash: bit set if set in over half of the hashes of all word shingles, repeats included."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(x, seed) for x in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(0, dtype=np.int64) * 2 > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Columns doc_id and fp (the fingerprint as a signed long). Null and word-less texts get zero."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py() or b"", shingle) for x in b.column(1)], np.uint64)
            yield record_batch(schema, [b.column(0), found.view(np.int64)])

    source = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("binary"))
    return map_texts(source, run, "doc_id long, fp long")


def _offsets(radius: int) -> list[int]:
    """Zero and half of the other grid offsets within the Manhattan radius, packed in base 16 like the cells."""
    zero = (0,) * len(WIDTHS)
    now = {zero}
    for _ in range(radius):
        now |= {(*d[:i], d[i] + s, *d[i + 1 :]) for d in now for i in range(len(WIDTHS)) for s in (1, -1)}
    return [sum(x << (4 * i) for i, x in enumerate(d)) for d in sorted(now) if d >= zero]


def near_pairs(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a < b or b < a, once each) of distinct fingerprints that differ in at most `radius` bits.

    `prints` has one column fp without repeats. Each fingerprint is the point of its popcounts in 15
    segments. One changed bit moves one coordinate by one, so the Manhattan distance of
    two points is a lower bound of the Hamming distance. The cells of the grid are the points
    themselves; each fingerprint probes half of the cells within the radius, so that every close
    pair of cells meets once, and the join's condition verifies the Hamming distance. Two random
    fingerprints share a cell with probability 1e-9, so that candidates stay few as fingerprints grow.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3: counts of 0 to 8 and offsets share a 4-bit field")
    counts, at = [], 0
    for i, bits in enumerate(WIDTHS):
        counts.append((F.bit_count(F.shiftrightunsigned(F.col("fp"), at).bitwiseAND((1 << bits) - 1)).cast("long") + radius) * (1 << (4 * i)))
        at += bits
    points = prints.select("fp", reduce(Column.__add__, counts).alias("cell"))
    steps = F.array(*[F.lit(x).cast("long") for x in _offsets(radius)])
    probes = points.select(F.col("fp").alias("a"), F.explode(steps).alias("d"), "cell").select("a", "d", (F.col("cell") + F.col("d")).alias("cell"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return probes.join(points.select(F.col("fp").alias("b"), "cell"), "cell").filter(close & ((F.col("d") != 0) | (F.col("a") < F.col("b")))).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """Fingerprint and component of every document: doc_id, fp, component_id (least doc_id linked).

    Equal fingerprints are one point before any join. Rows with a repeated doc_id are kept, each with
    its own text's fingerprint; a null doc_id takes part and is never the least unless alone (then
    null). Null, empty and word-less texts have fingerprint zero and link like any other. An empty table
    gives no rows; other columns are not carried.
    """
    prints = staged(with_fingerprints(docs, shingle), "fingerprints")
    by_print = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    by_print = staged(by_print, "distinct-fingerprints")
    pairs = near_pairs(by_print.select("fp"), radius)
    linked = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), "simhash")
    named = by_print.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document by 3-word shingles and up to two differing bits."""
    out = near_duplicates(table(spark, sf_dir, "documents"), 3, 2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
