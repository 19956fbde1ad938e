"""Pattern packing of token sequences by non-negative least squares over the histogram of lengths."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import map_texts, record_batch, staged, table

CAPACITY = 2048
#: Hash parts of one length; ranks are counted within a part, so that no task holds all pieces of a length.
SALTS = 256
#: Words whose ids a worker keeps, some 200 bytes each.
CACHED = 100_000
_coders: dict[str, tuple] = {}


def _coder(path: str):
    """Whole-text encoder and word cache of a byte-level BPE file, one of each in a Python worker.

    The `.tiktoken` file of the same name holds the same vocabulary as ranks and gives the same ids
    as the tokenizer file, several times faster; texts with the special token's string take the
    tokenizer itself.
    """
    if path not in _coders:
        import public_tokenizers
        import tiktoken
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _coders[path] = fast, {}
    return _coders[path]


@lru_cache(1)
def _whole(path: str):
    """The tokenizer of the file itself, loaded by a worker that meets a text with the special token's string."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _ids(text: str, path: str, fast, cache: dict) -> bytes:
    """Ids of a text, little-endian unsigned 32-bit.

    The pattern never joins what is left and right of a single space between two other characters
    other than white space, except the space to what follows: such words are encoded once and kept.
    """
    if "<|endoftext|>" in text:
        return np.array(_whole(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    first, *rest = text.split(" ")
    if any(not w or w[0].isspace() or w[-1].isspace() for w in rest) or (rest and (not first or first[-1].isspace())):
        return np.array(fast.encode_ordinary(text), "<u4").tobytes()
    out = [np.array(fast.encode_ordinary(first), "<u4").tobytes()]
    for w in rest:
        found = cache.get(w)
        if found is None:
            found = np.array(fast.encode_ordinary(" " + w), "<u4").tobytes()
            if len(w) < 40:
                if len(cache) >= CACHED:
                    cache.clear()
                cache[w] = found
        out.append(found)
    return b"".join(out)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces of at most `capacity` tokens.

    A document is its ids and `end_id`. Longer ones are cut, the first piece takes the remainder.
    Null text counts as empty.
    """
    fields = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    last = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast, cache = _coder(tokenizer)
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = _ids(text.as_py() or "", tokenizer, fast, cache) + last
                n = len(ids) // 4
                at, to = 0, (n - 1) % capacity + 1
                for k in range(-(-n // capacity)):
                    out.append((doc, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at, to = to, to + capacity
            yield record_batch(fields, list(zip(*out, strict=True)) if out else [[]] * 5)

    source = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return map_texts(source, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- the plan, from the histogram alone


def enumerate_patterns(have: np.ndarray, capacity: int, most: int) -> np.ndarray:
    """Patterns of two or three lengths that fill the capacity, as rows of three lengths (0: none).

    `have` holds the count of each length. Of more than `most` patterns those with the largest
    least count are taken; the rest of the histogram is packed as residual, so none is lost.
    """
    lengths = np.flatnonzero(have[:capacity])
    lengths = lengths[lengths > 0]
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    c = capacity - a - b
    ok = (a >= b) & (c >= 0) & (b >= c)
    a, b, c = a[ok], b[ok], c[ok]
    ok = (c == 0) | present[np.maximum(c, 0)]
    rows = np.stack([a[ok], b[ok], c[ok]], 1)
    room = np.where(rows > 0, have[rows], np.iinfo(np.int64).max).min(1)
    return rows[np.argsort(-room, kind="stable")[:most]]


def fit_repeats(patterns: np.ndarray, have: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 with the least squared gap between patterns and histogram.

    Accelerated projected gradient; the matrix is never built, a pattern has three entries at most.
    """
    if not len(patterns):
        return np.zeros(0)
    n, used = len(have), patterns > 0
    weight = used.astype(float)
    aim = have.astype(float)
    # The largest eigenvalue of A'A is at most the largest column sum times the largest row sum of A.
    step = 1 / (3.0 * np.bincount(patterns.ravel(), weight.ravel(), n).max())
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        gap = np.bincount(patterns.ravel(), (weight * y[:, None]).ravel(), n) - aim
        new = np.maximum(0, y - step * (gap[patterns] * weight).sum(1))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over counts: (lengths of a sequence, how many such) until `left` is used up.

    Sequences with equal contents are handled as one group, so the work follows the number of
    lengths, not the number of pieces.
    """
    groups: dict[int, list[tuple[tuple, int]]] = {}
    room = np.zeros(capacity + 1, bool)

    def put(free: int, content: tuple, count: int) -> None:
        groups.setdefault(free, []).append((content, count))
        room[free] = True

    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            fits = np.flatnonzero(room[size:])
            free = size + int(fits[0]) if len(fits) else capacity
            if len(fits):
                content, count = groups[free].pop()
                room[free] = bool(groups[free])
            else:
                content, count = (), -(-n // (capacity // size))
            each = free // size
            whole = min(count, n // each)
            if whole:
                put(free - each * size, (content, size, each), whole)
            n -= whole * each
            count -= whole
            if n and count:  # fewer than `each` pieces are left, and a sequence for them
                put(free - n * size, (content, size, n), 1)
                count, n = count - 1, 0
            if count and content:
                put(free, content, count)
    out = []
    for free in groups:
        for content, count in groups[free]:
            lengths: list[int] = []
            while content:
                content, size, each = content
                lengths[:0] = [size] * each
            out.append((lengths, count))
    return out


def plan(have: np.ndarray, capacity: int = CAPACITY, max_patterns: int = 20_000) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, repeats) that use each length exactly as often as the histogram has it.

    The fitted repeats, rounded down, can leave a residual that packs badly; so shares of them are tried too, down to
    none at all, and the plan with the fewest sequences is taken, of equal ones that with the largest share.
    """
    patterns = enumerate_patterns(have, capacity, max_patterns)
    fitted = fit_repeats(patterns, have)
    plans = [_rounded(have, capacity, patterns, fitted * share) for share in (1.0, 0.75, 0.5, 0.25, 0.1, 0.0)]
    return min(plans, key=lambda made: sum(times for _, times in made))


def _rounded(have: np.ndarray, capacity: int, patterns: np.ndarray, fitted: np.ndarray) -> list[tuple[list[int], int]]:
    left = have.astype(np.int64).copy()
    chosen: list[tuple[list[int], int]] = []
    for k in np.argsort(-fitted, kind="stable"):
        lengths = [int(v) for v in patterns[k] if v]
        times = int(fitted[k])
        for v in set(lengths):
            times = min(times, int(left[v]) // lengths.count(v))
        if times < 1:
            if fitted[k] < 1:
                break
            continue
        for v in lengths:
            left[v] -= times
        chosen.append((lengths, times))
    return chosen + _best_fit(left, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY, max_patterns: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...), each of 1 to `capacity` tokens.

    Only the histogram of lengths (at most `capacity` rows) comes to the driver. There, patterns of
    few documents that fill a sequence are enumerated, their repeats are fitted by non-negative least
    squares and rounded down, and the residual is packed best-fit. Pieces of a length are ranked in
    hash parts and meet their slots by a join on the length and the range of ranks; the slot table is
    bounded by the number of patterns and groups, whatever the number of pieces.
    """
    spark = pieces.sparkSession
    have = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        have[length] = n
    slots, sequence, used = [], 0, np.zeros(capacity + 1, np.int64)
    for lengths, times in plan(have, capacity, max_patterns):
        at = 0
        for size in sorted(set(lengths), reverse=True):
            each = lengths.count(size)
            slots.append((size, int(used[size]), int(used[size]) + each * times, sequence, each, at))
            used[size] += each * times
            at += each * size
        sequence += times
    slot_table = spark.createDataFrame(slots, "length long, low long, high long, first_sequence long, each int, base long")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    counts = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("within", F.row_number().over(inside)).join(starts, ["length", "salt"]).withColumn("rank", F.col("skip") + F.col("within") - 1)
    placed = ranked.join(F.broadcast(slot_table), ["length"]).filter("rank >= low and rank < high")
    nth = F.col("rank") - F.col("low")
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(nth, F.col("each").cast("long")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place: sequences of at most `capacity` tokens, gapless from 0.

    Null and empty texts are packed as their end token alone. Repeated rows are packed each. An empty
    table gives no rows. Clashing or extra columns of `docs` are not carried.
    """
    return pack(staged(pieces_of(docs, tokenizer, capacity), "pieces"), capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into pieces of at most 2048 tokens and packed; null texts are empty, an empty table gives no rows."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
