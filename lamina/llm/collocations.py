"""Phrase collocations: n-gram counts in counting quotient filters, merged across shards; scores and ranks as joins.

Texts become tables of local word numbers, slice by slice; the words of a slice meet the corpus's
dictionary by a join, so no task holds more than its slice's words. Phrases are counted level by level: one can
be frequent only if its words, and the phrases one word shorter within it, are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import byte_class, find_words, map_texts, mix, scratch_dir, span_hash, staged, table, text_slices
from lamina.llm.quotient_filter import CountingFilter, Merger

#: Bytes that end a piece; these, space and tab end a word.
ENDS = byte_class(b".,;:!?\n\x0b\x0c\r")
WORD = ~byte_class(b" \t.,;:!?\n\x0b\x0c\r")
#: Bytes of text in a slice, and keys that a task counts before it hands its filters on.
SLICE, HELD = 3 << 19, 1 << 20
#: Words are told from each other, in a filter of what is frequent, by so many bits at most (16 MB).
MOST_BITS = 1 << 27
LONGEST = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@contextmanager
def _few_rows(spark: SparkSession, rows: int = 16):
    """Arrow batches of few rows, for rows of about a MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """staged(), in row groups that are read a few MB at a time."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 8 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Number from 0 of each word, and the words. Two 64-bit hashes tell them apart; if one hash does not suffice, the bytes do."""
    one, other = span_hash(data, start, end, 0), span_hash(data, start, end, 1)
    _, first, back = np.unique(one, return_index=True, return_inverse=True)
    raw = data.tobytes()
    if (other[first][back] == other).all():
        return back, [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    found: dict[bytes, int] = {}
    back = np.array([found.setdefault(raw[s:e], len(found)) for s, e in zip(start.tolist(), end.tolist(), strict=True)])
    return back, list(found)


def _encode(langs: pa.Array, texts: pa.Array) -> Iterator[tuple]:
    """(lang, tokens, words, counts) for each lang of some rows: local numbers from 1, 0 between pieces."""
    codes = langs.dictionary_encode()
    names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy()
    for at, data, offsets in text_slices(texts, SLICE):
        data = _LOWER[data]
        start, end, row = find_words(data, offsets, WORD)
        if not len(start):
            continue
        ends = np.concatenate([[0], np.cumsum(ENDS[data])])
        apart = np.ones(len(start), bool)
        apart[1:] = (row[1:] != row[:-1]) | (ends[start[1:]] > ends[end[:-1]])
        of = code[at + row]
        for c in np.unique(of):
            on = np.flatnonzero(of == c)
            number, words = local_words(data, start[on], end[on])
            tokens = np.zeros(len(on) + int(apart[on].sum()), np.uint32)
            tokens[np.arange(len(on)) + np.cumsum(apart[on])] = number + 1
            yield names[c], tokens.tobytes(), words, np.bincount(number, minlength=len(words))


def sliced(docs: DataFrame) -> DataFrame:
    """slice, lang, tokens (uint32 numbers of the slice's words, 0 between pieces), words and counts of all texts."""
    fields = pa.schema([("slice", pa.int64()), ("lang", pa.string()), ("tokens", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            whole = pa.Table.from_batches(held).combine_chunks()
            for part in whole.to_batches():
                for lang, tokens, words, counts in _encode(part.column(0), part.column(1)):
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([number], [lang], [tokens], [[w.decode("utf-8", "replace") for w in words]], [counts.tolist()]), fields, strict=True)], schema=fields)
                    number += 1

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(1).nbytes
            if size >= SLICE:
                yield from out(held)
                held, size = [], 0
        if held:
            yield from out(held)

    source = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return map_texts(source, run, "slice long, lang string, tokens binary, words array<string>, counts array<long>")


def dictionary(words: DataFrame, least: int) -> DataFrame:
    """lang, word, f and id (long, from 1, nearly dense) of the words that occur `least` times or more."""
    frequent = staged(words.filter(F.col("f") >= least), "collocations-words")
    parts = max(16, frequent.count() // 100_000)
    numbered = frequent.withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(parts)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))
    return numbered.select("lang", "word", "f", ((place - 1) * parts + F.col("part") + 1).alias("id"))


def recoded(slices: DataFrame, words: DataFrame) -> DataFrame:
    """tokens (uint32 ids of the dictionary, 0 between runs of two or more frequent words) of each slice."""
    own = slices.select("slice", "lang", F.posexplode("words").alias("at", "word"))
    known = own.join(words.select("lang", "word", "id"), ["lang", "word"]).select("slice", F.struct("at", "id").alias("w"))
    maps = known.groupBy("slice").agg(F.collect_list("w").alias("map"))
    met = slices.select("slice", "tokens").join(maps, "slice").select("tokens", F.col("map.at").alias("at"), F.col("map.id").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                tokens = np.frombuffer(b.column(0)[i].as_py(), np.uint32)
                lookup = np.zeros(int(tokens.max()) + 1, np.uint32)
                lookup[b.column(1)[i].values.to_numpy() + 1] = b.column(2)[i].values.to_numpy()
                ids = np.append(lookup[tokens], np.uint32(0))
                on = np.concatenate([[False], ids > 0, [False]])
                on[1:-1] &= on[:-2] | on[2:]
                ids = np.where(on[1:-1], ids, np.uint32(0))[on[1:-1] | on[:-2]]
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], names=["tokens"])

    return met.mapInArrow(run, "tokens binary")


def _places(ids: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Two places of each n-gram in a bitmap of a power of two of bits."""
    h = np.zeros(len(ids[0]), np.uint64)
    for column in ids:
        h = mix(h * np.uint64(3) + column.astype(np.uint64) + np.uint64(1))
    return [(h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)]


def _frequent_bits(spark: SparkSession, phrases: DataFrame, n: int) -> np.ndarray:
    """Bitmap that has both places of every phrase of n words: of 16 bits for each, MOST_BITS at most. What is not in it is not frequent."""
    bits = min(MOST_BITS, 1 << max(16, int(16 * phrases.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_places([b.column(k).to_numpy() for k in range(n)], bits))
            cell = np.unique(at)
            word = cell >> 6
            edges = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, int)
            flags = np.bitwise_or.reduceat(np.uint64(1) << (cell & 63).astype(np.uint64), edges) if len(edges) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word[edges]), pa.array(flags.view(np.int64))], names=["word", "flags"])

    found = phrases.select(*[f"w{k + 1}" for k in range(n)]).mapInArrow(run, "word long, flags long").groupBy("word").agg(F.bit_or("flags").alias("flags")).toPandas()
    out = np.zeros(bits >> 6, np.uint64)
    out[found["word"].to_numpy(dtype=np.int64)] = found["flags"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _windows(tokens: np.ndarray, n: int, shorter: np.ndarray | None) -> list[np.ndarray]:
    """Ids of all windows of n words without a break whose two windows of n - 1 words are in `shorter`."""
    many = len(tokens) - n + 1
    if many <= 0:
        return [tokens[:0]] * n
    on = np.ones(many, bool)
    for k in range(n):
        on &= tokens[k : k + many] > 0
    at = np.flatnonzero(on)
    for step in (0, 1) if shorter is not None else ():
        keep = np.ones(len(at), bool)
        for place in _places([tokens[at + step + k] for k in range(n - 1)], 64 * len(shorter)):
            keep &= (shorter[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        at = at[keep]
    return [tokens[at + k] for k in range(n)]


def counted(blobs: DataFrame, n: int, bits: int, shard_bits: int, least: int, shorter: np.ndarray | None) -> DataFrame:
    """w1 to wn and a of the phrases of n words that occur `least` times or more.

    Each task counts its own windows in a filter, cuts it into shards and hands those on; a shard's
    filters are merged in one task. A shard holds an even share of the keys, as they are permuted.
    """
    spark = blobs.sparkSession
    shared = spark.sparkContext.broadcast(shorter)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, held, size = Merger(), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if filled := whole.close():
                for shard, part in filled.shards(shard_bits):
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([part.to_bytes()], pa.binary())], names=["shard", "filter"])

        def settle() -> None:
            nonlocal held, size
            if size:
                whole.add(CountingFilter.of([np.concatenate([h[k] for h in held]) for k in range(n)], bits))
            held, size = [], 0

        for b in batches:
            for blob in b.column(0):
                made = _windows(np.frombuffer(blob.as_buffer(), np.uint32), n, shared.value)
                held.append(made)
                size += len(made[0])
                if size >= HELD // 8:
                    settle()
            if len(whole) >= HELD:
                yield from out()
                whole = Merger()
        settle()
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, whole = None, Merger()

        def out() -> Iterator[pa.RecordBatch]:
            if filled := whole.close():
                ids, a = filled.at_least(least)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (*ids, a)], names=[*(f"w{k + 1}" for k in range(n)), "a"])

        for b in batches:
            for key, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if key != shard:
                    yield from out()
                    shard, whole = key, Merger()
                whole.add(CountingFilter.from_bytes(blob.as_py()))
        yield from out()

    filters = blobs.mapInArrow(count, "shard long, filter binary")
    dealt = filters.repartition(1 << min(shard_bits, 12), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(merge, ", ".join(f"w{k + 1} long" for k in range(n)) + ", a long")


def phrase_counts(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, f, id) and phrases (n_words, w1 to w4 with 0 for none, a) that occur `least` times or more, and n of each lang."""
    spark = docs.sparkSession
    slices = _kept(sliced(docs), "collocations-slices")
    words = slices.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    words = staged(words, "collocations-vocabulary")
    known = staged(dictionary(words, least), "collocations-dictionary")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    top, tokens = known.agg(F.max("id"), F.sum("f")).first()
    bits, shard_bits = int(top or 1).bit_length(), max(3, min(16, int((tokens or 1) >> 20).bit_length()))
    with _few_rows(spark):
        blobs = _kept(recoded(slices, known), "collocations-tokens")
        shorter, levels = None, []
        for n in range(2, LONGEST + 1):
            level = staged(counted(blobs, n, bits, shard_bits, least, shorter), f"collocations-{n}")
            levels.append(level.select(F.lit(n).alias("n_words"), *[F.col(f"w{k + 1}") if k < n else F.lit(0).cast("long").alias(f"w{k + 1}") for k in range(LONGEST)], "a"))
            if n < LONGEST:
                shorter = _frequent_bits(spark, level, n)
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionByName(level)
    return known, phrases, totals


_KEY = [f"w{k + 1}" for k in range(LONGEST)]


def _part(first: int, last: int) -> list:
    """Key of the words first to last (from 0, last excluded) of a phrase."""
    return [F.col(_KEY[first + k]) if first + k < last else F.lit(0).cast("long") for k in range(LONGEST)]


def _struct(columns: list, *more):
    return F.struct(*[c.alias(k) for c, k in zip(columns, _KEY, strict=True)], *more)


def scored(words: DataFrame, phrases: DataFrame, scale: int = 2_000_000) -> DataFrame:
    """Phrases with lang and, of the cut with the lowest score (of equals the shortest first part), score, l and r.

    A phrase meets the counts of its parts by joins on the parts' words. Scores are whole numbers
    from exact decimals.
    """
    counts = phrases.select(*_KEY, F.col("a").alias("f"), F.lit(None).cast("string").alias("lang")).unionByName(words.select(F.col("id").alias("w1"), *[F.lit(0).cast("long").alias(k) for k in _KEY[1:]], "f", "lang"))
    made = []
    for n in range(2, LONGEST + 1):
        cuts = [_struct(p, F.lit(k).alias("k"), F.lit(side).alias("side")) for k in range(1, n) for side, p in ((0, _part(0, k)), (1, _part(k, n)))]
        made.append(phrases.filter(F.col("n_words") == n).select(_struct([F.col(k) for k in _KEY]).alias("phrase"), "n_words", "a", F.explode(F.array(*cuts)).alias("part")))
    parts = made[0]
    for p in made[1:]:
        parts = parts.unionByName(p)
    met = parts.select("phrase", "n_words", "a", "part.*").join(counts, _KEY)
    each = met.groupBy("phrase", "n_words", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"), F.max("lang").alias("lang"))
    whole = lambda c: F.expr(f"cast({c} as decimal(20,0))")
    each = each.withColumn("ls", whole("l") + whole("r")).withColumn("score", F.expr(f"cast(a as decimal(20,0)) * {scale} div ls"))
    best = each.groupBy("phrase", "n_words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.max("lang").alias("lang"))
    return best.select("lang", "n_words", "phrase.*", "a", "cut.l", "cut.r", "cut.score")


def not_inside(candidates: DataFrame, phrases: DataFrame, percent: int = 80) -> DataFrame:
    """Candidates without those inside a longer phrase that occurs at least `percent` of a hundred times as often."""
    made = []
    for n in range(3, LONGEST + 1):
        inner = [_struct(_part(at, at + m)) for m in range(2, n) for at in range(n - m + 1)]
        made.append(phrases.filter(F.col("n_words") == n).select("a", F.explode(F.array(*inner)).alias("part")))
    longer = made[0]
    for p in made[1:]:
        longer = longer.unionByName(p)
    most = longer.groupBy("part").agg(F.max("a").alias("most")).select("part.*", "most")
    met = candidates.join(most, _KEY, "left")
    swallowed = F.expr(f"cast(most as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {percent}")
    return met.filter(~F.coalesce(swallowed, F.lit(False))).drop("most")


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each lang's first `top` phrases of two to four words.

    Texts are taken whole, A-Z lower-cased; null and empty ones have no words, a null lang is `und`,
    repeated rows and null ids count as documents each; other columns are not carried; an empty table gives no rows.
    """
    words, phrases, totals = phrase_counts(docs, least)
    left = not_inside(scored(words, phrases), phrases, percent)
    order = [F.desc("score"), F.desc("a")]
    # Equal ranks stay together here, so that the phrase can decide among them below.
    near = staged(left.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top).drop("place"), "collocations-best")
    spelled = near.select("*", F.posexplode(F.filter(F.array(*_KEY), lambda w: w > 0)).alias("at", "id")).join(words.select("id", "word"), "id")
    named = spelled.groupBy(*near.columns).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each lang of all documents."""
    return collocations(table(spark, sf_dir, "documents"))
