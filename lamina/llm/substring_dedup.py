"""Substring dedup: recurring passages located by hashes, confirmed by sharded Aho-Corasick automata.

A passage recurs if a window of WINDOW words does. Windows are not compared one by one: each window
has an anchor, the k-gram of its words with the least hash, so equal windows have equal anchors at
equal places. Neighbouring windows with one anchor form a run, and a run's words are a phrase.
Counts of anchors confirm what recurs; where all runs of an anchor are the same phrase, the phrase
is confirmed as a whole, else its windows are counted. Documents then come with the owners (least
doc_id) of their confirmed phrases; hashes give the places, and automata compiled for shards of
documents from those very passages confirm them word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import find_words, map_texts, mix, record_batch, released, signed, span_hash, staged, table, text_slices

WINDOW = 20
ANCHOR = 4
#: Words of the documents that share an automaton.
SHARD_WORDS = 100_000
#: Stands for a null doc_id, which comes before all others.
NO_ID = -(1 << 63)


def runs(word: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and anchor hash of each run. `row` is each word's text, in order."""
    none = np.zeros(0, np.int64)
    k = min(ANCHOR, window)
    n = len(word) - window + 1
    if n < 1:
        return none, none, none.astype(np.uint64)
    gram = np.zeros(len(word) - k + 1, np.uint64)
    for j in range(k):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + word[j : len(word) - k + 1 + j]
    gram = mix(gram)
    # Least gram of each window, the leftmost of equals, by doubling.
    width, low, at = 1, gram, np.arange(len(gram))
    wide = window - k + 1
    while width < wide:
        step = min(width, wide - width)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        width += step
    inside = row[:n] == row[window - 1 :]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (at[1:n] != at[: n - 1])
    start = np.flatnonzero(begin)
    end = inside.copy()
    end[:-1] &= ~inside[1:] | (at[1:n] != at[: n - 1])
    return start, np.flatnonzero(end) + 1 - start, low[start]


def _hashed(column: pa.Array, window: int):
    """For slices of texts: first row, rows, and of each word its row, start, end and hash, and the runs."""
    for at, data, offsets in text_slices(column):
        start, end, row = find_words(data, offsets)
        word = span_hash(data, start, end) if len(start) else np.zeros(0, np.uint64)
        yield at, len(offsets) - 1, row, word, *runs(word, row, window)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id"), docs["text"].cast("binary").alias("text"))


def _told_apart(docs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """id, text and h; id and h name a text: h is its hash where several rows have the id, or all may, else zero.

    Zeros compress to nothing when they are shuffled. Beyond `most` such ids every text gets its hash.
    """
    keyed, h = _keyed(docs), F.xxhash64("text")
    several = staged(keyed.groupBy("id").count().filter("count > 1").select("id"), "repeated-ids")
    if several.limit(most + 1).count() > most:
        return keyed.withColumn("h", h)
    several = F.broadcast(several.withColumn("_several", F.lit(True)))
    return keyed.join(several, "id", "left").select("id", "text", F.when(F.col("_several"), h).otherwise(F.lit(0).cast("long")).alias("h"))


def recurring_anchors(docs: DataFrame, window: int) -> DataFrame:
    """anchor, owner (least id) and alone (whether all its runs are one phrase) of each anchor that has two runs."""
    fields = pa.schema([("anchor", pa.int64()), ("phrase", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for at, _, row, word, start, n, anchor in _hashed(b.column(1), window):
                phrase = span_hash(word, start, start + n + window - 1, 1) if len(start) else anchor
                yield record_batch(fields, [signed(anchor), signed(phrase >> np.uint64(16)), ids[at:][row[start]]])  # 48 bits more than the anchor's

    rows = map_texts(_keyed(docs), run, "anchor long, phrase long, id long")
    found = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("phrase").alias("low"), F.max("phrase").alias("high"), F.min("id").alias("owner"))
    return found.filter("n > 1").select("anchor", "owner", (F.col("low") == F.col("high")).alias("alone"))


def marked_documents(docs: DataFrame, recurring: DataFrame, window: int) -> DataFrame:
    """id, text, anchors, owners and alone (three arrays, null where nothing recurs) and h of every document.

    Marks are gathered by id and h, so rows of one id with different texts each get their own.
    """
    fields = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("anchor", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs = b.column(0).to_numpy(), b.column(2).to_numpy()
            for at, _, row, _, start, _, anchor in _hashed(b.column(1), window):
                where = row[start]
                order = np.lexsort((anchor, where))
                new = np.ones(len(order), bool)
                new[1:] = (where[order][1:] != where[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
                held = where[order][new]
                yield record_batch(fields, [ids[at:][held], hs[at:][held], signed(anchor[order][new])])

    keyed = _told_apart(docs)
    held = map_texts(keyed, run, "id long, h long, anchor long").join(recurring, "anchor")
    marks = held.groupBy("id", "h").agg(F.collect_set(F.struct("anchor", "owner", "alone")).alias("marks"))  # equal rows bring the same marks
    return keyed.join(marks, ["id", "h"], "left").select("id", "text", F.col("marks.anchor").alias("anchors"), F.col("marks.owner").alias("owners"), F.col("marks.alone").alias("alone"), "h")


def split_documents(marked: DataFrame) -> DataFrame:
    """Documents in which nothing recurs with their result (text null), others with text and marks."""
    fields = pa.schema([("id", pa.int64()), ("text", pa.binary()), ("anchors", pa.list_(pa.int64())), ("owners", pa.list_(pa.int64())), ("alone", pa.list_(pa.bool_())), ("n_words", pa.int64()), ("kept", pa.string()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, anchors = b.column(1).to_pylist(), b.column(2)
            clear = anchors.is_null().to_pylist()
            n, kept = [None] * len(text), [None] * len(text)
            for i, x in enumerate(text):
                if clear[i]:
                    words = (x or b"").split()
                    n[i], kept[i], text[i] = len(words), hashlib.sha256(b" ".join(words)).hexdigest(), None
            yield record_batch(fields, [b.column(0), pa.array(text, pa.binary()), anchors.cast(pa.list_(pa.int64())), b.column(3).cast(pa.list_(pa.int64())), b.column(4).cast(pa.list_(pa.bool_())), n, kept, b.column(5)])

    return map_texts(marked, run, "id long, text binary, anchors array<long>, owners array<long>, alone array<boolean>, n_words long, kept string, h long")


def _lists(column: pa.Array, i: int) -> np.ndarray:
    return np.asarray(column[i].values.to_numpy(zero_copy_only=False))


def confirmed_windows(split: DataFrame, window: int) -> DataFrame:
    """id, h, starts and owners (arrays): windows of anchors with several phrases that occur more than once."""
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs = b.column(0).to_numpy(), b.column(4).to_numpy()
            for at, rows, row, word, start, n, anchor in _hashed(b.column(1), window):
                several = np.zeros(len(start), bool)
                where = row[start]
                edges = np.searchsorted(where, np.arange(rows + 1))
                for r in range(rows):
                    low, high = edges[r], edges[r + 1]
                    if low < high:
                        known = _lists(b.column(2), at + r)[~_lists(b.column(3), at + r).astype(bool)]
                        several[low:high] = np.isin(signed(anchor[low:high]), known)
                s, m = start[several], n[several]
                first = np.repeat(s, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                if not len(first):
                    continue
                x, y = (span_hash(word, first, first + window, which) for which in (1, 2))
                place = first - np.searchsorted(row, row[first])
                yield record_batch(fields, [signed(x), signed(y >> np.uint64(32)), ids[at:][row[first]], hs[at:][row[first]], place])  # 96 bits name a window

    source = split.filter(F.exists("alone", lambda v: ~v)).select("id", "text", "anchors", "alone", "h")
    rows = map_texts(source, run, "a long, b long, id long, h long, start long")
    owners = rows.groupBy("a", "b").agg(F.count("*").alias("total"), F.min("id").alias("owner")).filter("total > 1")
    found = rows.join(owners.select("a", "b", "owner"), ["a", "b"])
    return found.groupBy("id", "h").agg(F.collect_set(F.struct("start", "owner")).alias("w")).select("id", "h", F.col("w.start").alias("starts"), F.col("w.owner").alias("window_owners"))


#: Distinct words that one character tells apart, and words of a phrase of an automaton, whose depth it is.
ALPHABET, DEPTH = 1_000_000, 20_000


class _Shard:
    """Documents that share an automaton: their words as symbols, and their confirmed passages.

    Only words of passages have a symbol of their own, as no other word can take part in one. A symbol is
    a character, or two from separate ranges for a document with more words than characters.
    """

    def __init__(self, wide: bool = False) -> None:
        self.symbols, self.automaton, self.docs, self.words, self.wide = {}, ahocorasick.Automaton(), [], 0, wide

    def _symbol(self, number: int) -> str:
        if self.wide:
            return chr(0x100 + (number >> 15)) + chr(0x10000 + (number & 0x7FFF))
        return chr(number + (2 if number < 0xD000 else 0x2000))

    def add(self, key: int, words: list[bytes], passages: list[tuple[int, int, bool]]) -> None:
        """`passages`: start, end, and whether the document itself owns the passage, and so keeps its first occurrence.

        Of a passage that others own every occurrence goes. What another document brings is not this
        one's to remove: each document comes with all of its own passages.
        """
        symbol, each = self.symbols, 2 if self.wide else 1
        for start, end, _ in passages:
            for w in words[start:end]:
                if w not in symbol:
                    symbol[w] = self._symbol(len(symbol))
        none = "\x01" * each
        line = "".join([symbol.get(w, none) for w in words])
        # A longer passage is confirmed part by part, each as long as a window at least; the last one overlaps.
        cuts = [(min(at, max(start, end - DEPTH)), min(at + DEPTH, end), own) for start, end, own in passages for at in range(start, end, DEPTH)]
        spans = [(line[each * start : each * end], own) for start, end, own in cuts]
        for phrase, _ in spans:
            self.automaton.add_word(phrase, len(phrase))
        self.docs.append((key, words, line, {t for t, own in spans if own}, {t for t, own in spans if not own}))
        self.words += len(words)

    def located(self) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
        """Key, words and which of them go, of each document."""
        each = 2 if self.wide else 1
        if len(self.automaton):
            self.automaton.make_automaton()
        for key, words, line, own, others in self.docs:
            change = np.zeros(len(words) + 1, np.int64)
            kept = set()
            for end, length in self.automaton.iter(line) if own or others else ():
                start = end - length + 1
                phrase = line[start : end + 1]
                if phrase in own and phrase not in kept:
                    kept.add(phrase)
                    continue
                if phrase in own or phrase in others:
                    change[start // each] += 1
                    change[(end + 1) // each] -= 1
            yield key, words, np.cumsum(change[:-1]) > 0


def located_documents(split: DataFrame, windows: DataFrame, window: int, with_text: bool) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (and kept, the kept words) of the documents in which something recurs."""
    fields = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * with_text)

    def passages(b: pa.RecordBatch, i: int, size: int, word: np.ndarray, start: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> list[tuple[int, int, bool]]:
        """Passages of a document of `size` words: maximal ones that others own, and those of its own that it repeats."""
        key = b.column(0)[i].as_py()
        alone = _lists(b.column(4), i).astype(bool)
        known, owner = _lists(b.column(2), i)[alone], _lists(b.column(3), i)[alone]
        order = np.argsort(known)
        known, owner = known[order], owner[order]
        at = np.minimum(np.searchsorted(known, signed(anchor)), max(0, len(known) - 1))
        hit = known[at] == signed(anchor) if len(known) else np.zeros(len(anchor), bool)
        others = hit & (owner[at] != key) if len(known) else hit
        change = np.zeros(size + 1, np.int64)  # over window starts
        np.add.at(change, start[others], 1)
        np.add.at(change, (start + n)[others], -1)
        mine = hit & ~others
        spans = [(start[mine], (start + n)[mine] + window - 1)]
        if b.column(5)[i].is_valid:
            starts, owners = _lists(b.column(5), i), _lists(b.column(6), i)
            np.add.at(change, starts[owners != key], 1)
            np.add.at(change, starts[owners != key] + 1, -1)
            spans.append((starts[owners == key], starts[owners == key] + window))
        covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        out = [(int(s), int(e) + window - 1, False) for s, e in edges.reshape(-1, 2)]
        s, e = (np.concatenate(x) for x in zip(*spans, strict=True))
        if len(s):  # what the document owns matters only where it comes again
            _, first, times = np.unique(span_hash(word, s, e), return_index=True, return_counts=True)
            out += [(int(s[j]), int(e[j]), True) for j in first[times > 1]]
        return out

    def flush(shard: _Shard) -> pa.RecordBatch:
        out = []
        for key, words, gone in shard.located():
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            out.append((key, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *[kept.decode()] * with_text))
        return record_batch(fields, list(zip(*out, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, rows, row, word, start, n, anchor in _hashed(b.column(1), window):
                edges = np.searchsorted(row[start], np.arange(rows + 1))
                firsts = np.searchsorted(row, np.arange(rows + 1))
                for r in range(rows):
                    part = slice(edges[r], edges[r + 1])
                    found = passages(b, at + r, firsts[r + 1] - firsts[r], word[firsts[r] : firsts[r + 1]], start[part] - firsts[r], n[part], anchor[part])
                    words = (b.column(1)[at + r].as_py() or b"").split()
                    most = sum(end - start for start, end, _ in found)
                    if most > ALPHABET - len(shard.symbols):
                        most = len({w for start, end, _ in found for w in words[start:end]})
                    if most > ALPHABET - len(shard.symbols) and shard.docs:
                        yield flush(shard)
                        shard = _Shard()
                    shard.wide = most > ALPHABET and not shard.docs
                    shard.add(ids[at + r], words, found)
                    if shard.words >= SHARD_WORDS or shard.wide:
                        yield flush(shard)
                        shard = _Shard()
        if shard.docs:
            yield flush(shard)

    source = split.filter("anchors is not null").join(windows, ["id", "h"], "left").select("id", "text", "anchors", "owners", "alone", "starts", "window_owners")
    return map_texts(source, run, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def dedup_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document, after repeated passages are removed.

    A word is removed if a window of `window` words that covers it also starts earlier: in a document
    with a smaller doc_id, or earlier in its own. A null doc_id counts as the smallest. Null and empty
    texts have no words. Rows that repeat a doc_id are each treated as that document, with what recurs
    in their own text: each keeps its first occurrence of a passage that it owns. Only anchors, phrase hashes and owners are shuffled,
    and the texts once; documents in which nothing recurs are done after that, the rest go on.
    """
    split = released(staged(split_documents(marked_documents(docs, recurring_anchors(docs, window), window)), "passages"))
    windows = released(staged(confirmed_windows(split, window), "windows"))
    located = located_documents(split, windows, window, False)
    clear = split.filter("anchors is null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("kept").alias("kept_sha256"))
    return clear.union(located).select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the windows of 20 words that start earlier elsewhere."""
    return dedup_passages(table(spark, sf_dir, "documents"))
