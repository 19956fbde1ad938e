"""Toxicity by class-conditional Kneser-Ney models of word pairs, with backoff counts that both classes share.

Each class c has p_c(w | h) = (n_c(h, w) - D_c)+ / n_c(h) + g_c(h) p_c(w) over the pairs that are kept, and
p_c(w) = (N_c(w) - E_c)+ / N_c + l_c S(w), where N_c(w) counts the different words before w, N_c is
its sum, and S(w) is the same estimate from both classes together, mixed with a uniform share that unseen
words have. What discounts and left-out pairs take goes to g_c(h) and l_c, so the probabilities of a history sum to one.
Texts are compared by the mean of log p_toxic(w | h) - log p_ordinary(w | h), and their passages by the mean of
log p_toxic(w) - log p_ordinary(w): there pairs that happen to come again would outweigh what words say.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import byte_class, find_words, map_texts, mix, record_batch, signed, small_side, span_hash, staged, table, text_slices
from lamina.llm.quality import held_out

#: Words of the passages whose best mean is taken beside the mean of the whole text.
WINDOWS = (1, 4)
#: Numbers that a text is scored by: mean ratio of the whole text and of its best passages, log of the number of words.
SUMMARY = ("mean", *(f"window{w}" for w in WINDOWS), "length")
#: Least times that a pair occurs in toxic texts, and least different words before a word, to be kept in the model; the rest backs off.
LEAST_PAIR, LEAST_WORD = 5, 4
#: Pairs of a task that are counted at a time.
PART = 1 << 20
#: History of a text's first word, and the event after its last.
EDGE = np.uint64(0)
LETTERS = byte_class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def pairs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, history and word of each event: the runs of letters (48-bit hashes, ASCII in lower case) and the end of each text."""
    rows = len(offsets) - 1
    start, end, row = find_words(data, offsets, LETTERS)
    word = (span_hash(_LOWER[data], start, end, 1) >> np.uint64(16)) | np.uint64(1) if len(start) else np.zeros(0, np.uint64)
    last = np.cumsum(np.bincount(row, minlength=rows))
    w = np.insert(word, last, EDGE)
    row = np.insert(row, last, np.arange(rows))
    h = np.concatenate([[EDGE], w[:-1]]) if len(w) else w
    return row, h, w


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + w)


def _counted(keys: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of one of each, and how often they occur in ordinary and in toxic texts."""
    found, first, at = np.unique(keys, return_index=True, return_inverse=True)
    t = np.bincount(at, toxic, len(found)).astype(np.int64)
    return found, first, np.bincount(at, minlength=len(found)) - t, t


def _events(docs: DataFrame, schema: str, fields: pa.Schema, made) -> DataFrame:
    """Rows that `made` makes of the events (history, word, whether toxic) of columns toxic and text, some PART of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            label = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, data, offsets in text_slices(b.column(1)):
                row, h, w = pairs_of(data, offsets)
                held.append((h, w, label[at + row]))
                size += len(h)
                if size >= PART:
                    yield record_batch(fields, made(*(np.concatenate(x) for x in zip(*held, strict=True))))
                    held, size = [], 0
        if held:
            yield record_batch(fields, made(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return map_texts(docs.select(docs["toxic"].cast("int"), docs["text"].cast("binary")), run, schema)


def word_counts(docs: DataFrame, least: int = LEAST_PAIR) -> DataFrame:
    """w, o and t (occurrences by class), co, ct and c (different words before it by class and in both together), the ones and twos of its pairs, and pairs.

    `pairs` has h, o and t of the pairs that occur `least` times or more in toxic texts. The two words of a pair are 48 bits
    each: what is shuffled is a long and an int a pair and task, from which both are read again.
    """
    fields = pa.schema([("key", pa.int64()), ("low", pa.int32()), ("o", pa.int64()), ("t", pa.int64())])

    def made(h: np.ndarray, w: np.ndarray, toxic: np.ndarray) -> list:
        _, first, o, t = _counted(pair_key(h, w), toxic)
        h, w = h[first], w[first]
        return [signed((w << np.uint64(16)) | (h >> np.uint64(32))), h.astype(np.uint32).view(np.int32), o, t]

    types = _events(docs, "key long, low int, o long, t long", fields, made).groupBy("key", "low").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))
    times = [F.count_if(F.col(c) == n).alias(f"{c}{n}") for c in "ot" for n in (1, 2)]
    seen = [F.count_if(F.col("o") > 0).alias("co"), F.count_if(F.col("t") > 0).alias("ct"), F.count("*").alias("c")]
    h = F.shiftleft(F.col("key").bitwiseAND(0xFFFF), 32).bitwiseOR(F.col("low").cast("long").bitwiseAND(0xFFFFFFFF))
    pairs = F.collect_list(F.when(F.col("t") >= least, F.struct(h.alias("h"), "o", "t"))).alias("pairs")
    return types.groupBy(F.shiftrightunsigned("key", 16).alias("w")).agg(F.sum("o").alias("o"), F.sum("t").alias("t"), *seen, *times, pairs)


def discount(ones: float, twos: float) -> float:
    """Kneser-Ney's estimate from how many expressions occur once and twice; 0.5 where that says nothing."""
    return ones / (ones + 2 * twos) if ones > 0 and twos > 0 else 0.5


@dataclass
class Smoothed:
    """Both classes' probabilities of words (rows of `word`, sorted; last: any other word) and of kept pairs, and what histories leave to words."""

    word: np.ndarray
    p_word: np.ndarray  # (2, words + 1)
    key: np.ndarray
    p_pair: np.ndarray  # (2, pairs): the discounted share alone
    history: np.ndarray
    left: np.ndarray  # (2, histories + 1), last: any other history

    def at(self, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted one among sorted keys, one past the end for others."""
        if not len(keys):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, len(keys))

    def probabilities(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """p(w | h) by class, shape (2, n)."""
        pair = np.hstack([self.p_pair, np.zeros((2, 1))])
        return pair[:, self.at(self.key, pair_key(h, w))] + self.left[:, self.at(self.history, h)] * self.p_word[:, self.at(self.word, w)]


def estimate(words: dict, totals: dict, pairs: dict) -> Smoothed:
    """The model from counts: of the kept words (w, o, t, co, ct, c), over all words (see `train`), and of the kept pairs (h, w, o, t).

    Kept words come sorted by w; EDGE, the end of a text, is one of them if it was seen.
    """
    n = np.array([[totals["o"], totals["t"]]], float).T
    cont = np.stack([words["co"], words["ct"]]).astype(float)
    sums = np.array([totals["co"], totals["ct"]], float)
    types = np.array([totals["types_o"], totals["types_t"]], float)
    kinds = totals["types"] + 1.0  # any word that was not seen is one more
    d_shared = discount(totals["c1"], totals["c2"])
    shared = np.append(np.maximum(words["c"] - d_shared, 0) / max(totals["c"], 1), 0.0)
    # Words that are not kept are one event: theirs is all that the kept ones leave.
    rest = lambda p: np.append(p[:-1], max(1.0 - p[:-1].sum(), 1e-12))
    mass = d_shared * totals["types"] / max(totals["c"], 1) if totals["c"] else 1.0
    shared = rest(shared + mass / kinds)
    p_word = np.empty((2, len(words["w"]) + 1))
    for c, name in enumerate("ot"):
        d = discount(totals[f"c{name}1"], totals[f"c{name}2"])
        own = np.append(np.maximum(cont[c] - d, 0) / max(sums[c], 1), 0.0)
        back = d * types[c] / sums[c] if sums[c] else 1.0
        p_word[c] = rest(own + back * shared)
    key = pair_key(pairs["h"], pairs["w"])
    order = np.argsort(key)
    history, at = np.unique(pairs["h"], return_inverse=True)
    times = np.stack([words["o"], words["t"]]).astype(float)
    times[:, words["w"] == EDGE] = n  # a text begins as often as it ends
    known = np.minimum(np.searchsorted(words["w"], history), max(0, len(words["w"]) - 1))
    of = np.where(words["w"][known] == history, times[:, known], 0.0) if len(words["w"]) else np.zeros((2, len(history)))
    p_pair, left = np.zeros((2, len(key))), np.ones((2, len(history) + 1))
    for c, name in enumerate("ot"):
        d = discount(totals[f"{name}1"], totals[f"{name}2"])
        total = of[c][at]
        share = np.where(total > 0, np.maximum(pairs[name] - d, 0) / np.maximum(total, 1), 0.0)
        p_pair[c] = share
        left[c, :-1] = np.maximum(1.0 - np.bincount(at, share, len(history)), 1e-9)
    return Smoothed(words["w"], p_word, key[order], p_pair[:, order], history, left)


@dataclass
class KneserNey:
    """Log ratios of the two classes: of kept pairs, of words and of what histories leave; and the weights of the SUMMARY."""

    key: np.ndarray
    pair: np.ndarray
    word: np.ndarray
    by_word: np.ndarray
    history: np.ndarray
    by_history: np.ndarray
    bias: np.ndarray = field(default_factory=lambda: np.array([-1.0, 1.0, *[0.0] * (len(SUMMARY) - 1)]))

    def ratios(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        find = Smoothed.at
        pair = np.append(self.pair, 0.0)[place := find(self, self.key, pair_key(h, w))]
        lower = self.by_history[find(self, self.history, h)] + self.by_word[find(self, self.word, w)]
        return np.where(place < len(self.key), pair, lower)

    def summary(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The SUMMARY of each text; zeros for texts without a word."""
        rows = len(offsets) - 1
        out = np.zeros((rows, len(SUMMARY)))
        row, h, w = pairs_of(data, offsets)
        word = w != EDGE
        row, h, w = row[word], h[word], w[word]
        if not len(row):
            return out
        n = np.bincount(row, minlength=rows)
        out[:, 0] = np.bincount(row, self.ratios(h, w), rows) / np.maximum(1, n)
        ratio = self.by_word[Smoothed.at(self, self.word, w)].astype(float)
        first = np.cumsum(n) - n
        sums = np.concatenate([[0], np.cumsum(ratio)])
        at, last = np.arange(len(row)), (first + n)[row]
        for i, size in enumerate(WINDOWS, 1):
            begin = np.maximum(np.minimum(at, last - size), first[row])  # a shorter text is a shorter passage
            best = np.full(rows, -np.inf)
            np.maximum.at(best, row, (sums[np.minimum(at + size, last)] - sums[begin]) / (np.minimum(at + size, last) - begin))
            out[:, i] = np.where(n > 0, best, 0)
        out[:, -1] = np.log1p(n)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias[0] + x @ self.bias[1:], -500, 500)))


def log_ratios(m: Smoothed, h: np.ndarray, w: np.ndarray) -> KneserNey:
    """Log of toxic over ordinary of all that the model keeps; h and w are its pairs, in any order."""
    order = np.argsort(pair_key(h, w))
    of = lambda p: (np.log(p[1]) - np.log(p[0])).astype(np.float32)
    return KneserNey(m.key, of(m.probabilities(h[order], w[order])), m.word, of(m.p_word), m.history, of(m.left))


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic weights of the normalised ratios, by Newton steps with a small ridge; needs both labels."""
    if len(y) == 0 or y.min() == y.max():
        return np.array([-1.0, 1.0, *[0.0] * (len(SUMMARY) - 1)])
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(len(w))
        w += np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
    return w


def summarised(docs: DataFrame, model: KneserNey, extra: str | None = None) -> DataFrame:
    """doc_id (and the long column `extra`), score and its SUMMARY, for every row.

    Repeated rows are scored each, texts of any length whole; null and word-less texts have zeros; an empty
    table gives no rows. Other columns are not carried.
    """
    keep = ["doc_id"] + ([extra] if extra else [])
    fields = pa.schema([(c, pa.int64()) for c in keep] + [(c, pa.float64()) for c in ("score", *SUMMARY)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in text_slices(b.column(len(keep))):
                x = shared.value.summary(data, offsets)
                yield record_batch(fields, [*(b.column(i).slice(at, len(x)) for i in range(len(keep))), shared.value.score(x), *x.T.copy()])

    source = docs.select(*[docs[c].cast("long").alias(c) for c in keep], docs["text"].cast("binary"))
    return map_texts(source, run, ", ".join(f"{c} long" for c in keep) + "".join(f", {c} double" for c in ("score", *SUMMARY)))


def learn(counted: DataFrame, least_word: int = LEAST_WORD, least_pair: int = LEAST_PAIR) -> tuple[Smoothed, dict]:
    """The smoothed model of rows (toxic, text) and its kept pairs: sums on the executors; the kept words and pairs come to the driver.

    Discounts and totals are of all words and pairs. Kept are words with `least_word` different words before them and the edge,
    and pairs of kept words with `least_pair` occurrences in toxic texts; the others are pruned to the shared backoff. Both grow with the corpus.
    """
    words = staged(word_counts(counted, least_pair), "words")
    sums = [F.sum(c).alias(c) for c in ("co", "ct", "c", "o1", "o2", "t1", "t2")] + [F.count("*").alias("types"), F.count_if(F.col("co") > 0).alias("types_o"), F.count_if(F.col("ct") > 0).alias("types_t")]
    once = [F.count_if(F.col(c) == n).alias(f"{c}{n}") for c in ("co", "ct", "c") for n in (1, 2)]
    totals = {k: v or 0 for k, v in words.agg(*sums, *once).first().asDict().items()}
    totals |= dict(zip("ot", counted.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first(), strict=True))
    kept = words.filter((F.col("c") >= least_word) | (F.col("w") == int(EDGE))).select("w", "o", "t", "co", "ct", "c").toPandas()
    kept = {c: kept[c].to_numpy() for c in kept}
    kept["w"] = kept["w"].astype(np.int64).view(np.uint64)
    kept = {c: v[np.argsort(kept["w"])] for c, v in kept.items()}
    found = words.select("w", F.explode("pairs").alias("p")).select("p.h", "w", "p.o", "p.t").toPandas()
    pairs = {c: found[c].to_numpy().astype(np.int64).view(np.uint64 if c in "hw" else np.int64) for c in found}
    whole = np.isin(pairs["w"], kept["w"])
    pairs = {c: v[whole] for c, v in pairs.items()}
    return estimate(kept, totals, pairs), pairs


def train(docs: DataFrame, labels: DataFrame, calibration_rows: int = 20_000, seed: int = 11) -> KneserNey:
    """Models over all labelled documents but a fifth; the weights from at most `calibration_rows` of that fifth.

    `labels` has doc_id and toxic; null ids and labels are left out, of repeated ids the largest label
    counts. The counts cover every such document, however many. Without labels, or with one label only, the
    score is that of the ratio alone. Labels are broadcast only up to a million rows, else joined by a shuffle.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fifth = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(5)) == 0
    smooth, pairs = learn(docs.select("doc_id", "text").join(small_side(known.filter(~fifth), 1_000_000), "doc_id"))
    model = log_ratios(smooth, pairs["h"], pairs["w"])
    sample = known.filter(fifth).orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").limit(calibration_rows)
    rows = summarised(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), model, "toxic").toPandas()
    model.bias = calibrate(rows[list(SUMMARY)].to_numpy(), rows["toxic"].to_numpy().astype(float))
    return model


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; null and word-less texts get the score of zero evidence, an empty table no rows."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out(5, 0)).select("doc_id", "toxic")
    out = summarised(docs, train(docs, labels))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
