"""Quality rules: a decision list of threshold conjunctions, learned by sequential covering.

A rule is grown term by term on two thirds of the labelled rows that no earlier rule covers, by
information gain, and pruned from its end on the other third. The list becomes one ordered Spark
conditional expression over statistics of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import WORD, byte_class, find_words, map_texts, mix, record_batch, span_hash, table, text_slices
from lamina.llm.quality import held_out

#: Byte classes whose members are counted.
COUNTED = {
    "n_symbols": b"#*$%&|<>",
    "n_upper": bytes(range(65, 91)),
    "n_letters": bytes(range(65, 91)) + bytes(range(97, 123)),
    "n_digits": b"0123456789",
    "n_stops": b".,;:?",
    "n_shouts": b"!",
    "n_bars": b"|",
}
COUNTS = ("n_words", "word_chars", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_marked", *COUNTED)


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text of a slice. Repeats are told by 64-bit hashes: two of a text's n windows or lines are
    taken for equal wrongly with a probability of n * n / 2^65."""
    rows = len(offsets) - 1
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    out = {name: total(byte_class(members)[data]) for name, members in COUNTED.items()}
    start, end, row = find_words(data, offsets)
    out["n_words"] = np.bincount(row, minlength=rows)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out["word_chars"] = np.bincount(row, heads[end] - heads[start], rows).astype(np.int64)
    marks = byte_class(b"#*$%&|<>!@^~=+[]{}\\/_`")
    out["n_marked"] = np.bincount(row, marks[data[end - 1]] if len(end) else None, rows).astype(np.int64)
    lone = mix(np.arange(1, rows + 1, dtype=np.uint64))
    word = span_hash(data, start, end) if len(start) else np.zeros(0, np.uint64)
    _, first = np.unique(word ^ lone[row], return_index=True)
    out["n_distinct"] = np.bincount(row[first], minlength=rows)
    seen = np.zeros(len(word), bool)
    if len(word) > 2:
        run = mix(mix(mix(word[:-2]) * np.uint64(3) + word[1:-1]) * np.uint64(3) + word[2:])
        inside = np.flatnonzero(row[:-2] == row[2:])
        _, back, times = np.unique(run[inside] ^ lone[row[inside]], return_inverse=True, return_counts=True)
        again = inside[times[back] > 1]
        for k in range(3):
            seen[again + k] = True
    out["n_repeat_words"] = np.bincount(row[seen], minlength=rows)
    line_end = np.unique(np.concatenate([np.flatnonzero(data == 10), offsets[1:] if rows else offsets[:0]]))
    line_start = np.concatenate([[0], line_end[:-1] + (data[line_end[:-1]] == 10)]) if len(line_end) else line_end
    filled = np.concatenate([[0], np.cumsum(WORD[data])])
    some = filled[line_end] > filled[line_start]
    line_start, line_end = line_start[some], line_end[some]
    of = np.searchsorted(offsets, line_start, side="right") - 1
    out["n_lines"] = np.bincount(of, minlength=rows)
    line = span_hash(data, line_start, line_end, 1) if len(of) else np.zeros(0, np.uint64)
    _, first = np.unique(line ^ lone[of], return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(of[first], minlength=rows)
    return out


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` (longs) and the COUNTS of the whole text; null text has zeros, other columns are not carried."""
    fields = pa.schema([(c, pa.int64()) for c in (*keep, *COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in text_slices(b.column(len(keep))):
                made = statistics(data, offsets)
                yield record_batch(fields, [*(b.column(i).slice(at, len(offsets) - 1) for i in range(len(keep))), *(made[c] for c in COUNTS)])

    source = docs.select(*[docs[c].cast("long").alias(c) for c in keep], docs["text"].cast("binary").alias("text"))
    return map_texts(source, run, ", ".join(f"{c} long" for c in (*keep, *COUNTS)))


#: What rules may test: shares of the counts.
SHARES = {
    "word_length": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "bars_a_word": ("n_bars", "n_words"),
    "marked_words": ("n_marked", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "upper_letters": ("n_upper", "n_letters"),
    "digits": ("n_digits", "word_chars"),
    "stops_a_word": ("n_stops", "n_words"),
    "shouts_a_word": ("n_shouts", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}


def with_shares(counts: DataFrame) -> DataFrame:
    return counts.withColumns({k: F.col(a) / F.greatest(F.col(b), F.lit(1)) for k, (a, b) in SHARES.items()})


def base_failed() -> Column:
    """The fixed rule before the learned ones: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        values = x[:, names.index(self.feature)]
        return values > self.threshold if self.above else values <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    terms: tuple[Term, ...]
    keep: bool

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        return reduce(np.logical_and, (t.holds(x, names) for t in self.terms), np.ones(len(x), bool))


@dataclass
class DecisionList:
    """Rules in order; the first whose terms all hold decides, else `otherwise`."""

    rules: list[Rule] = field(default_factory=list)
    otherwise: bool = True

    def column(self) -> Column:
        """Verdict as one ordered conditional expression over SHARES."""
        return self._chosen(lambda i, r: F.lit(r.keep), F.lit(self.otherwise))

    def rule_column(self) -> Column:
        """Number of the rule that decides, from 1; 0 where none does."""
        return self._chosen(lambda i, r: F.lit(i + 1), F.lit(0))

    def _chosen(self, value, last: Column) -> Column:
        chain = None
        for i, rule in enumerate(self.rules):
            holds = reduce(Column.__and__, (t.column() for t in rule.terms))
            chain = F.when(holds, value(i, rule)) if chain is None else chain.when(holds, value(i, rule))
        return last if chain is None else chain.otherwise(last)

    def __str__(self) -> str:
        lines = [f"{' and '.join(map(str, r.terms))}: {'keep' if r.keep else 'reject'}" for r in self.rules]
        return "\n".join([*lines, f"otherwise: {'keep' if self.otherwise else 'reject'}"])


def _best_term(x: np.ndarray, hit: np.ndarray, names: list[str]) -> tuple[float, Term] | None:
    """The term with the greatest information gain for the rows `hit`; thresholds lie midway between values."""
    p_all, n = int(hit.sum()), len(hit)
    best = None
    before = np.log2(p_all / n)
    for i, name in enumerate(names):
        order = np.argsort(x[:, i], kind="stable")
        v, good = x[order, i], np.cumsum(hit[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        low_p, low_n = good[cut].astype(float), cut + 1.0
        for above, p, m in ((False, low_p, low_n), (True, p_all - low_p, n - low_n)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / m) - before), 0.0)
            k = int(gain.argmax())
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), Term(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
    return best


def _grown(x: np.ndarray, hit: np.ndarray, names: list[str], max_terms: int) -> list[Term]:
    terms: list[Term] = []
    rows = np.arange(len(x))
    while len(terms) < max_terms and hit[rows].any() and not hit[rows].all():
        found = _best_term(x[rows], hit[rows], names)
        if found is None:
            break
        terms.append(found[1])
        rows = rows[found[1].holds(x[rows], names)]
    return terms


def _pruned(terms: list[Term], x: np.ndarray, hit: np.ndarray, names: list[str]) -> tuple[float, int, tuple[Term, ...]]:
    """Worth on the pruning rows ((p - n) / (p + n)), rows covered right and the terms left, cut where the worth is greatest."""
    best = (-1.0, 0, ())
    for k in range(1, len(terms) + 1):
        on = Rule(tuple(terms[:k]), True).holds(x, names)
        p, n = int(hit[on].sum()), int((~hit[on]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, p, tuple(terms[:k]))
    return best


def learn(x: np.ndarray, good: np.ndarray, names: list[str], max_rules: int = 24, max_terms: int = 4, least_worth: float = 0.9, least_rows: int = 2, seed: int = 5) -> DecisionList:
    """Decision list for rows x (columns `names`) and their label.

    At each step a rule is grown and pruned for rejecting and one for keeping; the more worthy one, of
    equals the one for the rarer label, joins the list and the rows that it covers leave. Without rows everything is
    kept; rows of one label give no rule.
    """
    order = np.random.default_rng(seed).permutation(len(x))
    x, good = x[order], good[order].astype(bool)
    growing = np.arange(len(x)) % 3 != 2
    out = DecisionList(otherwise=bool(good.sum() * 2 >= len(good)))
    rare = bool(good.sum() * 2 < len(good))
    while len(out.rules) < max_rules and good.any() and not good.all():
        offers = []
        for keep in (rare, not rare):
            hit = good == keep
            terms = _grown(x[growing], hit[growing], names, max_terms)
            worth, rows, left = _pruned(terms, x[~growing], hit[~growing], names)
            if worth >= least_worth and rows >= least_rows:
                offers.append((worth, keep == rare, Rule(left, keep)))
        if not offers:
            break
        rule = max(offers, key=lambda o: o[:2])[2]
        out.rules.append(rule)
        rest = ~rule.holds(x, names)
        x, good, growing = x[rest], good[rest], growing[rest]
        if len(good):
            out.otherwise = bool(good.sum() * 2 >= len(good))
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, seed: int = 13) -> DecisionList:
    """Learns from at most `max_rows` labelled documents, those with the least hash of their id, that the base rule leaves.

    `labels` has doc_id and label 0 or 1; null labels and ids are left out, of repeated ids the least
    label counts. The bound keeps what is broadcast and what comes to the driver (one row of numbers each) the
    same at every size of the corpus.
    """
    known = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows)
    rows = with_shares(counted(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ["doc_id", "label"])).filter(~base_failed())
    names = list(SHARES)
    found = rows.select("doc_id", "label", *names).toPandas().sort_values(["doc_id", *names], kind="stable")
    return learn(found[names].to_numpy(dtype=float).reshape(-1, len(names)), found["label"].to_numpy(), names)


def judged(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and rule (the number of the rule that decided, 0 for none) of every row.

    Null and empty texts fail the base rule; repeated rows and null ids are judged each, texts of any
    length whole; other columns are not carried; an empty table gives no rows.
    """
    rows = with_shares(counted(docs, ["doc_id"])).withColumn("base_failed", base_failed())
    return rows.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & rules.column()).alias("kept"), rules.rule_column().alias("rule"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and verdict; the rules are learned from labels.quality outside the held part of op2."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out(4, 2)).select("doc_id", F.col("quality").alias("label"))
    return judged(docs, train(docs, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
