"""Quality rules: statistics against a plain count, the learner against planted rules, verdicts against the list read row by row."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import quality_rules as Q
from lamina.llm.quality import held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, rule int, word_length double"


def _texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("abé#*x") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    texts = [None, "", " \n\t\n", "one", "a b c", "a b c a b c", "a a a a", "x\n\n y \nx\nx \n\r\nx\r\nz\vz", "|<>$%&*# é|", "same\nsame\nsame"]
    texts += ["".join(rng.choice([w + rng.choice([" ", "\n", "\t ", "\r\n"]) for w in words]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    return [*texts, "long " * 30000, texts[20], "\n".join(["the same line again"] * 500)]


def _plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    seen = {i + k for i, t in enumerate(zip(words, words[1:], words[2:], strict=False)) if triples[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(seen)


def _documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", 0, 9, True, 7, 1.0) for i, t in enumerate(texts)], SCHEMA)


def test_statistics_match_plain_counts(spark):
    texts = _texts()
    got = {r.doc_id: r for r in Q.judged(_documents(spark, texts).repartition(3), Q.DecisionList()).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], _plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t and t[:80]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed) and r.rule == 0


def _planted(n, seed):
    x = np.random.default_rng(seed).random((n, 4))
    good = ~((x[:, 0] > 0.7) & (x[:, 1] <= 0.4)) & ~(x[:, 2] > 0.93)
    return x, good


def test_learns_planted_conjunctions():
    names = list("abcd")
    x, good = _planted(3000, 1)
    rules = Q.learn(x, good, names)
    x, good = _planted(2000, 2)
    said = np.full(len(x), rules.otherwise)
    for r in reversed(rules.rules):
        said = np.where(r.holds(x, names), r.keep, said)
    assert (said == good).mean() > 0.985
    assert 2 <= len(rules.rules) <= 24 and all(1 <= len(r.terms) <= 4 for r in rules.rules)
    assert Q.learn(*_planted(3000, 1), names) == Q.learn(*_planted(3000, 1), names)


def test_noise_gives_no_rules_and_one_label_none():
    rng = np.random.default_rng(4)
    x = rng.random((2000, 4))
    noisy = Q.learn(x, rng.random(2000) < 0.5, list("abcd"))
    covered = np.zeros(2000, bool)
    for r in noisy.rules:
        covered |= r.holds(x, list("abcd"))
    assert covered.mean() < 0.1
    assert Q.learn(x, np.ones(2000, bool), list("abcd")) == Q.DecisionList([], True)
    assert Q.learn(x, np.zeros(2000, bool), list("abcd")) == Q.DecisionList([], False)
    assert Q.learn(x[:0], np.zeros(0, bool), list("abcd")) == Q.DecisionList([], True)


def test_rules_become_one_ordered_expression(spark):
    names = list(Q.SHARES)
    rules = Q.DecisionList([Q.Rule((Q.Term("upper_letters", True, 0.5), Q.Term("digits", False, 0.2)), False), Q.Rule((Q.Term("upper_letters", True, 0.25),), True), Q.Rule((Q.Term("digits", True, 0.1),), False)])
    x = np.random.default_rng(3).random((200, len(names)))
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, " + ", ".join(f"{n} double" for n in names))
    got = {r.i: (r.keep, r.rule) for r in rows.select("i", rules.column().alias("keep"), rules.rule_column().alias("rule")).collect()}
    for i in range(len(x)):
        first = next((k for k, r in enumerate(rules.rules) if r.holds(x[i : i + 1], names)[0]), None)
        assert got[i] == ((True, 0) if first is None else (rules.rules[first].keep, first + 1))
    assert str(rules).splitlines()[0] == "upper_letters > 0.5 and digits <= 0.2: reject"


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = Q.train(docs, labels.filter(~held_out(4, 2)).select("doc_id", F.col("quality").alias("label")))
    rows = Q.judged(docs, rules).join(labels.filter(held_out(4, 2)), "doc_id").filter("not base_failed").collect()
    assert len(rows) > 20 and sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)


def test_tables_without_rows_or_labels(spark):
    docs = _documents(spark, ["word " * 3 + " ".join(map(str, range(60)))])
    none = spark.createDataFrame([], "doc_id long, label int")
    assert Q.judged(docs, Q.train(docs, none)).first().kept
    odd = spark.createDataFrame([(None, 1), (0, None), (0, 0)], "doc_id long, label int")
    assert Q.train(docs, odd) == Q.DecisionList([], False)
    assert Q.judged(docs.limit(0), Q.train(docs.limit(0), none)).count() == 0
