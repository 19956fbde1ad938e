"""Collocations against plain counts, and the counting quotient filters they are counted in."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from lamina.llm import collocations as C
from lamina.llm.quotient_filter import CountingFilter, Merger, pack, permute, unpack, unpermute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w1 long, a long, slice long, rank long"


@pytest.mark.parametrize("n,bits", [(2, 3), (2, 32), (3, 17), (4, 16), (4, 17), (4, 32)])
def test_filters_lose_nothing(n, bits):
    rng = np.random.default_rng(n * 100 + bits)
    top = (1 << bits) - 1
    ids = [np.concatenate([rng.integers(0, top, 3000, endpoint=True), [0, top, top]]).astype(np.uint64) for _ in range(n)]
    ids = [np.concatenate([c, np.repeat(c[:5], [1, 254, 255, 256, 1000])]) for c in ids]
    assert all((x == y).all() for x, y in zip(unpack(*unpermute(*permute(*pack(ids, bits), n, bits), n, bits), n, bits), ids, strict=True))
    want = Counter(zip(*[c.tolist() for c in ids], strict=True))
    whole = CountingFilter.of(ids, bits)
    halves = [CountingFilter.of([c[part] for c in ids], bits) for part in (slice(None, 2000), slice(2000, None))]
    merger = Merger()
    for h in halves:
        merger.add(h)
    for made in (whole, merger.close()):
        back = Counter()
        for shard, part in made.shards(4):
            data = part.to_bytes()
            again = CountingFilter.from_bytes(data)
            found, counts = again.at_least(1)
            assert (again.a == part.a).all() and (again.counts == part.counts).all()
            back.update(dict(zip(zip(*[c.tolist() for c in found], strict=True), counts.tolist(), strict=True)))
        assert back == want


def test_empty_filter():
    none = CountingFilter.of([np.zeros(0, np.uint64)] * 3, 9)
    again = CountingFilter.from_bytes(none.to_bytes())
    assert len(again) == 0 and list(none.shards(3)) == [] and Merger().close() is None


def test_keys_spread_over_shards():
    ids = [np.repeat(np.arange(300, dtype=np.uint64), 300), np.tile(np.arange(300, dtype=np.uint64), 300)]
    sizes = [len(p) for _, p in CountingFilter.of(ids, 9).shards(4)]
    assert len(sizes) == 16 and max(sizes) < 1.2 * min(sizes)


def _plain(rows, least, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            totals[lang] += len(w)
            for n in range(1, 5):
                f.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def _rows():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "Ünder", "z|x", "Q"]
    phrases = ["new york city", "a b c d", "r s t u v", "é É"]

    def text():
        said = [rng.choice(phrases) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        return "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n"]) for w in said)

    rows = [(rng.choice(["en", "en", "de", None, "und", "", "fr"]), text()) for _ in range(300)]
    return [*rows, ("en", None), (None, ""), ("de", " \n.,"), *[("en", rows[0][1])] * 40, ("fr", "tic TOC " * 20000)]


@pytest.mark.parametrize("least,top", [(30, 2000), (5, 7)])
def test_matches_plain_counts(spark, least, top):
    rows = _rows()
    docs = spark.createDataFrame([(i if i % 9 else None, t, lang, "s", 0, 1, 2, 3, 4) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(5)
    got = C.collocations(docs, least, 80, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _plain(rows, least, top)


def test_a_bitmap_full_of_others_changes_nothing(spark, monkeypatch):
    """The bitmap of frequent phrases only saves work: with 64 bits, all of them set, the result is the same."""
    rows = _rows()[:120]
    docs = spark.createDataFrame([(i, t, lang, "s", 0, 1, 2, 3, 4) for i, (lang, t) in enumerate(rows)], SCHEMA)
    monkeypatch.setattr(C, "MOST_BITS", 64)
    assert sorted(map(tuple, C.collocations(docs, 5).collect())) == _plain(rows, 5, 2000)


def test_equal_hashes_do_not_mix_words(monkeypatch):
    monkeypatch.setattr(C, "span_hash", lambda data, start, end, which: (end - start).astype(np.uint64) if which == 0 else data[start].astype(np.uint64))
    data = np.frombuffer(b"ab cd ab e", np.uint8)
    back, words = C.local_words(data, np.array([0, 3, 6, 9]), np.array([2, 5, 8, 10]))
    assert [words[i] for i in back] == [b"ab", b"cd", b"ab", b"e"]


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    words = spark.createDataFrame([("en", "x", big + 7, 1), ("en", "y", big + 1, 2)], "lang string, word string, f long, id long")
    phrases = spark.createDataFrame([(2, 1, 2, 0, 0, big)], "n_words int, w1 long, w2 long, w3 long, w4 long, a long")
    row = C.scored(words, phrases).first()
    assert row.score == 2000000 * big // (2 * big + 8) and (row.l, row.r) == (big + 7, big + 1)
    assert C.not_inside(C.scored(words, phrases), phrases).count() == 1


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_counting_task_merges_its_filters_in_a_hundred_megabytes():
    rng = np.random.default_rng(4)
    one, other = (CountingFilter.of([rng.integers(0, 1 << 17, 50_000).astype(np.uint64) for _ in range(4)], 17) for _ in range(2))
    tracemalloc.start()
    merged = one.merged(other)
    peak = tracemalloc.get_traced_memory()[1] / len(merged)
    tracemalloc.stop()
    assert peak * C.HELD < 100 << 20
