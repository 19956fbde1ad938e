"""Each operator on a small fixture with nulls, empty and long texts, ties, repeats and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lamina.llm import chat, line_dedup, mixing, packing, quality, simhash_dedup, substring_dedup, toxicity
from lamina.llm import pipeline as corpus_pipeline
from lamina.llm.approximate_search import nearest
from lamina.llm.components import components
from lamina.llm import exact_search
from lamina.llm.exact_search import top_k, usable

RNG = np.random.default_rng(3)
VOCAB = ["".join(RNG.choice(list("abcdeé"), 5)) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, taken long, id long, anchor long, component long"


def _text(n):
    return " ".join(RNG.choice(VOCAB, n))


def _rows():
    long, passage = _text(6000), _text(60)
    texts = [None, "", " \n\t", "one", long, long, passage, f"{_text(30)} {passage} {_text(30)}", f"{passage}\n{_text(10)}", "x " * 200, "a<|endoftext|>b  c\nd"]
    texts += [_text(int(n)) for n in RNG.integers(1, 300, 40)]
    near = _text(200).split()
    texts += [" ".join([*near[:k], "zzz", *near[k + 1 :]]) for k in (5, 90, 150)] + [" ".join(near)]
    return [(i, t, "en", [None, "a", "b", "c"][i % 4], 0, 1, 2, 3, 4, 5) for i, t in enumerate(texts)]


ROWS = _rows()
TEXTS = {r[0]: r[1] or "" for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_keeps_every_token_once(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, t in TEXTS.items():
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.piece):
            assert r.start == at and zlib.crc32(ids[4 * at : 4 * (at + r.length)]) == r.ids_crc32
            at += r.length
        assert at == len(ids) // 4
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none, path).count() == 0


def test_plan_uses_the_histogram_exactly():
    have = np.zeros(2049, np.int64)
    have[RNG.integers(1, 2049, 5000)] += RNG.integers(1, 40, 5000)
    used = np.zeros(2049, np.int64)
    sequences = 0
    for lengths, times in packing.plan(have):
        assert sum(lengths) <= 2048
        np.add.at(used, lengths, times)
        sequences += times
    assert (used == have).all()
    # Uniform lengths are a hard case: rounding leaves more to the residual than the tables do (33,807 of at least 33,806).
    assert sequences <= 1.03 * (have * np.arange(2049)).sum() / 2048


def test_simhash_matches_brute_force(docs, none):
    def print_of(text):
        words = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
        if not words:
            return 0
        parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {d: print_of(t) for d, t in TEXTS.items()}
    least = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and least[b] < least[a]:
                    least[a], changed = least[b], True
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash_dedup.near_duplicates(docs).collect()}
    assert got == {d: (prints[d], least[d]) for d in prints}
    assert simhash_dedup.near_duplicates(none).count() == 0


def test_near_pairs_finds_all_pairs(spark):
    base = RNG.integers(0, 2**63, 60)
    prints = np.unique(np.concatenate([base, base ^ (1 << RNG.integers(0, 62, 60)), base ^ (1 << RNG.integers(0, 30, 60)) ^ (1 << RNG.integers(31, 62, 60))]))
    want = {frozenset((int(a), int(b))) for a in prints for b in prints if a != b and int(a ^ b).bit_count() <= 2}
    got = [frozenset((r.a, r.b)) for r in simhash_dedup.near_pairs(spark.createDataFrame([(int(p),) for p in prints], "fp long")).collect()]
    assert set(got) == want and len(got) == len(want)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def test_substring_matches_brute_force(docs, none):
    seen, want = set(), {}
    for d, t in sorted(TEXTS.items()):
        words = t.encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want[d] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_passages(docs).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 6000
    assert substring_dedup.dedup_passages(none).count() == 0


def test_line_dedup_keeps_one_of_a_group(spark, none):
    line = "the quick brown fox jumps over the lazy dog near the old river bank every day"
    rows = [(1, f"{line}\nother words here entirely"), (2, f"{line.upper()}!\n---\n---"), (3, line.replace("every", "each")), (4, None), (5, ""), (6, "nothing alike in this one")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].n_removed == 0 and out[2].text == "---\n---" and out[4].text is None and out[5].text == "" and out[6].n_removed == 0
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_simhash_matches_brute_force(spark):
    texts = [_text(5), _text(80), "w " * 40000 + "v", " ".join(f"k{i}" for i in range(16383)), "only", "One--TWO\tthree"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {r.id: r.doc_id for r in line_dedup.lines_of(docs).collect()}
    wanted = line_dedup.lines_of(docs).select("id")
    got = {ids[r.id]: r.bits % 2**64 for r in line_dedup._texts(docs, wanted).collect()}
    for key, text in enumerate(texts):
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(re.findall(r"[^\W_]+", text.lower()))]
        assert got[key] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_lines_with_few_words_replaced_share_a_block(spark):
    rng = random.Random(11)
    rows = []
    for i, (length, changed) in enumerate([(8, 1), (20, 1), (30, 2), (58, 2), (62, 5), (100, 5), (149, 5), (152, 9), (500, 15)]):
        words = [f"v{i}x{j}" for j in range(length)]
        other = list(words)
        for j in rng.sample(range(length), changed):
            other[j] = f"n{i}x{j}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = {r.id: r.doc_id for r in line_dedup.lines_of(docs).collect()}
    codes = {}
    for r in line_dedup.blocks(docs).filter(f"class <> {line_dedup.WHOLE}").collect():
        codes.setdefault(of[r.id], set()).add(r.code)
    assert sum(bool(codes[k] & codes[k + 1]) for k in range(0, len(rows), 2)) >= 7
    assert not any(codes[a] & codes[b] for a in codes for b in codes if a // 2 != b // 2)


def _distance(s: str, t: str) -> int:
    row = list(range(len(t) + 1))
    for i, x in enumerate(s):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(t):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_line_groups_match_brute_force(spark):
    rng = random.Random(7)
    lines = []
    for length in (12, 25, 40, 60):
        base = _text(length).split()
        for _ in range(14):  # chains of copies of copies, with some words swapped, dropped or changed
            words = list(rng.choice([base, lines[-1].split() if lines else base]))
            for _ in range(rng.randint(0, 3)):
                i, j = rng.randrange(len(words)), rng.randrange(len(words))
                if rng.random() < 0.5:
                    words[i], words[j] = words[j], words[i]
                else:
                    words[i] = words[j]
            lines.append(" ".join(words))
        lines += [" ".join(reversed(base)), " ".join(base[1:] + base[:1])]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    group, links = list(range(len(lines))), []
    for i, s in enumerate(lines):
        for j, t in enumerate(lines[:i]):
            if s == t or _distance(s, t) <= int(max(len(s), len(t)) * (1 - 0.8) + 1e-9):
                links.append((i, j))
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    gone = {r.doc_id for r in line_dedup.lines_of(docs).join(line_dedup.dropped_lines(docs), ["row", "line_no"], "left_semi").collect()}
    want = {i for i in range(len(lines)) if group[i] != i}
    assert gone <= want and len(gone) >= 0.95 * len(want) and 0 < len(want) < len(lines)


def test_edit_bounds_agree_with_the_distance(spark):
    base = _text(30)
    words = base.split()
    others = [base, " ".join(words[1:]), " ".join(["new", *words]), " ".join(reversed(words)), " ".join(words[:15]), base.replace("a", "o"), _text(30), ""]
    long = _text(500).split()
    others = [(base, t) for t in others] + [(" ".join(long), " ".join([*long[:k], "zz", "q", *long[k + 2 :]])) for k in (1, 250)] + [(" ".join(long), _text(500))]
    df = spark.createDataFrame([(i, 0, s, t) for i, (s, t) in enumerate(others)], "u long, v long, s string, t string")
    most = "cast(floor(greatest(length(s), length(t)) * 0.2 + 1e-9) as int)"
    near = {r.u for r in df.filter(f"levenshtein(s, t) <= {most}").collect()}
    judged = {r.u: r.ok for r in line_dedup.bounded(df, 0.8).collect()}
    assert near <= set(judged) and {u for u, ok in judged.items() if ok} <= near and sum(judged.values()) >= 5


def test_chat_round_trip(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, "assistant", "a"), (2, 1, "user", None), (3, 0, None, "#<\\"), (None, 0, "us:er: x", "line\nline"), (None, 1, "assistant", ""), (2, 1, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.examples(df)).collect()}
    for conv in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert got[conv].loss == "".join(t for role, t in want if role == "assistant")


def test_mixing_meets_targets(docs, none):
    out = mixing.taken_by_document(docs).collect()
    again = mixing.taken_by_document(docs.repartition(5)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again)) and len(out) == len(ROWS)
    source = {r[0]: r[3] for r in ROWS}
    for s in {None, "a", "b", "c"}:
        part = [r for r in out if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 1
        assert all(r.taken <= 2 * r.size and r.size == len(TEXTS[r.doc_id].encode().split()) for r in part)
    assert mixing.taken_by_document(none).count() == 0


def test_targets_reshare_what_is_capped():
    got = {s: t for s, _, t in mixing.targets([("a", 10), ("b", 100), (None, 1000)])}
    assert got["a"] == 20 and got["b"] == 200 and abs(got[None] - (1.5 * 1110 - 220)) < 1e-9
    split = mixing.splitting_tree(np.array([7, 100, 0, 33]), 5, 1)
    assert (split.sum(0) == [7, 100, 0, 33]).all() and split.sum(1).max() - split.sum(1).min() <= 3


def test_exact_search_matches_brute_force(spark):
    x = RNG.integers(-40, 40, (300, 8))
    x[50:60] = x[3]
    df = spark.createDataFrame([(i, [int(v) for v in row]) for i, row in enumerate(x)], "vec_id long, v array<long>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(df, df.filter("vec_id % 10 = 0"), 5).collect()}
    for q in range(0, 300, 10):
        s = x @ x[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, s[i]) for i in best]
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_nearest_recall_and_scores(spark):
    x = RNG.standard_normal((2000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, v array<double>")
    got = {}
    for r in nearest(df, df.filter("vec_id % 50 = 0"), 10).collect():
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-9
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & set(sorted((i for i in range(2000) if i != q), key=lambda i: -(x[i] @ x[q]))[:10])) / 10 for q in range(0, 2000, 50)]
    assert np.mean(hits) >= 0.9
    bad = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [float("inf")]), (5, [1.0])], "vec_id long, v array<double>")
    assert [r.vec_id for r in bad.filter(usable(F.col("v"))).collect()] == [5]


def test_search_prunes_clustered_data():
    centres = RNG.integers(-4000, 4000, (12, 8))
    x = (centres[RNG.integers(0, 12, 3000)] + RNG.integers(-9, 9, (3000, 8))).astype(np.int64)
    q, ids = x[::50], np.arange(len(x))
    search = exact_search._Search(q, ids[::50], x, ids, 5)
    search.run(exact_search.CoverNode(search.qf, np.arange(len(q)), leaf=exact_search.QUERY_LEAF), exact_search.CoverNode(search.xf, ids))
    assert search.products_done < 0.5 * len(q) * len(x)
    for n, i in enumerate(ids[::50]):
        s = x @ x[i]
        best = sorted((j for j in ids if j != i), key=lambda j: (-s[j], j))[:5]
        assert search.best[n].tolist() == best


def test_searches_of_vectors_of_other_lengths_and_none(spark):
    rows = [(i, [i % 7, 3, i]) for i in range(60)] + [(100 + i, [i, 1]) for i in range(20)] + [(200, [])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = top_k(df, df.filter("vec_id % 10 = 0"), 3).collect()
    assert {r.vec_id < 100 for r in got if r.query_id == 10} == {True} and {r.vec_id >= 100 for r in got if r.query_id == 110} == {True}
    real = df.filter("size(v) > 0").select("vec_id", F.col("v").cast("array<double>").alias("v"))
    near = nearest(real, real.filter("vec_id % 10 = 0"), 3).collect()
    assert len([r for r in near if r.query_id == 110]) == 3 and {r.vec_id >= 100 for r in near if r.query_id == 110} == {True}
    assert nearest(real.limit(0), real.limit(0)).count() == 0


def test_kneser_ney_probabilities_sum_to_one(spark):
    texts = [("you are a silly goose", 1), ("you silly silly goose", 1), ("silly goose you are", 1), ("the goose is a bird", 0), ("a bird is the word the bird said", 0), (None, 0), ("", 1)]
    df = spark.createDataFrame([(t, y) for t, y in texts] * 3, "text string, toxic int")
    model, pairs = toxicity.learn(df, least_word=1, least_pair=2)
    assert len(pairs["t"]) >= 3 and pairs["t"].min() >= 2
    seen = np.append(model.word, np.uint64(12345))  # the last stands for any other word
    for h in [*model.history, np.uint64(999)]:
        p = model.probabilities(np.full(len(seen), h), seen)
        assert np.allclose(p.sum(1), 1, atol=1e-6) and (p > 0).all()
    words = {w: toxicity.pairs_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[2][0] for w in ("silly", "bird")}
    ratio = toxicity.log_ratios(model, pairs["h"], pairs["w"])
    at = {w: ratio.by_word[toxicity.Smoothed.at(ratio, ratio.word, np.array([k]))[0]] for w, k in words.items()}
    assert at["silly"] > 0 > at["bird"]


def test_classifiers_learn_on_held_out(spark):
    good, bad = [_text(60) for _ in range(150)], [" ".join(w + "%%%" for w in _text(60).split()) for _ in range(150)]
    toxic = [f"{t} idiot {_text(5)} scum" for t in good[:75]]
    rows = [(i, t, int(i < 150), int(i >= 300)) for i, t in enumerate(good + bad + toxic)] + [(900, None, 1, 0), (901, "", 1, 0), (901, "", 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").withColumn("score", F.lit(1))
    model = quality.train(df, df.filter("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") < 300, F.col("quality")).alias("label")))
    scores = {r.doc_id: r.score for r in quality.scored(df, model).collect()}
    assert np.mean([(scores[i] >= 0.7) == (i < 150) for i in range(1, 300, 2)]) > 0.95 and 0 <= scores[900] == scores[901] <= 1
    judge = toxicity.train(df, df.filter("doc_id % 2 = 0 or doc_id % 3 = 0").select("doc_id", "toxic"))
    marked = {r.doc_id: r.score for r in toxicity.summarised(df, judge).collect()}
    assert np.mean([(marked[i] >= 0.5) == (i >= 300) for i in range(1, 375, 2)]) > 0.95 and 0 <= marked[900] == marked[901] <= 1
    assert quality.keep_good(df, model).columns == df.columns


def test_pipeline_stages_keep_document_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixture", "packing"]
    kept = corpus_pipeline.quality(spark, docs, sf)
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0").collect()}
    assert kept.columns == docs.columns and kept.count() < docs.count() and len(bad & {r.doc_id for r in kept.collect()}) <= 0.2 * len(bad)
    last = corpus_pipeline.run(spark, sf)
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_products_beyond_64_bits_that_nobody_wants(spark):
    rows = [(1, [10**14, 0]), (2, [10**14, 3]), (3, [5, 10**5]), (4, [-(10**14), 2]), (5, [7, 1])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    asked = vectors.filter("vec_id = 3")
    want = sorted(((-sum(a * b for a, b in zip(rows[2][1], v, strict=True)), i) for i, v in rows if i != 3))
    assert [(-r.score, r.vec_id) for r in top_k(vectors, asked, 4).orderBy("rank").collect()] == want
    found = top_k(vectors, vectors.filter("vec_id = 5"), 1).collect()
    assert [(r.vec_id, r.score) for r in found] == [(2, 7 * 10**14 + 3)]
    with pytest.raises(Exception, match="does not fit in 64 bits"):
        top_k(vectors, vectors.filter("vec_id = 1"), 2).collect()


@pytest.mark.parametrize("kind", ["lognormal", "uniform", "short"])
def test_packing_never_takes_more_than_best_fit(kind):
    rng = np.random.default_rng(8)
    drawn = {"lognormal": rng.lognormal(5.5, 1, 200_000), "uniform": rng.uniform(1, 2048, 20_000), "short": rng.integers(1, 40, 50_000)}[kind]
    lengths = np.clip(drawn.astype(int), 1, 2048)
    have = np.bincount(lengths, minlength=2049)
    made = packing.plan(have)
    used = np.zeros(2049, int)
    for parts, times in made:
        assert sum(parts) <= 2048
        np.add.at(used, parts, times)
    assert (used == have).all()
    assert sum(t for _, t in made) <= sum(t for _, t in packing._best_fit(have.astype(np.int64), 2048))


def test_very_long_passages_are_confirmed_in_parts(spark, monkeypatch):
    rng = random.Random(5)
    long = " ".join(f"v{rng.randrange(3000)}" for _ in range(45_000))
    docs = spark.createDataFrame([(0, long), (1, f"head {long} tail"), (2, f"{long} {long}")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in substring_dedup.dedup_passages(docs).orderBy("doc_id").collect()] == [(0, 45_000, 0), (1, 45_002, 45_000), (2, 90_000, 90_000)]


def test_more_words_than_characters(spark, monkeypatch):
    """With an alphabet of a few words, shards are cut and a document of more words takes two characters a word; nothing changes."""
    passage = [f"w{i}" for i in range(60)]
    texts = [" ".join(f"a{k}x{i}" for i in range(30)) + " " + " ".join(passage) + f" tail{k}" for k in range(6)] + [" ".join(passage * 2), "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    want = sorted(map(tuple, substring_dedup.dedup_passages(docs).collect()))
    for most in (25, 61, 70):
        monkeypatch.setattr(substring_dedup, "ALPHABET", most)
        for wide in (False, True):
            shard = substring_dedup._Shard(wide)
            shard.add(1, [w.encode() for w in texts[6].split()], [(0, 60, True), (60, 120, False)])
            (_, _, gone), = shard.located()
            assert gone.tolist() == [False] * 60 + [True] * 60
    assert [r[2] for r in want] == [0, 60, 60, 60, 60, 60, 120, 0]
    shard = substring_dedup._Shard(True)
    words = [b"%d" % (i) for i in range(1_200_040)]
    shard.add(1, words, [(0, 1_200_000, True)])
    (_, _, gone), = shard.located()
    assert not gone.any()


def test_toxic_pairs_are_counted_in_both_classes_by_one_pass(spark):
    texts = [("a b a b c", 1), ("a b c c", 0), ("b a b", 1), ("", 0), ("c a", 1)]
    df = spark.createDataFrame([(t, y) for t, y in texts], "text string, toxic int")
    want, seen = {}, {}
    for text, y in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        _, h, w = toxicity.pairs_of(data, np.array([0, len(data)]))
        for k in zip(h.tolist(), w.tolist(), strict=True):
            want.setdefault(k, [0, 0])[y] += 1
    for (h, w), _ in want.items():
        seen.setdefault(w, set()).add(h)
    rows = toxicity.word_counts(df, 2).collect()
    assert {(p.h, r.w): [p.o, p.t] for r in rows for p in r.pairs} == {k: v for k, v in want.items() if v[1] >= 2}
    assert {r.w: r.c for r in rows} == {w: len(hs) for w, hs in seen.items()}
