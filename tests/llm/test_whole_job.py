"""What the operators promise beyond their first tests: near copies at the stated similarity, null and repeated ids."""

import collections
import hashlib
import random

import numpy as np

from lamina.llm import line_dedup, mixing, substring_dedup
from lamina.llm import pipeline as corpus_pipeline
from lamina.llm.approximate_search import nearest
from lamina.llm.exact_search import top_k

WORDS = [f"w{i}" for i in range(3000)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).repartition(3)


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_duplicate_stage_matches_brute_force_jaccard(spark):
    rng = random.Random(5)
    texts = []
    for length in (8, 40, 200, 200, 200, 600):
        base = [rng.choice(WORDS) for _ in range(length)]
        texts.append(" ".join(base))
        for changes in (1, 1, 2, 3, 4, 5, 8, 12):  # similarities on both sides of 0.8
            copy = list(base)
            for i in rng.sample(range(length), min(length, changes)):
                copy[i] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    texts += ["", " \n", "One two", "one  TWO", "three"]
    sets, group, close = [_shingles(t) for t in texts], list(range(len(texts))), 0
    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if len(s & t) >= 0.8 * len(s | t):
                close += 1
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    out = corpus_pipeline.near_duplicates(spark, _docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), "").collect()
    assert sorted(r.doc_id for r in out) == sorted(set(group)) and close > 40 and len(out) < len(texts) - 10


def test_near_duplicate_stage_tells_rows_of_one_id_apart(spark):
    same = " ".join(WORDS[:50])
    rows = [(None, same, "a"), (None, same, "a"), (7, same, "a"), (7, "another text altogether", "a"), (None, "a third one", "a"), (None, "a third one", "a"), (3, None, "a")]
    out = corpus_pipeline.near_duplicates(spark, _docs(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted([(7, same), (7, "another text altogether"), (0, "a third one"), (3, "")])


def _repeated_vectors(n=200, times=40):
    """Ids below n of one row, 300 with equal rows and 301 with different ones, both ahead of all others."""
    rng = np.random.default_rng(9)
    rows = [(i, [int(v) for v in rng.integers(1, 40, 6)]) for i in range(n)]
    rows += [(300, [90] * 6)] * times + [(301, [60 + i, 60, 60, 60, 60, 60]) for i in range(times)]
    queries = [r for r in rows if r[0] % 20 == 0]
    want = {}
    for q, v in queries:
        best = {}
        for i, x in rows:
            if i != q:
                score = sum(a * b for a, b in zip(v, x, strict=True))
                best[i] = max(best.get(i, score), score)
        want[q] = sorted(best.items(), key=lambda b: (-b[1], b[0]))
    return rows, queries, want


def test_exact_search_counts_repeated_rows_once(spark):
    rows, queries, want = _repeated_vectors()
    data, asked = (spark.createDataFrame(r, "vec_id long, v array<long>") for r in (rows, [q for q in queries if q[0] < 300]))
    got = {}
    for r in sorted(top_k(data, asked, 5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: w[:5] for q, w in want.items() if q < 300}


def test_nearest_counts_repeated_rows_once(spark):
    rows, queries, want = _repeated_vectors(22, 20)  # few enough for one leaf
    data, asked = (spark.createDataFrame([(i, [float(x) for x in v]) for i, v in r], "vec_id long, v array<double>") for r in (rows, [q for q in queries if q[0] < 300]))
    got = {}
    for r in sorted(nearest(data, asked, 20).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: w[:20] for q, w in want.items() if q < 300}


def test_substring_dedup_of_null_and_repeated_ids(spark):
    rng = random.Random(11)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    passages = [text(30) for _ in range(4)]
    rows = []
    for i in (None, None, None, None, 4, 4, 4, 9, 9, 12):  # the passages at other places in texts of other lengths
        some = [text(rng.randint(0, 300)) + rng.choice(passages)[rng.randint(0, 4) :] for _ in range(rng.randint(1, 3))]
        rows.append((i, " ".join(w for part in some for w in part + text(rng.randint(0, 9)))))
    rows += [(None, " ".join(passages[0])), (None, " ".join(passages[0])), (4, None), (12, rows[-1][1])]
    first = {}  # least id of each window; null comes first
    split = [((-1 if i is None else i), (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for at in range(len(words) - 19):
            window = tuple(words[at : at + 20])
            first[window] = min(first.get(window, i), i)
    want = []
    for i, words in split:
        gone, seen = [False] * len(words), set()
        for at in range(len(words) - 19):
            window = tuple(words[at : at + 20])
            if first[window] < i or window in seen:
                gone[at : at + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_passages(docs).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 200


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    said = "a line that several documents hold word for word"
    own = [f"only here {WORDS[9 * i]} {WORDS[9 * i + 1]} {WORDS[9 * i + 2]}" for i in range(8)]
    rows = [(None, f"{own[0]}\n{own[1]}"), (None, f"{own[2]}\n{said}"), (None, f"{own[3]}\n{own[4]}"), (5, f"{own[5]}\n{said}"), (5, f"{own[6]}\n{own[7]}")]
    rows += [(6, f"{said}\n---\nso {WORDS[100]} is {WORDS[101]}")] * 3 + [(7, None), (7, None), (7, "")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, rows[0][1], 0), (None, rows[1][1], 0), (None, rows[2][1], 0), (5, own[5], 1), (5, rows[4][1], 0)]
    want += [(6, f"---\nso {WORDS[100]} is {WORDS[101]}", 1), (6, "---", 2), (6, "---", 2), (7, None, 0), (7, None, 0), (7, "", 0)]
    assert sorted((str(r.doc_id), str(r.text), r.n_removed) for r in out) == sorted((str(i), str(t), n) for i, t, n in want)


def test_mixture_stage_takes_whole_rows_of_null_and_repeated_ids(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        text = "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 12)))
        rows.append((rng.choice([None, 5, i]), text, rng.choice(["a", "b", "c"])))
    rows += [rows[0]] * 3  # equal rows
    words = lambda t: len(t.split())
    plan = mixing.targets([(s, sum(words(t) for _, t, x in rows if x == s)) for s in "abc"])
    out = corpus_pipeline.mixture(spark, _docs(spark, rows), "").collect()
    assert {(r.doc_id, r.text, r.source) for r in out} <= set(rows)
    longest = max(words(t) for _, t, _ in rows)
    for source, _, target in plan:
        assert abs(sum(words(r.text) for r in out if r.source == source) - target) <= longest / 2 + 1
    times = collections.Counter((r.doc_id, r.text, r.source) for r in out)
    assert all(n <= 2 * rows.count(r) for r, n in times.items())


def test_near_duplicate_stage_proposes_all_pairs_of_near_fingerprints(spark):
    from lamina.llm import shingle_dedup, simhash_dedup

    rng = random.Random(8)
    long = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    texts = [" ".join([*long[:k], "zz", *long[k + 1 :]]) for k in (5, 900, 3000)] + [" ".join(long), " ".join(long).upper(), "one two three", None, ""]
    df = _docs(spark, [(i, t, "a") for i, t in enumerate(texts)])
    node = {r.n: r.text for r in df.selectExpr("xxhash64(coalesce(text, '')) AS n", "text").collect()}
    prints = {n: simhash_dedup.fingerprint((t or "").encode(), 5) for n, t in node.items()}
    close = {frozenset((a, b)) for a in node for b in node if a != b and (prints[a] ^ prints[b]).bit_count() <= 2}
    pairs = shingle_dedup.simhash_pairs(df, 5, 2)
    linked = {frozenset((r.u, r.v)) for r in pairs.collect()}
    assert linked and linked <= close
    group = {r.node: r.component for r in shingle_dedup.components(pairs, "test").collect()}
    assert all(group[a] == group[b] for a, b in map(tuple, close))
