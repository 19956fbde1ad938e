"""Each registered query of this subpackage on a written fixture: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from lamina.llm.queries import QUERIES, SQL

SAID = "\\### Assistant: </turn> ok"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, n_words long, fp long"


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def _documents():
    rng = random.Random(4)
    texts = [_words(rng, rng.randint(1, 120)) for _ in range(80)] + ["%%% ||| !!! 999 %%% " * 9] * 10
    texts += [_words(rng, 30) + " idiot scum " + _words(rng, 20) for _ in range(30)]
    texts += [None, "", " \n ", _words(rng, 4000), texts[3], texts[3], texts[4] + " tail"]
    rows = [(i, t, "en", [None, "a", "b"][i % 3], 0, 1, 2.0, 3, 4) for i, t in enumerate(texts)]
    return rows + [(None, texts[5], "en", "a", 0, 1, 2.0, 3, 4), (7, texts[8], "en", "b", 0, 1, 2.0, 3, 4), (7, texts[7], "en", "b", 0, 1, 2.0, 3, 4)]


ROWS = _documents()


def _write(spark, path, empty):
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([] if empty else ROWS, DOCS)
    labels = [] if empty else [(r[0], int("%%%" not in (r[1] or "")), int("idiot" in (r[1] or ""))) for r in ROWS if r[0] is not None]
    x = rng.integers(-8, 8, (260, 6)) / 8
    x[40:48] = x[20]
    vectors = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    vectors += [(20, vectors[20][1], 0), (400, None, 0), (401, [1.0, None], 0), (402, [float("nan")] * 6, 0), (403, [0.0] * 6, 0), (404, [float("inf")] * 6, 0)]
    turns = [(1, 0, "user", SAID), (1, 1, "assistant", SAID), (2, 0, "assistant", None), (3, 0, "user", "#<\\"), (3, 0, "user", "#<\\"), (None, 1, "assistant", "x" * 30000)]
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([] if empty else vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([] if empty else turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("full"), False)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("empty"), True)


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "pipeline"])
def test_queries_of_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert [r.conv_id for r in rows] == ([-7] if name == "op5_chat" else [])


def test_pipeline_of_empty_tables(spark, empty):
    assert QUERIES["pipeline"](spark, empty).count() == 0


def test_pipeline_of_the_fixture(spark, full):
    rows = QUERIES["pipeline"](spark, full).collect()
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 2048
    bad = {r[0] for r in ROWS if r[1] and "%%%" in r[1]}
    assert rows and not bad & {r.doc_id for r in rows}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, full, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{full}/{t}.parquet/*.parquet'")
    out = QUERIES[name](spark, full)
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(out.columns)
    want = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in found.fetchall())
    assert sorted(str([r[c] for c in sorted(names)]) for r in out.collect()) == want


def test_op1_places_every_piece(spark, full):
    rows = QUERIES["op1_packing"](spark, full).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and len(rows) >= len(ROWS)
    assert max(r.length for r in rows) <= 2048 and sum(r.doc_id == 123 for r in rows) > 1


@pytest.mark.parametrize("name, parts, part", [("op2_quality", 4, 2), ("op7_toxicity", 5, 0)])
def test_scores(spark, full, name, parts, part):
    rows = QUERIES[name](spark, full).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= (0.7 if parts == 4 else 0.5))
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == part)


def test_op3_keeps_first_occurrences(spark, full):
    rows = {}
    for r in QUERIES["op3_substring_dedup"](spark, full).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) == len(ROWS)
    text = dict((r[0], r[1]) for r in ROWS[:80])
    assert rows[5][0].n_removed == (len(text[5].split()) if len(text[5].split()) >= 20 else 0)  # a null id comes before all others
    assert rows[20][0].kept_sha256 == hashlib.sha256(" ".join(text[20].split()).encode()).hexdigest()


def test_op4_groups(spark, full):
    rows = QUERIES["op4_simhash"](spark, full).collect()
    assert len(rows) == len(ROWS) and all(len(r.fingerprint) == 16 and int(r.fingerprint, 16) >= 0 for r in rows)
    of = {}
    for r in rows:
        of.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(v) == 1 for v in of.values())
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {120}


def test_op6_meets_targets(spark, full):
    rows = QUERIES["op6_mixing"](spark, full).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    total = {}
    for r in rows:
        total[r.target, r.source_size] = total.get((r.target, r.source_size), 0) + r.taken
    assert all(abs(taken - target) <= 1 for (target, _), taken in total.items()) and len(total) == 3
    assert sorted(map(str, rows)) == sorted(map(str, QUERIES["op6_mixing"](spark, full).collect()))


def test_op9_finds_all_of_few(spark, full):
    rows = QUERIES["op9_nearest"](spark, full).collect()
    assert {r.query_id for r in rows} == set(range(0, 260, 20)) and all(1 <= r["rank"] <= 20 for r in rows)
    assert not {400, 401, 402, 403, 404} & {r.vec_id for r in rows} and all(r.vec_id != r.query_id for r in rows)


def test_op10_keeps_one_of_equal_lines(spark, full):
    rows = QUERIES["op10_line_dedup"](spark, full).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].n_removed == 1  # the row without an id comes first
    assert by_id[3].n_removed == 0 and by_id[124].n_removed == by_id[125].n_removed == 1
