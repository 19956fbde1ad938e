"""Conversation repair against a search that keeps all strings, and by all cases a table can bring."""

import random
import re
import time
from itertools import product

import pytest

from lamina.llm.turn_repair import DELETE, Repairer, digested, faulty, repaired

SCHEMA = "conv_id long, turn long, role string, text string, n long, edit string, gaps long"


def _plain(rows):
    """Least (cost, edits) of rows (initial, must_go, cut) by keeping every state's whole string."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def inserted(best):
        for _ in range(3):
            for q, to in ((0, 2), (1, 2), (3, 2), (2, 3)):
                if q in best:
                    best[to] = min(best.get(to, (10**9, "")), (best[q][0] + 5, best[q][1] + "I"))
        return best

    best = inserted({0: (0, "")})
    for c, must_go, cut in rows:
        new = {}
        for q, (cost, text) in best.items():
            offers = [(q, cost + 2, "D")]
            if not must_go:
                offers.append((3 if q == 2 else 2, cost + 1 + 5 * cut, "R"))
                if (q, c) in after:
                    offers.append((after[q, c], cost + 5 * cut, "K"))
            for to, k, e in offers:
                new[to] = min(new.get(to, (10**9, "")), (k, text + e))
        best = inserted(new)
    return min(best[q] for q in (0, 3) if q in best)


def _run(rows):
    work, edits, most = Repairer(), [], 0
    for c, must_go, cut in rows:
        edits += work.add({"s": "system", "u": "user", "a": "assistant"}.get(c, c), "t", must_go, cut)
        most = max(most, work.unresolved())
    cost, rest = work.close()
    edits += rest
    return (cost, "".join(e * n for e, _, _, n in edits)), edits, most


def test_all_short_conversations():
    kinds = [(c, m, t) for c, m, t in product("suax", (False, True), (False, True)) if not (m and t)]
    for n in range(4):
        for rows in product(kinds, repeat=n):
            assert _run(rows)[0] == _plain(rows)


@pytest.mark.parametrize("seed", range(12))
def test_long_conversations_stay_small_in_memory(seed):
    rng = random.Random(seed)
    roles = rng.choice(["ua", "sua", "uuua", "aaau", "suax", "x"])
    rows = [(rng.choice(roles), rng.random() < 0.1, rng.random() < 0.1) for _ in range(1500)]
    got, edits, most = _run(rows)
    assert got == _plain(rows)
    assert most < 200
    made = "".join(r[:1] for e, r, _, _ in edits if e != DELETE)
    assert re.fullmatch("(s?(ua)+)?", made)


def test_open_ties_take_time_in_proportion():
    """Users alone: whether the first goes depends on how many follow, so all stays open; each tie is decided in a few steps."""
    n = 60_001
    began = time.time()
    cost, edits = _run([("u", False, False)] * n)[0]
    assert (cost, edits) == (n // 2 + 2, "D" + "KR" * (n // 2)) and time.time() - began < 30
    assert _run([("u", False, False)] * 301)[0] == _plain([("u", False, False)] * 301)
    assert _run([("u", False, False), ("a", False, False)] * 3000)[2] < 40


def test_rows_of_every_kind(spark):
    rows = [
        (1, 0, "user", "Hi?"), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 3, "assistant", "Yes."),
        (2, None, "system", "Be kind."), (2, 5, None, None), (2, 6, "user", " \t\n"), (2, 9, "user", "cut off"),
        (None, 1, "user", "x" * 200000 + "."), (None, 2, "assistant", "é."),
        (4, None, "assistant", "!"), (4, None, "assistant", "!"),
    ]
    turns = spark.createDataFrame([(*r, 7, "edit", 9) for r in rows], SCHEMA)
    ids = spark.createDataFrame([(1,), (5,), (None,)], "conv_id long")
    got = {r.conv_id: r for r in digested(repaired(turns, ids)).collect()}
    assert set(got) == {1, 2, None, 4, 5}
    assert (got[1].audit, got[1].cost, got[1].duplicate, got[1].gaps, got[1].illegal) == ("KKDD", 4, 2, 1, 2)
    assert (got[2].blank, got[2].truncated, got[2].gaps, got[2].illegal, got[2].audit) == (2, 1, 2, 3, "DDDD")
    assert (got[None].audit, got[None].cost) == ("KK", 0)
    assert (got[4].audit, got[4].gaps, got[4].duplicate) == ("DD", 0, 1)
    assert got[5].repaired_sha256.startswith("e3b0c442") and got[5].audit == "" and got[5].cost == 0
    edits = repaired(turns, ids).filter("edit is not null").collect()
    assert sum(r.times for r in edits) == len(rows)
    assert faulty(turns).filter("n > 1").count() == 2


def test_empty_table(spark):
    assert digested(repaired(spark.createDataFrame([], SCHEMA))).count() == 0
