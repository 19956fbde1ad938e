import random

from pyspark.sql import functions as F

from lamina.llm import line_dedup


def _words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def test_bounds_tell_scattered_changes_and_moved_ends(spark):
    rng = random.Random(5)
    pairs = []
    for n in (150, 1000):
        base = _words(rng, n)
        other = [w if i % 9 else x for i, (w, x) in enumerate(zip(base, _words(rng, n), strict=True))]
        pairs += [(base, other), (base, _words(rng, n // 20) + other), (base, other[: n // 2] + other[n // 2 + 6 :]), (base, base[n // 3 :] + _words(rng, n // 3)), (base, _words(rng, n))]
    base = _words(rng, 60)
    pairs += [(base, base[:-1]), (base[1:], base), (base, base[:30] + base[31:]), (base, base), (base, [*base, "x"]), (["ab", "ab"], ["ab"] * 9)]
    df = spark.createDataFrame([(i, 0, " ".join(s), " ".join(t)) for i, (s, t) in enumerate(pairs)], "u long, v long, s string, t string")
    most = "cast(floor(greatest(length(s), length(t)) * 0.2 + 1e-9) as int)"
    near = {r.u for r in df.filter(f"levenshtein(s, t) <= {most}").collect()}
    told = line_dedup.bounded(df, 0.8)
    judged = {r.u: r.ok for r in told.collect()}
    assert {u for u, ok in judged.items() if ok} <= near <= set(judged)
    assert near == {0, 1, 2, 5, 6, 7, 10, 11, 12, 13, 14} and all(judged[u] for u in near)
    assert {r.u for r in told.filter(F.col("ok") | F.expr("levenshtein(s, t, most) >= 0")).collect()} == near


def test_strays_meet_lines_of_similar_length_alone(spark):
    rng = random.Random(6)
    sizes = [1, 4, 5, 400, 399, 499, 500, 501, 625, *[rng.randint(1, 3000) for _ in range(200)]]
    rows = [(7, i, i % 40, 0, size, 0) for i, size in enumerate(sizes)]
    placed = spark.createDataFrame(rows, "code long, id long, part long, main long, size int, bits long")
    got = {frozenset((r.u, r.v)) for r in line_dedup._across(placed, 0.8, 18).collect()}
    as_long = lambda a, b: abs(a - b) <= int(max(a, b) * (1 - 0.8) + 1e-9)
    want = {frozenset((i, j)) for i in range(len(sizes)) for j in range(i) if i % 40 != j % 40 and as_long(sizes[i], sizes[j])}
    assert got == want and frozenset((3, 6)) in got


def test_words_are_summed_before_they_go_to_pairs(spark):
    docs = spark.createDataFrame([(1, "--one two, three four FIVE six seven eight--\n" + " ".join(f"w{i}" for i in range(22)))], "doc_id long, text string")
    made = line_dedup.blocks(docs)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    words = [x for x in plan.split("\n") if "Generate explode" in x or "Aggregate" in x]
    # From the scan upwards (last line first) the words are exploded, then summed, and only then dealt to pairs.
    kinds = ["Aggregate" if "Aggregate" in x else "Generate" for x in words]
    assert kinds[0] == "Aggregate" and "Generate" in kinds[1 : kinds.index("Aggregate", 1)]
    assert made.filter(F.col("class") == line_dedup.WHOLE).count() == 2
