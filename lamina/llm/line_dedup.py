"""Fuzzy line dedup with DataFrame functions only: SimHash, pigeonhole blocks, edit similarity, components.

The distinct words of a normalised line are dealt to B classes by hash, and each class has a SimHash
of its own: a block. One replaced word reaches two blocks at most, so lines that differ in c words
agree in at least B - 2c blocks (pigeonhole), and in a class of many words the majority often
absorbs a change. Lines that agree in a block are candidates; the SimHash over all words and then
the edit distance decide.
"""

from __future__ import annotations

from itertools import combinations
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import small_side, staged, table
from lamina.llm.components import components

#: Distinct words from which on a line has so many classes. Below PAIRED words a block covers two of PAIR_CLASSES classes.
PAIRED, PAIR_CLASSES = 24, 5
BANDS = ((PAIRED, 6), (60, 12), (150, 20), (400, 32))
#: A line is in the neighbouring band too if its words come within these shares of the edge: lines of 0.8 times the words meet.
BELOW, ABOVE = 0.9, 1.125
#: Words that a block covers at least, so that few unlike lines share one: of one class, of a pair, of a pair of a line under TINY words.
LEAST, LEAST_PAIR, LEAST_TINY, TINY = 5, 3, 2, 6
#: Bits of 64 in which the SimHashes of a candidate pair may differ: a fifth of the words replaced makes 13.1 on average.
MAX_BITS = 18
#: Bits of a counter; four of them lie side by side in a long, so 16 longs count 64 bits and 8 the 32 bits of a block.
LANE = 16
#: Words from which on counters might overflow: a lane holds a count and one bit for the comparison below.
LONG = 1 << (LANE - 2)
_ONES = sum(1 << (LANE * i) for i in range(64 // LANE))
BLOCK_LANES = 8
#: Stands for the whole line among its classes.
WHOLE = -1
_BETWEEN = "[^\\p{L}\\p{N}]+"


def normalised(line: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), _BETWEEN, " "))


def _lanes(h: Column, lanes: int) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(_ONES)).alias(f"c{j}") for j in range(lanes)]


def _majority(n: Column, lanes: int = LANE) -> Column:
    """Fingerprint whose bit b is set if over half of the n words have it, from the counters c0 on.

    Adding LONG less the least majority to a counter sets its bit LANE - 2 if it reaches that majority;
    four counters are compared by one addition, and none carries into the next.
    """
    short = (F.lit(LONG) - F.floor(n / 2).cast("long") - 1) * _ONES
    out = F.lit(0).cast("long")
    for j in range(lanes):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(f"c{j}") + short, LANE - 2).bitwiseAND(_ONES), j))
    return out


def _row_key(*columns: str) -> Column:
    """Hash of a row's columns; a null is not taken for the value of a neighbour."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def _once(value: Column) -> Column:
    """The value, worked out once: filters on it are not moved below an explode, where each would work it out anew."""
    return F.explode(F.array(value))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, row, line_no, line and id (its hash) of all lines that are not empty.

    `row` is the row's own key, a column of docs or else made from its doc_id and text.
    """
    if "row" not in docs.columns:
        docs = docs.withColumn("row", _row_key("doc_id", "text"))
    lines = docs.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter("line != ''").withColumn("id", F.xxhash64("line"))


def _bands(words: Column) -> Column:
    """Array of the numbers of classes that a line of so many distinct words uses: one, or two near the edge of a band."""
    edges = [0, *[e for e, _ in BANDS], 1 << 60]
    sizes = [PAIR_CLASSES, *[b for _, b in BANDS]]
    inside = [F.when((words >= int(low * BELOW)) & (words < high * ABOVE), F.lit(b)) for low, high, b in zip(edges[:-1], edges[1:], sizes, strict=True)]
    very_long = F.greatest(F.lit(sizes[-1]), F.ceil(words / (LONG // 64)).cast("int"))  # so that no counter of a class fills
    inside[-1] = F.when(words >= int(edges[-2] * BELOW), very_long)
    return F.array_compact(F.array(*inside))


def _class(h: Column, number: Column) -> Column:
    """Class of a word's hash among `number` classes. The bits used are in no block."""
    return F.pmod(F.shiftrightunsigned(h, 56) * 256 + F.shiftrightunsigned(h, 40).bitwiseAND(255), number).cast("int")


def _covering(own: Column, number: Column) -> Column:
    """The classes whose blocks cover a class: itself, or the pairs that hold it."""
    pairs = list(combinations(range(PAIR_CLASSES), 2))
    table_of = F.array(*[F.array(*[F.lit(i) for i, p in enumerate(pairs) if c in p]) for c in range(PAIR_CLASSES)])
    return F.when((number == PAIR_CLASSES) & (own != WHOLE), F.element_at(table_of, F.greatest(own, F.lit(0)) + 1)).otherwise(F.array(own))


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of the distinct lines with a letter or digit: id, class, code and words; candidates share a class's code.

    The row of class WHOLE, one a line, has the hash of the normal form as code, and times (occurrences).
    Equal lines meet once, with their text, after a partial aggregate; what follows is done
    where they are, without another shuffle. Lines whose two hashes disagree are left out.
    """
    twice = lines_of(docs).withColumn("check", F.xxhash64(F.lit(1), "line"))
    met = twice.groupBy("id").agg(F.first("line").alias("line"), F.count("*").alias("times"), F.min("check").alias("low"), F.max("check").alias("high"))
    # The line is split where its normal form has spaces; what stands before or after its first or last word is empty.
    split = met.filter("low = high").select("id", "times", _once(F.split(F.lower("line"), _BETWEEN)).alias("all"))
    split = split.select("id", "times", F.xxhash64(F.trim(F.array_join("all", " "))).alias("code"), _once(F.array_remove(F.array_distinct("all"), "")).alias("ws"))
    split = split.withColumn("words", F.size("ws")).filter("words > 0")
    # The null at the end of the words makes the row of the whole line.
    every = F.concat("ws", F.array(F.lit(None).cast("string")))
    dealt = split.select("id", "times", "code", "words", F.explode(_bands(F.col("words"))).alias("number"), every.alias("ws"))
    hashed = dealt.select("id", "words", "number", "times", "code", F.explode("ws").alias("w")).withColumn("h", F.when(F.col("w").isNotNull(), F.xxhash64("w")))
    own = F.when(F.col("h").isNull(), WHOLE).otherwise(_class(F.col("h"), F.col("number")))
    key = ["id", "times", "code", "words", "number", "class"]
    # Words are summed by their one class first; the few sums, not the words, go to the pairs.
    summed = hashed.withColumn("class", own).groupBy(*key).agg(F.count("*").alias("n"), *_lanes(F.col("h"), BLOCK_LANES))
    summed = summed.filter((F.col("class") != WHOLE) | (F.col("number") == F.element_at(_bands(F.col("words")), 1)))
    lanes = [f"c{j}" for j in range(BLOCK_LANES)]
    paired = summed.withColumn("class", F.explode(_covering(F.col("class"), F.col("number"))))
    summed = paired.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("n", *lanes)])
    whole = F.col("class") == WHOLE
    least = F.when(F.col("number") != PAIR_CLASSES, LEAST).when(F.col("words") < TINY, LEAST_TINY).otherwise(LEAST_PAIR)
    code = F.when(whole, F.col("code")).otherwise(F.xxhash64("number", "class", _majority(F.col("n"), BLOCK_LANES)))
    return summed.filter(whole | (F.col("n") >= least)).select("id", "class", code.alias("code"), F.when(whole, F.col("words")).alias("words"), F.when(whole, F.col("times")).alias("times"))


def _edits(longest: Column, similarity: float) -> Column:
    """The edits that the similarity allows the longer of two lines."""
    return F.floor(longest * (1 - similarity) + 1e-9).cast("int")


def _near(a: str, b: str, max_bits: int) -> Column:
    return F.coalesce(F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits, F.lit(True))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, norm, size (its length) and bits (SimHash of the distinct words) of the wanted lines (id): found again in the documents by their hash.

    The SimHash of a line that is too long for the counters is null.
    """
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).select("line", F.xxhash64("line").alias("id"))
    found = lines.join(small_side(wanted, 1_000_000), "id", "left_semi").groupBy("id").agg(F.first("line").alias("line"))
    norm = found.select("id", _once(normalised(F.col("line"))).alias("norm"))
    hashed = norm.select("id", "norm", F.explode(F.array_distinct(F.split("norm", " "))).alias("w")).select("id", "norm", F.xxhash64("w").alias("h"))
    return hashed.groupBy("id", "norm").agg(F.count("*").alias("n"), *_lanes(F.col("h"), LANE)).select("id", "norm", F.length("norm").alias("size"), F.when(F.col("n") < LONG, _majority(F.col("n"))).alias("bits"))


def _with_texts(pairs: DataFrame, texts: DataFrame, max_bits: int) -> DataFrame:
    """The pairs (u, v) whose SimHashes are near, with their normal forms s and t."""
    s, t = (texts.select(F.col("id").alias(i), F.col("norm").alias(n), F.col("bits").alias(b)) for i, n, b in (("u", "s", "x"), ("v", "t", "y")))
    return pairs.join(s, "u").join(t, "v").filter(_near("x", "y", max_bits)).select("u", "v", "s", "t")


def _parts(ids: DataFrame, column: str, parts: DataFrame, name: str) -> DataFrame:
    """Adds the group of a line so far; a line without links is its own."""
    of = parts.select(F.col("node").alias(column), F.col("component").alias(name))
    return ids.join(of, column, "left").withColumn(name, F.coalesce(name, column))


def line_groups(docs: DataFrame, made: DataFrame, similarity: float = 0.8, max_bits: int = MAX_BITS) -> DataFrame:
    """node (id) and component of the lines that link to others, from the staged rows of `blocks`.

    Codes are counted first, by sums in each task; a code of two lines is a pair. Under a code of more,
    all lines are compared with one of them, the hub. Pairs that cheap bounds find similar make groups. Then
    come the pairs of lines in different groups: those tried that the bounds left open, and, of the codes
    whose lines are in several groups, those of a line outside the hub's group (a stray) with each line of another
    group. So a large group of copies costs a few stars instead of all its pairs, and each pair of
    lines under a code is either compared or known to be connected.
    """
    keyed = made.filter((F.col("class") != WHOLE) | (F.col("words") <= LEAST_TINY)).select("code", "id")
    # Each code has a hub of its own, so that a group of copies, which shares many codes, has many.
    mark = F.min(F.col("id").bitwiseXOR(F.col("code"))).alias("hub")
    sums = keyed.groupBy("code").agg(F.min("id").alias("u"), F.max("id").alias("v"), F.count("*").alias("n"), mark)
    shared = staged(sums.filter("u < v").withColumn("hub", F.col("hub").bitwiseXOR(F.col("code"))), "line-codes")
    members = staged(keyed.join(small_side(shared.filter("n > 2").select("code", "hub"), 1_000_000), "code"), "line-members")
    stars = members.filter("id != hub").select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v"))
    tried = staged(shared.filter("n = 2").select("u", "v").union(stars).distinct(), "line-pairs")
    close = tried.select(F.col("u").alias("id")).union(tried.select("v")).distinct()
    texts = staged(_texts(docs, close), "line-texts")
    judged = staged(bounded(_with_texts(tried, texts, max_bits), similarity).select("u", "v", "ok"), "line-judged")
    parts = staged(components(judged.filter("ok").select("u", "v"), "line-groups"), "line-parts")

    open_ = _parts(_parts(judged.filter("not ok").select("u", "v"), "u", parts, "p"), "v", parts, "q").filter("p != q")
    parts = _bridged(_similar(open_, texts, similarity, max_bits), parts)

    placed = _parts(members, "id", parts, "part")
    main = placed.filter("id = hub").select("code", F.col("part").alias("main"))
    placed = placed.join(main, "code")
    mixed = placed.filter("part != main").select("code").distinct()
    placed = staged(placed.join(mixed, "code", "left_semi").join(texts.select("id", "size", "bits"), "id"), "line-places")
    across = _across(placed, similarity, max_bits)
    return _bridged(_similar(across, texts, similarity, max_bits), parts)


def _across(placed: DataFrame, similarity: float, max_bits: int) -> DataFrame:
    """The pairs (u, v) of a stray and a line of another group under one code that are near in bits and in length.

    Similar lines are of the same or the next step of length, as a step is a little more than the similarity
    allows. So a code with many lines meets step by step, in several tasks, and not all its lines with all.
    """
    placed = placed.withColumn("step", F.floor(F.log("size") / log(1.01 / similarity)).cast("int"))
    strays = placed.filter("part != main").select("code", "step", F.col("id").alias("u"), F.col("part").alias("p"), F.col("bits").alias("x"), F.col("size").alias("m"))
    other = placed.select("code", F.explode(F.sequence(F.col("step") - 1, F.col("step") + 1)).alias("step"), F.col("id").alias("v"), F.col("part").alias("q"), F.col("bits").alias("y"), F.col("size").alias("n"), (F.col("part") == F.col("main")).alias("first"))
    apart = (F.col("p") != F.col("q")) & (F.col("first") | (F.col("p") < F.col("q")))
    as_long = F.abs(F.col("m") - F.col("n")) <= _edits(F.greatest("m", "n"), similarity)
    keys = (strays["code"] == other["code"]) & (strays["step"] == other["step"])
    return strays.join(other, keys & apart & as_long & _near("x", "y", max_bits)).select("u", "v").distinct()


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float, max_bits: int) -> DataFrame:
    """The pairs (u, v) that are similar, by the bounds or else by the distance itself."""
    found = bounded(_with_texts(pairs.select("u", "v"), texts, max_bits), similarity)
    return staged(found.filter(F.col("ok") | F.expr("levenshtein(s, t, most) >= 0")).select("u", "v"), "line-bridges")


def _bridged(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """The groups (node, component) after these edges too: only groups that the edges bridge are worked on."""
    bridges = _parts(_parts(edges, "u", parts, "p"), "v", parts, "q").select("p", "q").filter("p != q").distinct()
    joined = components(bridges.select(F.col("p").alias("u"), F.col("q").alias("v")), "line-groups")
    lone = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().join(parts, "node", "left_anti")
    nodes = parts.select("node", F.col("component").alias("part")).union(lone.select("node", F.col("node").alias("part")))
    return staged(_parts(nodes, "part", joined, "component").select("node", "component"), "line-parts")


def dropped_lines(docs: DataFrame, similarity: float = 0.8, max_bits: int = MAX_BITS) -> DataFrame:
    """row and line_no of each line that has an earlier occurrence in its connected group.

    Lines link if they are equal, or if they share a block (or, with up to two words, the normal form), the SimHashes of their
    distinct words differ in at most `max_bits` bits and the edit distance of the normal forms is at most
    (1 - similarity) of the longer one. Of each connected group the first occurrence (least doc_id,
    nulls first, then row, then line) stays. Lines without a letter or digit are never dropped. Rows with one
    key have one result here; `dedup_lines` sees to all but the first of them.
    """
    made = staged(blocks(docs), "line-blocks")
    groups = line_groups(docs, made, similarity, max_bits)
    unique = made.filter(F.col("class") == WHOLE).select("id", "times")
    classed = unique.join(groups.select(F.col("node").alias("id"), "component"), "id", "left").filter("times > 1 or component is not null")
    classed = classed.select("id", F.coalesce("component", "id").alias("component"))
    found = staged(lines_of(docs).select("id", "doc_id", "row", "line_no").join(classed, "id").select("component", "doc_id", "row", "line_no"), "line-repeats")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "row", "line_no")).alias("first"))
    return found.join(first, "component").filter("first.row != row or first.line_no != line_no").select("row", "line_no")


#: Characters from which on a line is cut into pieces, and of a piece.
LONG_LINE, PIECE = 2048, 128
#: Places of the distance's table up to which it is worked out at once.
FEW = 20_000
#: Words between two places where lines are cut to be compared piece by piece, at least.
ANCHOR = 4
#: Letters that stand for words when lines are compared word by word.
_ALPHABET = "".join(map(chr, range(0x4E00, 0x5E00)))


def _stripped(pairs: DataFrame) -> DataFrame:
    """The pairs without the words that s and t have in common at their start, then at their end: their distance stays, if both have words left."""
    same = lambda a, b: F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    others = [c for c in pairs.columns if c not in ("s", "t")]
    out = pairs.select(*others, F.split("s", " ").alias("s"), F.split("t", " ").alias("t"))
    for _ in range(2):  # what is left after the start is turned round, and so is what is left after the end
        out = out.select(*others, "s", "t", _once(same("s", "t")).alias("at"))
        left = lambda c: F.when(F.col("at") == 0, F.slice(c, 1, 0)).otherwise(F.slice(c, F.greatest(F.col("at"), F.lit(1)).cast("int"), F.size(c)))
        out = out.select(*others, _once(F.reverse(left("s"))).alias("s"), _once(F.reverse(left("t"))).alias("t"))
    return out.select(*others, _once(F.array_join("s", " ")).alias("s"), _once(F.array_join("t", " ")).alias("t"))


def _anchored(a: str, b: str) -> Column:
    """Upper bound of the distance of two lines, given as arrays of words: the sum over the pieces between words where both go on alike.

    A word of `a` is such a place if it comes first there, the one after it is the same in both, and
    it stands about as far after the last such place in both.
    """
    word = lambda c, i: F.try_element_at(c, i.cast("int"))

    def piece(state: Column, i: Column, j: Column) -> Column:
        s = F.array_join(F.slice(a, state["i"], i - state["i"]), " ")
        t = F.array_join(F.slice(b, state["j"], j - state["j"]), " ")
        return state["cost"] + F.levenshtein(s, t) + F.when((s == "") != (t == ""), 1).otherwise(0)

    def met(state: Column, i: Column) -> Column:
        j = F.array_position(b, word(a, i)).cast("int")
        step, shift = i - state["i"], F.abs((j - state["j"]) - (i - state["i"]))
        fits = (step >= ANCHOR) & (j > state["j"]) & (shift <= ANCHOR + F.floor(step / 2)) & word(a, i + 1).eqNullSafe(word(b, j + 1)) & (F.array_position(a, word(a, i)) == i)
        return F.when(fits, F.struct(i.alias("i"), j.alias("j"), piece(state, i, j).cast("int").alias("cost"))).otherwise(state)

    start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(0).alias("cost"))
    return F.aggregate(F.sequence(F.lit(1), F.size(a)), start, met, lambda state: piece(state, F.size(a) + 1, F.size(b) + 1))


def bounded(pairs: DataFrame, similarity: float) -> DataFrame:
    """Adds most (the edits that the similarity allows) and ok (whether it is kept to); pairs too unlike go, those that are dear to tell stay with ok false.

    The words that s and t have in common at their start or end go first. The distance of what is left is
    taken at once if it is short; else it takes that length squared, and cheap upper bounds may tell. Words that differ at one place cost at most the longer
    of the two each, words beyond the end of the other line their length and a space. Else words stand
    for letters: each of the edits by words costs at most the longest word and a space, or, if all of
    them put a word that the other line lacks for one that it lacks, the longest of those. Long lines are also cut
    into equally many pieces, which together are at least as far apart.
    """
    longest = F.greatest(F.length("s"), F.length("t"))
    cost = lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(F.greatest(F.length(x), F.length(y)) + 1)
    placed = F.aggregate(F.zip_with(F.split("s", " "), F.split("t", " "), cost), F.lit(0), lambda acc, v: acc + v)
    near = pairs.withColumn("most", _edits(longest, similarity)).filter(F.abs(F.length("s") - F.length("t")) <= F.col("most"))
    # With nothing left of one line the other has words more and no others.
    gone = (F.col("s") == "") | (F.col("t") == "")
    few = F.length("s").cast("long") * F.least(F.length("t"), 2 * F.col("most") + 1) <= FEW
    said = F.when(gone, True).when(few, F.expr("levenshtein(s, t, most) >= 0")).when(placed <= F.col("most"), True)
    told = _stripped(near).select("*", _once(F.struct(said.alias("ok"))).alias("told")).select("*", "told.ok").drop("told").filter("ok is null or ok")
    told = told.select("*", _once(F.when(F.col("ok").isNull(), F.struct(F.split("s", " ").alias("a"), F.split("t", " ").alias("b")))).alias("ws"))
    told = told.select(*pairs.columns, "most", _once(F.when(F.col("ok"), True).otherwise(_anchored("ws.a", "ws.b") <= F.col("most"))).alias("ok"))
    open_ = ~F.col("ok")
    hashes = lambda c: F.transform(F.split(c, " "), lambda w: F.xxhash64(w))
    told = told.select("*", _once(F.when(open_, F.struct(hashes("s").alias("a"), hashes("t").alias("b")))).alias("h"))
    told = told.select("*", _once(F.when(open_, F.array_distinct(F.concat("h.a", "h.b")))).alias("all"))
    letters = F.split(F.lit(_ALPHABET), "")
    spelled = lambda c: F.array_join(F.transform(c, lambda x: F.element_at(letters, F.array_position("all", x).cast("int"))), "")
    told = told.select("*", _once(F.when(open_ & (F.size("all") <= len(_ALPHABET)), F.struct(spelled("h.a").alias("a"), spelled("h.b").alias("b")))).alias("w"))
    told = told.withColumn("edits", F.expr("levenshtein(w.a, w.b, cast(most / 2 as int))"))
    lone = lambda a, b: F.length(F.call_function("translate", a, b, F.lit("")))
    swapped = (lone(F.col("w.a"), F.col("w.b")) == F.col("edits")) & (lone(F.col("w.b"), F.col("w.a")) == F.col("edits"))
    size = lambda words: F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0))
    s, t = F.split("s", " "), F.split("t", " ")
    word = F.when(swapped, F.greatest(size(F.array_except(s, t)), size(F.array_except(t, s)))).otherwise(F.greatest(size(s), size(t)) + 1)
    by_words = (F.col("edits") >= 0) & (F.col("edits") * word <= F.col("most"))
    pieces = F.ceil(longest / PIECE)

    def cut(c: str, i: Column) -> Column:
        at = lambda k: F.floor(F.length(c) * k / pieces)
        return F.substring(c, (at(i) + 1).cast("int"), (at(i + 1) - at(i)).cast("int"))

    parted = F.aggregate(F.sequence(F.lit(0).cast("long"), pieces - 1), F.lit(0), lambda total, i: total + F.levenshtein(cut("s", i), cut("t", i)))
    ok = F.when(F.col("ok") | F.coalesce(by_words, F.lit(False)), True).otherwise((longest > LONG_LINE) & (parted <= F.col("most")))
    return told.select("u", "v", "s", "t", "most", ok.alias("ok"))


def dedup_lines(docs: DataFrame, similarity: float = 0.8, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents without repeated lines, with n_lines and n_removed; other columns as they were.

    Lines are parted by \\n. Lines without a letter or digit stay. Null text stays null with no lines;
    a document may lose all its lines, its text is then empty; an empty table gives an empty one.
    Columns n_lines and n_removed of the input are replaced. A row is told from others by all its
    columns, so null and repeated doc_ids need no care; of rows that agree in all, the first is
    treated as the only one, and the others lose every line with a letter or digit.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc"), _row_key(*[f"`{c}`" for c in own]).alias("row"))
    plain = whole.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), "row")
    gone = dropped_lines(plain, similarity, max_bits).groupBy("row").agg(F.collect_set("line_no").alias("gone"))
    equal = staged(whole.groupBy("row").agg(F.count("*").alias("times")).filter("times > 1"), "equal-rows")
    joined = whole.join(gone, "row", "left")
    if not equal.isEmpty():
        again = joined.join(equal, "row").dropDuplicates(["row"]).select("doc", "row", "gone", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("nth"))
        every = F.array_compact(F.transform(F.split("doc.text", "\n"), lambda x, i: F.when(normalised(x) != "", i)))
        again = again.select("row", "doc", F.when(F.col("nth") == 1, F.col("gone")).otherwise(every).alias("gone"))
        joined = joined.join(equal, "row", "left_anti").select("row", "doc", "gone").unionByName(again)
    cut = joined.select("doc", "gone", _once(F.split("doc.text", "\n")).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at("lines", i + 1)), "\n"))
    kept = [text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in own]
    n_lines = F.when(F.col("doc.text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    return cut.select(*kept, n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents: doc_id, n_lines, n_removed and the hash of what `dedup_lines` leaves; a null text hashes as empty."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
