"""Mixing sources to target weights: hypergeometric splitting tree over permuted blocks, DataFrame functions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import SPACE, staged, table

BLOCKS = 256
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a table of blocks or sources up to which it is broadcast: some 50 bytes each.
SMALL = 200_000


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def targets(sizes: list[tuple[str | None, int]], share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> list[tuple[str | None, int, float]]:
    """(source, size, target): `share` of all words by weight, none above `most` times its size.

    Sources come in code point order, null last, and take the weights in turn. What a capped source
    cannot take is shared again among the others by weight until none is above its cap.
    """
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(ordered))]
    open_, target, rest = set(range(len(ordered))), [0.0] * len(ordered), share * sum(n for _, n in ordered)
    while open_:
        unit = rest / sum(weight[i] for i in open_)
        over = [i for i in open_ if unit * weight[i] >= most * ordered[i][1]]
        if not over:
            for i in open_:
                target[i] = unit * weight[i]
            break
        for i in over:
            target[i] = most * ordered[i][1]
            rest -= target[i]
            open_.discard(i)
        rest = max(rest, 0.0)
    return [(s, n, t) for (s, n), t in zip(ordered, target, strict=True)]


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard, shape (shards, sources): draws that use each quota exactly.

    A node splits its quotas between two halves of its shards: the left half gets its share of all
    blocks, drawn without replacement, so the counts of its sources are multivariate hypergeometric.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        low, high, have = todo.pop()
        if high - low == 1:
            out[low] = have
            continue
        mid = (low + high) // 2
        draw = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(have, int(have.sum()) * (mid - low) // (high - low), method="marginals") if len(have) else have
        todo += [(low, mid, draw), (mid, high, have - draw)]
    return out


def _hash(seed: int, *columns: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def mix(docs: DataFrame, shards: int = 8, seed: int = 7, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, max_sources: int = 100_000) -> DataFrame:
    """Rows of the mix: doc_id, source, size, source_size, target, epoch, taken (words of this draw), shard, place.

    `docs` has doc_id, source and text. The mix passes over each source at most ceil(most) times. An
    epoch of a source is cut into 256 blocks of documents by hash, in random order; its quota is the number
    of blocks that reach its target. The splitting tree gives each shard its number of blocks of
    each source, exactly as many as the quotas, and a shard draws its own, disjoint range of the
    permuted blocks; within a shard `place` is a random order. The block in which a target ends is
    cut into parts by another hash, then into documents in hash order, and of the last document only the missing
    words are taken. Reruns draw the same. Null text has size 0; documents of size 0 are never
    drawn; a null source is a source. Repeated rows count each. Only one row per source comes to the
    driver (an error above `max_sources`); an empty table gives no rows.
    """
    sized, wanted = _sized(docs, share, most, weights, max_sources)
    drawn = _drawn(sized, wanted, shards, seed, int(np.ceil(most)))
    return _named(drawn, wanted).select("doc_id", "source", "size", "source_size", "target", "epoch", "taken", "shard", "place")


def _sized(docs: DataFrame, share: float, most: float, weights: tuple[float, ...], max_sources: int) -> tuple[DataFrame, list]:
    """rid (a number of the row, fixed by writing it), doc_id, source and size of all rows; targets of the sources."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"))
    sized = staged(rows, "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(max_sources + 1).collect()
    if len(per_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    return sized, targets([tuple(r) for r in per_source], share, most, weights)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only if the known bound of its rows is small."""
    return F.broadcast(df) if rows <= SMALL else df


def _named(rows: DataFrame, wanted: list) -> DataFrame:
    """Puts source, source_size and target for the source's number."""
    plan = rows.sparkSession.createDataFrame([(i, s, n, t) for i, (s, n, t) in enumerate(wanted)], "si int, source string, source_size long, target double")
    return rows.join(_small(plan, len(wanted)), "si")


def _drawn(sized: DataFrame, wanted: list, shards: int, seed: int, epochs: int) -> DataFrame:
    """Rows (rid, doc_id, si, size, epoch, block, shard, taken, place) with taken > 0; si is the number of the source."""
    spark = sized.sparkSession
    quota = [(s, i, e, min(n, round(t) - e * n)) for i, (s, n, t) in enumerate(wanted) for e in range(epochs) if round(t) > e * n]
    quotas = spark.createDataFrame(quota, "s string, si int, epoch int, quota long")
    rows = sized.filter("size > 0").join(_small(quotas, len(quota)), F.col("source").eqNullSafe(F.col("s"))).drop("source", "s")
    rows = rows.withColumn("block", F.pmod(_hash(seed, "epoch", F.lit("block"), "doc_id"), F.lit(BLOCKS)).cast("int"))
    front = staged(_reached(rows, ["si", "epoch"], "block", seed), "blocks")
    dealt = _dealt(front, len(wanted), shards, seed)
    drawn = rows.drop("quota").join(_small(dealt, len(quota) * BLOCKS), ["si", "epoch", "block"])
    whole = drawn.filter("quota >= words").withColumn("taken", F.col("size"))
    # The block in which a source's target ends is cut once more, by another hash.
    inner = drawn.filter("quota < words").drop("words").withColumn("part", F.pmod(_hash(seed, "epoch", F.lit("part"), "doc_id"), F.lit(BLOCKS)).cast("int"))
    fine = _reached(inner, ["si", "epoch", "block"], "part", seed).drop("words")
    inner = inner.drop("quota").join(_small(fine, len(quota) * BLOCKS), ["si", "epoch", "block", "part"])
    order = Window.partitionBy("si", "epoch", "block", "part").orderBy(_hash(seed, "epoch", F.lit("doc"), "doc_id"), "doc_id", "size", "rid")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = inner.withColumn("taken", F.least("size", F.greatest(F.lit(0), F.col("quota") - before)))
    columns = ["rid", "doc_id", "si", "size", "epoch", "block", "shard", "taken"]
    both = whole.select(columns).union(cut.select(columns)).filter("taken > 0")
    return both.withColumn("place", _hash(seed, "epoch", F.lit("place"), "doc_id"))


def _reached(rows: DataFrame, keys: list[str], block: str, seed: int) -> DataFrame:
    """Blocks up to the quota in permuted order: their words, and what is left of the quota when they come."""
    sums = rows.groupBy(*keys, block).agg(F.sum("size").alias("words"), F.max("quota").alias("all"))
    order = Window.partitionBy(*keys).orderBy(_hash(seed, "epoch", F.lit(f"order of {block}"), block), block)
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*keys, block, "words", (F.col("all") - before).alias("quota")).filter("quota > 0")


def _dealt(front: DataFrame, sources: int, shards: int, seed: int) -> DataFrame:
    """The blocks within the quotas with the shard that draws each: a shard has a range of a source's permuted blocks, as long as the tree says."""
    have = np.zeros(sources, np.int64)
    for i, n in front.groupBy("si").count().collect():
        have[i] = n
    ends = splitting_tree(have, shards, seed).cumsum(0)
    deals = [(i, int(ends[k - 1, i]) if k else 0, int(ends[k, i]), k) for i in range(sources) for k in range(shards)]
    deal = front.sparkSession.createDataFrame(deals, "si int, low long, high long, shard int").filter("high > low")
    order = Window.partitionBy("si").orderBy(_hash(seed, "epoch", F.lit("deal"), "block"), "epoch", "block")
    ranked = front.withColumn("nth", F.row_number().over(order) - 1)
    return ranked.join(_small(deal, len(deals)), "si").filter("nth >= low and nth < high").select("si", "epoch", "block", "words", "quota", "shard")


def taken_by_document(docs: DataFrame, shards: int = 8, seed: int = 7, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, max_sources: int = 100_000) -> DataFrame:
    """doc_id, size, source_size, target and taken (sum of what the shards drew of it) of every row, drawn or not."""
    sized, wanted = _sized(docs, share, most, weights, max_sources)
    drawn = _drawn(sized, wanted, shards, seed, int(np.ceil(most))).groupBy("rid").agg(F.sum("taken").alias("taken"))
    plan = docs.sparkSession.createDataFrame([(s, n, t) for s, n, t in wanted], "p string, source_size long, target double")
    out = sized.join(_small(plan, len(wanted)), F.col("source").eqNullSafe(F.col("p"))).join(drawn, "rid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by the given weights: what it takes of each row, null texts and ids included."""
    return taken_by_document(table(spark, sf_dir, "documents"))
