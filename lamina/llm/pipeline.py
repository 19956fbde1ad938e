"""From raw documents to packed sequences: quality, lines, near duplicates, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import staged
from lamina.llm.line_dedup import dedup_lines
from lamina.llm.mixing import mix
from lamina.llm.packing import pack_documents
from lamina.llm.quality import keep_good, quality_model
from lamina.llm.shingle_dedup import keep_one

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Rows are judged one by one, so null and repeated ids need no care; null and empty texts are judged
    by their zero features, and an empty table gives an empty one.
    """
    return keep_good(docs, quality_model(spark, sf_dir, docs)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that say about the same, the first stays; a document may be left empty.

    Null text stays null; of rows equal in all columns the first alone keeps its lines; empty in, empty out.
    """
    return _as_documents(dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose members are linked by a Jaccard similarity of 0.8 of their 5-word shingles.

    Pairs come from op4's SimHash grid first, then from MinHash bands, as two bits are far closer than 0.8.

    Texts without a word, null ones included, are copies of each other. Null and repeated ids need no
    care, of rows equal in id and text one stays, and an empty table gives an empty one.
    """
    return keep_one(docs, shingle=5, similarity=0.8).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each draw of a document is a row, with its whole text.

    Where a source's target ends inside a document, that one is drawn if at least half of it is due: a
    source ends within half a document of its target. Rows are drawn by a hash of all their columns,
    so null and repeated doc_ids need no care; rows that agree in all come once for each draw of one.
    Documents without a word are never drawn; an empty table gives an empty one.
    """
    keyed = docs.withColumn("_row", F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]))
    draws = mix(keyed.select(F.col("_row").alias("doc_id"), "source", "text")).filter(F.col("taken") * 2 >= F.col("size"))
    rows = keyed.dropDuplicates(["_row"]).join(draws.select(F.col("doc_id").alias("_row")), "_row")
    return _as_documents(rows)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows of the mixture with their places; null and empty texts are their end token alone."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]

#: SQL cannot train a model, hash words to fingerprints or run a tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all of `documents`, each written to the shared scratch folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
