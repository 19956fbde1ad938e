"""Chat formatting by prefix-target expansion, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import table

#: Marks around a turn. Neither `#` nor `<` is left bare inside a text or role.
OPEN, CLOSE = "### ", " </turn>\n"


def escaped(text: Column) -> Column:
    """Backslash before each backslash, `#` and `<`: no mark can then occur inside a text."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#")), F.lit("<"), F.lit("\\<"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit(":"), F.lit("\\:")), F.lit(": "))


def examples(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One row for each turn of the target role: conv_id, example, text, mask_start and mask_length.

    `turns` has conv_id, turn, role and text. The text holds all earlier turns and the reply; only the
    reply (code points mask_start, from 0, for mask_length) is trainable. A conversation that does not
    end with a reply has one more example, of all its turns with nothing trainable, so that no turn
    is lost. Rows come in the order of turn, then role, then text, nulls first; null role and text
    count as empty. A null conv_id is a conversation; repeated rows are turns each; an empty table gives no
    examples. Other columns are not carried.
    """
    clean = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    made = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(_head(t["role"]), escaped(t["text"]), F.lit(CLOSE))).alias("parts"),
        F.transform("turns", lambda t: F.length(escaped(t["text"]))).alias("sizes"),
        F.filter(F.transform("turns", lambda t, i: F.when((t["role"] == target_role) | (i == F.size("turns") - 1), F.struct(i.alias("at"), (t["role"] == target_role).alias("reply")))), lambda x: x.isNotNull()).alias("targets"),
    )
    each = made.select("conv_id", "parts", "sizes", F.posexplode("targets").alias("example", "target"))
    text = F.array_join(F.slice("parts", F.lit(1), F.col("target.at") + 1), "")
    size = F.when(F.col("target.reply"), F.element_at("sizes", F.col("target.at") + 1)).otherwise(F.lit(0))
    return each.select("conv_id", "example", text.alias("text"), size.alias("mask_length")).select("conv_id", "example", "text", (F.length("text") - len(CLOSE) - F.col("mask_length")).alias("mask_start"), "mask_length")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: its turns (role, text), and the trainable texts in order."""
    trained = F.when(F.col("mask_length") > 0, unescaped(F.substring("text", F.col("mask_start") + 1, F.col("mask_length")))).otherwise("")
    rows = formatted.select("conv_id", "example", "text", F.struct("example", trained.alias("loss")).alias("part"))
    grouped = rows.groupBy("conv_id").agg(F.max_by("text", "example").alias("last"), F.sort_array(F.collect_list("part")).alias("parts"), F.sum(F.length("text")).alias("formatted_chars"))
    pieces = F.filter(F.split("last", " </turn>\n"), lambda x: x != "")
    role = r"^### ((?:[^:\\]|\\.)*): "
    turns = F.transform(pieces, lambda p: F.struct(unescaped(F.regexp_extract(p, role, 1)).alias("role"), unescaped(F.regexp_replace(p, role, "")).alias("text")))
    return grouped.select("conv_id", turns.alias("turns"), F.array_join(F.transform("parts", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back; null texts are empty, an empty table leaves the one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = read_back(examples(turns.union(planted)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
