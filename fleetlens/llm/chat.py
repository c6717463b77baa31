"""Chat formatting with Spark expressions only.

A conversation becomes one text of messages ``<|im_start|>role<|im_sep|>text<|im_end|>``; adjacent turns of one role form one
message whose texts ``<|im_part|>`` separates, so that reading back gives every turn. Control strings inside roles and texts
(``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) get a backslash after their first character; one that has some gets one more,
so unescaping is exact. Null texts and roles count as empty. Turns are ordered by turn, then role, then text; a null turn comes first;
repeated rows are turns of their own. A null conv_id is a conversation like others. An empty table gives no rows; other columns
are ignored. One conversation is one row, so its turns meet in one task by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, SEP, PART, END = "<|im_start|>", "<|im_sep|>", "<|im_part|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(\||/?s>|/?INST\])", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(\||/?s>|/?INST\])", "$1$2$3")


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted) from rows (conv_id, turn, role, text)."""
    sorted_turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    rows = turns.select("conv_id", "turn", escape(_empty("role")).alias("role"), escape(_empty("text")).alias("text"))

    def piece(t: Column, i: Column) -> Column:
        role_at = lambda j: F.get(F.col("turns"), j)["role"]
        first = (i == 0) | (role_at(i - 1) != t["role"])
        last = (i == F.size("turns") - 1) | (role_at(i + 1) != t["role"])
        return F.concat(F.when(first, F.concat(F.lit(START), t["role"], F.lit(SEP))).otherwise(F.lit(PART)), t["text"], F.when(last, F.lit(END)).otherwise(F.lit("")))

    return (rows.groupBy("conv_id").agg(sorted_turns.alias("turns"))
            .select("conv_id", F.array_join(F.transform("turns", piece), "").alias("formatted")))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array of (role, text), loss array): the inverse of ``format_chats``. Loss texts are the assistant's."""
    quoted = lambda s: s.replace("|", r"\|")
    messages = F.filter(F.split("formatted", quoted(END)), lambda m: m != "")

    def turns_of(message: Column) -> Column:
        body = F.split(message, quoted(SEP), 2)
        role = unescape(F.substring(body[0], len(START) + 1, 1 << 30))
        return F.transform(F.split(body[1], quoted(PART)), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    read = formatted.select("conv_id", "formatted", F.flatten(F.transform(messages, turns_of)).alias("turns"))
    return read.withColumn("loss", F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]))


def chat_digests(turns: DataFrame) -> DataFrame:
    """The formatted chats, read back and summed up: counts, digests of the turns and of the text under the loss mask."""
    read = read_chats(format_chats(turns))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
                       F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


def with_control_case(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The turns plus conversation -7, whose two texts imitate control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)
