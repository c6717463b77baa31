"""Exact duplicates: heavy hitters are removed map-side, the remaining digests are shuffled.

Texts are equal when they agree after deleting every white-space character of [\\x20\\x09-\\x0D]; null counts as empty. Of equal
texts the row with most code points stays, then the one with the smallest doc_id. A null doc_id loses every tie. Rows that repeat
a doc_id and its text are one document: ``duplicates`` marks them alike, ``distinct_documents`` returns one of them. An empty table
gives no rows; other columns pass through ``distinct_documents`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import fresh, stored, text_of

#: Counters of a Misra-Gries summary: every digest with more than 1/(COUNTERS + 1) of the rows is found.
COUNTERS = 512
#: Rows summarised at a time, in one array.
BLOCK_ROWS = 1 << 15


def digest_of(text: str = "text") -> Column:
    """SHA-256 of the text without white space, 32 bytes."""
    return F.unhex(F.sha2(F.translate(text_of(text), " \t\n\x0b\f\r", ""), 256))


def _reduced(summaries: DataFrame, k: int) -> DataFrame:
    """Misra-Gries reduction of each row's array of (n, key): take the (k+1)-th largest count off all, keep what is positive."""
    ordered = summaries.select(F.sort_array("entries", asc=False).alias("o"))
    spare = F.coalesce(F.try_element_at("o", F.lit(k + 1))["n"], F.lit(0))
    return ordered.select(F.explode(F.slice("o", 1, k)).alias("e"), spare.alias("spare")).filter("e.n > spare").select("e.key", (F.col("e.n") - F.col("spare")).alias("n"))


def frequent(keys: DataFrame, counters: int = COUNTERS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, n): at most ``counters`` candidates, among them every key with more than 1/(counters + 1) of all rows.

    Exact counts of row blocks are reduced to summaries, which add up and are reduced once more; both steps keep the error of a
    count below rows/(counters + 1).
    """
    blocks = (keys.select("key", F.shiftright(F.monotonically_increasing_id(), block_rows.bit_length() - 1).alias("block"))
              .groupBy("block", "key").agg(F.count("*").alias("n"))
              .groupBy("block").agg(F.collect_list(F.struct("n", "key")).alias("entries")))
    summed = _reduced(blocks, counters).groupBy("key").agg(F.sum("n").alias("n"))
    top = summed.orderBy(F.desc("n"), "key").limit(counters + 1)
    return _reduced(top.agg(F.collect_list(F.struct("n", "key")).alias("entries")), counters)


def _best(rows: DataFrame) -> DataFrame:
    """Per digest: the row that stays and the number of rows."""
    return (rows.groupBy("digest").agg(F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("low"))).alias("best"), F.count("*").alias("group_size"))
            .select("digest", F.bitwise_not(F.col("best.low")).alias("keep_id"), "group_size"))


def _split(rows: DataFrame, counters: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(winners of the frequent digests, rows with these digests and their winner, remaining rows). At most ``counters`` keys are broadcast."""
    key = F.xxhash64("digest")
    heavy = frequent(rows.select(key.alias("key")), counters).select("key")
    winners = stored(_best(rows.withColumn("key", key).join(F.broadcast(heavy), "key", "left_semi").drop("key")).filter("group_size > 1"), "winners")
    return winners, rows.join(F.broadcast(winners), "digest"), rows.join(F.broadcast(winners), "digest", "left_anti")


def duplicates(docs: DataFrame, text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. Only digests and ids are shuffled, never texts."""
    rows = stored(docs.select(F.col("doc_id").cast("long"), digest_of(text).alias("digest"), F.char_length(text_of(text)).alias("n_chars")), "digests")
    _, frequent_rows, rest = _split(rows, counters)
    marked = frequent_rows.unionByName(rest.join(_best(rest), "digest"))
    return marked.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
                         F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns.

    Copies of frequent digests leave before the shuffle: of these only rows equal to the winner pass. The others meet by digest, where
    a row number of one is also applied before the exchange.
    """
    digest, size, rank, keep, copies = fresh(docs, "digest", "n_chars_", "rank", "keep_id", "group_size")
    tagged = docs.withColumns({digest: digest_of(text), size: F.char_length(text_of(text))})
    rows = stored(tagged.select(F.col("doc_id").cast("long"), F.col(digest).alias("digest"), F.col(size).alias("n_chars")), "digests")
    winners, _, _ = _split(rows, counters)
    winners = winners.select(F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.col("group_size").alias(copies))
    left = tagged.join(F.broadcast(winners), digest, "left").filter(F.col(copies).isNull() | F.col(keep).eqNullSafe(F.col("doc_id").cast("long")))
    order = Window.partitionBy(digest).orderBy(F.desc(size), F.col("doc_id").asc_nulls_last())
    return left.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
