"""Neighbour lookups along time that survive hot keys.

A plain ``lag`` window puts every row of a key into one task. Here a key is cut into time
chunks, each chunk is sorted on its own, and only the first and last row of each chunk meet
in a second window that carries values over chunk borders. Results equal the plain
window for any chunk width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FIRST, _LAST, _CHUNK, _SLOT = "__first", "__last", "__chunk", "__slot"


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
) -> DataFrame:
    """Add previous-row values (``lag``) and next-row values (``lead``) within each key.

    ``chunk`` must not decrease along ``order`` (e.g. hour of the ordering time). The second
    window groups the border rows of a key together and leaves every other row in the group of
    its own chunk, so the plan stays one straight line that reads its input once.
    """
    lag, lead = lag or {}, lead or {}
    local = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    across = Window.partitionBy(*keys, _SLOT).orderBy(_CHUNK, *order)
    first, last = F.col(_FIRST), F.col(_LAST)

    cols = {_FIRST: F.lag(F.lit(1)).over(local).isNull(), _LAST: F.lead(F.lit(1)).over(local).isNull()}
    cols.update({n: F.lag(c).over(local) for n, c in lag.items()})
    cols.update({n: F.lead(c).over(local) for n, c in lead.items()})
    marked = df.withColumn(_CHUNK, chunk).withColumns(cols)
    carried = {n: F.when(first, F.lag(c).over(across)).otherwise(F.col(n)) for n, c in lag.items()}
    carried.update({n: F.when(last, F.lead(c).over(across)).otherwise(F.col(n)) for n, c in lead.items()})
    # Border rows share one slot per key; other rows keep their chunk.
    slot = F.when(first | last, F.lit(-(2**62))).otherwise(F.col(_CHUNK))
    return marked.withColumn(_SLOT, slot).withColumns(carried).drop(_FIRST, _LAST, _CHUNK, _SLOT)


def with_running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, value: Column, name: str
) -> DataFrame:
    """Inclusive running sum per key: a sum inside each chunk plus the totals of earlier chunks.

    Chunk totals are one row per (key, chunk), joined back on both columns.
    """
    df = df.withColumns({_CHUNK: chunk, "__v": value})
    totals = df.groupBy(*keys, _CHUNK).agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(_CHUNK).alias("__kc"),
        F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off"),
    )
    local = Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("__s", F.sum("__v").over(local))
    cond = F.col(_CHUNK).eqNullSafe(F.col("__kc"))
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = summed.join(offsets, cond, "left").withColumn(name, F.col("__s") + F.coalesce("__off", F.lit(0)))
    return joined.drop(_CHUNK, "__v", "__s", "__kc", "__off", *[f"__k{i}" for i in range(len(keys))])
