"""Best-fit packing of token sequences by large-item matching.

Each document becomes its token ids and an end id; documents longer than the capacity are cut into full pieces, with the shorter piece first. How the
pieces fill sequences depends only on how many there are of each length, so the plan is made from that histogram, which has no more entries than the
capacity has tokens, whatever the corpus holds:

1. Pieces above one third of the capacity are large; no more than two of them share a sequence. From the longest down, each is matched with the longest
   large one that still fits, which gives as many pairs as any matching can.
2. Smaller pieces, from the longest down, go where the gap is smallest that still takes them; where none does, a new sequence is opened.

Pieces of one length and sequences of one gap are interchangeable, so both steps move whole runs of them. The plan is a short table: pieces of a length
with numbers from a to b go, so many a sequence, to the sequences from c on. Every piece gets a number among those of its length: its place within
its task, plus the counts of earlier tasks. The plan's size depends on the capacity alone.

A null text counts as empty and gives one piece, the end id; a repeated row and a null doc_id give pieces like any other row. Very long texts give
many full pieces. Ties are pieces of equal length, and any order of them gives equally many sequences. Other columns are ignored whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.bpe import VOCABULARY
from fleetlens.llm.common import small_or_shuffled, stored, text_of
from fleetlens.llm.fast_tokens import ByteLevel

CAPACITY, END = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece of each document, with its task and its place among the task's pieces of the same length."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())])

    def run(batches):
        encoder, part, seen = ByteLevel(vocabulary), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encoder.ids(body.as_py()), end).astype("<u4")
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b]), part, seen[b - a]))
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_of(text).alias("text")).mapInArrow(run, PIECES)


class Plan:
    """Runs of equal sequences, filled from a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        #: (length, first number, pieces, first sequence, pieces a sequence, offset in it)
        self.moves: list[tuple[int, int, int, int, int, int]] = []
        self.used = dict.fromkeys(histogram, 0)
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.order: list[int] = []  # gaps that some sequence has, ascending
        left = {length: n for length, n in histogram.items() if n > 0}
        self._match({length: n for length, n in left.items() if 3 * length > capacity})
        for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
            self._best_fit(length, left[length])

    def _move(self, length: int, n: int, first: int, each: int, gap: int) -> None:
        self.moves.append((length, self.used[length], n, first, each, self.capacity - gap))
        self.used[length] += n

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _has_gap(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.gaps:
                insort(self.order, gap)
            self.gaps.setdefault(gap, []).append((first, n))

    def _match(self, large: dict[int, int]) -> None:
        lengths = sorted(large)
        while lengths:
            longest = lengths[-1]
            at = bisect_left(lengths, self.capacity - longest + 1) - 1  # the longest that fits beside it
            if at < 0:
                n, partner = large[longest], 0
            else:
                partner = lengths[at]
                n = large[longest] // 2 if partner == longest else min(large[longest], large[partner])
                if n == 0:  # a single piece left that fits its own length only
                    at -= 1
                    partner = lengths[at] if at >= 0 else 0
                    n = min(large[longest], large[partner]) if partner else large[longest]
            first = self._open(n)
            self._move(longest, n, first, 1, self.capacity)
            large[longest] -= n
            if partner:
                self._move(partner, n, first, 1, self.capacity - longest)
                large[partner] -= n
            self._has_gap(self.capacity - longest - partner, first, n)
            lengths = [x for x in lengths if large[x]]

    def _best_fit(self, length: int, n: int) -> None:
        while n:
            at = bisect_left(self.order, length)
            if at == len(self.order):
                each = self.capacity // length
                self._has_gap(self.capacity, self._open(-(-n // each)), -(-n // each))
                continue
            gap = self.order[at]
            runs, each = self.gaps[gap], gap // length
            first, many = runs.pop()
            if not runs:
                del self.gaps[gap], self.order[at]
            full = min(many, n // each)
            if full:
                self._move(length, full * each, first, each, gap)
                self._has_gap(gap - each * length, first, full)
                n -= full * each
            if full < many:
                rest = n if n < each else 0  # the last pieces of this length
                if rest:
                    self._move(length, rest, first + full, rest, gap)
                    self._has_gap(gap - rest * length, first + full, 1)
                    n = 0
                self._has_gap(gap, first + full + bool(rest), many - full - bool(rest))


def packed(docs: DataFrame, capacity: int = CAPACITY, end: int = END, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Every piece with the sequence it goes to and its offset there."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, capacity, end, text, vocabulary), "pieces")
    counts = stored(cut.groupBy("part", "length").count(), "piece-counts")
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)  # at most ``capacity`` rows
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(counts.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before")), "piece-numbers")
    numbered = cut.join(small_or_shuffled(before), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("number"))
    table = spark.sparkContext.broadcast(np.array(sorted(plan.moves), dtype=np.int64).reshape(-1, 6))

    def place(batches):
        moves = table.value
        lengths, firsts = moves[:, 0], moves[:, 1]
        low, high = (np.searchsorted(lengths, np.arange(capacity + 1), side) for side in ("left", "right"))
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            row = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for chosen in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                a, b = low[length[chosen[0]]], high[length[chosen[0]]]
                row[chosen] = a + np.searchsorted(firsts[a:b], number[chosen], "right") - 1
            _, first, _, sequence, each, offset = moves[row].T
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence + (number - first) // each),
                                              pa.array(offset + (number - first) % each * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(place, PACKED)
