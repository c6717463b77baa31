"""Alignment of two tokenizers' outputs by diagonal run skipping.

A byte-level BPE (A) and a piece model (B) cut the same bytes, ``space + text``, into tokens. Each side is an array of byte offsets at which its tokens
end; offsets at which both end cut the tokens into groups. Along a stretch of one-to-one groups the two arrays are equal at a constant shift of index,
so the scan compares blocks at that shift, doubling the block while they agree and halving it at the first difference; a long stretch costs
a few comparisons of memory. Where the arrays differ, the side that is behind advances token by token until both end at one offset; that group is
irregular and sets the new shift. Texts of one Arrow batch are laid end to end: each text ends on both sides, so no group crosses texts.

Links are all pairs of an A and a B token of one group. A group's links are counted by distinct ids, so a long group without common ends
gives as many pairs as it has distinct ids, not occurrences. Each document keeps its distinct id pairs and how often each is linked; the number of
documents that hold a pair is a grouped count over these, combined before the shuffle. Pairs that many documents hold go back to the documents by
broadcast, at most HEAVY of them by construction; the others by a shuffled join, where no pair has many rows.

Null and empty texts, and texts whose tokens' bytes differ from ``space + text`` on either side (the piece model may normalise characters), have
no tokens: zeros and an empty digest. Rows that repeat, or repeat a doc_id, count as documents of their own; a null doc_id stays null. Very long texts are
aligned whole, in memory that grows with the longest text of a batch. Ties: all pairs with the highest count of their A id are best. Other columns are ignored
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.bpe import VOCABULARY
from fleetlens.llm.common import scratch, stored, text_of
from fleetlens.llm.fast_tokens import ByteLevel, Pieces

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Pairs broadcast at most; bytes of text aligned at once, unless one text is longer; pairs of a group's links spelt out one by one.
HEAVY, SPAN, SMALL_GROUP = 200_000, 1 << 20, 64
#: Tokens compared one by one at a new shift before blocks double.
FIRST_PROBES = 8
ALIGNED = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
                    ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def stretches(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one-to-one stretches as (i, j, length), irregular groups as (i, i_end, j, j_end)) of two rising arrays with one last value."""
    n = len(ends_a)
    a, b = ends_a.tolist(), ends_b.tolist()
    a.append(-1)  # ends that never agree stop every probe
    b.append(-2)
    runs: list[int] = []
    groups: list[int] = []
    i = j = 0
    while i < n:
        start, first, few = i, j, i + FIRST_PROBES
        while a[i] == b[j]:  # the first blocks at the current shift hold one token
            i += 1
            j += 1
            if i == few:
                step = FIRST_PROBES
                while a[i:i + step] == b[j:j + step]:  # then they double
                    i += step
                    j += step
                    step += step
                while step > 1:  # the first difference lies within the last block
                    step >>= 1
                    if a[i:i + step] == b[j:j + step]:
                        i += step
                        j += step
                break
        if i > start:
            runs += (start, first, i - start)
            if i == n:
                break
        p, q, x, y = i, j, a[i], b[j]
        while x != y:
            if x < y:
                p += 1
                x = a[p]
            else:
                q += 1
                y = b[q]
        groups += (i, p + 1, j, q + 1)
        i, j = p + 1, q + 1
    return np.array(runs, dtype=np.int64).reshape(-1, 3), np.array(groups, dtype=np.int64).reshape(-1, 4)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, laid end to end."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def _spelt(size: int, separators: tuple[bytes, bytes]) -> np.ndarray:
    """Decimal id and separator as fixed-width bytes, padded with zero bytes, at 2 * id + which separator."""
    return np.array([b"%d%b" % (i, s) for i in range(size) for s in separators])


class Aligner:
    def __init__(self, vocabulary: str, piece_model: str):
        self.a, self.b = ByteLevel(vocabulary), Pieces(piece_model)
        self.size_a, self.size_b = (np.array([len(x) for x in side.bytes], dtype=np.int64) for side in (self.a, self.b))
        self.pool_b, self.start_b = np.frombuffer(b"".join(self.b.bytes), np.uint8), np.cumsum(self.size_b) - self.size_b
        self.width = self.b.size
        self.spelt = np.concatenate([_spelt(self.a.size, (b",", b"|")), _spelt(self.b.size, (b",", b";"))])

    def _tokens(self, texts: list[str]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """The texts whose tokens give the bytes of ``space + text`` on both sides, with their ids."""
        full = [k for k, t in enumerate(texts) if t]
        found = []
        for k, ids in zip(full, self.b.ids([texts[k] for k in full]), strict=True):
            body, theirs = " " + texts[k], np.array(ids, dtype=np.int64)
            plain, own = body.encode("utf-8", "replace"), self.a.plain_ids(body).astype(np.int64)
            # A gives the bytes of its pieces of text, so a lost piece shows in the length
            if self.size_a[own].sum() == len(plain) == self.size_b[theirs].sum():
                found.append((k, own, theirs, plain))
        if not found:
            return [], [], []
        every = np.concatenate([x[2] for x in found])
        said = self.pool_b[_ranges(self.start_b[every], self.size_b[every])]
        wrong = np.concatenate([[0], np.cumsum(said != np.frombuffer(b"".join(x[3] for x in found), np.uint8))])
        ends = np.cumsum([len(x[3]) for x in found])
        same = wrong[ends] == wrong[np.concatenate([[0], ends[:-1]])]
        kept = [x for x, ok in zip(found, same, strict=True) if ok]
        return [x[0] for x in kept], [x[1] for x in kept], [x[2] for x in kept]

    def align(self, texts: list[str]) -> list[tuple | None]:
        """Per text (n_a, n_b, n_groups, n_links, digest, pairs, times), None for one without tokens."""
        out: list[tuple | None] = [None] * len(texts)
        chosen, ids_a, ids_b = self._tokens(texts)
        if not chosen:
            return out
        count_a, count_b = np.array([len(x) for x in ids_a]), np.array([len(x) for x in ids_b])
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        runs, odd = stretches(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        at_a, at_b = _ranges(runs[:, 0], runs[:, 2]), _ranges(runs[:, 1], runs[:, 2])
        last_a, last_b = np.cumsum(count_a), np.cumsum(count_b)  # number of tokens up to the end of each text
        closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)  # whether a token is the last of its group
        closes_a[at_a] = closes_b[at_b] = 1
        closes_a[odd[:, 1] - 1] = closes_b[odd[:, 3] - 1] = 1
        # each group's A tokens, then its B tokens, as one row of fixed-width words
        ends_a, starts_b = np.flatnonzero(closes_a) + 1, np.concatenate([[0], np.flatnonzero(closes_b) + 1])
        words = np.empty(len(a) + len(b), np.int64)
        words[np.arange(len(a)) + starts_b[np.cumsum(closes_a) - closes_a]] = 2 * a + closes_a
        words[np.arange(len(b)) + ends_a[np.cumsum(closes_b) - closes_b]] = 2 * (self.a.size + b) + closes_b
        spelt, size = self.spelt[words].tobytes(), self.spelt.dtype.itemsize
        groups = np.cumsum(closes_a)[last_a - 1]

        codes, weights, owners = [a[at_a] * self.width + b[at_b]], [np.ones(len(at_a), np.int64)], [np.searchsorted(last_a, at_a, "right")]
        n_a, n_b = odd[:, 1] - odd[:, 0], odd[:, 3] - odd[:, 2]
        small = n_a * n_b <= SMALL_GROUP
        few = odd[small]
        if len(few):
            left = _ranges(few[:, 0], n_a[small])  # each A token of a group, with all B tokens of it
            wide = np.repeat(n_b[small], n_a[small])
            right = _ranges(np.repeat(few[:, 2], n_a[small]), wide)
            left = np.repeat(left, wide)
            codes.append(a[left] * self.width + b[right])
            weights.append(np.ones(len(left), np.int64))
            owners.append(np.searchsorted(last_a, left, "right"))
        for i, p, j, q in odd[~small].tolist():
            (x, nx), (y, ny) = np.unique(a[i:p], return_counts=True), np.unique(b[j:q], return_counts=True)
            codes.append((x[:, None] * self.width + y).reshape(-1))
            weights.append((nx[:, None] * ny).reshape(-1))
            owners.append(np.full(len(x) * len(y), np.searchsorted(last_a, i, "right")))
        code, weight, owner = np.concatenate(codes), np.concatenate(weights), np.concatenate(owners)
        span = self.a.size * self.width
        keys = owner * span + code
        order = np.argsort(keys)
        keys = keys[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        times, keys = np.add.reduceat(weight[order], heads), keys[heads]
        text_of_key, pair = np.divmod(keys, span)
        cut_pairs = np.searchsorted(text_of_key, np.arange(len(chosen) + 1))
        before = 0
        for n, k in enumerate(chosen):
            low, high = cut_pairs[n], cut_pairs[n + 1]
            first = size * (int(last_a[n] - count_a[n]) + int(last_b[n] - count_b[n]))
            own = spelt[first:size * int(last_a[n] + last_b[n])].replace(b"\0", b"")[:-1]
            out[k] = (int(count_a[n]), int(count_b[n]), int(groups[n]) - before, int(times[low:high].sum()), hashlib.sha256(own).hexdigest(), pair[low:high], times[low:high])
            before = int(groups[n])
        return out


def _batches(bodies, span: int):
    """Row numbers, cut where their texts add up to ``span`` characters."""
    own, size = [], 0
    for k, body in enumerate(bodies):
        own.append(k)
        size += len(body.as_py())
        if size >= span:
            yield own
            own, size = [], 0
    if own:
        yield own


def aligned(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, piece_model: str = PIECE_MODEL) -> DataFrame:
    """Per row: token, group and link counts, digest of the groups, and the distinct linked id pairs (a * number of B ids + b) with their times."""
    def run(batches):
        aligner, row = Aligner(vocabulary, piece_model), TaskContext.get().partitionId() << 33
        for batch in batches:
            bodies = batch.column("text")
            for chosen in _batches(bodies, SPAN):
                found = aligner.align([bodies[k].as_py() for k in chosen])
                found = [x or (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)) for x in found]
                cuts = pa.array(np.concatenate([[0], np.cumsum([len(x[5]) for x in found])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chosen[0], len(chosen)), pa.array(np.arange(row, row + len(chosen))), *(pa.array([x[c] for x in found], pa.int64()) for c in range(4)),
                     pa.array([x[4] for x in found], pa.string()), *(pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([x[c] for x in found]), t)) for c, t in ((5, pa.int64()), (6, pa.int32())))], schema=SCHEMA)
                row += len(chosen)

    return docs.select(F.col("doc_id").cast("long"), text_of(text).alias("text")).mapInArrow(run, ALIGNED)


def links(rows: DataFrame) -> DataFrame:
    """(row, pair, times) of every document."""
    return rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, documents, best): documents that hold each linked pair, and whether no pair of its A id has more."""
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents")), "pair-counts")
    a = F.expr(f"pair div {width}")
    most = counts.groupBy(a.alias("a")).agg(F.max("documents").alias("most"))  # no more rows than A has ids
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def common_from(counts: DataFrame, heavy: int) -> int:
    """The least power of two such that at most ``heavy`` pairs have as many documents."""
    exponents = {r["e"]: r["n"] for r in counts.groupBy(F.floor(F.log2("documents")).cast("int").alias("e")).agg(F.count("*").alias("n")).collect()}  # at most 64 rows
    e, total = 64, 0
    while e > 0 and total + exponents.get(e - 1, 0) <= heavy:
        e -= 1
        total += exponents.get(e, 0)
    return 1 << e


def alignments(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, piece_model: str = PIECE_MODEL, heavy: int = HEAVY) -> DataFrame:
    """Per row the counts of tokens, groups and links, how many links are best for their A id, the sum of pair counts and the digest of the groups."""
    path = scratch(docs.sparkSession, "aligned")
    found = aligned(docs, text, vocabulary, piece_model)
    found.write.option("compression", "zstd").parquet(path)
    rows = docs.sparkSession.read.schema(found.schema).parquet(path)
    counts = stored(pair_counts(rows, Pieces(piece_model).size), "pairs")
    least = common_from(counts, heavy)
    common, rare = counts.filter(F.col("documents") >= least), counts.filter(F.col("documents") < least)
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum")]
    parts = links(rows).join(F.broadcast(common), "pair").groupBy("row").agg(*sums)
    if least > 1:
        others = links(rows).join(F.broadcast(common.select("pair")), "pair", "left_anti")
        parts = parts.unionByName(others.join(rare.hint("merge"), "pair").groupBy("row").agg(*sums))
    total = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("pairs", "times").join(total, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
