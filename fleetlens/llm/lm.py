"""A word bigram model in an Elias-Fano trie, built and queried by Spark tasks.

Tokens are the words of ``shingles`` and one end per text; a start that is never predicted precedes the first word. With c the count of a token in
training texts, N of all tokens and V of different ones, p1(w) = (c(w)+1) / (N+V+1), and

    p(w | u) = max(c(u w) - D, 0) / c(u) + D * (different words after u) / c(u) * p1(w)

The trie has two levels, cut into shards by hash so that no task holds more than a shard:
- words: hashes in Elias-Fano blocks, exact counts;
- successors: contexts in Elias-Fano blocks, monotone pointers to the range of each context's successors, and these successors in
  Elias-Fano blocks keyed relative to their context (context number, then hash of the word), with the discounted probability in one byte; the back-off
  weight of a context in one byte.
A query finds the context, then searches the word among its successors. Shards are files in the shared folder, mapped into memory by the tasks that score.

Counting sums up within tasks first; only packed (key, count) blocks are shuffled. A context with more than 1/HOT of all tokens is spread over all shards;
there are at most HOT of these. Every text, token and bigram counts; the number of shards follows the text.

Null and empty texts are one end token. Training texts are those whose crc32(doc_id as text) mod 7 is not 2; a null doc_id counts as "". Every input row gives
one row and repeated rows count repeatedly. Other columns are ignored. An empty table gives no rows; without training texts both scores are those of an empty count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import eliasfano as ef
from fleetlens.llm.common import rows_of, scratch, stored, text_of
from fleetlens.llm.shingles import mix, word_hashes

END, START = np.uint64(0xE4D0E4D0E4D0E4D1), np.uint64(0x57A2757A2757A275)
DISCOUNT, HOT = 0.75, 1024
#: Characters of text to a shard; tokens handled at a time by counting and by scoring tasks.
SHARD_CHARS, COUNT_TOKENS, SCORE_TOKENS = 32_000_000, 3_000_000, 1_000_000
#: Bits of a word's hash that successors keep, below the number of their context; steps of the one-byte logarithms.
WORD_BITS = np.uint64(40)
STEP = 12 / 255


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def quantised(p: np.ndarray) -> np.ndarray:
    """Probabilities as one byte each, on a logarithmic scale from 1e-12 to 1."""
    return np.clip(np.rint((np.log10(np.maximum(p, 1e-12)) + 12) / STEP), 0, 255).astype(np.uint8)


LEVELS = 10 ** (np.arange(256) * STEP - 12)


def _counted(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys (one array, or pairs) in order and how often each occurs."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    first = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(order) else np.empty(0, bool)
    at = np.flatnonzero(first)
    return (*(k[at] for k in keys), np.diff(np.append(at, len(order))))


def _summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    order = np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    at = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    return [k[at] for k in keys], np.add.reduceat(n, at)


def _pack(keys: list[np.ndarray], n: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, compressed."""
    first = np.diff(keys[0], prepend=np.uint64(0))
    return zlib.compress(b"".join(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() for a in (first, *keys[1:], n.astype(np.uint64))), 1)


def _unpack(data: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(columns, 8, -1)
    out = [np.ascontiguousarray(c.T).view(np.uint64).ravel() for c in raw]
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


@dataclass
class Model:
    """Where the trie lies and what it was counted from."""

    folder: str
    shards: int
    tokens: int = 0
    words: int = 0
    hot: dict[int, tuple[int, float]] = field(default_factory=dict)  # context: count, back-off weight

    def shard_of(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(32)).astype(np.int64) * self.shards >> 32

    def place(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Shard of each bigram: that of its context, or of the pair if the context is hot."""
        hot = np.isin(context, np.fromiter(self.hot, np.uint64, len(self.hot)))
        return self.shard_of(np.where(hot, mix(context + word), context))

    def counts(self, words: np.ndarray) -> np.ndarray:
        """Training count of each of the sorted distinct words."""
        out = np.zeros(len(words), dtype=np.int64)
        shard = self.shard_of(words)
        edges = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.unique(shard):
            level = ef.load(self.folder, f"words-{s}")
            if level:
                own = slice(edges[s], edges[s + 1])
                at = ef.find(level, words[own])
                out[own] = np.where(at >= 0, level["count"][np.maximum(at, 0)], 0)
        return out

    def successors(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probability of each bigram and the back-off weight of its context (1 if unknown)."""
        p, weight = np.zeros(len(context)), np.ones(len(context))
        shard = self.place(context, word)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.unique(shard):
            level = ef.load(self.folder, f"pairs-{s}")
            if level:
                own = order[edges[s]:edges[s + 1]]
                heads = {k: level[f"c_{k}"] for k in ("heads", "high", "width", "at", "low")}
                at = ef.find(heads, context[own])
                own, at = own[at >= 0], at[at >= 0]
                weight[own] = LEVELS[level["weight"][at]]
                hit = ef.find(level, (at.astype(np.uint64) << WORD_BITS) | (word[own] >> (np.uint64(64) - WORD_BITS)))
                low, high = level["pointer"][at], level["pointer"][at + 1]
                there = (hit >= 0) & (hit >= low) & (hit < high)
                p[own[there]] = LEVELS[level["p"][hit[there]]]
        for key, (_, w) in self.hot.items():
            weight[context == np.uint64(key)] = w
        return p, weight

    def score(self, texts: list[str]) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, score) of each text."""
        hashed = [np.append(word_hashes(t), END) for t in texts]
        sizes = np.array([len(h) for h in hashed])
        word = np.concatenate(hashed)
        ends = np.cumsum(sizes)
        context = np.concatenate([[START], word[:-1]])
        context[ends[:-1]] = START
        different, back = np.unique(word, return_inverse=True)
        count = self.counts(different)[back]
        base = (count + 1) / (self.tokens + self.words + 1)
        _, one, back = np.unique(mix(context) + word, return_index=True, return_inverse=True)
        p, weight = self.successors(context[one], word[one])
        full = p[back] + weight[back] * base
        first = ends - sizes
        return list(zip(sizes.tolist(), np.add.reduceat((count > 0).astype(np.int64), first).tolist(), np.add.reduceat(np.log10(base), first).tolist(),
                        np.add.reduceat(np.log10(full), first).tolist(), strict=True))


def _groups(batches, limit: int) -> Iterator[tuple[list, list[str]]]:
    """Rows (ids, texts) gathered up to about ``limit`` tokens of six characters."""
    ids, texts, size = [], [], 0
    for doc_id, body in rows_of(batches, "doc_id", "text"):
        ids.append(doc_id)
        texts.append(body)
        size += len(body) + 6
        if size > 6 * limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def _blocks(rows: DataFrame, model: Model, pairs: bool) -> DataFrame:
    """(shard, block): counts of words or bigrams, summed up within tasks and packed by shard."""
    def count(batches):
        for _, texts in _groups(batches, COUNT_TOKENS):
            hashed = [np.append(word_hashes(t), END) for t in texts]
            word = np.concatenate(hashed)
            if pairs:
                context = np.concatenate([[START], word[:-1]])
                context[np.cumsum([len(h) for h in hashed])[:-1]] = START
                context, word, n = _counted(context, word)
                keys, shard = [context, word], model.place(context, word)
            else:
                word, n = _counted(word)
                keys, shard = [word], model.shard_of(word)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(model.shards + 1))
            found = [s for s in range(model.shards) if edges[s] < edges[s + 1]]
            for s in found:
                own = order[edges[s]:edges[s + 1]]
                yield pd.DataFrame({"shard": [s], "block": [_pack([k[own] for k in keys], n[own])]})

    return rows.mapInPandas(count, "shard long, block binary")


def _word_level(model: Model):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(b, 2) for b in pdf.block]
        (word,), n = _summed([np.concatenate([p[0] for p in parts])], np.concatenate([p[1] for p in parts]))
        ef.save(model.folder, f"words-{pdf.shard[0]}", ef.encode(word) | {"count": n})
        hot = np.argsort(-n.astype(np.int64), kind="stable")[:HOT]
        return pd.DataFrame({"words": [len(word)], "tokens": [int(n.sum())], "top": [word[hot].view(np.int64)], "top_n": [n[hot].astype(np.int64)]})

    return build


def _pair_level(model: Model):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(b, 3) for b in pdf.block]
        keys, n = _summed([np.concatenate([p[i] for p in parts]) for i in (0, 1)], np.concatenate([p[2] for p in parts]))
        del parts
        context, word = keys
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        different = np.diff(np.append(first, len(context)))
        total = np.add.reduceat(n, first).astype(float)
        names = context[first]
        hot = np.flatnonzero(np.isin(names, np.fromiter(model.hot, np.uint64, len(model.hot))))
        for i in hot:
            total[i] = model.hot[int(names[i])][0]
        place = np.repeat(np.arange(len(first), dtype=np.uint64), different)
        key = (place << WORD_BITS) | (word >> (np.uint64(64) - WORD_BITS))
        level = ef.encode(key) | {f"c_{k}": v for k, v in ef.encode(names).items()}
        level |= {"pointer": np.append(first, len(context)).astype(np.int64), "p": quantised((n - DISCOUNT) / np.repeat(total, different)), "weight": quantised(DISCOUNT * different / total)}
        ef.save(model.folder, f"pairs-{pdf.shard[0]}", level)
        return pd.DataFrame({"context": names[hot].view(np.int64), "different": different[hot].astype(np.int64)})

    return build


def train(rows: DataFrame) -> Model:
    """The trie of all given rows (doc_id, text)."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.char_length("text") + 1), F.count("*")).first()
    model = Model(scratch(spark, "lm"), max(8, -(-(size[0] or 0) // SHARD_CHARS)))
    if not size[1]:
        return model
    by_shard = lambda blocks, build, schema: blocks.groupBy("shard").applyInPandas(build, schema)
    levels = stored(by_shard(_blocks(rows, model, pairs=False), _word_level(model), "words long, tokens long, top array<long>, top_n array<long>"), "lm-words")
    model.words, model.tokens = map(int, levels.agg(F.sum("words"), F.sum("tokens")).first())
    top = levels.select(F.explode(F.arrays_zip("top", "top_n")).alias("t")).filter(F.col("t.top_n") * HOT > model.tokens)
    model.hot = {r[0] & 0xFFFFFFFFFFFFFFFF: (r[1], 1.0) for r in top.select("t.top", "t.top_n").collect()}  # fewer than HOT
    model.hot.pop(int(END), None)
    model.hot[int(START)] = (int(size[1]), 1.0)
    spread = stored(by_shard(_blocks(rows, model, pairs=True), _pair_level(model), "context long, different long"), "lm-pairs")
    for r in spread.groupBy("context").agg(F.sum("different").alias("n")).collect():  # at most HOT + 1
        key = r["context"] & 0xFFFFFFFFFFFFFFFF
        model.hot[key] = (model.hot[key][0], DISCOUNT * r["n"] / model.hot[key][0])
    return model


RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """Trains on the training texts and scores every row."""
    rows = docs.select(F.col("doc_id").cast("long"), text_of(text).alias("text"))
    model = train(rows.filter(~held_out(F.col("doc_id"))))

    def run(batches):
        for ids, texts in _groups(batches, SCORE_TOKENS):
            out = pd.DataFrame(model.score(texts), columns=["n_tokens", "n_known", "base_score", "score"])
            out.insert(0, "doc_id", pd.array(ids, dtype="Int64"))
            yield out

    return rows.mapInPandas(run, RESULT).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
