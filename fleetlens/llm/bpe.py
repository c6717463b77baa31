"""Byte-level BPE as a streaming transducer, and the inverse byte-to-text machine.

Encoding. Text is cut at the special tokens, then into pieces by the vocabulary's pattern, window by window; a piece is kept back
until it cannot grow any more. The transducer reads the bytes of a piece and holds, for each of the last ``lookahead`` positions, the last token
of the encoding of the prefix that ends there. That token is unique: among the tokens that end at the position it is the one that the pair test
accepts after the prefix before it (two tokens may stand side by side if, building both, no merge across their border comes first).
``lookahead`` is computed from the merge list: no token is longer, so every later prefix continues one of the held ones. Once all held
positions descend from one boundary, the tokens before it are stable and leave; memory stays at a few times the lookahead however long the piece is.

Decoding. Ids become bytes by table; an incremental UTF-8 state machine turns bytes into text chunk by chunk, malformed ones into U+FFFD.

Pieces repeat, so a bounded memo of two generations keeps their ids: when the younger is full the older goes, and pieces in use come over again. A worker keeps
it from task to task; results do not depend on it.

Null and empty texts have no tokens. Every input row gives one row, repeated rows too; a null doc_id stays null; other columns are
ignored or, in ``with_token_counts``, kept. An empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import fresh, rows_of, text_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = regex.compile(public_tokenizers.PATTERN)
#: Characters read before pieces are cut; ids held before they are hashed and decoded; pieces remembered.
WINDOW, CHUNK, MEMO = 1 << 18, 1 << 16, 600_000


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes: printable Latin-1 is itself, the rest follows from U+0100."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ids = {bytes(letters[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        spelt = [tuple(bytes(letters[c] for c in side) for side in pair) for pair in pairs]
        self.ranks = {pair: rank for rank, pair in enumerate(spelt)}
        #: Sufficient lookahead: the longest token that the merge list can build, by the lengths of what each merge joins.
        length: dict[bytes, int] = {}
        for a, b in spelt:
            length[a + b] = length.get(a, 1) + length.get(b, 1)
        self.lookahead = max(length.values(), default=1)
        self.split = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.halves = {a + b: (rank, a, b) for (a, b), rank in self.ranks.items()}
        self._edges: tuple[dict, dict] = ({}, {})
        self._right: dict[tuple[bytes, bytes], bool] = {}

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The parts of the token that stand at its left (0) or right (1) end while it is being built, each with the rank of the merge that ends it."""
        found = self._edges[side].get(token)
        if found is None:
            found = [(token, math.inf)]
            if token in self.halves:
                rank, *halves = self.halves[token]
                found = [*self._edge(halves[side], side)[:-1], (halves[side], rank), *found]
            self._edges[side][token] = found
        return found

    def neighbours(self, a: bytes, b: bytes) -> bool:
        """Whether b may follow a: building both, by rank and from the left, no merge across their border comes first."""
        found = self._right.get((a, b))
        if found is None:
            left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
            while True:
                (x, ends_x), (y, ends_y) = left[i], right[j]
                rank = self.ranks.get((x, y), math.inf)
                if rank < ends_x and rank <= ends_y:
                    found = False
                elif ends_x == ends_y == math.inf:
                    found = True
                else:
                    i, j = (i + 1, j) if ends_x <= ends_y else (i, j + 1)
                    continue
                break
            if len(self._right) > MEMO:
                self._right.clear()
            self._right[a, b] = found
        return found


class Transducer:
    """Reads bytes, gives the ids of tokens as soon as no later byte can change them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.reach = vocabulary, vocabulary.lookahead
        self.text, self.last = b"", [b""]  # last[i]: last token of the encoding of text[:i]

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = 3 * self.reach
        for i in range(0, len(data), step):
            self._extend(data[i:i + step])
            if len(self.text) >= 4 * self.reach:
                out += self._settled()
        return out

    def _extend(self, data: bytes) -> None:
        n, last, ids, right, neighbours = len(self.text), self.last, self.v.ids, self.v._right, self.v.neighbours
        text = self.text = self.text + data
        for end in range(n + 1, len(text) + 1):
            for start in range(end - 1, max(-1, end - 1 - self.reach), -1):
                token = text[start:end]
                if token in ids:
                    before = last[start]
                    fits = right.get((before, token)) if start else True
                    if fits or fits is None and before is not None and neighbours(before, token):
                        last.append(token)
                        break
            else:
                last.append(None)  # cannot happen while every byte is a token

    def whole(self, text: bytes) -> list[int]:
        """Ids of a piece no longer than the lookahead: nothing can leave before its end, so its positions are held in one pass."""
        ids, right, neighbours = self.v.ids, self.v._right, self.v.neighbours
        found = ids.get(text)
        if found is not None:  # a token that reaches back to the start needs no pair test
            return [found]
        last: list[bytes | None] = [b""]
        hold = last.append
        for end in range(1, len(text) + 1):
            start = end
            while start:
                start -= 1
                token = text[start:end]
                if token in ids:
                    if not start:
                        break
                    before = last[start]
                    fits = right.get((before, token))
                    if fits or fits is None and before is not None and neighbours(before, token):
                        break
            else:
                token = None  # cannot happen while every byte is a token
            hold(token)
        out, at = [], len(text)
        while at:
            token = last[at]
            out.append(ids[token])
            at -= len(token)
        out.reverse()
        return out

    def _chain(self, at: int) -> list[bytes]:
        out = []
        while at > 0:
            out.append(self.last[at])
            at -= len(self.last[at])
        return out[::-1]

    def _settled(self) -> list[int]:
        """Tokens up to the boundary from which all held positions descend."""
        live = set(range(len(self.text) - self.reach, len(self.text) + 1))
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(top - len(self.last[top]))
        cut = live.pop()
        out = [self.v.ids[t] for t in self._chain(cut)]
        if cut:
            self.text = self.text[cut:]
            self.last = [b"", *self.last[cut + 1:]]
            for i in range(1, len(self.last)):  # a token that began before the cut no longer has its start here
                if len(self.last[i]) > i:
                    self.last[i] = None
        return out

    def finish(self) -> list[int]:
        out = [self.v.ids[t] for t in self._chain(len(self.text))]
        self.text, self.last = b"", [b""]
        return out


class Encoder(dict):
    """Memo from piece to its ids as little-endian 32-bit integers, filled by the transducer; at most ``size`` pieces in both generations."""

    def __init__(self, vocabulary: Vocabulary, size: int = MEMO):
        super().__init__()
        self.v, self.size, self.machine, self.older = vocabulary, size, Transducer(vocabulary), {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            data = piece.encode("utf-8", "replace")
            if len(data) <= self.machine.reach:
                packed = array("I", self.machine.whole(data)).tobytes()
            else:
                packed = array("I", self.machine.feed(data) + self.machine.finish()).tobytes()
        if len(self) >= self.size // 2:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = packed
        return packed

    def stream(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text, in parts."""
        end = 0
        for m in self.v.split.finditer(text) if self.v.split else ():
            yield from self._plain(text, end, m.start())
            yield array("I", [self.v.special[m[0]]]).tobytes()
            end = m.end()
        yield from self._plain(text, end, len(text))

    def _plain(self, text: str, start: int, stop: int) -> Iterator[bytes]:
        size = WINDOW
        while start < stop:
            part = text[start:min(start + size, stop)]
            pieces = PATTERN.findall(part)
            if start + size < stop:  # the last two pieces may depend on what follows
                tail = len(pieces[-1]) + (len(pieces[-2]) if len(pieces) > 1 else 0)
                if tail == len(part):
                    size *= 2
                    continue
                del pieces[-2:]
                start += len(part) - tail
                size = WINDOW
            else:
                start = stop
            yield b"".join(map(self.__getitem__, pieces))


@lru_cache(maxsize=1)
def worker_encoder(vocabulary: str) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(Vocabulary(vocabulary))


class Decoder:
    """Ids to text, chunk by chunk."""

    def __init__(self, vocabulary: Vocabulary):
        self.table, self.machine = vocabulary.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.machine.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


def round_trip(encoder: Encoder, text: str) -> tuple[int, str, str]:
    """Number of tokens, digest of the packed ids, digest of the decoded text, in constant memory beside the text."""
    decoder, n, packed, plain = Decoder(encoder.v), 0, hashlib.sha256(), hashlib.sha256()
    for part in encoder.stream(text):
        for i in range(0, len(part), 4 * CHUNK):
            own = part[i:i + 4 * CHUNK]
            n += len(own) // 4
            packed.update(own)
            plain.update(decoder.feed(memoryview(own).cast("I")).encode())
    plain.update(decoder.finish().encode())
    return n, packed.hexdigest(), plain.hexdigest()


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def token_digests(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: the number of tokens and digests of ids and decoded text."""
    def run(batches):
        encoder = worker_encoder(vocabulary)
        for pdf in batches:
            rows = [(doc_id, *round_trip(encoder, body)) for doc_id, body in rows_of([pdf], "doc_id", "text")]
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), text_of(text).alias("text")).mapInPandas(run, RESULT)


def encoded(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the token ids of every row."""
    def run(batches):
        encoder = worker_encoder(vocabulary)
        for pdf in batches:
            ids = [memoryview(b"".join(encoder.stream(body))).cast("I").tolist() for body in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "ids": ids})

    return docs.select(F.col("doc_id").cast("long"), text_of(text).alias("text")).mapInPandas(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    def run(batches):
        v = Vocabulary(vocabulary)
        for pdf in batches:
            texts = []
            for ids in pdf.ids:
                d = Decoder(v)
                texts.append("".join([*(d.feed(ids[i:i + CHUNK]) for i in range(0, len(ids), CHUNK)), d.finish()]))
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "text": texts})

    return tokens.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInPandas(run, "doc_id long, text string")


def with_token_counts(docs: DataFrame, name: str = "n_tokens", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """All rows and columns plus the number of tokens and whether decoding gives the text back; existing columns keep their names."""
    count, same = fresh(docs, name, "round_trip")

    @F.pandas_udf("struct<n long, same boolean>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(vocabulary)
        for texts in batches:
            out = []
            for body in texts:
                n, _, plain = round_trip(encoder, body)
                out.append((n, plain == hashlib.sha256(body.encode("utf-8", "replace")).hexdigest()))
            yield pd.DataFrame(out, columns=["n", "same"])

    (both,) = fresh(docs, "tokens")
    return docs.withColumn(both, measured(text_of(text))).withColumns({count: F.col(both)["n"], same: F.col(both)["same"]}).drop(both)
