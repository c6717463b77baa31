"""Secret scans with a trigram inverted index.

Each rule's regex is turned into a Boolean query: alternatives (OR) of trigrams that every match must contain (AND), in lower case. Documents
are indexed in blocks, as Spark hands them to a task: postings list the documents of the block that hold a trigram. Intersecting
and uniting postings gives the candidates of a rule, which the regex then verifies; rules without mandatory trigrams scan every
document. Only trigrams that some rule asks for are posted. A block never leaves its task, so texts are read once and not shuffled.

Null and empty texts have no spans. Spans are (kind, start, end) in code points, end exclusive. Every input row gives one row, repeated
rows too; a null doc_id stays null; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from re import _constants as op
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import text_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    valid: Callable[[re.Match], bool] = field(default=lambda m: True)
    flags: int = 0


#: The base rules first; the others add the token formats that services publish.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8, re.IGNORECASE | re.ASCII),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}"),  # a run of 32 or more, found without visiting shorter ones one by one
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: Alternatives of one rule beyond which its query would cost more than it saves; such a rule scans fully.
MAX_ALTERNATIVES = 64


def _runs(tree) -> list[list[str]]:
    """Alternatives of a parsed regex, each the literal runs that a match must contain in order; a run that is not closed joins the next one."""
    out = [[""]]
    for kind, arg in tree:
        if kind is op.LITERAL:
            more = [[chr(arg).lower()]]
        elif kind is op.IN and len(arg) <= 8 and all(k is op.LITERAL for k, _ in arg):
            more = [[c] for c in sorted({chr(c).lower() for _, c in arg})]
        elif kind is op.BRANCH:
            more = [x for branch in arg[1] for x in _runs(branch)]
        elif kind is op.SUBPATTERN:
            more = _runs(arg[-1])
        elif kind is op.MAX_REPEAT and arg[:2] == (0, 1):
            more = [[""]] + _runs(arg[2])
        elif kind is op.MAX_REPEAT and arg[0] >= 1:
            more = [[*x, ""] for x in _runs(arg[2])]  # one round, then anything
        elif kind is op.AT:
            more = [[""]]
        else:
            more = [["", ""]]
        if len(out) * len(more) > MAX_ALTERNATIVES:
            more = [["", ""]]
        out = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in out for b in more]
    return out


def trigram_query(pattern: str, flags: int = 0) -> list[frozenset[str]] | None:
    """OR of ANDs of mandatory trigrams; None if some match needs none."""
    query = {frozenset(run[i:i + 3] for run in runs for i in range(len(run) - 2)) for runs in _runs(_parser.parse(pattern, flags))}
    least = [q for q in query if not any(other < q for other in query)]  # what another alternative implies adds nothing
    return None if frozenset() in query else sorted(least, key=sorted)


def postings(texts: list[str], trigrams: set[str]) -> dict[str, np.ndarray]:
    """For each trigram the places of the block's texts that hold it, letters in either case."""
    lowered = [t.lower() for t in texts]
    return {g: np.flatnonzero(np.fromiter((g in t for t in lowered), bool, len(lowered))) for g in trigrams}


def candidates(query: list[frozenset[str]] | None, index: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Places that fit the query, shortest postings first."""
    if query is None:
        return np.arange(n)
    found = []
    for grams in query:
        lists = sorted((index[g] for g in grams), key=len)
        hits = lists[0]
        for other in lists[1:]:
            hits = np.intersect1d(hits, other, assume_unique=True)
        found.append(hits)
    return np.unique(np.concatenate(found))


def joined(spans, kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]), x[2])))


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Secrets of every row by all rules."""
    kinds = tuple(r.kind for r in rules)
    compiled = [(r.kind, re.compile(r.pattern, r.flags), r.valid, trigram_query(r.pattern, r.flags)) for r in rules]
    wanted = {g for *_, query in compiled for grams in query or () for g in grams}

    def blocks(batches):
        for pdf in batches:
            texts = list(pdf.text)
            index = postings(texts, wanted)
            spans: list[list[tuple[str, int, int]]] = [[] for _ in texts]
            for kind, regex, valid, query in compiled:
                for i in candidates(query, index, len(texts)):
                    spans[i] += [(kind, *m.span()) for m in regex.finditer(texts[i]) if valid(m)]
            base = [[x for x in own if x[0] in BASE] for own in spans]
            yield pd.DataFrame({
                "doc_id": pdf.doc_id.astype("Int64"), **{f"n_{k}": [sum(x[0] == k for x in own) for own in base] for k in BASE},
                "base_sha256": [hashlib.sha256(joined(own, kinds).encode()).hexdigest() for own in base],
                "spans": [joined(own, kinds) for own in spans], "n_added": [len(a) - len(b) for a, b in zip(spans, base, strict=True)]})

    return docs.select(F.col("doc_id").cast("long"), text_of(text).alias("text")).mapInPandas(blocks, RESULT)
