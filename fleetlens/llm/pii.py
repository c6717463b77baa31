"""Personal data by candidate gradient boosting.

Generators with high recall propose overlapping spans (kind, start, end in code points, end exclusive). The base spans among them
follow fixed patterns and checks and always stay. All other candidates get features of format and context; boosted trees, trained here
on the corpus itself, score them; a threshold per kind, calibrated on a held-out fold, selects what is added. Added spans never overlap a base
span or each other (the more probable one wins, then the earlier, then the order of kinds).

Labels: positive are disguised twins of base spans ("a at b dot com", "1[.]2[.]3[.]4", a phone number without its country code), in the base span's own
context. Negative are candidates that fail a hard check (no Luhn sum, a part above 255, a domain end that is no known suffix, more digits or letters right at
the span) and decoys: twins broken so that they fail such a check, or moved to another place of the text, as numbers without any grouping. All other candidates
may be real disguised data and have no label. Thresholds are calibrated on held-out twins against held-out negatives. Training and
calibration read every labelled example, equal ones as one row weighted by their number; a caller may bound them. Every text
is scanned and scored whole, very long ones too, in time linear in their length.

Null and empty texts have no spans. Every input row gives one row, repeated rows too; a null doc_id stays null; other columns are
ignored. An empty table gives no rows. Without positive or negative labels nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import rows_of, stored, text_of

KINDS = ("email", "ip", "card", "phone")
#: Distinct examples of a training partition.
FIT_ROWS = 20_000
#: Steps of a unit of the margin in which thresholds are counted.
STEPS = 1024
#: Share of right spans that a kind's threshold must reach on the held-out fold.
PRECISION = 0.98

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Wider forms: a spelt-out at sign, dots in brackets, runs of digits with any punctuation.
AT = re.compile(r"\s?[(\[]\s?at\s?[)\]]\s?|\sat\s", re.IGNORECASE)
WIDE_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?|\sdot\s)[A-Za-z0-9-]++)++", re.IGNORECASE)
#: Common ends of domains.
SUFFIXES = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "io", "ai", "app", "dev", "co", "me", "tv", "eu", "uk", "de", "fr", "es", "it", "nl", "pl", "pt",
            "se", "no", "fi", "dk", "ch", "at", "be", "cz", "gr", "hu", "ie", "ro", "ru", "ua", "tr", "us", "ca", "mx", "br", "ar", "au", "nz", "jp", "cn", "kr", "in", "za", "test", "example")
WIDE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[(\[]?\.[)\]]?\s?[0-9]{1,3}){3}(?![0-9])")
WIDE_NUMBER = re.compile(r"(?<![0-9])\(?[0-9](?:[ ().\-/]{0,2}[0-9]){7,18}(?![0-9])")
CUES = {"email": ("mail", "contact", "@"), "ip": ("ip", "host", "addr", "server"), "card": ("card", "visa", "pay", "credit"), "phone": ("phone", "tel", "call", "mobile", "fax")}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches of local@domain, found from the at signs, so in linear time."""
    end, at = 0, text.find("@")
    floor = 0
    while at >= 0:
        before = text[max(end, floor):at]
        local = len(before) - len(before.rstrip(LOCAL))
        floor = at + 1
        if local and (m := DOMAIN.match(text, at + 1)):
            yield at - local, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans that always stay, by kind, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in DIGITS.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def proposals(text: str) -> set[tuple[str, int, int]]:
    """Overlapping spans of the wide generators."""
    out = set()
    floor = 0
    for m in AT.finditer(text):
        before = text[floor:m.start()]
        local = len(before) - len(before.rstrip(LOCAL))
        floor = m.end()
        if local and (d := WIDE_DOMAIN.match(text, m.end())):
            out.add(("email", m.start() - local, d.end()))
    out |= {("ip", *m.span()) for m in WIDE_IP.finditer(text)}
    for m in WIDE_NUMBER.finditer(text):
        n = sum(c.isdigit() for c in m[0])
        out |= {(kind, *m.span()) for kind, fits in (("card", 13 <= n <= 19), ("phone", 9 <= n <= 15)) if fits}
    return out


def _end(span: str) -> str:
    return re.split(r"[. )\]]", span)[-1].lower()


def features(kind: str, span: str, before: str, after: str) -> list[float]:
    """Format of the span and its surroundings."""
    digits = [c for c in span if c.isdigit()]
    groups = re.findall(r"[0-9]+", span)
    cue = [before.lower().rfind(c) for c in CUES[kind]]
    return [float(x) for x in (
        KINDS.index(kind), len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), span.count("("), span.count("-"), span.count(" "), span.count("."),
        span.startswith("+"), "@" in span, " at " in span.lower() or "at)" in span.lower(), span.lower().count("dot"), len(set(digits)) / max(1, len(digits)), luhn("".join(digits)) if kind == "card" else 0,
        max((int(g[:9]) for g in groups), default=0) <= 255, len(_end(span)), max(cue), _end(span) in SUFFIXES, before[-1:].isalnum(), after[:1].isalnum(), before[-1:].isdigit() or after[:1].isdigit())]


def disguises(kind: str, span: str) -> list[str]:
    """Twins of a base span that people also write."""
    if kind == "email":
        name, _, domain = span.partition("@")
        return [f"{name} at {domain.replace('.', ' dot ')}", f"{name} (at) {domain}", f"{name}[at]{domain.replace('.', '[dot]')}", f"{name} at {domain}"]
    if kind == "ip":
        return [span.replace(".", "[.]"), span.replace(".", " . "), span.replace(".", "(.)")]
    if kind == "card":
        fours = re.findall(".{1,4}", re.sub("[ -]", "", span))
        return [".".join(fours), "/".join(fours), "  ".join(fours)]
    bare = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", span)
    digits = re.sub("[^0-9]", "", bare)
    return [x for x in (bare, f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}.{digits[3:6]}.{digits[6:]}") if WIDE_NUMBER.fullmatch(x)]


def decoys(kind: str, span: str) -> list[str]:
    """Broken twins: none is personal data of the kind."""
    twins, digits = disguises(kind, span), re.sub("[^0-9]", "", span)
    if kind == "email":
        name, _, domain = span.partition("@")
        labels = domain.split(".")
        return [f"{name} at {'.'.join([*labels[:-1], 'then' + labels[0]])}", f"{labels[0]} at {name}.The", f"{name} at {labels[0]}.and"]
    if kind == "ip":
        return [re.sub("^[0-9]+", lambda m: str(256 + int(m[0][-3:])), t) for t in twins]
    if kind == "card":
        return [t[:-1] + str((int(t[-1]) + 1 + len(t) % 8) % 10) for t in twins]
    return [digits, f"{digits[:4]}-{digits[4:6]}-{digits[6:8]} {digits[8:]}", f"{digits[:6]}.{digits[6:]}"]


def fails(kind: str, span: str, before: str, after: str) -> bool:
    """Whether a candidate fails a hard check of its kind."""
    groups = re.findall("[0-9]+", span)
    if kind == "email":
        return _end(span) not in SUFFIXES and len(_end(span)) > 2
    if kind == "card" and not luhn("".join(groups)) or kind == "ip" and any(len(g) > 3 or int(g) > 255 for g in groups):
        return True
    return before[-1:].isalnum() or after[:1].isalnum()


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), *x[1:])))


FOUND = ("doc_id long, base array<struct<kind string, s int, e int>>, candidates array<struct<kind string, s int, e int, x array<double>>>, "
         "labelled array<struct<y double, s int, e int, x array<double>>>")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Base spans, further candidates with features, and labelled examples of every row."""
    def scan(batches):
        for pdf in batches:
            out = []
            for doc_id, body in rows_of([pdf], "doc_id", "text"):
                base = base_spans(body)
                around = lambda s, e: (body[max(0, s - 24):s], body[e:e + 8])  # noqa: B023, E731
                free = [c for c in sorted(proposals(body)) if not any(s < c[2] and c[1] < e for _, s, e in base)]
                scored = [(k, s, e, features(k, body[s:e], *around(s, e))) for k, s, e in free]
                labelled = [(0.0, s, e, x) for k, s, e, x in scored if fails(k, body[s:e], *around(s, e))]
                for k, s, e in base:
                    labelled += [(1.0, s, e, features(k, t, *around(s, e))) for t in disguises(k, body[s:e])]
                    elsewhere = (s + len(body) // 2) % len(body)
                    labelled += [(0.0, s, e, features(k, t, *around(p, p + e - s))) for t in decoys(k, body[s:e]) for p in (s, elsewhere)]
                out.append((doc_id, base, scored, labelled))
            yield pd.DataFrame(out, columns=["doc_id", "base", "candidates", "labelled"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), text_of(text).alias("text")).mapInPandas(scan, FOUND)


@dataclass
class Trees:
    """Boosted trees as arrays, and a threshold of the margin for each kind."""

    nodes: list[np.ndarray] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for nodes, weight in zip(self.nodes, self.weights, strict=True):
            at = np.zeros(len(x), dtype=int)
            for _ in range(len(nodes)):
                feature = nodes[at, 0].astype(int)
                if (feature < 0).all():
                    break
                go = np.where(x[np.arange(len(x)), np.maximum(feature, 0)] <= nodes[at, 1], nodes[at, 2], nodes[at, 3]).astype(int)
                at = np.where(feature < 0, at, go)
            total += weight * nodes[at, 4]
        return total


def _exported(tree) -> np.ndarray:
    """Rows (feature or -1, threshold, left, right, prediction) of one fitted tree."""
    rows: list[list[float]] = []

    def visit(node) -> int:
        k = len(rows)
        rows.append([-1.0, 0.0, 0.0, 0.0, node.prediction()])
        if node.subtreeDepth():
            rows[k][:2] = [node.split().featureIndex(), node.split().threshold()]
            rows[k][2] = visit(node.leftChild())
            rows[k][3] = visit(node.rightChild())
        return k

    visit(tree._java_obj.rootNode())
    return np.array(rows)


def labelled_rows(found: DataFrame) -> DataFrame:
    """(y, x, kind, order, held): every labelled example; one in five, by a hash of its place, is held out."""
    place = ("doc_id", "l.s", "l.e", "l.x")
    return found.select("doc_id", F.explode("labelled").alias("l")).select("l.y", "l.x", F.col("l.x")[0].alias("kind"), F.xxhash64(*place).alias("order"), (F.pmod(F.xxhash64(F.lit("held"), *place), F.lit(5)) == 0).alias("held"))


def merged(found: DataFrame) -> DataFrame:
    """(y, x, weight, held): all labelled examples, equal ones as one row with their number as weight."""
    return labelled_rows(found).groupBy("y", "x", "held").agg(F.count("*").cast("double").alias("weight"))


def sampled(found: DataFrame, rows: int) -> DataFrame:
    """(y, x, weight, held): at most an equal share of ``rows`` of each kind and label, for callers that bound their examples."""
    share = max(1, rows // (2 * len(KINDS)))
    examples = labelled_rows(found)
    strata = examples.groupBy("kind", "y").agg(F.count("*").alias("n"))
    # about twice the share gets as far as the windows
    near = examples.join(F.broadcast(strata), ["kind", "y"]).filter(F.pmod("order", F.lit(1_000_003)) * F.col("n") < F.lit(2 * share * 1_000_003).cast("long"))
    own = Window.partitionBy("kind", "y")
    taken = near.withColumn("place", F.row_number().over(own.orderBy(F.pmod("order", F.lit(1_000_003)), "order"))).filter(F.col("place") <= share)
    return taken.withColumn("weight", F.col("n") / F.count("*").over(own)).select("y", "x", "weight", "held")


def train(found: DataFrame, rows: int | None = None, precision: float = PRECISION) -> Trees:
    """Boosted trees on four folds of the labelled candidates; thresholds on the fifth. ``rows`` bounds the examples, without it all are used."""
    known = stored(merged(found) if rows is None else sampled(found, rows), "pii-labels")
    fit = known.filter("NOT held").select(F.col("y").alias("label"), "weight", array_to_vector("x").alias("features"))
    if fit.select("label").distinct().count() < 2:
        return Trees()
    fit = fit.coalesce(2 + fit.count() // FIT_ROWS)
    model = GBTClassifier(maxIter=12, maxDepth=4, seed=7, stepSize=0.3, checkpointInterval=-1, weightCol="weight").fit(fit)
    trees = Trees([_exported(t) for t in model.trees], list(model.treeWeights))
    trees.thresholds = thresholds(known.filter("held"), trees, precision)
    return trees


def thresholds(held: DataFrame, trees: Trees, precision: float) -> dict[str, float]:
    """The least margin of each kind, in steps, from which on the share of right examples reaches ``precision``."""
    def steps(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf.x)
                yield pd.DataFrame({"kind": x[:, 0].astype(int), "step": np.floor(trees.margin(x) * STEPS).astype(int), "right": pdf.y * pdf.weight, "weight": pdf.weight})

    counts = held.select("y", "x", "weight").mapInPandas(steps, "kind int, step long, right double, weight double")
    # The margins' range bounds the steps: about 9,000 a kind.
    rows = counts.groupBy("kind", "step").agg(F.sum("right").alias("right"), F.sum("weight").alias("weight")).toPandas()
    out = {}
    for i, kind in enumerate(KINDS):
        own = rows[(rows.kind == i) & (rows.step > 0)].sort_values("step", ascending=False)
        good = own.step[own.right.cumsum() / own.weight.cumsum() >= precision]
        if len(good):
            out[kind] = float(good.iloc[-1]) / STEPS
    return out


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def select(found: DataFrame, trees: Trees) -> DataFrame:
    """The chosen spans of every row."""
    def choose(batches):
        for pdf in batches:
            flat = [(i, c) for i, cs in enumerate(pdf.candidates) for c in cs]
            added: list[list[tuple[str, int, int]]] = [[] for _ in range(len(pdf))]
            if flat and trees.thresholds:
                m = trees.margin(np.array([list(c["x"]) for _, c in flat]))
                best = sorted((-p, c["s"], KINDS.index(c["kind"]), i, c["e"]) for (i, c), p in zip(flat, m, strict=True) if p >= trees.thresholds.get(c["kind"], np.inf))
                for _, s, k, i, e in best:
                    if not any(s < x[2] and x[1] < e for x in added[i]):
                        added[i].append((KINDS[k], s, e))
            out = []
            for doc_id, base, more in zip(pdf.doc_id, pdf.base, added, strict=True):
                base = [(b["kind"], b["s"], b["e"]) for b in base]
                counts = [sum(b[0] == k for b in base) for k in KINDS]
                out.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            yield pd.DataFrame(out, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]).astype({"doc_id": "Int64"})

    return found.drop("labelled").mapInPandas(choose, RESULT)


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first covers all."""
    out, end = [], 0
    for s, e, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if s >= end:
            out += [text[end:s], f"[{kind}]"]
        end = max(end, e)
    return "".join(out) + text[end:]


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Spans of personal data of every row; see the module for the rules."""
    found = stored(find(docs, text), "pii")
    return select(found, train(found))
