"""Language identification by Bayesian evidence fusion.

log p(language | row) is, up to a constant, the sum of
- the text likelihood: letter trigrams, hashed to ``BUCKETS``, under add-one smoothed models counted over all labelled documents. Trigrams overlap,
  so a long text weighs as ``EFFECTIVE`` independent ones; every trigram of the text counts alike;
- the declared markup language: p(declared | language), smoothed towards the overall share of the declaration;
- the prior of the host, smoothed towards that of its address suffix, which is smoothed towards the global one. All three are grouped
  counts of what the texts alone say.
The class ``und`` spreads its trigrams evenly; it wins where no known language explains the letters.

Null and empty texts, and texts without letters, carry no text evidence: their language is ``und`` with probability 1. Null hosts
are the host "", null declarations are "none". Rows pass through one by one, repeated ones too, with all their columns; result columns take
a free name. Ties go to the language that sorts first. An empty table gives no rows; without labelled rows every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import fresh, rows_of, small_or_shuffled, stored, text_of

BUCKETS, EFFECTIVE, STRENGTH = 1 << 16, 200, 10.0
UND, UND_PRIOR = "und", 1e-3
_LETTER: list[np.ndarray] = []


def trigrams(text: str) -> np.ndarray:
    """Buckets of the text's letter trigrams; whatever is no letter counts as one blank."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = np.where(_LETTER[0][codes], codes, 32)
    codes = codes[(codes != 32) | (np.roll(codes, 1) != 32)].astype(np.uint64)
    if not (codes != 32).any():
        return np.empty(0, dtype=np.int64)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (codes[2:] * np.uint64(0x165667B19E3779F9))
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)


@dataclass
class TextModel:
    """Log probabilities by bucket and language; the last language is ``und``."""

    languages: list[str]
    table: np.ndarray

    def evidence(self, text: str) -> tuple[list[float], int]:
        grams = trigrams(text)
        if not len(grams):
            return [0.0] * len(self.languages), 0
        total = self.table[grams].sum(axis=0, dtype=np.float64)
        return (total * min(1.0, EFFECTIVE / len(grams))).tolist(), len(grams)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> TextModel:
    """Trigram models of all rows whose label is a code of two or three letters. At most BUCKETS counts a language reach the driver."""
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for body, code in rows_of(batches, "text", "lang"):
            sums[code] = sums.get(code, 0) + np.bincount(trigrams(body), minlength=BUCKETS)
        for code, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": code, "bucket": at, "n": n[at]})

    rows = labelled.select(text_of(text).alias("text"), F.lower(F.col(lang)).alias("lang")).filter(F.col("lang").rlike("^[a-z]{2,3}$") & (F.col("lang") != UND))
    counts = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counts.lang))
    table = np.full((BUCKETS, len(languages) + 1), 1.0)
    for i, code in enumerate(languages):
        own = counts[counts.lang == code]
        table[own.bucket.to_numpy(), i] += own.n.to_numpy()
    return TextModel([*languages, UND], np.log(table / table.sum(axis=0)).astype(np.float32))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def suffix_of(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def declared_of(html: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})\b""", 1))


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&[A-Za-z#0-9]{1,10};", " ")


def _observed(rows: DataFrame, model: TextModel, text: Column, host: Column, suffix: Column, declared: Column) -> tuple[DataFrame, list[str]]:
    names = fresh(rows, "_host", "_suffix", "_declared", "_text")

    @F.pandas_udf("struct<ll array<double>, n long>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.evidence(t) for t in texts], columns=["ll", "n"])

    code = F.coalesce(declared, F.lit(""))
    values = (F.coalesce(host, F.lit("")), F.coalesce(suffix, F.lit("")), F.when(code == "", "none").otherwise(code), scored(F.coalesce(text, F.lit(""))))
    return rows.withColumns(dict(zip(names, values, strict=True))), names


def _counted(evidence: DataFrame, names: list[str], languages: list[str]) -> DataFrame:
    """What texts alone say: (host, suffix, declared, best, n), one row per combination that occurs."""
    host, suffix, declared, text = (F.col(c) for c in names)
    best = F.when(text["n"] == 0, F.lit(UND)).otherwise(F.element_at(F.array(*map(F.lit, languages)), F.array_position(text["ll"], F.array_max(text["ll"])).cast("int")))
    return evidence.groupBy(host.alias("host"), suffix.alias("suffix"), declared.alias("declared"), best.alias("best")).agg(F.count("*").alias("n"))


def _host_priors(counted: DataFrame, languages: list[str]) -> tuple[DataFrame, list[float]]:
    """(host, prior array by language), and the global prior."""
    known = counted.filter(F.col("best") != UND)
    total = {r["best"]: r["n"] for r in known.groupBy("best").agg(F.sum("n").alias("n")).collect()}  # a row per language
    size = sum(total.values()) + len(languages) - 1
    top = [(total.get(code, 0) + 1) / size * (1 - UND_PRIOR) for code in languages[:-1]] + [UND_PRIOR]
    per = lambda key: known.groupBy(key).agg(*[F.sum(F.when(F.col("best") == code, F.col("n")).otherwise(0)).alias(f"n{i}") for i, code in enumerate(languages)], F.sum("n").alias("all"))
    smooth = lambda n, total, above: (n + STRENGTH * above) / (total + STRENGTH)
    by_suffix = per("suffix").select("suffix", *[smooth(F.col(f"n{i}"), F.col("all"), F.lit(top[i])).alias(f"s{i}") for i in range(len(languages))])
    hosts = per("host").join(known.groupBy("host").agg(F.max("suffix").alias("suffix")), "host").join(by_suffix, "suffix")
    return hosts.select("host", F.array(*[smooth(F.col(f"n{i}"), F.col("all"), F.col(f"s{i}")) for i in range(len(languages))]).alias("prior")), top


def _declarations(counted: DataFrame, languages: list[str]) -> dict[str, list[float]]:
    """log p(declared | language); the keys are bounded by the codes of two and three letters."""
    table = counted.groupBy("declared", "best").agg(F.sum("n").alias("n")).toPandas()
    if table.empty:
        return {}
    n = table.pivot_table(index="declared", columns="best", values="n", aggfunc="sum", fill_value=0).reindex(columns=languages, fill_value=0).astype(float)
    share = (n.sum(axis=1) / n.to_numpy().sum()).to_numpy()[:, None]
    p = (n.to_numpy() + STRENGTH * share) / (n.to_numpy().sum(axis=0) + STRENGTH)
    return {code: np.log(row).tolist() for code, row in zip(n.index, p, strict=True)}


def identify(rows: DataFrame, model: TextModel, text: Column, host: Column | None = None, suffix: Column | None = None, declared: Column | None = None) -> DataFrame:
    """All rows and columns plus language, probability and n_grams (under free names, see ``result_names``).

    Only counts are shuffled unless there are more hosts than may be broadcast; then rows meet their host's prior by a shuffle join.
    """
    nothing = F.lit(None).cast("string")
    host = nothing if host is None else host
    evidence, names = _observed(rows, model, text, host, suffix_of(host) if suffix is None else suffix, nothing if declared is None else declared)
    counted = stored(_counted(evidence, names, model.languages), "language-counts")
    priors, top = _host_priors(counted, model.languages)
    said = _declarations(counted, model.languages)
    host_name, _, declared_name, seen = names
    (prior,) = fresh(evidence, "_prior")
    joined = evidence.join(small_or_shuffled(stored(priors.select(F.col("host").alias(host_name), F.col("prior").alias(prior)), "host-priors")), host_name, "left")
    languages = F.array(*map(F.lit, model.languages))
    claims = F.create_map(*[x for code, row in said.items() for x in (F.lit(code), F.array(*map(F.lit, row)))]) if said else F.create_map(F.lit(""), F.array(F.lit(0.0)))
    claim = F.coalesce(claims[F.col(declared_name)], F.array_repeat(F.lit(0.0), len(model.languages)))
    whole = F.coalesce(F.col(prior), F.array(*map(F.lit, top)))
    scores = F.zip_with(F.zip_with(F.col(seen)["ll"], claim, lambda a, b: a + b), whole, lambda a, b: a + F.log(b))
    language, probability, grams = result_names(rows)
    (score,) = fresh(evidence, "_score")
    with_scores = joined.withColumn(score, scores)
    best = F.array_max(score)
    share = F.aggregate(score, F.lit(0.0), lambda a, x: a + F.exp(x - best))
    none = F.col(seen)["n"] == 0
    return with_scores.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(none, UND).otherwise(F.element_at(languages, F.array_position(score, best).cast("int"))).alias(language),
                              F.when(none, 1.0).otherwise(1 / share).alias(probability), F.col(seen)["n"].alias(grams))


def result_names(rows: DataFrame) -> list[str]:
    return fresh(rows, "language", "probability", "n_grams")


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, host, declared, language, probability, n_grams) of raw pages."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), declared_of(F.col("html")).alias("declared"), visible_text(F.col("html")).alias("seen"))
    return identify(rows, model, F.col("seen"), F.col("host"), declared=F.col("declared")).drop("seen")


def accepted_documents(docs: DataFrame, model: TextModel, least: float = 0.5) -> DataFrame:
    """The rows in a known language with at least the given probability; the source serves as host."""
    language, probability, _ = result_names(docs)
    host = F.col("source").cast("string") if "source" in docs.columns else None
    known = identify(docs, model, text_of(), host, suffix=F.lit(""))
    return known.filter((F.col(language) != UND) & (F.col(probability) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
