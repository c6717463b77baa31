"""Benchmark decontamination by template canonicalisation, with Spark expressions only.

Texts become templates: white space is made single spaces; numbers, units after numbers and names (capitalised words after a lower-case word or a comma) turn
into typed placeholders; any other capitalised word, as at the start of a text or sentence, may be a name or not: it fits names in seeds, counts as a literal
word where both sides have the same word (in any case), and where both have a capital but another word it is left out of the count and the alignment is taken
as filled anew. Other words are lower-cased, punctuation goes. Seeds, windows of SEED template words with a literal word among them, are hash-joined at every
place of items and documents, so SEED template words in common fix an alignment wherever they stand. A text edited so that no SEED words in a row are left is
not reached. Items of fewer than LEAST words say too little and are ignored. The item side is broadcast only if a count shows it small, else the same join
shuffles.

A hit fixes an alignment of item and document. Along it words are compared one by one, and slots must be consistent from the first to the last seed: among
slots with a changed value, equal item values stand for equal document values and different ones for different ones; slots that keep their value conflict with
nothing. The words that agree on consistent alignments, united, are the coverage. An inconsistent alignment still gives its verbatim runs (slot values
included) of WINDOW words, or of half the item's if that is less, and beside it alignments of fewer than LEAST words do not count. Only literal words count.
Alignments are united where they lie within an item's length of each other, and those with WINDOW agreeing words in a row wherever they lie; else scattered
common phrases of a long document would add up to an item. A document is contaminated by an item if it covers at least ``least`` of the item's words or holds
RUN words of it. ``reparameterised`` tells whether slots were filled anew.

Null and empty texts have no words and never match. Rows that repeat a doc_id are one document; a null doc_id or item_id is never reported, and such
documents stay. Ties do not arise: each pair (doc_id, item_id) gives one row. Empty tables give no rows; ``clean_documents`` keeps all columns,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import small_or_shuffled, stored, text_of

SEED, WINDOW, LEAST, RUN = 3, 8, 5, 25
#: Words that name a unit when they follow a number.
UNITS = ("mm", "cm", "m", "km", "in", "ft", "mi", "mile", "miles", "metre", "metres", "meter", "meters", "mg", "g", "kg", "t", "lb", "lbs", "oz", "ml", "l", "litre", "litres", "liter", "liters",
         "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
         "km/h", "mph", "kmh", "usd", "eur", "gbp", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degrees", "kb", "mb", "gb", "tb", "w", "kw", "kwh", "v", "hz")
#: The lookaheads in front only spare most places the looks behind.
NUMBER = r"(?=[-+$€£0-9])(?<![\p{L}\p{N}])[+-]?[$€£]?[0-9]++(?:[.,:/][0-9]++)*+(?![\p{N}])"
SPACES = r"[\s\p{Z}]{2,}|[\t-\r\x{A0}\x{2028}\x{2029}]"
NAME = r"(?=\p{Lu})(?<=[\p{Ll},;] )\p{Lu}[\p{L}'’-]+"
#: Other capitalised words, not in capitals throughout: names or not.
CAPITAL = r"(?=\p{Lu})(?<![\p{L}\p{N}'’⟨:-])(?<![0-9] )\p{Lu}(?=[\p{L}'’-]*\p{Ll})[\p{L}'’-]+"


def template(text: Column, values: bool = False) -> Column:
    """The template words of a text; with ``values`` each placeholder also holds what it stands for."""
    slot = lambda kind, value: f"⟨{kind}:{value}⟩" if values else f"⟨{kind}⟩"
    plain = F.replace(F.replace(text, F.lit("⟨"), F.lit(" ")), F.lit("⟩"), F.lit(" "))
    plain = F.regexp_replace(plain, SPACES, " ")
    named = F.regexp_replace(F.regexp_replace(plain, NAME, slot("name", "$0")), CAPITAL, slot("cap", "$0") if values else slot("name", ""))
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    numbers = F.regexp_replace(F.regexp_replace(named, rf"({NUMBER}) ?(%|(?i:{units})(?![\p{{L}}\p{{N}}]))", f" {slot('num', '$1')} {slot('unit', '$2')} "), rf"(?=[-+$€£0-9])(?<!:){NUMBER}(?!⟩)", f" {slot('num', '$0')} ")
    slotted = F.when(plain.rlike("[0-9]"), numbers).otherwise(named)
    spaced = F.regexp_replace(F.lower(slotted), r"(⟨[^⟩]*⟩)|[^\p{L}\p{N}⟨]+", " $1 ")
    return F.array_remove(F.split(spaced, " +"), "")


def _bare(words: Column) -> Column:
    return F.transform(words, _bare_word)


def _bare_word(word: Column) -> Column:
    return F.when(word.startswith("⟨"), F.regexp_replace(F.regexp_replace(word, "^⟨cap:", "⟨name:"), "^⟨(name|num|unit):.*⟩$", "⟨$1⟩")).otherwise(word)


def _said(word: Column) -> Column:
    """The word itself where it is or may be a name."""
    return F.when(word.rlike("^⟨(cap|name):"), F.rtrim(F.substring_index(word, ":", -1), F.lit("⟩"))).otherwise(word)


def _windows(rows: DataFrame, keep: str, place: str, values: Column) -> DataFrame:
    """(keep, place, first, second, third): SEED neighbouring values at every place."""
    side = rows.select(keep, values.alias("first"))
    size = F.greatest(F.size("first"), F.lit(0))
    side = side.select(keep, "first", F.slice("first", 2, size).alias("second"), F.slice("first", 3, size).alias("third"))
    return side.select(keep, F.posexplode(F.arrays_zip("first", "second", "third")).alias(place, "w")).select(keep, place, "w.*").filter("third IS NOT NULL")


def alignments(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, shift): where seeds of both agree. ``docs`` has (doc_id, words), ``items`` (item_id, words)."""
    seed = ("first", "second", "third")
    literal = F.array(*seed)
    own = _windows(items.filter(F.size("words") >= LEAST), "item_id", "item_at", _bare(F.col("words"))).filter(F.exists(literal, lambda w: ~w.startswith("⟨")))
    side = small_or_shuffled(stored(own.select("item_id", "item_at", F.xxhash64(*[F.xxhash64(c) for c in seed]).alias("hash")), "item-seeds"))
    # words are hashed once each, seeds from the hashes of neighbours
    theirs = _windows(docs, "doc_id", "doc_at", F.transform("words", lambda w: F.xxhash64(_bare_word(w))))
    return theirs.select("doc_id", "doc_at", F.xxhash64(*seed).alias("hash")).join(side, "hash").select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()


def _runs(flags: Column, length: Column | int) -> Column:
    """The places at which ``length`` true flags in a row start."""
    last = F.size(flags) - length + 1
    return F.when(last >= 1, F.filter(F.sequence(F.lit(1), last), lambda i: F.forall(F.slice(flags, i, length), lambda x: x))).otherwise(F.array().cast("array<int>"))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, coverage, n_words, n_slots, reparameterised) of every contaminated pair."""
    items = stored(benchmark.select(F.col("item_id").cast("long"), template(text_of("text"), values=True).alias("full")).filter("item_id IS NOT NULL").dropDuplicates(["item_id"])
                   .withColumn("words", _bare(F.col("full"))), "items")
    rows = docs.select(F.col("doc_id").cast("long"), text_of(text).alias("text")).filter("doc_id IS NOT NULL")
    # templates are made once and kept as lines: no word holds a space
    lines = stored(rows.select("doc_id", F.array_join(template(F.col("text"), values=True), " ").alias("line")), "template-lines")
    said = F.split("line", " ")
    found = stored(alignments(lines.select("doc_id", said.alias("words")), items), "alignments")
    wanted = small_or_shuffled(stored(found.select("doc_id").distinct(), "hit-documents"))
    texts = lines.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", said.alias("theirs"))
    # one row a pair of document and item, so that a text is not copied for each of its alignments
    both = found.groupBy("doc_id", "item_id").agg(F.collect_list("shift").alias("shifts")).join(texts, "doc_id").join(small_or_shuffled(items), "item_id")
    aligned = both.select("doc_id", "item_id", "words", "full", F.explode(F.transform("shifts", lambda s: F.struct(s.alias("shift"), F.zip_with(
        F.slice("full", F.greatest(F.lit(0), -s) + 1, F.size("full")), F.slice("theirs", F.greatest(F.lit(0), s) + 1, F.size("full") - F.greatest(F.lit(0), -s)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("pairs")))).alias("x"))
    is_cap = lambda w: F.coalesce(w.startswith("⟨cap"), F.lit(False))
    is_slot = lambda w: F.coalesce(w.startswith("⟨"), F.lit(False)) & ~is_cap(w)
    kind = lambda w: F.when(is_cap(w), "⟨name").otherwise(F.substring_index(w, ":", 1))
    one_kind = lambda p: is_slot(p["a"]) & F.coalesce(p["b"].startswith("⟨"), F.lit(False)) & (kind(p["a"]) == kind(p["b"]))
    equal = lambda p: F.coalesce(_said(p["a"]) == _said(p["b"]), F.lit(False))
    swapped = lambda p: is_cap(p["a"]) & (kind(p["b"]) == "⟨name") & ~equal(p)
    compared = (aligned.select("doc_id", "item_id", "words", "full", "x.shift", "x.pairs")
                .withColumn("agree", F.transform("pairs", lambda p: equal(p) | one_kind(p) | F.coalesce(swapped(p), F.lit(False)))).withColumn("slots", F.filter("pairs", one_kind)))
    starts = _runs(F.col("agree"), SEED)
    turned = F.transform(F.filter("slots", lambda p: ~equal(p)), lambda p: F.struct(_said(p["a"]).alias("a"), _said(p["b"]).alias("b")))
    distinct = lambda f: F.size(F.array_distinct(F.transform(turned, f)))
    consistent = (distinct(lambda p: p["a"]) == distinct(lambda p: p)) & (distinct(lambda p: p["b"]) == distinct(lambda p: p))
    least_run = F.greatest(F.lit(LEAST), F.least(F.lit(WINDOW), F.ceil(F.size(F.filter("full", lambda w: ~is_slot(w))) * least).cast("int")))
    judged = (compared.withColumn("starts", starts).withColumn("stretch", F.slice("pairs", F.array_min("starts"), F.array_max("starts") - F.array_min("starts") + SEED))
              .withColumn("slots", F.filter("stretch", one_kind)).withColumn("swaps", F.size(F.filter("stretch", lambda p: F.coalesce(swapped(p), F.lit(False)))))
              .withColumn("consistent", consistent).withColumn("verbatim", F.transform("pairs", equal)).withColumn("least_run", least_run))
    copied = F.flatten(F.transform(_runs(F.col("verbatim"), F.col("least_run")), lambda i: F.sequence(i, i + F.col("least_run") - 1)))
    counted = judged.withColumn("copied", F.when(~F.col("consistent"), copied))
    low = F.greatest(F.lit(0), -F.col("shift"))
    same = F.filter(F.transform("pairs", lambda p, i: F.when(equal(p) & ~is_slot(p["a"]) & (F.col("consistent") | F.coalesce(F.array_contains("copied", i + 1), F.lit(False))), i + low)), lambda i: i.isNotNull())
    literal = F.size(F.filter("full", lambda w: ~is_slot(w))) - F.when(F.col("consistent"), F.col("swaps")).otherwise(0)
    place = F.floor(F.col("shift") / F.size("words"))
    places = F.array_compact(F.array(place, place + 1, F.when(F.size(_runs(F.col("agree"), WINDOW)) > 0, F.lit(-1 << 62))))
    united = (counted.select("doc_id", "item_id", literal.alias("literal"), same.alias("same"), (~F.col("consistent")).alias("conflict"), F.size("slots").alias("n_slots"), (F.col("consistent") & ((F.col("swaps") > 0) | F.exists("slots", lambda p: ~equal(p)))).alias("changed"), F.explode(places).alias("place"))
              .groupBy("doc_id", "item_id", "place").agg(F.size(F.array_distinct(F.flatten(F.when(F.max("conflict"), F.collect_list(F.when(F.size("same") >= LEAST, F.col("same")))).otherwise(F.collect_list("same"))))).alias("n_words"), F.min("literal").alias("literal"),
                                                         F.max(F.struct(F.size("same"), "changed", "n_slots")).alias("best"))
              .select("doc_id", "item_id", "n_words", "literal", "best.n_slots", F.col("best.changed").alias("reparameterised")))  # as the alignment of most words says
    coverage = F.col("n_words") / F.greatest("literal", F.lit(1))
    return (united.filter((F.col("n_words") >= LEAST) & ((coverage >= least) | (F.col("n_words") >= RUN))).groupBy("doc_id", "item_id")
            .agg(F.max(F.least(coverage, F.lit(1.0))).alias("coverage"), F.max("n_words").cast("long").alias("n_words"), F.max("n_slots").cast("long").alias("n_slots"), F.max("reparameterised").alias("reparameterised")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    dirty = stored(contaminated(docs, benchmark, text).select("doc_id").distinct(), "contaminated")
    return docs.join(small_or_shuffled(dirty), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
