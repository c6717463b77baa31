"""Near duplicates by an inverted join of MinHash signature coordinates.

Every distinct shingle set (a class of documents) is posted under its ``COORDINATES`` tokens (coordinate, minimum). Two sets of Jaccard similarity 0.8 agree in
about 26 of 32 coordinates; candidates are pairs that agree in at least ``MATCHES`` = 16 (missed with probability below 1e-4 at 0.8, less above).
Collisions are counted with prefix and skip merging:

- tokens are ordered by rising frequency; a pair with MATCHES common tokens has at least ``SHARED`` of them among the first
  COORDINATES - MATCHES + SHARED tokens of both, so only these prefixes are posted and the long lists of common minima are skipped;
- lists of at most ``SHORT`` sets give their pairs, of which those with SHARED collisions stay;
- longer lists first meet their leader only, the set with the largest sum of token frequencies. Links to leaders join most sets of a list; a list whose sets are
  all connected is skipped. In the others every set outside the leader's component meets all sets of the list, block by block: a task
  holds one block of such sets and one of the list, intersects them through postings of shingles, and gives only links that connect what was apart.

No list is gathered whole and no group gives all its pairs, yet each pair that shares a posted token of a long list is either connected already or compared.
All links are confirmed on full sets: 100 * intersection >= ``percent`` * union. Components of the links are the result.

Words and shingles are those of ``shingles``. Null, empty and wordless texts have an empty set, linked with nothing. A text of fewer words than
a shingle has one shingle, the whole sequence. Rows that repeat a doc_id are one node; rows without doc_id are not linked, have no component and
stay. An empty table gives no rows. ``without_near_duplicates`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import components, rows_of, small_or_shuffled, stored, text_of
from fleetlens.llm.shingles import mix, shingle_set

COORDINATES, MATCHES, SHARED, SHORT = 32, 16, 4, 32
#: Sets and shingles of a block of a long list.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1_000_000
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signature(shingles: np.ndarray) -> np.ndarray:
    """A token for each coordinate: its minimum with the coordinate's number in the low bits."""
    low = np.uint64(COORDINATES - 1)
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 1 << 14):
        x = (shingles[i:i + (1 << 14)][None, :] ^ _SEEDS[:, None]) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, x.min(axis=1))
    return ((least & ~low) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def _signed(docs: DataFrame, text: str, words: int) -> DataFrame:
    """(doc_id, n, h1, h2, sig): size, fingerprint and signature of each row's shingle set."""
    def sign(batches):
        for pdf in batches:
            out = []
            for doc_id, body in rows_of([pdf], "doc_id", "text"):
                s = shingle_set(body, words)
                h1, h2 = (int(x.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for x in (s, mix(s)))
                out.append((doc_id, len(s), h1, h2, signature(s) if len(s) else []))
            yield pd.DataFrame(out, columns=["doc_id", "n", "h1", "h2", "sig"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), text_of(text).alias("text")).mapInPandas(sign, "doc_id long, n long, h1 long, h2 long, sig array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, text: str, words: int) -> DataFrame:
    """(id, shingles): the full sets of the wanted ids."""
    def collect(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.doc_id, "shingles": [shingle_set(t, words).view(np.int64) for t in pdf.text]})

    rows = docs.select(F.col("doc_id").cast("long"), text_of(text).alias("text")).join(small_or_shuffled(wanted.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    return rows.mapInPandas(collect, "id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    x, y = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    both = pairs.join(y, "b").join(x, "a").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _posted(reps: DataFrame) -> DataFrame:
    """(token, id, n, size, weight): each set's prefix of tokens that others have too, with the list's length n and the set's popularity.

    A set with fewer than SHARED posted tokens has no candidate; without it others may lose tokens too, so this is done three times.
    """
    tokens = reps.select("id", "size", F.explode("sig").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    ordered = (tokens.join(common, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"), F.first("size").alias("size"))
               # tokens that no other set has come first in the order and fill the prefix without posting anything
               .withColumn("room", F.size("t") - (MATCHES - SHARED)))
    posted = ordered.filter(F.col("room") >= SHARED).select("id", "size", F.explode(F.slice("t", F.lit(1), F.col("room"))).alias("t")).select("t.token", "id", "size")
    for _ in range(3):
        posted = stored(posted, "prefixes")
        lists = posted.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
        kept = posted.join(lists, "token")
        enough = kept.groupBy("id").agg(F.count("*").alias("k"), F.sum("n").alias("weight")).filter(F.col("k") >= SHARED).drop("k")
        posted = kept.join(enough, "id").select("token", "id", "size", "n", "weight")
        last, posted = posted, posted.select("token", "id", "size")
    return last


def _short_pairs(posted: DataFrame) -> DataFrame:
    lists = posted.filter(F.col("n") <= SHORT).groupBy("token").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)
    pairs = lists.select(F.explode(F.flatten(F.transform("ids", lambda b, i: F.transform(F.slice("ids", F.lit(1), i), lambda a: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).filter(F.col("n") >= SHARED).select("a", "b")


def _compare(percent: int):
    """One block of outsiders against one block of a long list."""
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, own = pdf[pdf.asks], pdf[~pdf.asks]
        links = []
        if len(ask) and len(own):
            sizes = own.shingles.map(len).to_numpy()
            ids = own.id.to_numpy()
            _, codes = np.unique(np.concatenate([own.component, ask.component]), return_inverse=True)
            group, label = codes[:len(own)], np.arange(codes.max() + 1)  # label: what the links found so far make of the components
            flat, owner = np.concatenate(own.shingles.to_list()), np.repeat(np.arange(len(own)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for me, mine, shingles in zip(ask.id, codes[len(own):], ask.shingles, strict=True):
                lo, hi = (np.searchsorted(flat, shingles, side=side) for side in ("left", "right"))
                runs = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
                common = np.bincount(owner[at], minlength=len(own))
                hit = np.flatnonzero((100 * common >= percent * (len(shingles) + sizes - common)) & (label[group] != label[mine]))
                met, one = np.unique(label[group[hit]], return_index=True)
                links += [(me, i) for i in ids[hit[one]]]
                label[np.isin(label, met)] = label[mine]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return compare


def _list_links(long_lists: DataFrame, joined: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the leaders did not find, see the module."""
    rows = stored(long_lists.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")), "lists")
    heads = rows.groupBy("token").agg(F.max_by("component", F.struct("weight", "id")).alias("main"), F.count("*").alias("sets"), F.sum("size").alias("shingles"))
    marked = rows.join(heads, "token").withColumn("asks", F.col("component") != F.col("main"))
    out = marked.filter("asks").groupBy("token").agg(F.count("*").alias("out_sets"), F.sum("size").alias("out_shingles"))
    blocks = lambda sets, shingles: F.greatest(F.ceil(F.col(sets) / BLOCK_SETS), F.ceil(F.col(shingles) / BLOCK_SHINGLES))
    open_lists = marked.join(out, "token").withColumns({"own_blocks": blocks("sets", "shingles"), "ask_blocks": blocks("out_sets", "out_shingles")})
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("other")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    asking = open_lists.filter("asks").select("token", "id", "component", "asks", place("ask_blocks").alias("x"), other("own_blocks")).withColumnRenamed("other", "y")
    owned = open_lists.select("token", "id", "component", F.lit(False).alias("asks"), place("own_blocks").alias("y"), other("ask_blocks")).withColumnRenamed("other", "x")
    tasks = asking.unionByName(owned).join(sets, "id")
    return tasks.groupBy("token", "x", "y").applyInPandas(_compare(percent), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", words: int = 2, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id, kept, n_links of the class.

    ``n_links`` counts the links that were needed to connect, not all similar sets: long lists give links to their leader and links that connect what was apart."""
    signed = stored(_signed(docs, text, words), "signatures")
    key = ["h1", "h2", "n"]
    classes = stored(signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min(F.struct("doc_id", "sig")).alias("m"))
                     .select(*key, F.col("m.doc_id").alias("id"), F.col("n").alias("size"), F.col("m.sig").alias("sig")), "classes")
    posted = stored(_posted(classes), "postings")
    long_lists = posted.filter(F.col("n") > SHORT)
    leaders = long_lists.groupBy("token").agg(F.max_by("id", F.struct("weight", "id")).alias("a"))
    led = long_lists.join(leaders, "token").filter("id != a").select("a", F.col("id").alias("b")).distinct()
    pairs = stored(_short_pairs(posted).unionByName(led).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    sets = stored(_sets(docs, wanted, text, words), "sets")
    links = stored(_confirmed(pairs, sets, percent), "links")
    joined = components(links).select("id", "component")
    more = stored(_list_links(long_lists, joined, sets, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "more-links")
    every = links.unionByName(more).distinct()
    degree = every.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    told = classes.drop("sig", "size").join(components(every), "id", "left").join(degree, "id", "left").select(*key, F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component"), "n_links")
    doc = F.col("doc_id")
    component = F.when(doc.isNotNull(), F.coalesce("component", doc))
    return (signed.select("doc_id", *key).join(told, key, "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(doc.isNotNull(), F.coalesce("class_id", doc)).alias("class_id"), component.alias("component_id"),
                    F.coalesce(component == doc, F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links")))


def without_near_duplicates(docs: DataFrame, text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the smallest of their component, with all their columns."""
    gone = stored(near_duplicates(docs, text, words, percent).filter("NOT kept").select("doc_id").distinct(), "near-copies")
    return docs.join(small_or_shuffled(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
