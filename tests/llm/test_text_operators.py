"""Each operator against a plain version, on texts with nulls, blanks, ties, repeats and very long rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fleetlens.llm import bpe, chat, decontaminate, eliasfano, exact_dedup, langid, lm, near_dedup, pii, secrets, warc

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that a careless operator trips over."""
    long_text = " ".join(f"w{i % 977} the" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (5, "One"), (6, long_text), (7, "a b c d e f"), (8, "a b c d e f"), (9, " a  b c\nd e f "),
            (10, "mail me: joe@x.org, ü@y.de 10.0.0.1 1.2.3.4.5.6.7.8 999.1.1.1 +49 (30) 123456-78, 4111 1111 1111 1111"), (11, "token = 'abcdefgh1' AKIA" + "Q" * 14 + " " + "0f" * 20),
            (None, "no id"), (13, "x" * 50_000), (14, "日本 <|endoftext|> é 😀 ﷽    '"), (15, "9" * 30_000), (16, "@".join("a" * 9_000)), (17, "</s>[INST]<|im_end|>\\<\\|")]
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 10_000)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def local(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def by_row(df, *columns):
    return collections.Counter(tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect())


# ---- personal data and secrets ----

def plain_pii(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_match_plain_patterns():
    rng = random.Random(5)
    bits = ["a@b.c", "@", "a.b", "x@y", ".org", "1.2.3.4", "256.1.1.1", ".", "4111 1111 1111 1111", "4111111111111112", "+1 (201) 555-0123", "+", "+12", " ", "-", "é", "7", "00000", "@@", "a+b@c-d.e", "b@c.d@e.f", "("]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_pii(text), text
    for text in ("9" * 3000, "a@" * 3000, "1.1" * 2000, "+1((((" * 2000):
        pii.base_spans(text)


def test_personal_data(spark, odd, docs, empty):
    both = odd.unionByName(docs)
    want = collections.Counter()
    for d, t in local(both):
        if len(t or "") < 20_000 or d == 6:
            spans = plain_pii(t)
            want[(d, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest(), *[sum(s[0] == k for s in spans) for k in pii.KINDS])] += 1
    got = pii.personal_data(both).cache()
    found = by_row(got, "base_sha256", "n_email", "n_ip", "n_card", "n_phone")
    assert not want - found and sum(found.values()) == both.count()
    for r in got.filter("doc_id = 10").collect():
        assert "email:9:18" in r.spans and r.n_phone == 1 and r.n_card == 1
    assert pii.personal_data(empty).count() == 0
    assert pii.redact("call +49 or a@b.c", "email:12:17,phone:5:8") == "call [phone] or [email]"


def test_added_spans_keep_base_and_do_not_overlap(spark, docs):
    twin = docs.withColumn("text", F.regexp_replace("text", "([a-z0-9]+)@([a-z0-9]+)\\.example\\.com", "$1 at $2 dot example dot com"))
    rows = pii.personal_data(docs.unionByName(twin.withColumn("doc_id", F.col("doc_id") + 100_000))).collect()
    for r in rows:
        spans = sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in r.spans.split(",") if x))
        assert len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added


def disguised_documents():
    """Texts with base spans for training, texts with one disguised span each, and clean prose: rows, and the planted (doc_id, kind, start, end)."""
    rng = random.Random(3)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))

    def card():
        body = "4" + number(14)
        return body + next(d for d in "0123456789" if pii.luhn(body + d))

    fours = lambda c, by: by.join(c[i:i + 4] for i in range(0, 16, 4))
    octets = lambda by: by.join(str(rng.randint(1, 255)) for _ in range(4))
    plain = {"email": lambda: f"mail {word()}.{word()}@{word()}.example.com", "ip": lambda: f"from host {octets('.')}", "card": lambda: f"paid by card {fours(card(), ' ')}", "phone": lambda: f"call +1 ({number(3)}) 555-{number(4)}"}
    hidden = {"email": lambda: ("mail ", f"{word()}.{word()} at {word()} dot example dot com"), "ip": lambda: ("from host ", octets("[.]")), "card": lambda: ("paid by card ", fours(card(), ".")), "phone": lambda: ("call ", f"({number(3)}) 555-{number(4)}")}
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], set()
    for i in range(400):
        rows.append((i, f"{prose(9)} {plain[pii.KINDS[i % 4]]()} {prose(7)}"))
    for i in range(1000, 1200):
        kind = pii.KINDS[i % 4]
        cue, span = hidden[kind]()
        lead = f"{prose(6)} {cue}"
        rows.append((i, f"{lead}{span}, {prose(5)}"))
        planted.add((i, kind, len(lead), len(lead) + len(span)))
    for i in range(2000, 2100):
        clean = (f"They met at noon.Then {prose(3)}", f"order {number(12)} of {prose(3)}", f"on 2024-01-15 103000 {prose(3)}", f"build 300[.]1[.]2[.]3 of {prose(4)}", prose(12))
        rows.append((i, clean[i % 5]))
    return rows, planted


def plain_selection(candidates, trees):
    """Added spans by one loop over trees and nodes."""
    scored = []
    for kind, s, e, x in candidates:
        margin = 0.0
        for nodes, weight in zip(trees.nodes, trees.weights, strict=True):
            at = 0
            while nodes[at][0] >= 0:
                at = int(nodes[at][2] if x[int(nodes[at][0])] <= nodes[at][1] else nodes[at][3])
            margin += weight * nodes[at][4]
        if kind in trees.thresholds and margin >= trees.thresholds[kind]:
            scored.append((-margin, s, pii.KINDS.index(kind), e))
    out = []
    for _, s, k, e in sorted(scored):
        if all(e <= a or b <= s for _, a, b in out):
            out.append((pii.KINDS[k], s, e))
    return out


def test_planted_disguises_are_found_and_selected_as_the_trees_say(spark):
    rows, planted = disguised_documents()
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    trees = pii.train(found)
    got = {r.doc_id: {(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)} for r in pii.select(found, trees).collect()}
    for kind in pii.KINDS:
        own = [p for p in planted if p[1] == kind]
        assert sum(p[1:] in got[p[0]] for p in own) >= 0.9 * len(own), (kind, trees.thresholds)
    assert not any(got[d] for d in got if d >= 2000)
    for r in found.collect():
        base = [(b.kind, b.s, b.e) for b in r.base]
        assert got[r.doc_id] == set(base + plain_selection([(c.kind, c.s, c.e, c.x) for c in r.candidates], trees))


def test_long_names_and_domains_are_whole_candidates():
    name, domain = "n" * 200, " dot ".join(["d" * 100] * 12)
    assert pii.proposals(f"x {name} at {domain} dot org.") == {("email", 2, 2 + 200 + 4 + len(domain) + 8)}
    for text in (" at a.b" * 20_000, "a at " * 20_000, "a dot " * 20_000, "1[.]" * 20_000):
        pii.proposals(text)


def test_copies_of_one_vector_do_not_fill_the_sample(spark):
    def example(i):
        y = float(i % 2)
        return (i, [(y, 0, 9, [float(i // 2 % 2), 10 * y, *[0.0] * 20])])
    found = spark.createDataFrame([example(i) for i in range(4000)], "doc_id long, labelled array<struct<y double, s int, e int, x array<double>>>")
    trees = pii.train(found, rows=400)
    assert trees.nodes and trees.thresholds.keys() == {"email", "ip"}


def test_trigram_queries_hold_for_every_match():
    texts = {"assign": "API_KEY = abcdefgh12", "access": "xAKIA" + "A1" * 8, "private_key": "-----BEGIN EC PRIVATE KEY-----", "github": "gho_" + "a" * 36, "slack": "xoxb-" + "1" * 12, "stripe": "sk_live_" + "a" * 20,
             "jwt": "eyJabcdefgh.eyJabcdefgh.abcdefgh"}
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern, rule.flags)
        if rule.kind == "hex":
            assert query is None
        else:
            assert any(all(g in texts[rule.kind].lower() for g in grams) for grams in query), rule
    assert secrets.trigram_query("ab|xyz") is None
    assert secrets.trigram_query("(foo|bars)+[0-9]?q") == [frozenset({"bar", "ars"}), frozenset({"foo"})]


def test_secrets(odd, docs, empty):
    both = odd.unionByName(docs)
    want = collections.Counter()
    for d, t in local(both):
        spans = []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.IGNORECASE | re.ASCII):
            spans += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] * (len(m[2]) >= 8)
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
        want[(d, hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest(), *[sum(s[1] == k for s in spans) for k in range(3)])] += 1
    assert by_row(secrets.scan(both), "base_sha256", "n_assign", "n_access", "n_hex") == want
    assert secrets.scan(empty).count() == 0


# ---- duplicates ----

def test_exact_duplicates(odd, docs, empty):
    both = odd.unionByName(docs)
    rows = [(d, t or "") for d, t in local(both)]
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t.translate(str.maketrans("", "", SPACE))].append((-len(t), d is None, d or 0, d))
    want = collections.Counter()
    for body, own in groups.items():
        for *_, d in own:
            keep = min(own)[3]
            want[d, keep, len(own), d == keep, hashlib.sha256(body.encode()).hexdigest()] += 1
    for counters in (3, 512):  # few counters: hot digests leave map-side, the rest is shuffled
        assert by_row(exact_dedup.duplicates(both, counters=counters), "keep_id", "group_size", "kept", "text_sha256") == want
    kept = exact_dedup.distinct_documents(both.withColumns({"digest": F.lit(1), "RANK": F.lit(2)}), counters=3)
    assert kept.columns == [*both.columns, "digest", "RANK"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(min(own)[3]) for own in groups.values())
    assert exact_dedup.duplicates(empty).count() == 0 and exact_dedup.distinct_documents(empty).count() == 0


def test_frequent_keys_are_found(spark):
    keys = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, 8).otherwise(F.col("id") + 100).alias("key"))
    found = {r.key: r.n for r in exact_dedup.frequent(keys.repartition(4), counters=20, block_rows=1024).collect()}
    assert {7, 8} <= found.keys() and len(found) <= 20 and found[7] <= 6667


def plain_components(rows, n=2, percent=80):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in sets}


def variants(rng, size, count):
    base = [f"t{rng.randint(0, 10**6)}" for _ in range(size)]
    for _ in range(count):
        copy = list(base)
        for _ in range(rng.randint(0, size // 7)):
            copy[rng.randrange(size)] = f"v{rng.randint(0, 10**6)}"
        yield " ".join(copy)


def test_near_duplicates(spark, odd, docs, empty):
    rng = random.Random(11)
    extra = [(1000 + i, t, "en", "s", 0) for i, t in enumerate([*variants(rng, 120, 90), *variants(rng, 60, 12), *variants(rng, 20, 5)])]
    both = odd.unionByName(docs).unionByName(spark.createDataFrame(extra, SCHEMA))
    want = plain_components([(d, t) for d, t in local(both) if d is not None])
    got = near_dedup.near_duplicates(both).collect()
    assert len(got) == both.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id in (None, r.component_id)) for r in got)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_row_without_id_leaves_its_copies_linked(spark):
    rng = random.Random(12)
    bodies = list(variants(rng, 60, 3))
    rows = [(d, bodies[0], "en", "s", 0) for d in (None, 7, 5, None, 9)] + [(d, t, "en", "s", 0) for d, t in ((20, bodies[1]), (21, bodies[2]))]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id is not None}
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == plain_components([(d, t) for d, t, *_ in rows if d is not None])
    assert got[9].component_id == 5 and not got[7].kept and not got[9].kept and got[9].class_id == 5
    left = near_dedup.without_near_duplicates(spark.createDataFrame(rows, SCHEMA), words=2).collect()
    assert {7, 9}.isdisjoint({r.doc_id for r in left})


def test_long_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 16)
    rng = random.Random(3)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(variants(rng, 60, 80))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain_components([r[:2] for r in rows])


# ---- tokens ----

def test_bpe_equals_the_library(odd, docs, empty):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    both = odd.unionByName(docs)
    want = collections.Counter()
    for d, t in local(both):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert by_row(bpe.token_digests(both), "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert by_row(bpe.decoded(bpe.encoded(both)), "text") == collections.Counter((d, t or "") for d, t in local(both))
    counted = bpe.with_token_counts(both.withColumn("N_Tokens", F.lit(1)))
    assert counted.columns[-2:] == ["n_tokens_", "round_trip"] and counted.filter("NOT round_trip").count() == 0
    assert bpe.token_digests(empty).count() == 0


def test_transducer_on_random_pieces(monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = bpe.Encoder(bpe.Vocabulary(), size=50)
    monkeypatch.setattr(bpe, "WINDOW", 64)
    rng = random.Random(2)
    alphabet = ["a", "the", "ing", " ", "\n", "é", "1", "!", "'s", "日本", "😀", "<|endoftext|>", "\x1c", "\x85", "zz", "AAAA", "tion" * 9]
    for n in [*[30] * 400, 5000]:
        text = "".join(rng.choice(alphabet) for _ in range(n))
        ids = np.frombuffer(b"".join(encoder.stream(text)), dtype="<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
    run = "".join(rng.choice("abcdeting") for _ in range(20_000))
    machine = bpe.Transducer(encoder.v)
    early = machine.feed(run.encode())
    assert len(machine.text) < 8 * encoder.v.lookahead  # memory does not grow with the piece
    assert early + machine.finish() == library.encode(run, add_special_tokens=False).ids


# ---- language model and language ----

def test_elias_fano():
    rng = np.random.default_rng(1)
    for n in (1, 16, 17, 4000):
        for keys in (np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)), np.unique(rng.integers(0, 3 * n, n).astype(np.uint64))):
            level = eliasfano.encode(keys)
            asked = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 3 * n, n).astype(np.uint64)])
            at = eliasfano.find(level, asked)
            assert ((at >= 0) == np.isin(asked, keys)).all() and (keys[at[at >= 0]] == asked[at >= 0]).all()


@pytest.mark.parametrize("limit", [lm.SCORE_TOKENS, 2_000])
def test_language_model(spark, odd, docs, empty, monkeypatch, limit):
    monkeypatch.setattr(lm, "COUNT_TOKENS", limit)
    rows = [(d, words(t)) for d, t in local(odd.unionByName(docs))]
    is_held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    one, two, contexts, after = (collections.Counter() for _ in range(4))
    for d, w in rows:
        if not is_held(d):
            one.update([*w, None])
            two.update(zip([0, *w], [*w, None], strict=True))
    for (u, _), n in two.items():
        contexts[u] += n
        after[u] += 1
    total, different = sum(one.values()), len(one)
    got = collections.defaultdict(list)
    for r in lm.scores(odd.unionByName(docs)).collect():
        got[r.doc_id].append(r)
    for d, w in rows:
        r = got[d][0]
        p1 = [(one[x] + 1) / (total + different + 1) for x in [*w, None]]
        p2 = [max(two[u, x] - 0.75, 0) / contexts[u] + 0.75 * after[u] / contexts[u] * p if contexts[u] else p for u, x, p in zip([0, *w], [*w, None], p1, strict=True)]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held(d), len(w) + 1, sum(one[x] > 0 for x in [*w, None]), total)
        assert math.isclose(r.base_score, sum(map(math.log10, p1)), rel_tol=1e-9)
        assert abs(r.score - sum(map(math.log10, p2))) < 0.03 * (len(w) + 1)  # one byte a probability
    held = [r for own in got.values() for r in own if r.held_out and (r.doc_id or 0) > 10_000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.scores(empty).count() == 0


def test_language_on_held_out_documents(odd, docs, empty):
    model = langid.train(docs.filter("doc_id % 2 = 0"))
    rest = docs.filter("doc_id % 2 = 1").withColumn("language", F.lit(0))
    found = langid.identify(rest, model, F.col("text"), F.col("source"), suffix=F.lit(""))
    assert found.columns == [*rest.columns, "language_", "probability", "n_grams"]
    assert found.filter(F.col("language_") == F.col("lang")).count() >= 0.98 * rest.count()
    assert langid.accepted_documents(docs, model).count() == docs.count()
    lone = {r.doc_id: r for r in langid.identify(odd, model, F.col("text")).collect() if r.doc_id}
    assert lone[1].language == lone[2].language == lone[15].language == "und" and len(lone) == 16
    assert langid.identify(empty, model, F.coalesce("text", F.lit(""))).count() == 0
    assert langid.train(empty).languages == ["und"]
    assert langid.accepted_documents(docs, langid.train(empty)).count() == 0


def test_evidence_of_pages(spark, docs):
    model = langid.train(docs)
    pages = spark.createDataFrame([(1, "https://a.b.de:8080/x?y", '<html lang="de"><p>die und der sich</p><script>var english = "the";</script></html>'), (2, None, None), (3, "nothing", "<b>"),
                                   *[(10 + i, f"http://h.fr/{i}", '<HTML LANG=fr>les des une pour avec</HTML>') for i in range(9)], (30, "http://h.fr/z", "<p>de</p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify_pages(pages, model).collect()}
    assert got[1].language == "de" and got[1].host == "a.b.de" and got[1].declared == "de"
    assert got[2].language == got[3].language == "und" and len(got) == pages.count()
    assert got[30].language == "fr"  # the host speaks where the text is short


# ---- benchmark ----

def test_contamination(spark, docs, empty):
    items = [(0, "If a farmer in Kent sells 12 boxes of apples for 40 dollars, then how many boxes does the farmer in Kent sell for 120 dollars in total?"), (1, "one two three four five six"), (2, "too short"), (3, None), (None, "x " * 40)]
    asked = items[0][1]
    changed = asked.replace("Kent", "Devon").replace("12 ", "7 ").replace("40 ", "21 ").replace("120 ", "63 ")
    rows = [(1, f"start here {asked} more"), (2, f"so what {changed}"), (3, changed.replace("for 63", "for 21").replace("sell for", "SELL,  for")), (4, None), (5, "nothing of the kind is here for the farmer in Kent"),
            (6, "zero. One, two -- three four five; six!"), (7, ""), (8, asked), (8, asked), (None, asked), (9, "too short")]
    own = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA).withColumn("item_id", F.lit("x"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(own, benchmark).collect()}
    assert got == {(1, 0): False, (2, 0): True, (8, 0): False, (6, 1): False}
    assert {r.doc_id for r in decontaminate.clean_documents(own, benchmark).collect()} == {3, 4, 5, 7, 9, None}
    assert decontaminate.contaminated(empty, benchmark).count() == 0 and decontaminate.clean_documents(own, benchmark.limit(0)).count() == own.count()


def leaks(spark, items, rows):
    own = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows.items()], SCHEMA)
    return {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(own, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}


def test_edited_items_are_found_at_every_offset(spark):
    plain = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    edited = lambda size, at: " ".join("zz" if i in at else w for i, w in enumerate(plain[:size]))
    items = {1: " ".join(plain[:17]), 2: " ".join(plain[20:36]), 3: " ".join(plain[36:60]), 4: "five short words stand here"}
    rows, want = {}, set()
    for k in range(4):
        before = "qq " * k
        rows |= {k: before + edited(17, {8}), 10 + k: before + items[2].replace(plain[27], "zz"), 20 + k: before + " ".join("zz" if i % 8 == 7 else w for i, w in enumerate(plain[36:60])),
                 30 + k: before + " ".join("zz" if i % 4 == 3 else w for i, w in enumerate(plain[36:60])), 40 + k: before + "five short words stand here again"}
        want |= {(k, 1), (10 + k, 2), (20 + k, 3), (30 + k, 3), (40 + k, 4)}
    rows[90] = " and ".join(" ".join(plain[i:i + 3]) + " qq" * 40 for i in range(0, 17, 3))  # short phrases far apart
    assert leaks(spark, items, rows).keys() == want


def test_slots_count_only_where_the_item_matches(spark):
    first = "the clerk wrote that every parcel on this long shelf has to leave the house before noon and that none of them may be opened by the young guard at the gate"
    items = {1: f"{first} while 7 carts stand at 9 doors and 7 men wait", 2: "a small shop sells 12 green lamps each day and 12 red lamps each night to people of the town"}
    rows = {1: f"{first} but 4 dogs ran by 8 trees or 5 ponds", 2: items[2].replace("12 red", "13 red"), 3: items[2].replace("12", "15"), 4: "nothing of the kind"}
    assert leaks(spark, items, rows) == {(1, 1): False, (2, 2): True, (3, 2): True}


def test_names_that_open_a_sentence(spark):
    items = {1: "Tom has 12 apples left. Tom buys 3 more pears. Tom eats 5 of them now.", 2: "in the tale that they tell of Kent and Devon the old king is with Mary and the young queen"}
    rows = {1: items[1].replace("Tom", "Ann").replace("12", "8"), 2: items[1].upper(), 3: items[2].replace(" Kent", "\nKent").replace(" Devon", "  Devon").replace(" Mary", "\n\n Mary"),
            4: "\n".join(items[1].split()), 5: "Bob had his apples. Bob sold more pears."}
    assert leaks(spark, items, rows) == {(1, 1): True, (2, 1): False, (3, 2): False, (4, 1): False}
    words = spark.createDataFrame([(rows[3], items[2])], "a string, b string").select(decontaminate.template(F.col("a")).alias("a"), decontaminate.template(F.col("b")).alias("b")).first()
    assert words.a == words.b


def test_planted_items_are_found(spark, docs):
    """Against a plain search of each item's words in each document."""
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = {r.item_id: plain(r.text) for r in benchmark.collect()}
    want = {(d, i) for d, t in local(docs) for i, x in items.items() if x in plain(t)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert want and want <= got and len(got - want) <= 1


# ---- chats and archives ----

def test_chats(spark):
    rows = [(1, 2, "user", "b<|im_end|>"), (1, 1, "user", "a\\<|"), (1, 3, "assistant", None), (1, 4, "assistant", "</s>[INST] <\\\\|x"), (2, 0, None, ""), (None, None, "assistant", "y"), (3, 0, "user", "same"), (3, 0, "user", "same"),
            (4, 0, "sys<|im_sep|>", "x" * 100_000), (5, 0, "assistant", "<"), (5, 1, "assistant", "|[")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    own = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[c].append((role or "", text or ""))
    read = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert {c: [tuple(t) for t in r.turns] for c, r in read.items()} == own
    assert {c: list(r.loss) for c, r in read.items()} == {c: [t for role, t in turns if role == "assistant"] for c, turns in own.items()}
    assert read[1].formatted.count(chat.START) == 2 and read[1].formatted.count(chat.PART) == 2
    assert chat.chat_digests(turns.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, version):
    rows = [(3, "http://a/x y", "same"), (1, "http://b", "same"), (2, None, None), (5, "", ""), (None, "u", "same"), (7, "http://c", "é\r\n\r\nWARC/1.0\r\n\x00" * 5000), (8, "http://d", "lone"), (8, "http://d", "lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("content", F.lit(1)).repartition(3)
    got = collections.Counter(tuple(r)[:5] for r in warc.archived(pages, version).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = collections.Counter()
    for page, _, html in rows:
        body = (html or "").encode()
        first = min(p for p, _, h in rows if p is not None and (h or "").encode() == body)
        want[page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if page == first else "revisit", None if page == first else first] += 1
    assert got == want
    assert warc.archived(pages.limit(0), version).count() == 0
    short = warc.archived(pages, version, min_bytes=5).filter("record_type = 'revisit'")
    assert short.count() == 0


def test_pipeline(spark, docs):
    """Every stage on its own input: what goes, goes for the stage's reason; clean documents stay."""
    left, before = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, left, SF)
        now = {r.doc_id for r in out.collect()}
        if name == "exact dedup":
            assert {before[d].translate(str.maketrans("", "", SPACE)) for d in now} == {t.translate(str.maketrans("", "", SPACE)) for t in before.values()}
        if name == "near dedup":
            ids = {r.doc_id for r in left.collect()}
            groups = plain_components([(d, before[d]) for d in ids], n=5)
            assert now == {d for d, (_, c) in groups.items() if c == d}
        assert out.columns == docs.columns or name == "tokens"
        left = out
    assert left.filter("round_trip").count() == left.count() > 100
    odd_rows = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None), (99_999, "", None, None, 0)], SCHEMA))
    for _, stage in corpus_pipeline.STAGES:
        odd_rows = stage(spark, odd_rows, SF)
    assert odd_rows.count() == 3


def test_personal_data_learns_from_every_example(spark):
    """A form that only eight of 200,000 examples have; a sample of 20,000 held none of them."""
    n = 23
    vector = lambda form: F.concat(F.array(F.lit(0.0), form.cast("double")), F.array_repeat(F.lit(0.0), n - 2))
    rows = spark.range(200_000).withColumn("form", F.when(F.col("id") < 8, 2).otherwise(F.col("id") % 2))
    found = rows.select(F.col("id").alias("doc_id"), F.array(F.struct(
        (F.col("form") == 1).cast("double").alias("y"), F.lit(0).alias("s"), F.lit(1).alias("e"), vector(F.col("form")).alias("x"))).alias("labelled"))
    assert pii.merged(found).agg(F.sum("weight")).first()[0] == 200_000
    trees = pii.train(found)
    margins = trees.margin(np.array([[0.0, form, *[0.0] * (n - 2)] for form in (0, 1, 2)]))
    assert margins[0] < 0 < margins[1] and margins[2] < 0
    assert 0 < trees.thresholds["email"] <= margins[1]


def test_pipeline_batches_are_small_and_the_session_is_left_as_it_was(spark):
    before = spark.conf.get(corpus_pipeline.BATCH)
    with corpus_pipeline.small_batches(spark):
        assert spark.conf.get(corpus_pipeline.BATCH) == corpus_pipeline.BATCH_ROWS
    assert spark.conf.get(corpus_pipeline.BATCH) == before
    spark.conf.set(corpus_pipeline.BATCH, "77")
    try:
        with corpus_pipeline.small_batches(spark):
            assert spark.conf.get(corpus_pipeline.BATCH) == "77"
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)
