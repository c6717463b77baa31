"""Whitening, alignment and packing against plain versions, on nulls, blanks, ties, repeats, long rows, empty tables and clashing names."""

import collections
import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm import alignment, packing, whitening
from fleetlens.llm.common import importable
from fleetlens.llm.fast_tokens import ByteLevel

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, pairs string, row long, length string, n_a int, part string, place string"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    importable(spark)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that a careless operator trips over, with columns named like those the operators make."""
    words = "the quick Überraschung 日本語 of 12,345 don't\n\n  x".split(" ")
    rng = random.Random(4)
    texts = [None, "", " ", "one", "one", "x" * 9000, " ".join(rng.choice(words) for _ in range(6000)), "a▁b", "ﬁ ligature", "<|endoftext|> </s> <s> <unk> <0x41>", "é😀\U0001f469‍\U0001f469", "a\0b\x01\x7f", "  two  spaces \t ",
             "tail " + " " * 700, "9" * 3000, "ab" * 2000, "　wide", "İstanbul ŞİŞ", "\r\n\r\n"]
    return spark.createDataFrame([(None if i == 3 else i % 15, t, "p", 1, "l", 2, "q", "r") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- tokens ----

def test_fast_ids_are_those_of_the_library():
    theirs, own, rng = Tokenizer.from_file(BYTES), ByteLevel(BYTES), random.Random(6)
    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    bits = [b.decode("utf-8", "replace") for b in own.bytes if b]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(4000)] + ["<|endoftext|>", "a<|endoftext|>b <|endoftext|", " " * 999 + "x", "'S 'll   \x1c"]
    for text, a, b in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.ids(text).tolist() == a.ids and own.plain_ids(text).tolist() == b.ids, repr(text)


# ---- packing ----

def packed_plainly(rows, capacity=1024):
    """Pieces of each row, by the library; and the number of sequences that best fit decreasing of single pieces takes."""
    own, out = Tokenizer.from_file(BYTES), []
    for doc_id, text in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % capacity + 1
        for k, a in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[a:first if k == 0 else a + capacity]
            out.append((doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def best_fit(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


def whole_sequences(rows, capacity):
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in parts) <= 2
    return len(held)


@pytest.mark.parametrize("capacity", [1024, 50, 7, 1])
def test_packing(odd, docs, capacity):
    both = odd.select("doc_id", "text", "row", "length", "part", "place") if capacity < 100 else odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    rows = packing.packed(both, capacity=capacity).collect()
    want = packed_plainly([tuple(r) for r in both.select("doc_id", "text").collect()], capacity)
    assert collections.Counter(tuple(r)[:5] for r in rows) == collections.Counter(want)
    used = whole_sequences(rows, capacity)
    total = sum(r.length for r in rows)
    assert -(-total // capacity) <= used <= best_fit([r.length for r in rows], capacity)


def test_large_pieces_get_the_most_pairs():
    rng = random.Random(8)
    for _ in range(200):
        capacity = rng.choice([30, 31, 32])
        lengths = [rng.randint(capacity // 3 + 1, capacity) for _ in range(rng.randint(1, 9))]
        plan = packing.Plan(collections.Counter(lengths), capacity)

        def pairs(left):
            if len(left) < 2:
                return 0
            first, rest = left[0], left[1:]
            return max([pairs(rest)] + [1 + pairs(rest[:i] + rest[i + 1:]) for i, x in enumerate(rest) if x + first <= capacity])

        assert plan.sequences == len(lengths) - pairs(lengths)


def test_plan_moves_every_piece_once():
    rng = random.Random(9)
    for _ in range(200):
        capacity = rng.choice([5, 12, 64])
        counts = {x: rng.choice([0, 1, 3, 1000]) for x in range(1, capacity + 1) if rng.random() < 0.6}
        plan = packing.Plan(counts, capacity)
        fill = collections.defaultdict(set)
        numbers = collections.defaultdict(list)
        for length, number, n, first, each, offset in plan.moves:
            numbers[length] += range(number, number + n)
            for k in range(n):
                own = set(range(offset + k % each * length, offset + (k % each + 1) * length))
                assert not own & fill[first + k // each] and max(own) < capacity
                fill[first + k // each] |= own
        assert all(sorted(numbers[x]) == list(range(c)) for x, c in counts.items())
        assert len(fill) == plan.sequences and all(v == set(range(len(v))) for v in fill.values())
        assert len(plan.moves) <= 40 * capacity  # by the capacity, not by the 1000 pieces of a length


def test_packing_of_nothing(spark, odd):
    assert packing.packed(odd.limit(0)).collect() == []


# ---- alignment ----

def aligned_plainly(rows):
    a_side, b_side = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_side.encode_special_tokens = True
    letters = {chr(b): b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(letters.values()))}
    spelt = {i: bytes(letters[c] for c in t) for t, i in a_side.get_vocab(with_added_tokens=False).items() if t != "<|endoftext|>"}
    found, counts = [], collections.Counter()
    for doc_id, text in rows:
        links, groups, n = collections.Counter(), [], (0, 0)
        if text:
            a = [(i, spelt[i]) for i in a_side.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()) for i in b_side.encode(text)]
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                n = (len(a), len(b))
                ends = [dict(zip(itertools.accumulate(len(x) for _, x in side), range(1, len(side) + 1), strict=True)) for side in (a, b)]
                i = j = 0
                for end in sorted(ends[0].keys() & ends[1].keys()):
                    p, q = ends[0][end], ends[1][end]
                    groups.append(([x for x, _ in a[i:p]], [x for x, _ in b[j:q]]))
                    links.update(itertools.product(*groups[-1]))
                    i, j = p, q
        counts.update(links.keys())
        found.append((doc_id, *n, groups, links))
    best = {}
    for (x, _), c in counts.items():
        best[x] = max(best.get(x, 0), c)
    return collections.Counter((doc_id, n_a, n_b, len(groups), sum(links.values()), sum(t for p, t in links.items() if counts[p] == best[p[0]]), sum(t * counts[p] for p, t in links.items()),
                                hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else "")
                               for doc_id, n_a, n_b, groups, links in found)


@pytest.fixture(scope="module")
def to_align(odd, docs):
    both = odd.select("doc_id", "text", "pairs", "n_a", "row").unionByName(docs.select("doc_id", "text"), allowMissingColumns=True)
    return both, aligned_plainly([tuple(r) for r in both.select("doc_id", "text").collect()])


@pytest.mark.parametrize("heavy", [200_000, 300, 0])
def test_alignment(to_align, heavy):
    both, want = to_align
    got = alignment.alignments(both, heavy=heavy)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == want


def test_alignment_of_nothing(odd):
    assert alignment.alignments(odd.limit(0)).collect() == []


def test_stretches_cover_both_sides():
    rng = random.Random(2)
    for _ in range(2000):
        common = sorted(rng.sample(range(1, 400), rng.randint(1, 120)))
        extra = lambda: {x for x in range(1, common[-1]) if rng.random() < rng.choice([0, 0.01, 0.3])}
        a, b = np.array(sorted(set(common) | extra())), np.array(sorted(set(common) | extra()))
        runs, groups = alignment.stretches(a, b)
        cuts = sorted([x for i, _, n in runs for x in a[i:i + n]] + [a[p - 1] for _, p, _, _ in groups])
        assert cuts == np.intersect1d(a, b).tolist()
        assert all((a[i:i + n] == b[j:j + n]).all() for i, j, n in runs) and all(a[p - 1] == b[q - 1] for _, p, _, q in groups)
        used = sorted([x for i, _, n in runs for x in range(i, i + n)] + [x for i, p, _, _ in groups for x in range(i, p)])
        assert used == list(range(len(a)))


# ---- whitening ----

def whitened_plainly(vectors):
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    far = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    v = np.array([[float(Fraction(sum(a[i] * a[j] for a in far), n ** 3)) for j in range(len(sums))] for i in range(len(sums))])
    return n, [sum(c * c for c in a) for a in far], np.array([[float(Fraction(c, n)) for c in a] for a in far]), v


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    made = (rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + [0, 1e4, -1e3, 0, 5]).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(made)] + [(7, made[7]), (None, made[8]), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf")] + [0.0] * 4), (904, []), (905, [1.0, 2.0])]
    return spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, component string"), [v for _, v in rows[:302]], [i for i, _ in rows[:302]]


def test_whitening(vectors):
    df, plain, ids = vectors
    n, deviation, centred, v = whitened_plainly(plain)
    rows = whitening.whitened(df).collect()
    assert len(rows) == 302 * 5 and {r.n for r in rows} == {302}
    assert collections.Counter((r.vec_id, r.deviation) for r in rows if r.component == 1) == collections.Counter(zip(ids, deviation, strict=True))
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    by_id = {(r.vec_id, r.component): r for r in rows}
    for c in range(5):
        want = centred @ axes[:, c] / np.sqrt(values[c])
        got = np.array([by_id[i, c + 1].whitened for i in ids])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
        assert abs(by_id[0, c + 1].explained / (values[c] / np.trace(v)) - 1) < 1e-9
    assert max(r.identity_error for r in rows) < 1e-8 and len({r.identity_error for r in rows}) == 1


def test_covariance_by_polarisation_is_exact(spark):
    """Far means, tiny spreads and huge entries: the matrix is the exact one, rounded."""
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e6, 1e15):
        made = (scale * rng.normal(size=(50, 4)) + 1e7).tolist()
        model = whitening.Whitening(whitening.vectors(spark.createDataFrame(list(enumerate(made)), "vec_id long, embedding array<double>")))
        assert (model.covariance == whitened_plainly(made)[3]).all()


def test_whitening_of_little(spark, vectors):
    df = vectors[0]
    assert whitening.whitened(df.limit(0)).collect() == [] and whitening.whitened(df.filter("vec_id >= 900")).filter("vec_id < 904").collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    rows = whitening.whitened(same).collect()
    assert len(rows) == 8 and all(r.whitened is None and r.identity_error is None and r.deviation == 0 for r in rows)
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], "vec_id long, embedding array<float>")
    rows = whitening.whitened(flat).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in rows) and max(r.identity_error for r in rows) < 1e-9
    huge = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert all(r.deviation is None for r in whitening.whitened(huge).collect() if r.vec_id < 3)


def test_whitening_of_the_table(spark):
    rows = whitening.whitened(spark.read.parquet(f"{SF}/embeddings.parquet")).agg(F.count("*").alias("n"), F.max("component").alias("c"), F.max("identity_error").alias("e")).first()
    assert rows.c == 32 and rows.e < 1e-4 and rows.n == 32 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
