"""Byte-level BPE, packing, context-tree weighting and the quality vote."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hectare.llm.bpe import Encoder, Prefixes, decode_documents, encode_documents
from hectare.llm.ctw import Level, keys_of, levels, log10_of, log_kt
from hectare.llm.lm_score import normalised, packed_keys, score_documents, unpacked_keys
from hectare.llm.packing import Tokens, best_fit, bred, crossed, cuts, mutated, pack_documents, sequences
from hectare.llm.quality import fit_voters, op5_quality, score_quality

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return Encoder.of(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def known(encoder):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


def odd_texts(n=1500):
    r = random.Random(9)
    pick = lambda: chr(r.choice([r.randint(9, 126), r.randint(128, 0x2FFF), r.randint(0x3000, 0xD7FF), r.randint(0x1F300, 0x1FAFF)]))
    return ["".join(pick() for _ in range(r.randint(0, 40))) for _ in range(n)] + ["", " " * 3000, "a" * 5000, "<|endoftext|> x", "don't  stop\n\n "]


def test_bpe_equals_the_library(encoder, known):
    texts = odd_texts()
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [known.encode_ordinary(t) for t in texts]


def test_appends_and_edits_keep_the_table_right(encoder, known):
    r = random.Random(2)
    for _ in range(300):
        data = "".join(r.choice("abcdefthe ing") for _ in range(r.randint(0, 300))).encode()
        table = Prefixes(encoder.vocabulary)
        at = 0
        while at < len(data):
            step = r.randint(1, 40)
            table.append(data[at : at + step])
            at += step
        i = r.randint(0, len(data))
        j, new = r.randint(i, min(len(data), i + 5)), b"xyz the"[: r.randint(0, 7)]
        filled = table.replace(i, j, new)
        want = Prefixes(encoder.vocabulary, data[:i] + new + data[j:])
        assert table.data == want.data and table.last == want.last and filled <= len(want.data) - i
    long = Prefixes(encoder.vocabulary, b"the quick brown fox jumps over the lazy dog " * 50)
    assert long.replace(3, 4, b"x") < 300


def test_encode_documents(docs, rows, nothing, known):
    got = encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = Counter()
    for r in rows:
        ids = np.array(known.encode_ordinary(r[1] or ""), "<u4").tobytes()
        want[r[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), ids] += 1
    assert Counter((x[0], x[1], x[2], x[3], bytes(x[4])) for x in got) == want
    assert encode_documents(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    back = decode_documents(encode_documents(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert Counter(map(tuple, back.collect())) == Counter((r[0], r[1] or "") for r in rows)


def test_tokens_equal_the_tokenizers_library(rows):
    from tokenizers import Tokenizer

    exact, own = Tokenizer.from_file(JSON), Tokens.of(JSON, RANKS, public_tokenizers.PATTERN)
    for text in odd_texts(300) + [r[1] or "" for r in rows]:
        assert own.ids(text) == exact.encode(text, add_special_tokens=False).ids


def test_cuts():
    assert cuts(1, 10) == [(0, 1)] and cuts(10, 10) == [(0, 10)]
    assert cuts(23, 10) == [(0, 3), (3, 10), (13, 10)] and cuts(20, 10) == [(0, 10), (10, 10)]


def test_breeding_keeps_every_item():
    r = random.Random(6)
    have = Counter(r.randint(1, 99) for _ in range(400))
    items = sorted(have.elements(), reverse=True)
    one, other = best_fit([], items, 100), best_fit([], sorted(items, key=lambda x: r.random()), 100)
    for child in (crossed(one, other, have, 100, r), mutated(one, 100, r), mutated(other, 100, r)):
        assert Counter(x for b in child for x in b) == have and max(map(sum, child)) <= 100
    people = bred(sorted(have.items()), [other], 3, 100, 4, 6)
    assert len(people[0]) <= min(len(one), len(other)) and Counter(x for b in people[0] for x in b) == have
    assert bred([], [], 1, 100, 2, 2)[0] == []


def test_pack_documents(docs, rows, nothing):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(JSON)
    packed = pack_documents(docs, JSON, RANKS, public_tokenizers.PATTERN, limit=128, region_pieces=40).cache()
    want = Counter()
    for r in rows:
        ids = np.array(exact.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        for piece, (start, n) in enumerate(cuts(len(ids), 128)):
            want[r[0], piece, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    got = packed.collect()
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    bins = defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(x.length for x in got)
    assert len(bins) <= 1.1 * -(-total // 128) + 1
    joined = {x.sequence_id: (x.length, bytes(x.ids)) for x in sequences(packed).collect()}
    for x in got:
        assert joined[x.sequence_id][1][4 * x.offset : 4 * (x.offset + x.length)] == bytes(x.ids)
    assert pack_documents(nothing, JSON, RANKS, public_tokenizers.PATTERN).count() == 0


def test_kt_estimate():
    for zeros, ones in [(0, 0), (1, 0), (3, 2), (0, 700), (5000, 9000), (100_000, 1)]:
        want = math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(zeros + ones + 1)
        assert abs(log_kt(np.array([zeros]), np.array([ones]))[0] - want) < 1e-6 * max(1, abs(want))


def slow_ctw(train: list[bytes], depth: int):
    """Context trees as nested dictionaries, straight from the definition."""
    counts = defaultdict(lambda: [0, 0])
    for text in train:
        padded = b"\n" * depth + text
        for i in range(depth, len(padded)):
            for bit in range(8):
                node = (1 << bit) | padded[i] >> (8 - bit)
                for d in range(depth + 1):
                    counts[padded[i - d : i], node][(padded[i] >> (7 - bit)) & 1] += 1
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(sum(n) + 1)
    weighted, below = {}, defaultdict(float)
    for context, node in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(counts[context, node])
        weighted[context, node] = own if len(context) == depth else np.logaddexp(math.log(0.5) + own, math.log(0.5) + below[context, node])
        if context:
            below[context[1:], node] += weighted[context, node]

    def score(text: bytes) -> float:
        total, padded = 0.0, b"\n" * depth + text
        for i in range(depth, len(padded)):
            for bit in range(8):
                node, one, p = (1 << bit) | padded[i] >> (8 - bit), (padded[i] >> (7 - bit)) & 1, None
                for d in range(depth, -1, -1):
                    key = padded[i - d : i], node
                    if key in counts:
                        n = counts[key]
                        own = (n[one] + 0.5) / (sum(n) + 1)
                        trust = 1 / (1 + math.exp(min(700, below[key] - kt(n)))) if d < depth else 1
                        p = own if p is None else trust * own + (1 - trust) * p
                total += math.log10(0.5 if p is None else p)
        return total

    return score


def test_scores_equal_a_plain_implementation(docs, rows):
    got = score_documents(docs.where("length(text) < 2000 OR text IS NULL"), depth=3).collect()
    used = [r for r in rows if len(r[1] or "") < 2000]
    body = {r[:2]: normalised((r[1] or "").encode()) for r in used}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [body[r[:2]] for r in used if not held(r[0])]
    score, c = slow_ctw(train, 3), Counter(w for b in train for w in b.split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = Counter()
    for r in used:
        w = body[r[:2]].split()
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        want[r[0], held(r[0]), len(w) + 1, sum(x in c for x in w) + 1, n, round(base, 6), round(score(body[r[:2]]), 3)] += 1
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 3)) for x in got) == want


def test_probabilities_add_up():
    r = np.random.default_rng(1)
    data = r.choice(np.frombuffer(b"abcab abd\n", np.uint8), 5000)
    keys, counts = np.unique(keys_of(data, 2), return_counts=True)
    tree = levels(keys, counts, 2, 0)
    contexts = np.array([0x6162, 0x7A7A, 0x6220, 0], np.uint64)
    every = (contexts[:, None] << np.uint64(8) | np.arange(256, dtype=np.uint64)).ravel()
    assert np.allclose((10 ** log10_of(every, tree, 2)).reshape(4, 256).sum(axis=1), 1)
    assert isinstance(tree[0], Level) and len(tree) == 3


def test_score_edges(nothing, docs):
    assert score_documents(nothing).count() == 0
    alone = score_documents(docs.where("doc_id = 2"), folds=1, fold=0).collect()  # nothing to learn from
    assert alone and all(x.train_tokens == 0 and abs(x.bits_per_byte - 8) < 1e-6 for x in alone)
    keys = np.array([0, 3, 2**40, 2**64 - 1], np.uint64)
    assert (unpacked_keys(packed_keys(keys), 4) == keys).all()


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = {x.doc_id: x for x in op5_quality(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [x for x in labels if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert len(got) == 1000 and all(got[x.doc_id].held_out for x in held)
    assert sum(got[x.doc_id].predicted == x.quality for x in held) / len(held) > 0.95
    assert all(x.predicted == (x.score >= 0.3) and 0 <= x.score <= 1 for x in got.values())


def test_quality_edges(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (3, 7), (None, 1), (4, 1), (6, 0)], "doc_id bigint, quality int")
    voters = fit_voters(docs, labels)
    out = score_quality(docs, voters, keep=["text", "row_key"])
    assert out.columns == ["kept_text", "kept_row_key", "doc_id", "held_out", "score", "predicted"] and out.count() == len(rows)
    assert out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert len({x.score for x in out.where("coalesce(kept_text, '') = ''").select("score").collect()}) == 1
    assert score_quality(nothing, voters).count() == 0
    none = fit_voters(docs, labels.where("doc_id < 0"))
    assert {x.score for x in score_quality(docs, none).collect()} == {0.5}
    a, b = (score_quality(docs.withColumn("source", F.lit(s)), voters).select("doc_id", "score").collect() for s in "xy")
    assert sorted(map(str, a)) == sorted(map(str, b))
