"""Periodic runs against a brute-force search."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from hectare.llm.runs import Grammar, op11_word_runs, periodic_runs, runs_of, word_runs


def brute(words, least=24, times=3):
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x, n, out = np.array([number[w] for w in words]), len(words), []
    for q in range(1, n // times + 1):
        same = np.concatenate(([False], x[q:] == x[:-q], [False]))
        edge = np.nonzero(same[1:] != same[:-1])[0]
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            own = x[s:e + q]
            if len(own) >= max(least, times * q) and not any(q % d == 0 and (own[d:] == own[:-d]).all() for d in range(1, q)):
                out.append((s, len(own), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(r):
    k, w = r.choice([1, 2, 3, 5, 30]), []
    for _ in range(r.randint(1, 12)):
        c = r.random()
        if c < 0.4:
            w += [r.randrange(k) for _ in range(r.randrange(12))]
        elif c < 0.8:
            unit = [r.randrange(k) for _ in range(r.randint(1, r.choice([3, 12, 40])))]
            w += (unit * 12)[:r.randint(1, len(unit) * 12)]
        elif w:
            s = r.randrange(len(w))
            w += w[s:s + r.randrange(60)]
    return [b"%d" % x for x in w]


def test_runs_equal_brute_force():
    r, found = random.Random(11), 0
    for _ in range(800):
        words = repetitive(r)
        want = brute(words)
        found += len(want)
        assert word_runs(words) == want
    assert found > 300


def test_known_words():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 500:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    letters = [c.encode() for c in fibonacci[-1]]
    assert word_runs(letters) == brute(letters) and word_runs(letters)
    assert word_runs([b"x"] * 24) == [(0, 24, 1)] and word_runs([b"x"] * 23) == []
    assert word_runs([b"%d" % (i % 9) for i in range(27)]) == [(0, 27, 9)] and word_runs([b"%d" % (i % 9) for i in range(26)]) == []
    assert runs_of([], 24, 3) == []


def test_grammar_derives_its_sequence():
    r = random.Random(3)
    for _ in range(100):
        ids = [int(w) for w in repetitive(r)] or [0]
        g = Grammar(ids)
        spell = lambda s: [s] if s < g.first_rule else spell(g.rules[s - g.first_rule][0]) + spell(g.rules[s - g.first_rule][1])
        assert spell(g.root) == ids
        for i, at in enumerate(g.place):
            if at >= 0:
                assert ids[at:at + g.length[i]] == spell(g.first_rule + i)


def test_operator_edges(docs, rows, nothing):
    got = periodic_runs(docs).collect()
    assert len(got) == len(rows)
    key = lambda x: (str(x[0]), x[1], x[2])
    want = []
    for row in rows:
        words = (row[1] or "").encode().split()
        runs = brute(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((row[0], runs, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    assert sorted([(x.doc_id, [tuple(r) for r in x.runs], x.collapsed) for x in got], key=key) == sorted(want, key=key)
    assert any(w[1] for w in want) and periodic_runs(nothing).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, least=8)


def test_query_equals_brute_force(spark, small):
    got = {x.doc_id: x for x in op11_word_runs(spark, small).collect()}
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(table)
    for d in table:
        words = (d.text or "").encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        x = got[d.doc_id]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        assert x.n_runs == len(runs) and (x.start, x.length, x.period) == (best or (None,) * 3)
        assert x.exponent_milli == (best and 1000 * best[1] // best[2])
        assert x.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
