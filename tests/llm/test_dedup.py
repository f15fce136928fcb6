"""Exact, near, line and passage deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hectare.llm import line_dedup
from hectare.llm.common import key_bits, key_filter, rows_among
from hectare.llm.exact_dedup import DigestIndex, exact_dedup
from hectare.llm.graph import components
from hectare.llm.hashing import LOWER, MinHash, common_size, shingle_sets, words
from hectare.llm.line_dedup import compared_lines, dedup_lines, starred, stretches
from hectare.llm.near_dedup import near_components, without_near_duplicates
from hectare.llm.near_dedup import SKETCH_BITS, likely, sketched
from hectare.llm.suffix_dedup import common_words, marked, merged_spans, minimisers, repeated_passages
from hectare.session import scratch_path

BLANK = re.compile(r"[\x20\x09-\x0D]+")


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.root(a)] = self.root(b)


def order(i):
    return (i is None, i or 0)


def test_exact_dedup(spark, docs, rows):
    index = DigestIndex(spark, scratch_path(spark, "index"))
    got = exact_dedup(docs, index, "one").collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(BLANK.sub("", r[1] or "").encode()).hexdigest()].append((-len(r[1] or ""), order(r[0]), r[0]))
    want = Counter()
    for digest, members in groups.items():
        members.sort()
        for i, m in enumerate(members):
            want[m[2], members[0][2], len(members), i == 0, digest] += 1
    assert Counter(map(tuple, got)) == want


def test_index_keeps_what_came_first(spark, docs, nothing):
    path = scratch_path(spark, "index")
    index = DigestIndex(spark, path, buckets=4)
    assert exact_dedup(nothing, index, "none").count() == 0 and index.read().count() == 0
    first = exact_dedup(docs.where("doc_id < 30"), index, "one").collect()
    stored = index.read().count()
    assert stored == len({r.text_sha256 for r in first}) == sum(r.kept for r in first)
    again = exact_dedup(docs.where("doc_id < 30"), index, "two").collect()
    assert not any(r.kept for r in again) and index.read().count() == stored
    more = exact_dedup(docs, DigestIndex(spark, path, buckets=4), "three").collect()
    known = {r.text_sha256: r.keep_id for r in first}
    assert all(not r.kept and r.keep_id == known[r.text_sha256] for r in more if r.text_sha256 in known)
    assert any(r.kept for r in more)


def test_append_reads_the_index_without_a_shuffle(spark, docs):
    index = DigestIndex(spark, scratch_path(spark, "index"), buckets=8)
    exact_dedup(docs, index, "one").count()
    fresh = docs.select(F.sha2("text", 256).alias("digest")).groupBy("digest").count()
    plan = fresh.hint("merge").join(index.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def shingle_set(text):
    w = [x for x in BLANK.split((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("percent", [85, 60])
def test_near_duplicates(docs, rows, percent):
    sets = [shingle_set(r[1]) for r in rows]
    g = Groups(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                g.join(i, j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[g.root(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    want = Counter((r[0], len(sets[i]), least[g.root(i)] if sets[i] else r[0], r[0] == (least[g.root(i)] if sets[i] else r[0])) for i, r in enumerate(rows))
    got = near_components(docs, percent=percent).drop("text_key")
    assert Counter(map(tuple, got.collect())) == want


def test_crowded_regions_lose_no_link(spark):
    """Many documents that differ a little from each other, most pairs of them just below the threshold."""
    r = random.Random(2)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
        texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    g = Groups(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                g.join(i, j)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in near_components(df).collect()}
    least = {}
    for i in range(len(texts)):
        least.setdefault(g.root(i), i)
    assert got == {i: least[g.root(i)] for i in range(len(texts))}


def test_near_duplicates_drop_rows(docs, nothing):
    kept = without_near_duplicates(docs, percent=80)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 3 in ids and ids.count(3) == 1 and len(ids) < docs.count()
    assert near_components(nothing).count() == 0 and without_near_duplicates(nothing).count() == 0


def test_word_hashes_tell_words_apart():
    texts = [b"ab ba  ab\n", b"", b" ", "é ab".encode(), b"x" * 300_000 + b" ab"]
    hashes, start, end, bounds = words(texts)
    assert list(np.diff(bounds)) == [3, 0, 0, 2, 2]
    assert hashes[0] == hashes[2] == hashes[4] == hashes[6] and len(set(hashes.tolist())) == 4
    assert [texts[0][a:b] for a, b in zip(start[:3], end[:3])] == [b"ab", b"ba", b"ab"]


def test_minhash_estimates_similarity():
    r = random.Random(1)
    a = [f"v{r.randint(0, 10**6)}" for _ in range(2000)]
    b = a[:1700] + [f"u{i}" for i in range(300)]
    sets = list(shingle_sets([" ".join(x).encode() for x in (a, b)], 1))
    true = common_size(*sets) / len(set(a) | set(b))
    m = MinHash(2048).of(np.concatenate(sets) >> np.uint64(32), np.array([0, len(sets[0])]))
    assert abs((m[0] == m[1]).mean() - true) < 0.05


def line_groups(rows, percent=80):
    occurrences = defaultdict(list)
    for i, r in enumerate(rows):
        for p, line in enumerate(compared_lines((r[1] or "").encode())):
            if line:
                occurrences[line].append((order(r[0]), i, p))
    lines = list(occurrences)
    sets = [set(stretches([x])[0].tolist()) for x in lines]
    g = Groups(len(lines))
    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                g.join(i, j)
    return occurrences, lines, g


def test_line_dedup(spark):
    r = random.Random(8)
    stock = [" ".join(f"tok{r.randint(0, 500)}" for _ in range(r.randint(1, 30))) for _ in range(60)]
    rows = []
    for i in range(60):
        lines = [r.choice(stock) for _ in range(r.randint(0, 6))]
        lines = [x if r.random() < 0.6 else x.replace("tok1", "tok2", 1) for x in lines]
        rows.append((i, "\n".join(x if r.random() < 0.9 else f"  {x.upper()} \t" for x in lines) if r.random() < 0.95 else None))
    occurrences, lines, g = line_groups(rows)
    first = {}
    for i, line in enumerate(lines):
        first[g.root(i)] = min(first.get(g.root(i), ((True, 0), 0, 0)), min(occurrences[line]))
    keep = {(i, p) for _, i, p in first.values()}
    got = {x.doc_id: x for x in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).select("document.doc_id", "n_lines", "n_kept", "text").collect()}
    for i, (doc, text) in enumerate(rows):
        whole, kept = (text or "").split("\n"), []
        for p, line in enumerate(compared_lines((text or "").encode())):
            if not line or (i, p) in keep:
                kept.append(whole[p])
        solid = sum(1 for x in kept if x.strip())
        n = sum(1 for x in whole if x.strip())
        assert (got[doc].n_lines, got[doc].n_kept, got[doc].text) == (n, solid, "" if n and not solid else "\n".join(kept))


def test_line_dedup_edges(docs, rows, nothing):
    out = dedup_lines(docs)
    assert out.columns == ["document", "n_lines", "n_kept", "text"] and out.count() == len(rows)
    got = out.select("document.*", F.col("text").alias("left"), "n_lines", "n_kept").collect()
    assert all(x.left == "" for x in got if x.text is None)
    repeated = [x for x in got if x.doc_id == 3]
    assert len({(x.left, x.n_kept) for x in repeated}) == 1
    assert all(x.left == "line\n\nother line of text" for x in got if x.text and x.text.startswith("line\nline"))
    assert dedup_lines(nothing).count() == 0


def test_a_hot_line_leaves_a_task_once():
    keys = np.full(5000, 7, np.uint64)
    key, node, a, b = starred(keys, np.arange(5000))
    assert len(key) == len(node) == 1 and len(a) < 10_000
    g = Groups(5000)
    for x, y in zip(a.tolist(), b.tolist()):
        g.join(x, y)
    assert len({g.root(i) for i in range(5000)}) == 1


def brute_passages(rows, least):
    """Word positions of later and of first occurrences, per row of distinct (id, text) in order."""
    texts = sorted({(order(r[0]), r[1] or "") for r in rows})
    seen, later, first = {}, defaultdict(set), defaultdict(set)
    for t, (_, text) in enumerate(texts):
        w = text.encode().split()
        for p in range(len(w) - least + 1):
            key = tuple(w[p : p + least])
            if key in seen:
                later[t].update(range(p, p + least))
                u, q = seen[key]
                first[u].update(range(q, q + least))
            else:
                seen[key] = (t, p)
    return texts, later, first


def test_passages(docs, rows):
    texts, later, first = brute_passages(rows, 50)
    got = defaultdict(list)
    for x in marked(docs, repeated_passages(docs)).select("document.doc_id", F.col("document.text").alias("body"), "text", "passages").collect():
        got[order(x.doc_id), x.body or ""].append(x)
    assert any(later.values())
    for t, key in enumerate(texts):
        for x in got[key]:
            marks = {True: set(), False: set()}
            for p in x.passages or []:
                a = len(key[1][: p["start"]].split())
                assert len(key[1][p["start"] : p["end"]].split()) == p["n_words"]
                marks[p["later"]].update(range(a, a + p["n_words"]))
            assert marks[True] == later[t]
            assert marks[True] | marks[False] >= first[t] | later[t]
            w = key[1].split()
            assert x.text.split() == [w[i] for i in range(len(w)) if i not in later[t]]


def test_passages_edges(docs, nothing):
    assert repeated_passages(nothing).count() == 0 and marked(nothing, repeated_passages(nothing)).count() == 0
    with pytest.raises(ValueError):
        repeated_passages(docs, least=30)
    assert merged_spans([(5, 9), (0, 3), (8, 12), (3, 4)]) == [(0, 4), (5, 12)]


def test_equal_passages_share_a_minimiser():
    r = np.random.default_rng(3)
    shared = r.integers(0, 2**63, 50).astype(np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([r.integers(0, 2**63, r.integers(0, 40)).astype(np.uint64), shared, r.integers(0, 2**63, 20).astype(np.uint64)]) for _ in range(2))
        at = [set((x - (len(y) - 70)) for x in minimisers(y, 35).tolist() if len(y) - 70 <= x <= len(y) - 70 + 34) for y in (a, b)]
        assert at[0] & at[1]


def test_components(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 400)]
    star = [(1000, x) for x in range(1001, 1200)]
    loose = [(r.randint(2000, 2600), r.randint(2000, 2600)) for _ in range(350)] + [(5, 5), (100, 101)]
    edges = chain + star + loose
    r.shuffle(edges)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    for per_task in (250_000, 60):
        got = {x.node: x.root for x in components(df, per_task).collect()}
        assert got == {x: root(x) for x in list(up) if root(x) != x}
    assert components(df.where("a < 0")).count() == 0


def test_key_filter_rejects_no_key(spark):
    df = spark.range(3000).select((F.col("id") * 7919 - 10**7).alias("k"))
    keys = df.where("k % 3 = 0")
    test = key_filter(keys, "k")
    passed = {x.k for x in df.where(test("k")).collect()}
    wanted = {x.k for x in keys.collect()}
    assert wanted <= passed and len(passed) < len(wanted) + 30
    bits = key_bits(keys, "k")
    assert {x.k for x in rows_among(df, bits, "k").collect()} == passed
    assert {x.k for x in rows_among(df, bits, "k", among=False).collect()}.isdisjoint(passed)


def test_lower_table():
    assert bytes(range(256)).translate(LOWER).count(b"a") == 2


@pytest.mark.parametrize("members", [3, 30, 200])
def test_passages_of_families_that_share_less(spark, members):
    """Cores of just under 50 words with different words around them hide no repeat that goes on to one side."""
    r = random.Random(members)
    rows = []
    for family in range(4):
        core = [f"f{family}c{i}" for i in range(45 + family + family // 3)]
        sides = [([f"l{family}v{v}w{i}" for i in range(40)], [f"r{family}v{v}w{i}" for i in range(40)]) for v in range(members)]
        for left, right in sides:
            rows.append(" ".join(left + core + right))
        for left, right in r.sample(sides, max(2, members // 4)):
            n = r.randint(1, 12)
            fresh = [f"x{r.randint(0, 10**9)}" for _ in range(60)]
            rows.append(" ".join(fresh[:30] + left[-n:] + core + fresh[30:] if r.random() < 0.5 else fresh[:30] + core + right[:n] + fresh[30:]))
    r.shuffle(rows)
    rows = list(enumerate(rows))
    texts, later, _ = brute_passages(rows, 50)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {x.doc_id: x.text.split() for x in marked(df, repeated_passages(df)).select("document.doc_id", "text").collect()}
    assert sum(map(len, later.values())) > 0
    for t, ((_, i), text) in enumerate(texts):
        w = text.split()
        assert got[i] == [w[k] for k in range(len(w)) if k not in later[t]]


@pytest.mark.parametrize("blocks", [1, 2])
def test_crowded_lines_are_ruled_out_before_they_are_compared(monkeypatch, blocks):
    """Only lines that a sketch leaves are cut into sets, and the components are those of all pairs."""
    r = random.Random(4)
    lines = ["".join(r.choice("abcdefgh ") for _ in range(r.choice((5, 8, 60, 400)))).encode() for _ in range(60)]
    lines += [x + b"zz" for x in lines[50:]]
    sets, own = [set(stretches([x])[0].tolist()) for x in lines], np.arange(len(lines)) % blocks
    left, right = np.flatnonzero(own == 0), np.flatnonzero(own == blocks - 1)
    want, got = Groups(len(lines)), Groups(len(lines))
    for i in left:
        for j in right:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                want.join(i, j)
    made, distinct = [], line_dedup.distinct
    monkeypatch.setattr(line_dedup, "distinct", lambda values: made.append(1) or distinct(values))
    for i, j in line_dedup.links_among(lines, np.arange(len(lines)), left, right, 80):
        got.join(i, j)
    root = lambda g: [g.root(i) for i in range(len(lines))]
    same = lambda g: {(i, j) for i in left for j in right if root(g)[i] == root(g)[j]}
    assert same(got) == same(want) and len(made) <= 20


def test_crowded_bands_lose_no_line(spark):
    """Lines of one template, most pairs below the threshold: the components are those of brute force over all pairs with a common band."""
    r = random.Random(6)
    template = [r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(160)]

    def varied(line, n):
        line = list(line)
        for at in r.sample(range(len(line)), n):
            line[at] = r.choice("0123456789")
        return line

    lines = [varied(template, 3) for _ in range(150)]
    lines += [varied(x, 1) for x in lines]
    rows = list(enumerate("".join(x) for x in lines))
    r.shuffle(rows)
    occurrences, found, g = line_groups(rows)
    first = {}
    for i, line in enumerate(found):
        first[g.root(i)] = min(first.get(g.root(i), (True, 0)), min(occurrences[line])[0])
    assert len(first) > 20
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {x.doc_id for x in dedup_lines(df, bands=40).where("n_kept = 1").select("document.doc_id").collect()}
    assert got == {i for _, i in first.values()}


def test_sketches_of_short_texts_rule_no_link_out():
    r = random.Random(9)
    hashed = MinHash(SKETCH_BITS, seed=53)
    for percent, n, m in ((85, 7, 6), (85, 14, 12), (85, 20, 17), (80, 5, 4), (80, 10, 8), (80, 20, 16)):
        for _ in range(60):
            x = np.array([r.randrange(1 << 32) for _ in range(n)], np.uint64)
            one, other = sketched(hashed.of(np.concatenate([x, x[:m]]), np.array([0, n]))).view(np.uint64)
            assert likely(one, other, np.array(n), np.array(m), percent)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_of_short_texts(spark, percent):
    r = random.Random(percent)
    texts = []
    for _ in range(150):
        w = [f"w{r.randint(0, 10**6)}" for _ in range(r.randint(5, 30))]
        texts += [" ".join(w), " ".join(w[:-1] if r.random() < 0.5 else w[1:]), " ".join([*w, "more"])]
    sets = [shingle_set(t) for t in texts]
    g = Groups(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                g.join(i, j)
    least = {}
    for i in range(len(texts)):
        least.setdefault(g.root(i), i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in near_components(df, percent=percent, least_depth=2).collect()}
    assert got == {i: least[g.root(i)] for i in range(len(texts))}


@pytest.mark.parametrize("partitions", ["4", "16"])
def test_index_opened_with_other_partitions(spark, partitions):
    """The bucket number belongs to the index, not to the session that opens it."""
    texts = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    path, before = scratch_path(spark, "index"), spark.conf.get("spark.sql.shuffle.partitions")
    assert exact_dedup(texts, DigestIndex(spark, path, buckets=8), "one").where("kept").count() == 200
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        index = DigestIndex(spark, path)
        assert exact_dedup(texts, index, "two").where("kept").count() == 0 and index.read().count() == 200
        with pytest.raises(ValueError):
            DigestIndex(spark, path, buckets=int(partitions))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_common_words():
    a = np.array([7, 1 << 31, 3, 9], ">u4").tobytes()
    for n in range(5):
        assert common_words(a, a[: 4 * n]) == n
    assert common_words(a, np.array([7, 1 << 31, 2, 9], ">u4").tobytes()) == 2 and common_words(b"", a) == 0


def test_pairs_of_suffixes_are_decided_by_extension(spark):
    """Two texts with one passage: no window is hashed; the neighbours are extended to exactly the common words."""
    r = random.Random(12)
    rows = []
    for pair in range(30):
        passage = [f"p{pair}w{i}" for i in range(r.choice([49, 50, 51, 80, 200]))]
        rows += [" ".join([f"a{r.random()}" for _ in range(r.randint(0, 60))] + passage + [f"z{r.random()}" for _ in range(r.randint(0, 60))]) for _ in range(2)]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    texts, later, first = brute_passages(rows, 50)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for x in marked(df, repeated_passages(df)).select("document.*", "passages").collect():
        got = {True: set(), False: set()}
        for p in x.passages or []:
            a = len(x.text[: p["start"]].split())
            got[p["later"]].update(range(a, a + p["n_words"]))
        assert got[True] == later[x.doc_id] and got[False] == first[x.doc_id]


@pytest.mark.parametrize("period", [1, 7, 34, 36, 51])
def test_passages_of_periodic_texts(spark, period):
    """Blocks that repeat inside their own window, in one text and in several."""
    unit = [f"u{i}" for i in range(period)]
    rows = [" ".join((unit * 300)[k : k + n]) for k, n in ((0, 170), (3, 120), (0, 49), (5, 50), (1, 260))]
    rows = [(i, f"only{i} {t} end{i}" if i % 2 else t) for i, t in enumerate(rows)]
    texts, later, _ = brute_passages(rows, 50)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.text.split() for x in marked(df, repeated_passages(df)).select("document.doc_id", "text").collect()}
    for t, ((_, i), text) in enumerate(texts):
        assert got[i] == [w for k, w in enumerate(text.split()) if k not in later[t]]


def test_lines_as_compared():
    r = random.Random(8)
    for _ in range(3000):
        text = bytes(r.choice(b" \t\n\x0b\x0c\rabZ\x00\x1c\xc3") for _ in range(r.randint(0, 30)))
        assert compared_lines(text) == [b" ".join(x.split()) for x in text.translate(LOWER).split(b"\n")]
