import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, rid int, node int, row_key int, label int"


def words(r, n, stock=400):
    return [f"w{r.randint(0, stock)}" for _ in range(n)]


def edge_rows(seed=5):
    """Documents with copies, near copies, shared passages, nulls, empty, blank and long texts, repeated rows and ids."""
    r = random.Random(seed)
    base = [words(r, r.randint(3, 160)) for _ in range(40)]
    passage = words(r, 70)
    texts = [" ".join(b[:60]) + "\n" + " ".join(b[60:]) for b in base]
    for b in base[:12]:
        near = list(b)
        near[len(near) // 2] = "changed"
        texts += [" ".join(near), "  " + "\t".join(b) + "\n", " ".join(b).upper()]
    for _ in range(4):
        texts.append(" ".join(words(r, 20) + passage + words(r, 15)))
    texts += [None, "", " \n\t ", "one", "ONE ", "a b c d", "éß 漢字 😀", "x" * 30_000, " ".join(words(r, 20_000, 9_000)), "line\nline\nline\n\nother line of text"]
    texts += ["stutter stutter stutter stutter " * 9, "$$$ %%% !!!" * 20]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (7, "same id, other text"), (None, texts[5]), (None, None)]
    r.shuffle(rows)
    # extra columns carry names that the operators use themselves
    return [(i, t, r.choice(["en", None]), r.choice(["a", "a", "a", "b", None]), None if t is None else len(t), "d", 1, 2, 3, None) for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
