"""Small documents with every awkward case, as a plain list and as a frame."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n int, block int, label double, digest string, size bigint, members string"


def make_texts() -> list[tuple]:
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    base = words(120)
    passage = " ".join(words(80))
    rows = []
    add = lambda t, source="a", id=None: rows.append((len(rows) if id is None else id, t, source))
    add(None)
    add("")
    add("   \n\t ")
    add("one")
    add("one two three")
    add("One TWO three\n\n")
    add(" ".join(base))
    add(" ".join(base).upper(), "b")
    for k in range(6):  # near copies
        w = list(base)
        w[10 + 9 * k] = "changed"
        add(" ".join(w), "b")
    add(" ".join(base[:60] + words(60)), None)  # half alike: no near copy
    for _ in range(4):
        add(" ".join(words(40)) + "\n" + passage + "\n" + " ".join(words(40)), "c")
    for _ in range(12):
        add(" ".join(words(rng.randint(5, 90))), rng.choice(["a", "b", "c", None, ""]))
    add("The same Line of enough length\nother\n  the same line of enough length \nthe same line of enough length", "d")
    add("x\r\nTHE SAME LINE OF ENOUGH LENGTH\ny", "d")
    add("the same line of enough length", "d")
    add("ÄÖÜ straße 世界 café naïve " * 8, "e")
    add("ab " * 900, "e")
    add(" ".join(words(6000)), "long")
    rows.append(rows[6])  # a repeated row
    rows.append(rows[6])
    rows.append((None, "a text without an id that is long enough to have shingles", None))
    rows.append((None, " ".join(base), "a"))
    return rows


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, s, None, "k", 1, 2, 0.5, "d", 7, "m") for i, t, s in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def unique_docs(spark, texts):
    """Without null or repeated ids."""
    seen = {}
    for i, t, s in texts:
        if i is not None:
            seen.setdefault(i, (i, t, None, s, None, "k", 1, 2, 0.5, "d", 7, "m"))
    return spark.createDataFrame(list(seen.values()), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
