"""Near duplicates against all pairs in plain Python."""

import random
import re

import pytest

from fairtract.llm import near
from fairtract.llm.graph import components

DOCS = "doc_id long, component_id string, text string, kept int"


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1)))


def plain(docs, k, percent):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingles(t, k))
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and root(x) != root(y):
                if any(100 * len(s & t) >= percent * len(s | t) for s in sets[x] for t in sets[y] if s and t):
                    a, b = sorted((root(x), root(y)))
                    parent[b] = a
    rows = []
    for i, t in docs:
        component = None if i is None else root(i)
        rows.append((i, len(shingles(t, k)), component, i is None or i == component))
    return sorted(rows, key=str)


def found(spark, docs, k, percent=80):
    df = spark.createDataFrame([(i, "x", t, 0) for i, t in docs], DOCS)
    return sorted(map(tuple, near.near_duplicates(df, k, percent).collect()), key=str)


def hard_cases():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = ["", None, "one", "ONE", "one two", "One  two\n", "two one", " \t", "ünï cödé wörds", "ÜNÏ cödé wörds"]
    # A chain whose ends are far apart, longer than one round can join.
    line = [word() for _ in range(400)]
    texts += [" ".join(line[i : i + 120]) for i in range(0, 280, 7)]
    # Copies of one base, each changed elsewhere: like the base, not like each other.
    base = [word() for _ in range(200)]
    texts.append(" ".join(base))
    for i in range(60):
        copy = base[:]
        for j in rng.sample(range(200), 9):
            copy[j] = word()
        texts.append(" ".join(copy))
    # The same without the base.
    other = [word() for _ in range(200)]
    for i in range(40):
        copy = other[:]
        for j in rng.sample(range(200), 7):
            copy[j] = word()
        texts.append(" ".join(copy))
    texts += [texts[60]] * 30
    return texts


@pytest.mark.parametrize("k", [2, 5])
def test_hard_cases(spark, k):
    docs = [(i, t) for i, t in enumerate(hard_cases())]
    random.Random(k).shuffle(docs)
    docs += [(None, "one two"), (None, docs[3][1]), docs[5], (7, "one two three"), (3, "again other text")]
    assert found(spark, docs, k) == plain(docs, k, 80)


def test_cells_find_what_stars_miss(spark, monkeypatch):
    # Cells of two rows: buckets are cut into many of them.
    monkeypatch.setattr(near, "CELL", 2)
    docs = list(enumerate(hard_cases()))
    assert found(spark, docs, 2) == plain(docs, 2, 80)


def test_empty_table(spark):
    assert found(spark, [], 5) == []


def test_survivors_keep_likely_pairs():
    assert near.least_matches(30, 80, 1e-6) < 30 * 0.8 < 30
    assert near.least_matches(150, 80, 1e-6) > 85


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    rows = dict(map(tuple, components(links).collect()))
    assert rows == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
