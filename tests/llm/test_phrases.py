"""Phrases against counts of all grams in dictionaries."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fairtract.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, h1 int, word string"


def plain(docs, top=2_000, least=10, share=50):
    by_lang = {}
    for text, lang in docs:
        grams = by_lang.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            grams.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang, f in by_lang.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = []
        for g, a in f.items():
            if len(g) == 1 or a < least:
                continue
            if len(g) == 2 and any(len(h) == 3 and c >= least and 100 * c >= share * a and g in (h[:2], h[1:]) for h, c in f.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        found.sort()
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)] + ["Éa", "x-y", "日本"]
    docs = [(" ".join(rng.choice(words, rng.integers(1, 40))) + str(rng.choice([".", "!\n", ""])), str(rng.choice(["en", "de"]))) for _ in range(150)]
    docs += [("one two, THREE four five six seven eight nine", "en")] * 12 + [("pair only", None), ("pair\tonly;", "und")] * 6
    docs += [("hot node " + f"v{i} v{i // 3} hot node u{i}", "en") for i in range(300)]
    return docs + [(None, "en"), ("", "en"), (None, None), (" .,; ", "fr"), ("a" * 5_000 + " b", "en")]


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 200, "many": 2}, {"bucket_bytes": 3_000, "many": 1}])
@pytest.mark.parametrize("top", [2_000, 7])
def test_same_phrases_as_dictionaries(spark, top, sizes):
    """Also with many small buckets, hot nodes in most slices, and lists that end in ties."""
    docs = corpus()
    df = spark.createDataFrame([(t, c, 1, "x") for t, c in docs], SCHEMA).repartition(5)
    assert rows(phrases.collocations(df, top, **sizes)) == plain(docs, top)


def test_empty_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None, 1, "x"), ("", "en", 1, "x")], SCHEMA)).count() == 0


def test_paths_are_compacted(spark):
    """A sentence of nine words is one path of seven edges between two ends; a branch cuts it."""
    docs = [("a b c d e f g h i", "en")] * 20 + [("d e f", "en")] * 10
    found = phrases.graph(spark.createDataFrame(docs, "text string, lang string"), 10)
    ends, steps = phrases.compact(found)
    paths = steps.groupBy("p1", "p2", "p3").agg(F.count("*").alias("n"), F.max("place").alias("last"), F.min("f").alias("f"), F.max("f").alias("g"))
    # a b c - b c d - c d e, then d e f of its own weight, then e f g - f g h - g h i.
    assert sorted((r.n, r["last"], r.f, r.g) for r in paths.collect()) == [(1, 0, 30, 30), (3, 2, 20, 20), (3, 2, 20, 20)]
    assert ends.count() == 4
    assert steps.where("begins").count() == 3 and steps.where("stops").count() == 3


def test_counts_over_64_bits(spark):
    big = 3_000_000_000_000
    df = spark.createDataFrame([(big, big, big + 1)], "a long, l long, r long")
    assert df.select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1_000_000 * big * big // (big * (big + 1))


def test_pieces_span_segments(monkeypatch):
    text = "aa bb cc dd. ee ff gg\nhh " * 40
    salts = np.array([7], np.uint64)  # of each text
    whole = phrases.Tokens(pa.array([text]), salts)
    monkeypatch.setattr(phrases, "SEGMENT", 17)
    cut = phrases.Tokens(pa.array([text]), salts)
    for name in ("starts", "lengths", "hashes", "last"):
        assert (getattr(whole, name) == getattr(cut, name)).all()
