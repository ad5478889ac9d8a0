"""Removal of earlier passages against windows held in a dictionary."""

import random
import re

import pytest

from fairtract.llm import passages

DOCS = "doc_id long, part int, text string, n_words string"


def plain(docs, window):
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, docs[i][1] or ""))
    seen, out = set(), {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", docs[i][1] or "") for i in order}
    for i in order:
        ws, gone = words[i], set()
        for p in range(len(ws) - window + 1):
            key = tuple(ws[p : p + window])
            if key in seen:
                gone.update(range(p, p + window))
            seen.add(key)
        out[i] = (docs[i][0], len(ws), len(gone), " ".join(x for p, x in enumerate(ws) if p not in gone))
    return sorted(out.values(), key=str)


def found(spark, docs, window):
    df = spark.createDataFrame([(i, 7, t, "x") for i, t in docs], DOCS)
    rows = passages.remove_repeats(df, window).select("doc_id", "n_words", "n_removed", "kept_text", "rest", "spans").collect()
    for r in rows:
        assert r.rest.part == 7 and sum(s.stop - s.start for s in r.spans) == r.n_removed
    return sorted((tuple(r)[:4] for r in rows), key=str)


def cases():
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    shared = [[word() for _ in range(rng.randrange(18, 90))] for _ in range(6)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "only a few words"), (4, "ä " * 70), (5, "x y " * 40), (None, "x y " * 40)]
    for i in range(10, 160):
        ws = []
        for _ in range(rng.randrange(6)):
            ws += rng.choice(shared) if rng.random() < 0.4 else [word() for _ in range(rng.randrange(40))]
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(ws)))
    docs += [docs[40], docs[40], (50, docs[60][1]), (None, docs[70][1]), (None, docs[70][1])]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("window", [20, 6])
@pytest.mark.parametrize("part_chars", [2_000_000, 500])
def test_equal_to_a_dictionary(spark, monkeypatch, window, part_chars):
    monkeypatch.setattr(passages, "PART_CHARS", part_chars)
    docs = cases()
    assert found(spark, docs, window) == plain(docs, window)


def test_many_copies_cost_a_row_per_part(spark, monkeypatch):
    monkeypatch.setattr(passages, "PART_CHARS", 5000)
    text = " ".join(f"w{i}" for i in range(50))
    docs = [(i, text) for i in range(300)]
    assert found(spark, docs, 20) == plain(docs, 20)


def test_empty_table(spark):
    assert found(spark, [], 20) == []


def test_results_come_through_anchors(spark, monkeypatch):
    """Without hits nothing goes, in one part or in many: the whole table of sf0.01 lies in one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    removed = lambda: passages.remove_repeats(docs).agg({"n_removed": "sum"}).first()[0]
    assert removed() > 50_000

    def no_hits(key, table):
        return table.slice(0, 0)

    monkeypatch.setattr(passages, "_hits", no_hits)
    assert removed() == 0
