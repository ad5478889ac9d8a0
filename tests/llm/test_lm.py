"""The language model against one counted with plain dictionaries."""

import math
import re
import shutil
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import pytest

from fairtract.llm import lm
from fairtract.llm.queries import op4_language_model

DOCS = "doc_id long, source string, text string, n_words long"


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["</s>"]


class Plain:
    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            ts = tokens(t)
            self.words.update(ts)
            self.pairs.update(zip(["<s>", *ts[:-1]], ts))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.before = Counter(w for _, w in self.pairs)
        self.after = defaultdict(Counter)
        self.total = Counter()
        for (h, _), c in self.pairs.items():
            self.after[h][min(c, 3)] += 1
        for (h, _), c in self.pairs.items():
            self.total[h] += c
        count = lambda values: [sum(1 for x in values if x == i) for i in (1, 2, 3, 4)]
        self.high, self.low = lm.discounts(*count(self.pairs.values())), lm.discounts(*count(self.before.values()))
        self.types = len(self.pairs)
        self.spare = sum(self.low[min(c, 3) - 1] for c in self.before.values()) / self.types

    def p(self, h, w):
        b = self.before[w]
        low = (b - (self.low[min(b, 3) - 1] if b else 0)) / self.types + self.spare / (self.v + 1)
        if h not in self.total:
            return low
        c = self.pairs[h, w]
        spare = sum(self.high[i - 1] * n for i, n in self.after[h].items())
        return (c - (self.high[min(c, 3) - 1] if c else 0) + spare * low) / self.total[h]

    def score(self, text):
        ts = tokens(text)
        base = sum(math.log10((self.words[t] + 0.1) / (self.n + 0.1 * (self.v + 1))) for t in ts)
        own = sum(math.log10(self.p(h, t)) for h, t in zip(["<s>", *ts[:-1]], ts))
        return len(ts), sum(t in self.words for t in ts), base, own


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def same(rows, docs):
    plain = Plain([t for i, t in docs if not held_out(i)])
    found = {(r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows}
    want = set()
    for i, t in docs:
        n, known, base, own = plain.score(t)
        want.add((i, n, round(base, 6), round(own, 6)))
        assert all(r.n_known == known for r in rows if r.doc_id == i and r.n_tokens == n)
    assert found == want and len(rows) == len(docs)
    assert {r.train_tokens for r in rows} == {plain.n}
    return plain


def test_odd_rows(spark):
    texts = ["a b a b c", "A b\tc\nc  c", "", None, "é É \x1f x", "a " * 700, "b a", "a b a b c"] * 4 + ["rare once"]
    docs = list(enumerate(texts)) + [(None, "a b"), (3, "a b"), (3, "a b")]
    rows = lm.score_held_out(spark.createDataFrame([(i, "s", t, 0) for i, t in docs], DOCS)).collect()
    plain = same(rows, docs)
    for h in ["a", "<s>", "b"]:
        total = sum(plain.p(h, w) for w in [*plain.words, "never met"])
        assert total == pytest.approx(1)


def test_empty_table(spark):
    assert lm.score_held_out(spark.createDataFrame([], DOCS)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op4_language_model(spark, sf).collect()
    same(rows, docs)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_frequent_histories_are_spread(spark):
    docs = spark.createDataFrame([(i, "s", " ".join(f"the w{i}x{j}" for j in range(50)), 0) for i in range(40)], DOCS)
    meta = lm.fit(docs)
    own = lm.Model(meta)
    full = [b for b in range(meta.pair_buckets) if len(own.file("pairs", b, "<u8"))]
    assert len(full) == meta.pair_buckets


def test_a_missing_file_is_an_error(spark, tmp_path):
    """Wherever a model's folder lies and whatever a bucket holds, a lost file is no empty one."""
    docs = [(i, "s", " ".join(f"w{(i * 7 + j * j) % 90}" for j in range(40)), 0) for i in range(60)]
    df = spark.createDataFrame(docs, DOCS)
    meta = lm.fit(df, str(tmp_path / "model"))
    assert meta.path.startswith("file:")
    scored = df.selectExpr("doc_id", "true as held_out", "text")
    assert lm.score(scored, meta).count() == 60
    for name in ("pairs", "words", "history"):
        lost = next(p for p in sorted((tmp_path / "model").iterdir()) if p.name.startswith(f"{name}-") and p.stat().st_size)
        content = lost.read_bytes()
        lost.unlink()
        # Another folder name, as workers remember the files that they have opened.
        moved = tmp_path / f"model-without-{name}"
        shutil.copytree(tmp_path / "model", moved)
        with pytest.raises(Exception, match="No such file"):
            lm.score(scored, replace(meta, path=f"file:{moved}")).collect()
        lost.write_bytes(content)
