"""Mixing and url rules against plain Python."""

import hashlib
import random
import re

import pytest

from fairtract.llm import mixing, urls

DOCS = "doc_id long, source string, text string, target int"


def targets(sizes, weights, cap):
    """Clamp and reshare round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, clamped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in clamped]
        left = total - sum(clamped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] >= cap * sizes[s]]
        if not over:
            return {**clamped, **share}
        clamped.update({s: cap * sizes[s] for s in over})
        if len(clamped) == len(order):
            return clamped


def mixed(spark, docs, **options):
    return mixing.mix_sources(spark.createDataFrame(docs, DOCS), **options).collect()


def test_mix_reaches_its_targets(spark):
    rng = random.Random(4)
    docs = []
    for i in range(900):
        source = rng.choice(["a"] * 6 + ["b", "Z", "ü", "c", "", None])
        docs.append((i, source, " ".join(["w"] * rng.randrange(60)), 0))
    docs += [(1000, "empty", None, 0), (1001, "empty", "", 0), (None, "a", "x y", 0), (None, "a", None, 0), docs[5], docs[5]]
    rows = mixed(spark, docs)
    size = {}
    for _, s, t, _ in docs:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, longest = targets(size, mixing.WEIGHTS, 3), max(r.size for r in rows)
    assert len(rows) == len(docs)
    for s in size:
        own = [r for r in rows if r.source == s]
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == size[s]
        assert abs(sum(r.taken for r in own) - want[s]) <= longest / 2 + 1e-6
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
    again = mixed(spark, docs[::-1])
    assert sorted(map(str, rows)) == sorted(map(str, again))
    other = mixed(spark, docs, seed=7)
    assert sorted(map(str, rows)) != sorted(map(str, other))
    out = mixing.drawn(mixing.mix_sources(spark.createDataFrame(docs, DOCS)))
    assert out.columns == ["doc_id", "source", "text", "target"] and out.count() == sum(r.copies for r in rows)


def test_mix_of_nothing_and_of_one_source(spark):
    assert mixed(spark, []) == []
    rows = mixed(spark, [(1, "a", "x y z", 0), (2, "a", "x", 0)])
    assert [r.taken for r in sorted(rows, key=lambda r: r.doc_id)] == [3, 1]


def test_order_is_that_of_the_digest(spark):
    docs = [(i, s, "w " * 10, 0) for i in range(40) for s in "ab"]
    rows = mixed(spark, docs, weights=(3.0, 1.0))
    more = {r.doc_id for r in rows if r.source == "a" and r.copies == 2}
    ranked = sorted(range(40), key=lambda i: hashlib.md5(f"42 {i}".encode()).hexdigest())
    assert more == set(ranked[: len(more)]) and len(more) == 20


RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
    ("block", "a.com", ""), ("allow", "a.com", "/ok"), ("block", "a.com", "/ok/not"), ("allow", "x.a.com", "/"), ("block", "a.com", "/ok"),
    ("block", "com", "/ü"), ("block", "xample.org", "/"), ("block", None, "/none"), ("block", "b.c", None),
]
URLS = [
    None, "", "no url", "://", "http://", "http://ORG", "https://Blog.Example.ORG/es/1?x#y", "http://example.org/es", "http://example.org/en/12",
    "http://a.com", "http://a.com/ok", "http://a.com/ok/not/1", "http://y.a.com/okay", "http://x.a.com/ok/not", "http://x.a.com?q=/ok", "ftp://aa.com/de/",
    "http://com/fr/", "http://b.c/anything", "http://..a.com/ok", "http://a.com./ok", "http://z.com/ü/1", "x http://org/a://b", "http://a.com#/ok", "http://myexample.org/es/",
]


def judged(url, rules, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
    best = None
    if host:
        for v, h, p in rules:
            h, p = h or "", p or ""
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                key = (len(h + p), len(h.split(".")), v)
                if best is None or key > best[0]:
                    best = (key, h + p, v)
    return host, path, best and best[1], best[2] if best else default


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_urls_equal_plain_rules(spark, partitions):
    rows = [(i % 7, u, "x") for i, u in enumerate(URLS * 3)] + [(None, "http://org/1", None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pages = spark.createDataFrame(rows, "page_id long, url string, host string")
        found = urls.judge_urls(pages, urls.rules_table(spark, RULES)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = [(i, u, *judged(u, RULES)) for i, u, _ in rows]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_urls_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = urls.rules_table(spark, [("block", "zz", "/")]).limit(0)
    assert urls.judge_urls(pages, none, "block").head().verdict == "block"
    assert urls.judge_urls(pages.limit(0), urls.rules_table(spark, RULES)).count() == 0
