"""Encoding, quality, main text, neighbours and token counts against plain versions."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from fairtract.llm import bpe, html, neighbours, quality, token_counts

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


# ---- byte-pair encoding ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts(library):
    rng = random.Random(1)
    pool = "aabbbccc  \t\n\x1c\x1f\x85\xa0éÉ\u0301ΣσΑßİıǅ0١½'''sStTrReE<|endoftext|><|startoftext|>中あ😀👍🏽#@!?...-_ﬁ\u2003\u200b\u3000"
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|>b", "it's I'LL we'Ve", "a" * 3000, "ab" * 700, "Σ ΑΣ"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(800)]
    names = sorted(library.get_vocab())
    texts += ["".join(rng.choice(names).replace("</w>", "") for _ in range(4)) for _ in range(800)]
    return texts + ["".join(rng.choice("abth") for _ in range(150)) for _ in range(100)]


def test_encoder_equals_the_library(library):
    code = bpe.Encoder(PATH)
    for text in odd_texts(library):
        ids = np.frombuffer(code.encode(text), np.int32)
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text)
        body, _ = code.decode(ids, np.array([0, len(ids)]))
        assert body.tobytes().decode() == library.decode(want, skip_special_tokens=False)


def test_encode_rows(spark, library, monkeypatch):
    texts = [None, "", "one two", "One  two", "x" * 500, "ünï <|endoftext|>"] * 3
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    found = {(r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode(docs, PATH).collect()}
    want = set()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i if i else None, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    assert found == want
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_word_memory_is_bounded_in_bytes(library, monkeypatch):
    """Long words, as of scripts without spaces or encoded data, are not remembered, short ones up to a number of bytes."""
    monkeypatch.setattr(bpe, "REMEMBERED", 10_000)
    code = bpe.Encoder(PATH)
    rng = random.Random(2)
    texts = [f"w{i} again " + "".join(rng.choice("ก字aZ9+/") for _ in range(3_000)) for i in range(200)]
    for text in texts:
        assert np.frombuffer(code.encode(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
        assert sum(bpe.ENTRY + 4 * len(w) + len(i) for w, i in code.words.items()) <= 11_000
        assert max(map(len, code.words)) <= bpe.LONGEST


def test_words_that_come_again_outlast_rare_ones(monkeypatch):
    """When the memory is full, rare words go and a word that comes again and again stays."""
    monkeypatch.setattr(bpe, "REMEMBERED", 10_000)
    code, encoded = bpe.Encoder(PATH), []
    plain = code.word
    monkeypatch.setattr(code, "word", lambda word: encoded.append(word) or plain(word))
    for i in range(500):
        code.encode(f"w{i} again")
    assert encoded.count("again") == 1 and len(encoded) == 501
    assert len(code.words) + len(code.older) <= 10_000 // bpe.ENTRY + 2


def test_memory_of_a_batch_is_bounded(monkeypatch):
    """A batch of large texts is encoded in runs, of which each frees what it took to decode the one before."""
    texts = [None, "", *["again and again " * 625] * 400]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(402)), "text": texts})
    coded = bpe._coded(PATH)
    bpe.encoder(PATH)
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in coded([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 402 and peak < 40_000_000
    found = pa.Table.from_batches(coded([batch]))
    monkeypatch.setattr(bpe, "BATCH_CHARS", 10**9)
    assert found.equals(pa.Table.from_batches(coded([batch])))


# ---- quality -----------------------------------------------------------------------------------


def judged(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {j for starts in at.values() if len(starts) > 1 for i in starts for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    raw = text.encode()
    ratio = len(raw) / len(zstandard.ZstdCompressor(level=3).compress(raw)) if raw else 1.0
    low, high = quality.band(len(raw))
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated), failed, ratio, low <= ratio <= high)


def test_quality_equals_plain(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlué") for _ in range(rng.randrange(1, 9)))
    texts = [None, "", " \n\t", "a b c a b c", "x\nx\n\nx \nx", "#*$%&|<> é", "ab " * 400, "\x1c\x85\xa0 z"]
    texts += [" ".join(word() for _ in range(rng.randrange(200))) + "\n" + word() for _ in range(60)]
    texts.append("".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ/+") for _ in range(9000)))
    texts.append(" ".join("%06d" % i for i in range(3000)))
    docs = [(i % 40, t) for i, t in enumerate(texts)] + [(None, "a b")]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, ratio double")
    for r, (i, t) in zip(quality.judge(df.coalesce(1)).collect(), docs):
        *figures, ratio, inside = judged(t)
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (i, *figures)
        assert r.ratio == pytest.approx(ratio)
        assert r.kept == (not r.base_failed and inside and r.bad_chunks <= quality.MAX_BAD_CHUNKS)
    assert quality.judge(df.limit(0)).count() == 0


def test_quality_bands():
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 10))) for _ in range(4000)]
    prose = " ".join(rng.choice(words) for _ in range(3000))
    noise = " ".join("".join(rng.choice("".join(map(chr, range(33, 127)))) for _ in range(60)) for _ in range(80))
    loops = " ".join(words[:120]) + " " + " ".join(" ".join(words[:60]) + f" x{i}" for i in range(40))
    c = zstandard.ZstdCompressor(level=3)

    def inside(text):
        ratio, bad = quality.ratios(text.encode(), c)
        low, high = quality.band(len(text.encode()))
        return low <= ratio <= high and bad <= quality.MAX_BAD_CHUNKS

    assert inside(prose) and not inside(noise) and not inside(loops)


LICENCE = """Permission is hereby granted, free of charge, to any person who gets a copy of this work, to use it without
limits, to change it, to pass it on and to sell it, on these terms. The notice above goes with every copy or large part of
the work. The work comes as it is, without warranty of any kind, stated or implied, be it of fitness for a purpose or of
title. In no event shall the makers be liable for any claim, damages or other liability, whether in an action of contract,
tort or otherwise, that arises from the work or its use. You may charge a fee for handing over a copy, and you may offer
warranty in exchange for a fee. You must cause changed files to carry plain notices that you changed them and on what day.
If distribution is made by offering access to copy from a named place, then offering equal access to the source from the
same place counts as distribution of the source, even though third parties are not compelled to copy it along."""
CODE = """def read(path, limit=None):
    rows = []
    with open(path, encoding="utf-8") as source:
        for number, line in enumerate(source):
            if limit is not None and number >= limit:
                break
            key, _, value = line.rstrip().partition("=")
            rows.append((key.strip(), value.strip()))
    return rows


class Table:
    def __init__(self, rows):
        self.rows = dict(rows)

    def get(self, key, default=None):
        return self.rows.get(key, default)

    def merge(self, other):
        for key, value in other.rows.items():
            if key not in self.rows:
                self.rows[key] = value
        return self

    def write(self, path):
        with open(path, "w", encoding="utf-8") as target:
            for key in sorted(self.rows):
                target.write(f"{key} = {self.rows[key]}\n")
"""
CYRILLIC = """Каждый человек имеет право на образование. Образование должно быть бесплатным по меньшей мере в том, что касается
начального и общего образования. Начальное образование должно быть обязательным. Техническое и профессиональное образование
должно быть общедоступным, и высшее образование должно быть одинаково доступным для всех на основе способностей каждого.
Образование должно быть направлено к полному развитию человеческой личности и к увеличению уважения к правам человека."""


def test_wide_bands_keep_real_text(spark):
    """Licence prose, code and another script stay as they are and put together; noise and loops go."""
    rng = random.Random(9)
    noise = " ".join("".join(rng.choice("".join(map(chr, range(33, 127)))) for _ in range(50)) for _ in range(120))
    loop = " ".join(f"{LICENCE[:150]} {i}" for i in range(300))
    texts = [LICENCE, CODE, CYRILLIC, LICENCE + "\n" + CODE + "\n" + CYRILLIC, noise, loop]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.kept for r in quality.judge(df.coalesce(1)).collect()] == [True] * 4 + [False] * 2


def shares(spark, path, bands):
    """Rejected shares of low-quality and of good labelled documents that pass the base rule."""
    docs, labels = (spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "labels"))
    found = quality.judge(docs, bands).where("not base_failed").join(labels, "doc_id")
    gone = {r.quality: r.gone / r.n for r in found.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("gone")).collect()}
    return gone[0], gone[1]


def test_fitted_bands_reject_low_quality_elsewhere(spark):
    """Bands fitted on one table, and its documents, judge another one: at least half of the low-quality documents
    go there and one in fifty good ones at most."""
    fitted = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{fitted}/{n}.parquet") for n in ("documents", "labels"))
    bands = quality.fit_bands(docs, labels)
    low, good = shares(spark, "/root/testdata/sf0.01", bands)
    assert low >= 0.5 and good <= 0.02
    low, good = shares(spark, fitted, bands)
    assert low >= 0.5 and good <= 0.01
    # A smaller sample of the same table gives bands of the same kind.
    assert len(quality.fit_bands(docs, labels, rows=500).plain) == len(quality.STARTS)


def test_bands_are_fitted_on_all_good_documents(spark):
    """Sixty long texts among 45,000: enough to fit their band, but not in a sample of 20,000."""
    texts, rng = [], random.Random(11)
    for i in range(61):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9))) for _ in range(40 + i)]
        texts.append(" ".join(rng.choice(words) for _ in range(400))[: 1800 if i else 400])
    n = 45_000
    table = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    docs = spark.range(n).withColumn("k", F.greatest(F.col("id") - (n - 61), F.lit(0))).join(F.broadcast(table), "k")
    docs = docs.select(F.col("id").alias("doc_id"), "text")
    bands = {start: (low, high) for start, low, high in quality.fit_bands(docs, docs.select("doc_id", F.lit(1).alias("quality"))).plain}
    compressor = zstandard.ZstdCompressor(level=quality.LEVEL)
    ratio = [len(t) / len(compressor.compress(t.encode())) for t in texts]
    for start, own in ((256, ratio[:1]), (1536, ratio[1:])):
        assert bands[start] == pytest.approx(tuple(np.quantile(own, quality.QUANTILES) * quality.MARGINS))


def test_bands_without_labels_are_wide(spark):
    docs = spark.createDataFrame([(1, None), (None, "x y"), (2, "a b c")], "doc_id long, text string")
    for known in ([], [(1, 1), (2, None), (None, 1)]):
        bands = quality.fit_bands(docs, spark.createDataFrame(known, "doc_id long, quality int"))
        assert (bands.plain_chunk, bands.other_chunk) == (quality.WIDE.plain_chunk, quality.WIDE.other_chunk)
        assert all(quality.band(start, quality.WIDE.plain) == tuple(limits) for start, *limits in bands.plain)


def test_quality_of_texts_unlike_the_sample(spark):
    rng = random.Random(4)
    cyrillic = [chr(c) for c in range(0x430, 0x450)]
    words = ["".join(rng.choice(cyrillic) for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    numbers = " ".join(f"{rng.randrange(1000)}" for _ in range(900))
    texts = [" ".join(rng.choice(words) for _ in range(400)), numbers, "ab cd1 " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.kept for r in quality.judge(df.coalesce(1)).collect()] == [True, True, False]


# ---- main text ---------------------------------------------------------------------------------


def page(i, body):
    return (
        f'<html><head><title>T{i}</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body><header><h1>Site</h1></header>'
        f'<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>{body}'
        f'<div class="box">All rights reserved. Call us on {i} for offers.</div><aside>See also</aside><section id="comments"><p>me too</section>'
        f"<form><label>Mail</label><input></form><footer>&copy; us</footer></body></html>"
    )


def test_main_text(spark):
    rows = []
    for i in range(30):
        article = f"<article><header><h2>Head {i} &amp; tail</h2></header><p>First &lt;{i}&gt;\n  text<br>line<p><b>Second</b> part {i * 7}&nbsp;x<ul><li>a<li>b{i}</ul></article>"
        rows.append((i, f"http://a.com/{i}", page(i, article), "x"))
    # The same without an article element: only the site's repeated box is known to be dull.
    rows += [(100 + i, f"http://b.com/{i}", page(i, f"<div id='body'><p>Text {' '.join(f'w{i}x{j}' for j in range(5))}</p></div>"), "x") for i in range(30)]
    rows += [(200, None, "plain", None), (201, "http://c.com", None, None), (None, "http://c.com", "", None), (200, None, "plain", None)]
    rows += [(202, "http://d.com", "<p>un<b>closed &am &copy; &#x41;&#66; <!-- no --> <div class=ad>buy<p>now</div> end", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = {}
    for r in html.extract(df).collect():
        found.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert len(found) == 64
    for i in range(30):
        assert found[i] == [f"Head {i} & tail First <{i}> text line Second part {i * 7} x a b{i}"]
        assert found[100 + i] == ["Text " + " ".join(f"w{i}x{j}" for j in range(5))]
    assert found[200] == ["plain", "plain"] and found[201] == [""] and found[None] == [""]
    assert found[202] == ["unclosed &am © AB end"]
    assert html.extract(df.limit(0)).count() == 0


def test_given_pages_equal_their_articles(spark):
    import html as entities

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    own = {r.page_id: r.html for r in pages.collect()}
    for r in html.extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", own[r.page_id], re.S)[1]
        assert r.text == " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_importance_of_branches(spark):
    rows = [("h", f"<div class='same'>one text</div><div class='own'>text of page {'abcdefghij'[i]}</div>") for i in range(10)]
    tree = {r.branch: r for r in html.style_tree(spark.createDataFrame(rows, "host string, html string")).collect()}
    same = html.branch_of(html._ROOT, "div", [("class", "same")]).number
    own = html.branch_of(html._ROOT, "div", [("class", "own")]).number
    assert tree[same].importance == pytest.approx(0, abs=1e-9) and tree[own].importance == pytest.approx(html.DECAY)
    assert tree[same].n_pages == 10


def test_tree_decides_inside_articles_and_named_parts(spark):
    """Parts that no name gives away go, and text under the name of a frame stays, by importance alone."""
    word = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))

    def site(i, n):
        # The title is in a header outside of the article; a widget holds the text, as page builders do.
        return (
            f"<header><p>The Site</p><h1>Title {word(i)}</h1></header><article><p>Text {word(i)}.</p>"
            f"<div>Our journal is free to read.</div><p>More {word(i * n)}.</p></article>"
            f"<div class='widget'><p>Block {word(i)}.</p></div><section class='comments'>Reader {word(i)}</section>"
            f"<div class='ad'>Buy {word(i)}</div><footer>Made {word(i)}</footer>"
        )

    rows = [(i, f"http://large.com/{i}", site(i, 7)) for i in range(40)]
    rows += [(100 + i, f"http://small.com/{i}", site(i, 7)) for i in range(3)]
    rows += [(200 + i, f"http://copies.com/{i}", "<nav>Home</nav><article><p>The same article.</p></article>") for i in range(9)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(40):
        assert found[i] == f"Title {word(i)} Text {word(i)}. More {word(i * 7)}. Block {word(i)}."
    for i in range(3):  # too few pages to tell: names decide
        assert found[100 + i] == f"Text {word(i)}. Our journal is free to read. More {word(i * 7)}."
    assert {found[200 + i] for i in range(9)} == {"The same article."}


def peak_of(script):
    import subprocess
    import sys

    tail = "import resource; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    return int(subprocess.run([sys.executable, "-c", f"{script}\n{tail}"], capture_output=True, text=True, check=True).stdout.split()[-1])


def test_deeply_nested_page_is_linear():
    """50,000 open elements, with ends that fit none: facts and text of the page, under 200 MB more than nothing."""
    start = "import pyarrow as pa, time; from fairtract.llm import html"
    body = """
page = "".join(f"<div class=c{i % 7}>" + ("w%d</span></section>" % i if i % 10 == 0 else "") for i in range(50_000)) + "<nav>menu</nav>"
begin = time.time()
facts = list(html._facts([pa.record_batch({"host": ["a"], "html": [page]})]))
text = html.main_text(page, frozenset())
assert len(text.split()) == 5_000 and "menu" not in text and facts[0].nbytes < 20_000_000
assert time.time() - begin < 30
"""
    assert peak_of(start + body) - peak_of(start) < 200


def test_deep_pages_of_a_site(spark):
    """Below the depth limit names still count, and text there is judged with the branch at the limit."""
    deep = "<div>" * 100
    rows = [(i, "http://deep.com/x", f"{deep}<p>text {i} {'abcdefgh'[i % 8]}</p><aside>links {i}</aside>") for i in range(12)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {i: f"text {i} {'abcdefgh'[i % 8]}" for i in range(12)}


# ---- neighbours --------------------------------------------------------------------------------


def exact(vectors, k):
    out = []
    usable = {}
    for i, v in vectors:
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        usable.setdefault(i, []).append(np.array(v, float))
    for q in sorted(usable):
        if q % 50:
            continue
        found = set()
        for i, vs in usable.items():
            for v in vs:
                for w in usable[q]:
                    if i != q and len(v) == len(w):
                        found.add((-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 9), i))
        for rank, (s, i) in enumerate(sorted(found)[:k], 1):
            out.append((q, rank, i, -s))
    return out


@pytest.mark.parametrize("rows", [16_384, 300])
def test_neighbours_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(neighbours, "TREE_ROWS", rows)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 7)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 16))
    vectors = [(i, (base[i % 20] + rng.normal(size=16) * 0.4).tolist()) for i in range(1500)]
    same = vectors[100][1]
    vectors = [(i, same if i % 3 == 0 else v) for i, v in vectors]
    vectors += [(2000, None), (2050, []), (2100, [0.0] * 16), (2150, [1.0] * 15 + [float("nan")]), (2200, [1.0] * 15 + [None]), (2250, [1.0, 2.0]), (2300, [2.0, 1.0])]
    vectors += [(None, vectors[1][1]), vectors[7], vectors[50], (2350, [float("inf")] * 16), (2400, [1e-30] * 16), (2450, [1e200] * 16)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, score string")
    found = neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    want = exact([(i, [x * 1e-100 for x in v] if v and v[0] and v[0] == 1e200 else v) for i, v in vectors], 5)
    got = {(r.query_id, r["rank"], r.vec_id) for r in found}
    hits = len(got & {w[:3] for w in want})
    assert len(found) == len(want) and hits >= 0.97 * len(want)
    scores = {(q, i): s for q, _, i, s in want}
    assert all(abs(r.score - scores[r.query_id, r.vec_id]) < 1e-8 for r in found if (r.query_id, r.vec_id) in scores)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def share_and_recall(spark, vectors, k=5, certainty=neighbours.CERTAINTY):
    """Verified share of all pairs of queries and vectors, and the share of the true nearest that were found."""
    df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>")
    is_query = F.col("vec_id") % 50 == 0
    found = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, is_query, k, certainty).collect()}
    _, classes = neighbours._classes(df, is_query, k)
    verified = neighbours.verify(classes, df.where(is_query).select(F.col("vec_id").alias("cls")), k, certainty).agg({"verified": "sum"}).first()[0]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    asked = np.arange(0, len(vectors), 50)
    cosine = unit[asked] @ unit.T
    cosine[np.arange(len(asked)), asked] = -2
    best = np.argsort(-cosine, axis=1)[:, :k]
    true = {(int(q), int(i)) for q, row in zip(asked, best) for i in row}
    return verified / (len(asked) * len(vectors)), len(found & true) / len(true)


@pytest.mark.parametrize("rows", [16_384, 1_000])
def test_clustered_vectors_are_pruned(spark, monkeypatch, rows):
    """Of clusters of close vectors under a fifth is verified, in one tree or in cells, and little is missed."""
    monkeypatch.setattr(neighbours, "TREE_ROWS", rows)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(100, 32))
    share, recall = share_and_recall(spark, centres[rng.integers(0, 100, 8_000)] + 0.15 * rng.normal(size=(8_000, 32)))
    assert share < 0.2 and recall >= 0.95


def test_more_trees_than_boxes_are_all_searched(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TREE_ROWS", 200)
    monkeypatch.setattr(neighbours, "MOST_BOXES", 1)
    rng = np.random.default_rng(7)
    assert share_and_recall(spark, rng.normal(size=(1_500, 16)))[1] >= 0.95


def test_chi_square():
    assert neighbours.chi_square(0) == 0 and neighbours.chi_square(neighbours.test_bound(0.99)) == pytest.approx(0.99)
    # A known quantile of eight degrees of freedom.
    assert neighbours.test_bound(0.95) == pytest.approx(15.507, abs=1e-3)


# ---- token counts ------------------------------------------------------------------------------


def test_signed_batches(spark, tmp_path):
    path = f"file://{tmp_path}/counts"
    schema = "doc_id long, text string, source string, lang string, n long, n_docs int"
    docs = spark.createDataFrame(
        [(1, "a b", "s", "en", 5, 9), (2, "a b", "s", None, 7, 9), (3, None, None, "de", None, 9), (3, None, None, "de", None, 9)], schema
    )
    rows = lambda: sorted(map(tuple, token_counts.totals(spark, path).collect()), key=str)
    assert rows() == []
    load = token_counts.inserted(docs, "v1", F.col("n"))
    assert token_counts.commit(spark, path, "1", load) and not token_counts.commit(spark, path, "1", load)
    assert rows() == sorted([("s", "en", "v1", 1, 5), ("s", None, "v1", 1, 7), (None, "de", "v1", 2, 0)], key=str)
    token_counts.commit(spark, path, "2", token_counts.revised(docs, "v1", F.col("n"), F.col("doc_id")))
    assert rows() == sorted([("s", "en", "v1", 1, 1), ("s", None, "v1", 1, 2), (None, "de", "v1", 2, 6)], key=str)
    gone = token_counts.copies(docs)
    assert [r.doc_id for r in gone.collect()] == [2]
    token_counts.commit(spark, path, "3", token_counts.deleted(gone, "v1", F.col("doc_id")))
    assert rows() == sorted([("s", "en", "v1", 1, 1), (None, "de", "v1", 2, 6)], key=str)
    # A batch that broke off has no success mark: it does not count, and can be written anew.
    load.write.parquet(f"{path}/batch=4")
    (tmp_path / "counts" / "batch=4" / "_SUCCESS").unlink()
    assert rows() == sorted([("s", "en", "v1", 1, 1), (None, "de", "v1", 2, 6)], key=str)
    assert token_counts.commit(spark, path, "4", load.limit(0)) and len(rows()) == 2


def test_digest_is_that_of_joined_ids(spark):
    row = spark.range(1).select(F.sha2(F.array_join(F.array(F.lit(5), F.lit(17)), " "), 256).alias("h")).head()
    assert row.h == hashlib.sha256(b"5 17").hexdigest()


def test_copies_keep_columns_of_any_name(spark):
    rows = [(1, "a", "own", 5, 6), (2, "a", "other", 7, 8), (3, None, "x", 1, 1), (4, "", "y", 2, 2), (None, "a", "z", 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _first int, _times int")
    assert sorted(map(tuple, token_counts.copies(docs).collect())) == [rows[1], rows[3]]


def test_batches_count_without_the_mark_of_the_committer(spark, tmp_path):
    setting = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(setting, "false")
    try:
        load = token_counts.inserted(spark.createDataFrame([("s", "en", 3)], "source string, lang string, n int"), "v", F.col("n"))
        assert token_counts.commit(spark, str(tmp_path), "1", load) and not token_counts.commit(spark, str(tmp_path), "1", load)
    finally:
        conf.unset(setting)
    assert [tuple(r) for r in token_counts.totals(spark, str(tmp_path)).collect()] == [("s", "en", "v", 1, 3)]
