"""Phrases that stand together more often than their parts: a weighted de Bruijn graph of words.

Nodes of the graph are pairs of neighbouring words, edges are triples, the
longest grams; an edge leads from its first pair to its second one. Only edges
are counted. A piece of text ends with edges to an end mark, so whatever enters a
node also leaves it, and the count of a pair is the flow out of its node, the
ends of pieces included. The flow through the pairs that begin with a word is the
count of the word. A node with one edge in and one out, both of its own weight, is
inside a unary path: paths are compacted, and only nodes at their ends are looked up.

Words are 64-bit hashes of language and bytes until the result is cut. Tasks send
sorted arrays of the distinct edges of a slice of text to buckets of nodes. A
node with more edges in a slice than a bucket should hold is hot: its edges are dealt
over other buckets one by one, its home bucket is told to pass on what others sent, and
the two are added up by edge.

A null text is empty, a null language is ``und``, repeated rows all count, an empty
table gives no rows. Memory follows the slice (8 MB of text) or the longest piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtract.llm.storage import drop, stage
from fairtract.llm.words import _BASE, _BASE_INV, _BYTE, _LOWER, _STEP, U64, _bytes_of, _power, byte_slices, mix, planes, runs, unplanes

#: Pieces end at these, words of a piece at the others.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
END, HOT = U64(0), U64(1)
#: Bytes of text whose edges a bucket holds.
BUCKET_BYTES = 4_000_000
SEGMENT = 1_000_000
#: Bytes of packed rows in a batch.
BATCH_BYTES = 4_000_000

_IS_BREAK, _IS_GAP = np.zeros(256, bool), np.zeros(256, bool)
_IS_BREAK[list(BREAKS)] = True
_IS_GAP[list(BREAKS + BLANKS)] = True

_PACKED = "bucket long, n long, data binary, langs array<string>"
_COUNTED = "kind string, lang string, word string, h1 long, h2 long, h3 long, n long"
_COUNTED_ARROW = pa.schema([(n, pa.string()) for n in ("kind", "lang", "word")] + [(n, pa.int64()) for n in ("h1", "h2", "h3", "n")])


class Tokens:
    """Words of a slice of texts: starts and lengths in ``body``, hashes, and whether a piece ends there."""

    def __init__(self, texts: pa.Array, salts: np.ndarray):
        data, offsets = _bytes_of(texts)
        self.body = _LOWER[data[offsets[0] : offsets[-1]]]
        bounds = offsets - offsets[0]
        found = [self._segment(a, b, bounds) for a, b in self._segments(bounds)]
        self.starts, self.lengths, self.hashes, self.last = (
            (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, t) for t in (np.int64, np.int32, U64, bool))
        )
        self.bounds = bounds
        h = mix(self.hashes + salts[self.text_of(self.starts)]) if len(self.starts) else self.hashes
        # The two least values are marks.
        self.hashes = np.where(h <= HOT, h + U64(2), h)

    def text_of(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, starts, "right") - 1

    def _segments(self, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """Byte ranges that end with a piece or a text."""
        start, size = 0, len(self.body)
        while start < size:
            stop = min(start + SEGMENT, size)
            if stop < size:
                cuts = np.flatnonzero(_IS_BREAK[self.body[start:stop]])
                inner = bounds[(bounds > start) & (bounds <= stop)]
                best = max(start + cuts[-1] + 1 if len(cuts) else 0, inner[-1] if len(inner) else 0)
                if not best:
                    after = np.flatnonzero(_IS_BREAK[self.body[stop:]])
                    ends = [stop + after[0] + 1] if len(after) else []
                    best = min([*ends, bounds[bounds > stop][0]])
                stop = int(best)
            yield start, stop
            start = stop

    def _segment(self, a: int, b: int, bounds: np.ndarray):
        body = self.body[a:b]
        size = len(body)
        gap, ends_piece = _IS_GAP[body], _IS_BREAK[body]
        inner = bounds[(bounds > a) & (bounds < b)] - a
        opens, closes = np.ones(size, bool), np.ones(size, bool)
        opens[1:] = gap[:-1]
        opens[inner] = True
        closes[:-1] = gap[1:]
        closes[inner - 1] = True
        s, e = np.flatnonzero(opens & ~gap), np.flatnonzero(closes & ~gap) + 1
        sums = np.zeros(size + 1, U64)
        np.cumsum(_BYTE[body] * _power("up", _BASE, size)[:size], out=sums[1:])
        h = mix((sums[e] - sums[s]) * _power("down", _BASE_INV, size)[s] + (e - s).astype(U64) * _STEP)
        piece = np.cumsum(ends_piece, dtype=np.int32)[s] + np.searchsorted(inner, s, "right")
        last = np.ones(len(s), bool)
        last[:-1] = piece[1:] != piece[:-1]
        return s + a, (e - s).astype(np.int32), h, last

    def strings(self, at: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Lengths and joined bytes of some words."""
        length = self.lengths[at].astype(np.int64)
        return length, _gather(self.body, self.starts[at], length).tobytes()


def _gather(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    upto = np.cumsum(length)
    return data[np.repeat(starts - upto + length, length) + np.arange(upto[-1] if len(upto) else 0)]


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _edges(ids: np.ndarray, last: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct edges of a slice by numbers of words (0: end mark), sorted, with their counts."""
    # Two empty places stand behind the last word; what lies behind an end of a piece is the end mark.
    own = np.append(ids.astype(np.int32) + 1, np.zeros(2, np.int32))
    ended = np.append(last, [True, True])
    second = np.where(ended[:-2], 0, own[1:-1])
    third = np.where(ended[:-2] | ended[1:-1], 0, own[2:])
    if n_words < (1 << 21) - 1:
        key = own[:-2].astype(U64) << U64(42)
        key |= second.astype(U64) << U64(21)
        key |= third.astype(U64)
        key.sort()
        begins = runs(key)
        n = np.diff(np.append(begins, len(key)))
        key, low = key[begins], U64((1 << 21) - 1)
        return (key >> U64(42)).astype(np.int32), ((key >> U64(21)) & low).astype(np.int32), (key & low).astype(np.int32), n
    first = own[:-2]
    order = np.lexsort((third, second, first))
    first, second, third = first[order], second[order], third[order]
    new = np.ones(len(order), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (third[1:] != third[:-1])
    begins = np.flatnonzero(new)
    return first[begins], second[begins], third[begins], np.diff(np.append(begins, len(order)))


def _spread(h: np.ndarray, n: int) -> np.ndarray:
    return (((mix(h) >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def _node(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mix(h1) + h2 * _STEP


def _slice(texts: pa.Array, langs: pa.Array, n_buckets: int, many: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of one slice: edges by node, edges of hot nodes, and words with the flow through them."""
    coded = langs.fill_null("und").dictionary_encode()
    names, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    tokens = Tokens(texts, np.array([_salt(x) for x in names], U64)[lang])
    known, first_at, ids = np.unique(tokens.hashes, return_index=True, return_inverse=True)
    tokens.hashes = None
    first, second, third, n = _edges(ids, tokens.last, len(known))
    del ids
    flow = np.bincount(first, n, len(known) + 1)[1:].astype(U64) if len(n) else np.zeros(0, U64)
    yield from _batches(_edge_rows(np.append(END, known), first, second, third, n, n_buckets, many), None)

    def word_rows() -> Iterator[tuple[int, int, bytes]]:
        for bucket, at in _by_bucket(2 * n_buckets + _spread(known, n_buckets)):
            own = first_at[at]
            length, body = tokens.strings(own)
            number = lang[tokens.text_of(tokens.starts[own])]
            columns = [(known[at], 8), (flow[at], 5), (number.astype(U64), 4), (length.astype(U64), 4)]
            yield bucket, len(at), b"".join([*(planes(c, w) for c, w in columns), body])

    yield from _batches(word_rows(), names)


def _edge_rows(hashes, first, second, third, n, n_buckets: int, many: int) -> Iterator[tuple[int, int, bytes]]:
    """Sorted edges by bucket of their node; those of a hot node one by one, and a mark at its home."""
    h1, h2 = hashes[first], hashes[second]
    node = _node(h1, h2)
    begins = runs(node)
    sizes = np.diff(np.append(begins, len(node)))
    hot = sizes > max(many, 2 * len(node) // n_buckets)
    bucket = _spread(node, n_buckets)
    marks = begins[hot]
    if len(marks):
        every = np.repeat(hot, sizes)
        bucket[every] = n_buckets + _spread(node[every] + hashes[third[every]] * _BASE, n_buckets)
    del node
    for b, at in _by_bucket(bucket):
        columns = [(h1[at], 8), (h2[at], 8), (hashes[third[at]], 8), (n[at].astype(U64), 5)]
        yield b, len(at), b"".join(planes(c, w) for c, w in columns)
    if len(marks):
        h1, h2 = h1[marks], h2[marks]
        for b, at in _by_bucket(_spread(_node(h1, h2), n_buckets)):
            none = np.zeros(len(at), U64)
            yield b, len(at), b"".join(planes(c, w) for c, w in [(h1[at], 8), (h2[at], 8), (none + HOT, 8), (none, 5)])


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each bucket, in order."""
    order = np.argsort(bucket, kind="stable")
    begins = runs(bucket[order])
    for a, b in zip(begins, np.append(begins[1:], len(order))):
        yield int(bucket[order[a]]), order[a:b]


def _batches(rows: Iterator[tuple[int, int, bytes]], langs: list[str] | None) -> Iterator[pa.RecordBatch]:
    def batch(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        bucket, n, data = zip(*held)
        named = pa.array([langs] * len(held), pa.list_(pa.string()))
        columns = [pa.array(bucket, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary()), named]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "n", "data", "langs"])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > BATCH_BYTES:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def _merged_edges(table: pa.Table, hot_bucket: bool, least: int) -> pa.Table:
    parts = []
    for n, data in zip(table["n"].to_pylist(), table["data"]):
        buffer, at, part = data.as_buffer(), 0, []
        for width in (8, 8, 8, 5):
            values, at = unplanes(buffer, n, width, at)
            part.append(values)
        parts.append(part)
    h1, h2, h3, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((h3, h2, h1))
    h1, h2, h3, n = h1[order], h2[order], h3[order], n[order]
    new_node = np.ones(len(n), bool)
    new_node[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    new_edge = new_node.copy()
    new_edge[1:] |= h3[1:] != h3[:-1]
    begins = np.flatnonzero(new_edge)
    h1, h2, h3, n, new_node = h1[begins], h2[begins], h3[begins], np.add.reduceat(n, begins), new_node[begins]
    node_begins = np.flatnonzero(new_node)
    sizes = np.diff(np.append(node_begins, len(n)))
    passed = np.repeat(np.logical_or.reduceat(h3 == HOT, node_begins), sizes) if not hot_bucket else np.ones(len(n), bool)
    flow = np.add.reduceat(n, node_begins)
    node = ~passed[node_begins] & (h2[node_begins] != END) & (flow >= least)
    edge = ~passed & (h3 != END) & (n >= least)
    passed &= h3 != HOT
    at = node_begins[node]
    none = np.zeros(len(at), U64)
    return pa.concat_tables(
        [_counted("node", h1[at], h2[at], none, flow[node]), _counted("edge", h1[edge], h2[edge], h3[edge], n[edge]), _counted("hot", h1[passed], h2[passed], h3[passed], n[passed])]
    )


def _counted(kind: str, h1, h2, h3, n, lang=None, word=None) -> pa.Table:
    size = len(n)
    none = pa.nulls(size, pa.string())
    columns = [pa.array([kind] * size, pa.string()), none if lang is None else lang, none if word is None else word]
    columns += [pa.array(x.astype(U64).view(np.int64)) for x in (h1, h2, h3, n)]
    return pa.Table.from_arrays(columns, schema=_COUNTED_ARROW)


def _merged_words(table: pa.Table, least: int) -> pa.Table:
    hashes, counts, langs, lengths, bodies, names = [], [], [], [], [], {}
    for n, data, own in zip(table["n"].to_pylist(), table["data"], table["langs"].to_pylist()):
        buffer, at = data.as_buffer(), 0
        number = np.array([names.setdefault(x, len(names)) for x in own])
        for out, width in ((hashes, 8), (counts, 5), (langs, 4), (lengths, 4)):
            values, at = unplanes(buffer, n, width, at)
            out.append(number[values.astype(np.int64)] if out is langs else values)
        bodies.append(np.frombuffer(buffer, np.uint8, offset=at) if at < len(buffer) else np.zeros(0, np.uint8))
    h, n, lang, length = (np.concatenate(x) for x in (hashes, counts, langs, lengths))
    body, length = np.concatenate(bodies), length.astype(np.int64)
    starts = np.cumsum(length) - length
    order = np.argsort(h, kind="stable")
    begins = runs(h[order])
    flow = np.add.reduceat(n[order], begins)
    of_lang = np.bincount(lang, n, len(names))
    many = flow >= least
    at = order[begins[many]]
    offsets = np.append(0, np.cumsum(length[at])).astype(np.int32)
    word = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(_gather(body, starts[at], length[at]).tobytes()))
    listed = pa.array(list(names), pa.string())
    none, zero = np.zeros(len(at), U64), np.zeros(len(names), U64)
    return pa.concat_tables(
        [_counted("word", h[at], none, none, flow[many], listed.take(pa.array(lang[at])), word), _counted("total", zero, zero, zero, of_lang, listed)]
    )


class Graph:
    """The frequent part of the graph: ``words(h, lang, word, f)``, ``nodes(a, b, f)``, ``edges(h1, h2, h3, f)``,
    and ``totals(lang, n)`` of all words."""

    def __init__(self, counted: DataFrame, least: int):
        self.counted = counted
        kind = lambda k: counted.where(F.col("kind") == k)
        count = F.col("n").alias("f")
        self.words = kind("word").select(F.col("h1").alias("h"), "lang", "word", count)
        self.totals = kind("total").groupBy("lang").agg(F.sum("n").alias("n"))
        hot = kind("hot").groupBy("h1", "h2", "h3").agg(F.sum("n").alias("f"))
        flow = kind("hot").where(f"h2 <> {END}").groupBy(F.col("h1").alias("a"), F.col("h2").alias("b")).agg(F.sum("n").alias("f"))
        self.edges = kind("edge").select("h1", "h2", "h3", count).unionByName(hot.where((F.col("f") >= least) & (F.col("h3") != int(END))))
        self.nodes = kind("node").select(F.col("h1").alias("a"), F.col("h2").alias("b"), count).unionByName(flow.where(F.col("f") >= least))


def graph(docs: DataFrame, least: int = 10, bucket_bytes: int = BUCKET_BYTES, many: int = 1_000) -> Graph:
    """The graph of the words of all documents, with nodes and edges of ``least`` occurrences.

    A node is hot in a slice where it has over ``many`` edges and twice a bucket's share.
    """
    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = size // bucket_bytes + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in byte_slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                yield from _slice(part.column("text"), part.column("lang"), n_buckets, many)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind = key[0].as_py() // n_buckets
        return _merged_words(table, least) if kind == 2 else _merged_edges(table, kind == 1, least)

    # As many tasks as buckets of each kind, so that a task does not grow with the input.
    packed = rows.mapInArrow(pack, _PACKED).repartition(n_buckets, "bucket")
    counted = packed.groupBy("bucket").applyInArrow(merge, _COUNTED)
    return Graph(stage(counted, "grams"), least)


def compact(found: Graph) -> tuple[DataFrame, DataFrame]:
    """The graph with its unary paths compacted: ``(ends, steps)``.

    ``steps`` are the edges ``h1, h2, h3, f`` with the first edge ``p1, p2, p3`` of their path, their
    ``place`` on it, and whether a path ``begins`` or ``stops`` with them; all edges of a path weigh the
    same, and so does every node between them. ``ends`` are the other nodes ``a, b, f``, with the ``most``
    that an edge at them weighs.
    """
    out = found.edges.select(F.col("h1").alias("a"), F.col("h2").alias("b"), F.lit(None).cast("long").alias("f"), F.col("f").alias("leaving"), F.lit(None).cast("long").alias("entering"), F.lit(None).cast("long").alias("before"))
    into = found.edges.select(F.col("h2").alias("a"), F.col("h3").alias("b"), F.lit(None).cast("long").alias("f"), F.lit(None).cast("long").alias("leaving"), F.col("f").alias("entering"), F.col("h1").alias("before"))
    bare = found.nodes.selectExpr("a", "b", "f", "null as leaving", "null as entering", "null as before")
    nodes = bare.unionByName(out).unionByName(into).groupBy("a", "b").agg(
        F.max("f").alias("f"),
        F.count("leaving").alias("outs"),
        F.count("entering").alias("ins"),
        F.max("leaving").alias("leaving"),
        F.max("entering").alias("entering"),
        F.max("before").alias("before"),
    )
    inner = F.expr("outs = 1 and ins = 1 and leaving = f and entering = f")
    nodes = stage(nodes.withColumn("inner", inner), "nodes")
    between = nodes.where("inner").select("a", "b", "before")
    first = between.withColumnsRenamed({"a": "h1", "b": "h2"})
    last = between.select(F.col("a").alias("h2"), F.col("b").alias("h3"), F.lit(False).alias("stops"))
    edges = found.edges.join(first, ["h1", "h2"], "left").join(last, ["h2", "h3"], "left")
    begins = F.col("before").isNull()
    edges = stage(edges.select("h1", "h2", "h3", "f", "before", begins.alias("begins"), F.coalesce("stops", F.lit(True)).alias("stops")), "edges")
    # Each edge inside a path points at the one before it; pointers are doubled until all reach the first.
    key = ["h1", "h2", "h3"]
    links = edges.where("not begins").select(*key, F.col("before").alias("p1"), F.col("h1").alias("p2"), F.col("h2").alias("p3"), F.lit(1).cast("long").alias("place"))
    links = stage(links, "links")
    while True:
        nearer = links.select(*[F.col(c).alias(f"p{i}") for i, c in enumerate(key, 1)], *[F.col(f"p{i}").alias(f"q{i}") for i in (1, 2, 3)], F.col("place").alias("more"))
        joined = links.join(nearer, ["p1", "p2", "p3"], "left")
        moved = F.col("more").isNotNull()
        stepped = stage(
            joined.select(*key, *[F.coalesce(f"q{i}", f"p{i}").alias(f"p{i}") for i in (1, 2, 3)], (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), moved.alias("moved")), "links"
        )
        drop(links)
        links = stepped.drop("moved")
        if not stepped.where("moved").head(1):
            break
    inside = edges.join(links, key, "left")
    steps = inside.select(*key, "f", *[F.coalesce(f"p{i}", f"h{i}").alias(f"p{i}") for i in (1, 2, 3)], F.coalesce("place", F.lit(0)).alias("place"), "begins", "stops")
    ends = nodes.where("not inner").select("a", "b", "f", F.greatest("leaving", "entering").alias("most"))
    return ends, steps


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (l r)), exact for counts up to 10^15."""
    wide = [x.cast("decimal(15,0)") for x in (a, left, right)]
    whole = F.lit(1_000_000).cast("decimal(7,0)") * (wide[0] * wide[0])
    return F.call_function("div", whole, wide[1] * wide[2])


def scored(found: Graph, share: int = 50) -> DataFrame:
    """Candidates as hashes: ``lang, h1, h2, h3 (null for pairs), a, l, r, score``.

    Pairs inside a triple with ``share`` percent of their count or more are left out; all nodes inside
    paths are such pairs.
    """
    ends, steps = compact(found)
    at = lambda name, a, b: ends.select(F.col("a").alias(a), F.col("b").alias(b), F.col("f").alias(name))
    # Pairs inside a path weigh what the path weighs.
    heads = steps.join(at("front", "h1", "h2"), ["h1", "h2"], "left").join(at("back", "h2", "h3"), ["h2", "h3"], "left")
    triples = heads.select("h1", "h2", "h3", F.col("f").alias("a"), F.coalesce("front", "f").alias("front"), F.coalesce("back", "f").alias("back"))
    alone = (F.col("most") * 100 < F.col("f") * share) | F.col("most").isNull()
    pairs = ends.where(alone).select(F.col("a").alias("h1"), F.col("b").alias("h2"), F.lit(None).cast("long").alias("h3"), F.col("f").alias("a"))
    both = triples.unionByName(pairs, allowMissingColumns=True).withColumn("tail", F.coalesce("h3", "h2"))
    first = found.words.select(F.col("h").alias("h1"), "lang", F.col("f").alias("f1"))
    final = found.words.select(F.col("h").alias("tail"), F.col("f").alias("f_tail"))
    known = both.join(first, "h1").join(final, "tail")
    cut1 = F.struct(_score(F.col("a"), F.col("f1"), F.coalesce("back", "f_tail")).alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.coalesce("back", "f_tail").alias("r"))
    cut2 = F.when(F.col("front").isNotNull(), F.struct(_score(F.col("a"), F.col("front"), F.col("f_tail")).alias("score"), F.lit(2).alias("k"), F.col("front").alias("l"), F.col("f_tail").alias("r")))
    return known.select("lang", "h1", "h2", "h3", "a", F.least(cut1, cut2).alias("cut")).select("lang", "h1", "h2", "h3", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, top: int = 2_000, least: int = 10, share: int = 50, **sizes: int) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Order: score, then count, both descending, then the phrase's bytes. ``sizes`` are those of ``graph``.
    """
    found = graph(docs, least, **sizes)
    candidates = stage(scored(found, share), "candidates")
    # The score and count at which a language's list ends; at most ``top`` steps down lead there.
    steps = candidates.groupBy("lang", "score", "a").agg(F.count("*").alias("rows"))
    down = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    steps = steps.withColumn("step", F.row_number().over(down)).where(F.col("step") <= top)
    upto = F.sum("rows").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    level = steps.withColumn("above", upto - F.col("rows")).where(F.col("above") < top).groupBy("lang")
    level = stage(level.agg(F.min(F.struct("score", "a")).alias("level")), "levels")
    kept = candidates.join(level, "lang").where(F.struct("score", "a") >= F.col("level")).drop("level")
    for i in (1, 2, 3):
        named = found.words.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"))
        kept = kept.join(named, f"h{i}", "left")
    phrases = kept.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(stage(found.totals, "totals"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
