"""Interpolated modified Kneser-Ney language model, counted in Spark and mapped by workers.

The model's files lie in a folder that all machines share. They are sorted
arrays of hashes and keys with counts beside them, cut into buckets; a worker
maps the ones it needs and keeps none of them in its heap:

    words-B      sorted 64-bit hashes of the words of range B of all hashes
    counts-B     their counts
    history-B    by word: count as history, and followers met once, twice, more
    before-B     by word: distinct words before it
    pairs-C      sorted (history id, word id) keys of bucket C
    times-C      their counts, 255 meaning: look in large-C
    large-C      (key, count) of counts of 255 and more

A word's id is its place among all sorted hashes, so ids need no table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtract.llm.storage import mapped, new_path, put, qualified
from fairtract.llm.words import U64, Words, byte_slices, mix, planes, runs, unplanes

#: Hash of the token that ends each text; the start is a history only.
END = U64(0x0EAD0EAD0EAD0EAD)
#: Key ranges per shuffle partition, so that partitions are even.
BUCKETS_PER_PARTITION = 4
#: A group of word buckets has about so many words, or several partitions share a group: every
#: pair bucket sends each group a row, so groups are few.
GROUP_WORDS = 1_000_000
PARTITIONS_PER_GROUP = 4
MANY = 255
_HISTORY = np.dtype([("total", "<u8"), ("once", "<u4"), ("twice", "<u4"), ("more", "<u4")])
_LARGE = np.dtype([("key", "<u8"), ("times", "<u8")])
PACKED = "bucket long, n long, data binary"


@dataclass(frozen=True)
class Meta:
    """What workers need besides the files: bounded by the number of buckets."""

    path: str
    word_buckets: int
    pair_buckets: int
    #: Ids of bucket B begin at ``offsets[B]``; the last entry is the number of words.
    offsets: tuple[int, ...]
    n_tokens: int
    #: Words more frequent than this have their pairs dealt to all buckets.
    hot: int
    #: Runs of word buckets whose figures are added up together.
    word_groups: int = 1
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low_total: int = 0
    low_spare: float = 1.0
    #: The pair buckets that have files; a file that is missing in any of these is an error.
    pairs: tuple[int, ...] = ()


def is_held_out(doc_id: Column) -> Column:
    """Every tenth document by checksum of its id; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(n)) >> U64(32)


def _chunks(batches, names: list[str]):
    """Batches cut into slices: ``Words`` and the other columns."""
    for batch in batches:
        for start, stop in byte_slices(batch.column("text")):
            part = batch.slice(start, stop - start)
            yield Words(part.column("text"), lower=True), [part.column(n) for n in names]


def _spread(words: Words, values: np.ndarray, begin, end) -> tuple[np.ndarray, np.ndarray]:
    """Values of each document's words between a begin and an end, and where documents begin."""
    n_docs = len(words.first) - 1
    first = words.first + 2 * np.arange(n_docs + 1)
    out = np.empty(first[-1], values.dtype)
    out[first[:-1]] = begin
    out[first[1:] - 1] = end
    out[np.arange(len(values)) + 2 * words.doc_of_word() + 1] = values
    return out, first


def _rows(bucket: np.ndarray, columns: list[tuple[np.ndarray, int]]):
    begins = runs(bucket)
    ends = np.append(begins[1:], len(bucket)) if len(begins) else begins
    return [(int(bucket[a]), int(b - a), b"".join(planes(c[a:b], w) for c, w in columns)) for a, b in zip(begins, ends)]


def _batch(rows) -> pa.RecordBatch:
    bucket, n, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["bucket", "n", "data"]
    )


def _columns(table: pa.Table, widths: list[int]) -> list[np.ndarray]:
    out = [[] for _ in widths]
    for n, data in zip(table["n"].to_pylist(), table["data"]):
        at, data = 0, data.as_buffer()
        for c, w in zip(out, widths):
            values, at = unplanes(data, n, w, at)
            c.append(values)
    return [np.concatenate(c) for c in out]


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = runs(keys)
    return [keys[begins], *(np.add.reduceat(v[order], begins) if len(begins) else v for v in values)]


def _count_words(n_buckets: int):
    def count_words(batches):
        for words, _ in _chunks(batches, []):
            h, n = np.unique(words.hashes, return_counts=True)
            h, n = np.append(h, END), np.append(n, len(words.first) - 1).astype(U64)
            h, n = _summed(h, n)
            yield _batch(_rows(word_bucket(h, n_buckets), [(h, 8), (n, 5)]))

    return count_words


def _keep_words(path: str):
    def keep_words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        h, n = _summed(*_columns(table, [8, 5]))
        put(f"{path}/words-{bucket}", h.astype("<u8").tobytes())
        put(f"{path}/counts-{bucket}", n.astype("<u8").tobytes())
        return pa.table({"bucket": [bucket], "n": [len(h)], "total": [int(n.sum())]})

    return keep_words


class Model:
    """The mapped files of a model, opened as they are needed."""

    def __init__(self, meta: Meta):
        self.meta = meta
        self.offsets = np.array(meta.offsets)
        self.open: dict[str, np.ndarray] = {}
        self.n_words = int(self.offsets[-1])
        self.pairs = frozenset(meta.pairs)
        self.groups = np.arange(meta.word_buckets) * meta.word_groups // meta.word_buckets

    def file(self, name: str, bucket: int, dtype) -> np.ndarray:
        name = f"{name}-{bucket}"
        if name not in self.open:
            self.open[name] = mapped(f"{self.meta.path}/{name}", dtype)
        return self.open[name]

    def group_of(self, ids: np.ndarray) -> np.ndarray:
        return self.groups[np.searchsorted(self.offsets[1:-1], ids.astype(np.int64), "right")]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of sorted hashes; -1 and 0 for unknown words."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        bucket = word_bucket(h, self.meta.word_buckets).astype(np.int64)
        bounds = np.append(runs(bucket), len(bucket))
        for a, b in zip(bounds[:-1], bounds[1:]):
            k = int(bucket[a])
            if self.offsets[k] == self.offsets[k + 1]:
                continue
            known = self.file("words", k, "<u8")
            at = np.minimum(np.searchsorted(known, h[a:b]), len(known) - 1)
            found = np.flatnonzero(known[at] == h[a:b])
            ids[a + found] = at[found] + self.offsets[k]
            counts[a + found] = self.file("counts", k, "<u8")[at[found]].astype(np.int64)
        return ids, counts

    def tokens(self, words: Words):
        """Of all tokens with starts and ends: id and count, and where documents begin."""
        distinct, place = np.unique(words.hashes, return_inverse=True)
        ids, counts = self.look_up(distinct)
        (end,), (n_end,) = self.look_up(np.array([END]))
        id_of, first = _spread(words, ids[place], self.n_words, end)
        # As a history the start is as frequent as the end.
        count_of, _ = _spread(words, counts[place], n_end, n_end)
        return id_of, count_of, first

    def pair_bucket(self, key: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A history's pairs are in one bucket, those of a frequent history in all."""
        spread = np.where(count > self.meta.hot, mix(key), mix(key >> U64(32)))
        return (spread >> U64(20)) % U64(self.meta.pair_buckets)

    def times(self, key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs, 0 for those never met."""
        out = np.zeros(len(key), np.int64)
        order = np.lexsort((key, bucket))
        sorted_bucket = bucket[order]
        bounds = np.append(runs(sorted_bucket), len(order))
        for a, b in zip(bounds[:-1], bounds[1:]):
            k, rows = int(sorted_bucket[a]), order[a:b]
            if k not in self.pairs:  # no pair of the training texts fell there
                continue
            known = self.file("pairs", k, "<u8")
            at = np.minimum(np.searchsorted(known, key[rows]), len(known) - 1)
            found = known[at] == key[rows]
            rows, at = rows[found], at[found]
            times = self.file("times", k, np.uint8)[at].astype(np.int64)
            large = np.flatnonzero(times == MANY)
            if len(large):
                kept = self.file("large", k, _LARGE)
                times[large] = kept["times"][np.searchsorted(kept["key"], key[rows[large]])]
            out[rows] = times
        return out

    def by_id(self, name: str, ids: np.ndarray, dtype) -> np.ndarray:
        """Records of known ids."""
        out = np.zeros(len(ids), dtype)
        bucket = np.searchsorted(self.offsets[1:-1], ids, "right")
        order = np.argsort(bucket, kind="stable")
        bounds = np.append(runs(bucket[order]), len(order))
        for a, b in zip(bounds[:-1], bounds[1:]):
            k, rows = int(bucket[order[a]]), order[a:b]
            out[rows] = self.file(name, k, dtype)[ids[rows] - self.offsets[k]]
        return out

    def probabilities(self, history: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of words (-1: unknown) after histories (-1: unknown) of the given counts."""
        meta = self.meta
        low_d, high_d = np.append(0.0, meta.low_discounts), np.append(0.0, meta.discounts)
        distinct, place = np.unique(word, return_inverse=True)
        before = np.zeros(len(distinct), np.int64)
        known = distinct >= 0
        before[known] = self.by_id("before", distinct[known], "<u8").astype(np.int64)
        low = (before - low_d[np.minimum(before, 3)]) / max(meta.low_total, 1) + meta.low_spare / (self.n_words + 1)
        low = low[place]

        old = history >= 0
        distinct, place = np.unique(history[old], return_inverse=True)
        seen = self.by_id("history", distinct, _HISTORY)
        total = seen["total"].astype(float)
        spare = high_d[1] * seen["once"] + high_d[2] * seen["twice"] + high_d[3] * seen["more"]
        pair = np.flatnonzero(old & (word >= 0))
        key = (history[pair].astype(U64) << U64(32)) | word[pair].astype(U64)
        keys, at = np.unique(key, return_inverse=True)
        of_history = np.zeros(len(keys), np.int64)
        of_history[at] = count[pair]
        times = np.zeros(len(word), np.int64)
        times[pair] = self.times(keys, self.pair_bucket(keys, of_history))[at]
        out = low.copy()
        met = times[old]
        out[old] = (met - high_d[np.minimum(met, 3)] + spare[place] * low[old]) / total[place]
        return out


@cache
def model(meta: Meta) -> Model:
    return Model(meta)


def _count_pairs(meta: Meta):
    def count_pairs(batches):
        own = model(meta)
        for words, _ in _chunks(batches, []):
            ids, counts, first = own.tokens(words)
            keep = np.ones(len(ids), bool)
            keep[first[1:] - 1] = False
            at = np.flatnonzero(keep)
            key, place, n = np.unique(
                (ids[at].astype(U64) << U64(32)) | ids[at + 1].astype(U64), return_index=True, return_counts=True
            )
            bucket = own.pair_bucket(key, counts[at][place])
            order = np.lexsort((key, bucket))
            key = key[order]
            columns = [(key >> U64(32), 4), (key & U64(2**32 - 1), 4), (n[order], 5)]
            yield _batch(_rows(bucket[order], columns))

    return count_pairs


def _keep_pairs(meta: Meta):
    """Writes a bucket of pairs; sends on what it tells of histories, words and counts of counts."""

    def keep_pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket, own = key[0].as_py(), model(meta)
        history, word, n = _columns(table, [4, 4, 5])
        pair, n = _summed((history << U64(32)) | word, n)
        large = n >= U64(MANY)
        kept = np.zeros(large.sum(), _LARGE)
        kept["key"], kept["times"] = pair[large], n[large]
        put(f"{meta.path}/pairs-{bucket}", pair.tobytes())
        put(f"{meta.path}/times-{bucket}", np.minimum(n, U64(MANY)).astype(np.uint8).tobytes())
        put(f"{meta.path}/large-{bucket}", kept.tobytes())
        one = np.ones(len(pair), U64)
        ids, total, once, twice, more = _summed(
            pair >> U64(32), n, *((x).astype(U64) for x in (n == 1, n == 2, n > 2))
        )
        words, before = _summed(pair & U64(2**32 - 1), one)
        none = np.zeros(len(words), U64)
        rows = _rows(own.group_of(ids), [(ids, 4), (total, 8), (once, 4), (twice, 4), (more, 4), (np.zeros(len(ids), U64), 4)])
        rows += _rows(own.group_of(words), [(words, 4), (none, 8), (none, 4), (none, 4), (none, 4), (before, 4)])
        small = np.array([*((n == i).sum() for i in (1, 2, 3, 4)), bucket], U64)
        rows.append((-1, 5, planes(small, 8)))
        return pa.Table.from_batches([_batch(rows)])

    return keep_pairs


def _keep_stats(meta: Meta):
    def keep_stats(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket, own = key[0].as_py(), model(meta)
        if bucket < 0:
            (n,) = _columns(table, [8])
            told = n.reshape(-1, 5).astype(np.int64)
            small = [*told[:, :4].sum(axis=0).tolist(), *sorted(told[:, 4].tolist())]
            return pa.table({"bucket": [bucket], "small": [small], "total": pa.array([0], pa.int64())})
        ids, *sums = _columns(table, [4, 8, 4, 4, 4, 4])
        ids, total, once, twice, more, before = _summed(ids, *sums)
        found = np.zeros(len(ids), _HISTORY)
        found["total"], found["once"], found["twice"], found["more"] = total, once, twice, more
        ids = ids.astype(np.int64)
        for b in np.flatnonzero(own.groups == bucket).tolist():
            low, high = own.offsets[b], own.offsets[b + 1]
            # The start of a text, a history but no word, comes after all words.
            high += b == meta.word_buckets - 1
            rows = slice(*np.searchsorted(ids, [low, high]))
            history, left = np.zeros(high - low, _HISTORY), np.zeros(high - low, "<u8")
            history[ids[rows] - low], left[ids[rows] - low] = found[rows], before[rows]
            put(f"{meta.path}/history-{b}", history.tobytes())
            put(f"{meta.path}/before-{b}", left.tobytes())
        small = [int((before == i).sum()) for i in (1, 2, 3, 4)] + [int((before > 2).sum())]
        return pa.table({"bucket": [bucket], "small": [small], "total": [int(before.sum())]})

    return keep_stats


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and more; where too few counts of counts are known, a half of each step."""
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))


def fit(docs: DataFrame, path: str | None = None) -> Meta:
    """Count all of ``docs(text)`` into a model's files below ``path`` (default: a new shared folder).

    Tokens are the lower-cased words (A-Z) and an end for each text; a null
    text is an end alone. The model is of order 2: pairs of neighbours,
    interpolated with how many words a word was met after, and that with a
    uniform share for each known word and one unknown. Each step counts chunks
    in tasks, sends sorted packed arrays to buckets, and writes a bucket's
    files from one task; the pairs of a very frequent history are dealt to all
    buckets. The driver sees a few numbers per bucket.
    """
    spark = docs.sparkSession
    path = qualified(spark, path) if path else new_path(spark, "lm")
    texts = docs.select("text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = BUCKETS_PER_PARTITION * partitions
    kept = (
        texts.mapInArrow(_count_words(n_buckets), PACKED)
        .groupBy("bucket")
        .applyInArrow(_keep_words(path), "bucket long, n long, total long")
        .collect()
    )
    sizes, total = {r.bucket: r.n for r in kept}, sum(r.total for r in kept)
    offsets = (0, *np.cumsum([sizes.get(b, 0) for b in range(n_buckets)]).tolist())
    if offsets[-1] >= 2**32 - 1:
        raise ValueError("more than 2^32 distinct words")
    groups = min(n_buckets, max(-(-partitions // PARTITIONS_PER_GROUP), -(-offsets[-1] // GROUP_WORDS)))
    meta = Meta(path, n_buckets, n_buckets, offsets, total, total // (8 * n_buckets), groups)
    if not total:
        return meta
    told = (
        texts.mapInArrow(_count_pairs(meta), PACKED)
        .groupBy("bucket")
        .applyInArrow(_keep_pairs(meta), PACKED)
        .groupBy("bucket")
        .applyInArrow(_keep_stats(meta), "bucket long, small array<long>, total long")
        .collect()
    )
    high = next(r.small for r in told if r.bucket < 0)
    low = np.sum([r.small for r in told if r.bucket >= 0], axis=0)
    low_total = sum(r.total for r in told)
    d = discounts(*low[:4].tolist())
    return replace(
        meta,
        pairs=tuple(high[4:]),
        discounts=discounts(*high[:4]),
        low_discounts=d,
        low_total=low_total,
        low_spare=float(d[0] * low[0] + d[1] * low[1] + d[2] * low[4]) / low_total,
    )


def _scored(meta: Meta):
    def scored(batches):
        own = model(meta)
        v = own.n_words
        for words, (doc_id, held_out) in _chunks(batches, ["doc_id", "held_out"]):
            n_docs = len(words.first) - 1
            if v:
                ids, counts, first = own.tokens(words)
                keep = np.ones(len(ids), bool)
                keep[first[1:] - 1] = False
                at = np.flatnonzero(keep)
                p = own.probabilities(ids[at], ids[at + 1], counts[at])
                c = counts[at + 1]
            else:
                c, p = np.zeros(len(words) + n_docs, np.int64), np.ones(len(words) + n_docs)
            begins = words.first[:-1] + np.arange(n_docs)
            base = np.log10((c + 0.1) / (meta.n_tokens + 0.1 * (v + 1)))
            add = lambda x: np.add.reduceat(x, begins)
            yield pa.RecordBatch.from_arrays(
                [
                    doc_id,
                    held_out,
                    pa.array(words.counts + 1, pa.int64()),
                    pa.array(add((c > 0).astype(np.int64)), pa.int64()),
                    pa.array(np.full(n_docs, meta.n_tokens), pa.int64()),
                    pa.array(add(base)),
                    pa.array(add(np.log10(p))),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return scored


def score(docs: DataFrame, meta: Meta) -> DataFrame:
    """Log10 probabilities of the whole texts of ``docs(doc_id, held_out, text)``.

    Workers map the model's files and look up sorted keys of a chunk at a
    time. Returns one row per input row: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, perplexity``. A null or empty text is an
    end alone. ``base_score`` is that of single words with 0.1 added to each
    count. A model of no texts gives every token probability 1.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    found = docs.select("doc_id", "held_out", "text").mapInArrow(_scored(meta), schema)
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score_held_out(docs: DataFrame) -> DataFrame:
    """Scores of all of ``docs(doc_id, text)`` by a model of those not held out."""
    split = docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    return score(split, fit(split.where("not held_out")))
