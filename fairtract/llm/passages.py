"""Removal of passages that occur before, by fixed-block anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairtract.llm.words import U64, Words, mix, planes, runs, unplanes, window_hashes

#: Characters of text that one part of the documents holds; a longer document is a part of its own size.
PART_CHARS = 2_000_000
#: Key ranges per shuffle partition, so that partitions are even.
BUCKETS_PER_PARTITION = 8
#: Bytes of an anchor's hash besides its bucket; a false hit only adds a window to verify.
ANCHOR_BYTES = 3
_LAST_ID = np.iinfo(np.int64).max
_WINDOW_STEP = U64(0xD6E8FEB86659FD93)


def _sorted_part(table: pa.Table) -> pa.Table:
    """Rows of a part in the order of the documents, whatever order they came in."""
    return table.sort_by([("doc", "ascending"), ("text", "ascending")]).combine_chunks()


def _windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows by start, and which starts have a whole window in their document."""
    h = window_hashes(words.hashes, k)
    return h, words.left()[: len(h)] >= k


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order that sorts the values, and in it where each run of equal ones begins."""
    order = np.argsort(values, kind="stable")
    return order, runs(values[order])


def _by_bucket(bucket: np.ndarray, part: int, columns: list[tuple[np.ndarray, int]]):
    """Rows ``bucket, part, n, data`` from columns that are sorted by bucket."""
    begins = runs(bucket)
    ends = np.append(begins[1:], len(bucket)) if len(begins) else begins
    return [
        (int(bucket[a]), part, int(b - a), b"".join(planes(c[a:b], width) for c, width in columns))
        for a, b in zip(begins, ends)
    ]


def _packed(rows) -> pa.Table:
    bucket, part, n, data = zip(*rows) if rows else ((), (), (), ())
    return pa.table(
        {
            "bucket": pa.array(bucket, pa.int64()),
            "part": pa.array(part, pa.int64()),
            "n": pa.array(n, pa.int64()),
            "data": pa.array(data, pa.binary()),
        }
    )


PACKED = "bucket long, part long, n long, data binary"


def _probes(block: int, n_buckets: int):
    """Of each part: a row for each distinct rolling block, marked if it is an aligned block too, and if it is met twice."""

    def probes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = _sorted_part(table)
        words = Words(table["text"])
        h, whole = _windows(words, block)
        within = (np.arange(len(words)) - np.repeat(words.first[:-1], words.counts))[: len(h)]
        at = np.flatnonzero(whole)
        h, aligned = h[at], within[at] % block == 0
        order, begins = _groups(h)
        any_aligned = np.add.reduceat(aligned[order], begins, dtype=np.int64) > 0 if len(begins) else np.zeros(0, bool)
        first = order[begins]
        twice = np.diff(np.append(begins, len(order))) > 1
        h, mark = h[first], at[first] * 4 + twice * 2 + any_aligned
        bucket = (h >> U64(32)) % U64(n_buckets)
        anchor = h & U64(256**ANCHOR_BYTES - 1)
        order = np.lexsort((anchor, bucket))
        return _packed(_by_bucket(bucket[order], key[0].as_py(), [(anchor[order], ANCHOR_BYTES), (mark[order], 4)]))

    return probes


def _read(table: pa.Table, widths: list[int]):
    """Columns of all rows of a bucket, one after the other, and the row of each entry."""
    columns, owner = [[] for _ in widths], []
    for i, (n, data) in enumerate(zip(table["n"].to_pylist(), table["data"])):
        at, data = 0, data.as_buffer()
        for c, width in zip(columns, widths):
            values, at = unplanes(data, n, width, at)
            c.append(values)
        owner.append(np.full(n, i, np.int32))
    return [np.concatenate(c) for c in columns], np.concatenate(owner)


def _answers(key: tuple[pa.Scalar, ...], table: pa.Table, owner: np.ndarray, positions: np.ndarray) -> pa.Table:
    """Positions grouped by the row that they came from."""
    order = np.argsort(owner, kind="stable")
    owner, positions = owner[order], positions[order]
    begins = runs(owner)
    ends = np.append(begins[1:], len(owner)) if len(begins) else begins
    part = table["part"].to_pylist()
    rows = [(key[0].as_py(), part[owner[a]], int(b - a), planes(positions[a:b], 4)) for a, b in zip(begins, ends)]
    return _packed(rows)


def _hits(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Anchors that occur twice, in one part or in two, and at least once aligned."""
    (anchor, mark), owner = _read(table, [ANCHOR_BYTES, 4])
    order, begins = _groups(anchor)
    size = np.diff(np.append(begins, len(order)))
    marks = np.bitwise_or.reduceat(mark[order], begins)
    aligned, twice = marks & U64(1) > 0, marks & U64(2) > 0
    hit = order[np.repeat(((size > 1) | twice) & aligned, size)]
    return _answers(key, table, owner[hit], (mark >> U64(2))[hit])


def _positions(table: pa.Table) -> np.ndarray:
    found = [unplanes(d.as_buffer(), n, 4)[0] for n, d in zip(table["n"].to_pylist(), table["data"])]
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def _window_pair(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each whole window, and the windows' starts."""
    h, whole = _windows(words, window)
    second = window_hashes(mix(words.hashes + _WINDOW_STEP), window)
    at = np.flatnonzero(whole)
    return h[at], second[at], at


def _candidates(window: int, block: int, n_buckets: int):
    """Of each part: the first start of each distinct window that can be a repeat, and the other starts for itself.

    All aligned blocks of a repeated window were found by a rolling block of
    the other place, so all of them must be hits.
    """

    def candidates(key: tuple[pa.Scalar, ...], table: pa.Table, hits: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _packed([])
        table = _sorted_part(table)
        words = Words(table["text"])
        h = window_hashes(words.hashes, block)
        # A hit stands for all windows of its part with the same words.
        hit = np.isin(h, np.unique(h[_positions(hits)]))
        within = np.arange(len(words)) - np.repeat(words.first[:-1], words.counts)
        a, b, at = _window_pair(words, window)
        held = np.ones(len(at), bool)
        aligned = at + -within[at] % block
        while len(inside := np.flatnonzero(aligned + block <= at + window)):
            held[inside] &= hit[aligned[inside]]
            aligned += block
        a, b, at = a[held], b[held], at[held]
        order = np.lexsort((at, b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        first, again = order[new], np.sort(at[order[~new]])
        a, b, at = a[first], b[first], at[first]
        bucket = (b >> U64(32)) % U64(n_buckets)
        # In page order, so that positions and ids have runs in their high bytes.
        order = np.lexsort((at, bucket))
        doc = table["doc"].to_numpy()[np.searchsorted(words.first, at, "right") - 1].astype(np.int64)
        doc = doc.view(U64) ^ U64(1 << 63)  # unsigned in the order of the signed ids
        low = int(doc.min()) if len(doc) else 0
        columns = [(a[order], 8), (b[order] & U64(0xFFFF), 2), (doc[order] - U64(low), 8), (at[order], 4)]
        part = key[0].as_py()
        rows = [(k, p, n, low.to_bytes(8, "little") + d) for k, p, n, d in _by_bucket(bucket[order], part, columns)]
        # Later starts in the part itself are late; they come back in a bucket of its own.
        return _packed([*rows, (-1 - part, part, len(again), planes(again, 4))])

    return candidates


def _later(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Starts of windows whose words start earlier in another part."""
    if key[0].as_py() < 0:
        return table
    columns, owner = [[], [], [], []], []
    parts = table["part"].to_pylist()
    for i, (n, data) in enumerate(zip(table["n"].to_pylist(), table["data"])):
        data = data.as_buffer()
        low = int.from_bytes(memoryview(data)[:8], "little")
        at = 8
        for c, width in zip(columns, (8, 2, 8, 4)):
            values, at = unplanes(data, n, width, at)
            c.append(values)
        columns[2][-1] = columns[2][-1] + U64(low)
        owner.append(np.full(n, i, np.int32))
    a, b, doc, at = (np.concatenate(c) for c in columns)
    owner = np.concatenate(owner)
    part = np.array(parts)[owner]
    order = np.lexsort((at, part, doc, b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    late = order[~new]
    return _answers(key, table, owner[late], at[late])


def _cut(window: int):
    """Kept words of each document of a part: the words of its late windows go."""

    def cut(key: tuple[pa.Scalar, ...], table: pa.Table, late: pa.Table) -> pa.Table:
        table = _sorted_part(table)
        words = Words(table["text"])
        # A window that is late is so at all its places, of which all but the first are in the list.
        removed = _positions(late)
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, removed, 1)
        np.add.at(steps, removed + window, -1)
        covered = np.cumsum(steps)[:-1] > 0
        n_removed = np.diff(np.append(0, np.cumsum(covered))[words.first])
        kept, spans = [], []
        for d, gone_words in enumerate(n_removed):
            tokens = words.bytes_of(d).split()
            if gone_words:
                mask = covered[words.first[d] : words.first[d + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                spans.append([{"start": s, "stop": e} for s, e in edges.reshape(-1, 2).tolist()])
                tokens = [t for t, m in zip(tokens, mask.tolist()) if not m]
            else:
                spans.append([])
            kept.append(b" ".join(tokens))
        return (
            table.drop(["part"])
            .append_column("n_words", pa.array(words.counts, pa.int64()))
            .append_column("n_removed", pa.array(n_removed, pa.int64()))
            .append_column("kept_text", pa.array(kept, pa.binary()).cast(pa.string()))
            .append_column("spans", pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))))
        )

    return cut


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """Documents of ``docs(doc_id, text, ...)`` without the words of earlier passages.

    A word goes if a window of ``window`` words of one document covers it whose
    words also start earlier: in a document of smaller doc_id, or earlier in
    the same one.

    Reference blocks of half a window lie end to end in every document, so each
    whole window holds one, wherever it starts. All rolling blocks probe them,
    by hash, those of their own part as well. Windows whose blocks are all hits are the candidates, verified by a hash over
    all their words (80 bits besides the bucket, which is a hash of its own)
    against the earliest start of the same words;
    overlapping verified windows are the maximal repeats that are cut.

    Documents lie in parts by a hash of their id, all of about ``PART_CHARS``.
    A part sends each distinct block and window once, so a passage that very
    many documents share costs a row per part, and no pairs are made. Rows
    between parts are packed arrays; the documents are shuffled once and read
    from that shuffle by each of the three passes.

    Returns one row per input row: ``doc_id, text, rest, n_words, n_removed,
    kept_text, spans``; ``rest`` is a struct of the other columns whatever their
    names, ``kept_text`` the kept words joined by one space, ``spans`` the word
    ranges that went. A null text has no words. A null doc_id comes after all
    others. Rows of equal id are in order of their texts, so of two equal rows
    one is earlier. Windows do not cross documents; shorter documents stay.
    """
    spark = docs.sparkSession
    block = window // 2
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    chars = docs.agg(F.sum(F.length("text"))).head()[0] or 0
    n_parts = max(int(chars // PART_CHARS), 1)
    n_buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = docs.select(
        F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(n_parts)).alias("part"),
        F.coalesce("doc_id", F.lit(_LAST_ID)).alias("doc"),
        F.col("doc_id"),
        F.col("text"),
        (F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("string")).alias("rest"),
    )
    # The same shuffle serves all three passes.
    grouped = parted.groupBy("part")
    probes = grouped.applyInArrow(_probes(block, n_buckets), PACKED)
    hits = probes.groupBy("bucket").applyInArrow(_hits, PACKED)
    candidates = grouped.cogroup(hits.groupBy("part")).applyInArrow(_candidates(window, block, n_buckets), PACKED)
    late = candidates.groupBy("bucket").applyInArrow(_later, PACKED)
    out = parted.drop("part").schema.simpleString()[7:-1]
    cut = grouped.cogroup(late.groupBy("part")).applyInArrow(
        _cut(window), f"{out},n_words:bigint,n_removed:bigint,kept_text:string,spans:array<struct<start:bigint,stop:bigint>>"
    )
    return cut.drop("doc")
