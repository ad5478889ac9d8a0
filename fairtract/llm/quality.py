"""Quality rules: words, repeats and zstandard compression bands of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from fairtract import staging
from fairtract.llm.storage import stage
from fairtract.llm.words import _BYTE, SPACES, U64, Words, byte_slices, mix, window_hashes
from fairtract.operators.ranks import exact_quantiles

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
REPEAT_WINDOW = 3
SYMBOLS = b"#*$%&|<>"
LEVEL = 3
#: Bytes of a chunk; a last chunk of under half of that is judged with the whole text only.
CHUNK = 4096
#: Where bands begin, in bytes of text.
STARTS = (0, 128, 256, 512, 768, 1024, 1536, 2048, 3072, 4096, 6144, 8192, 16384, 32768, 65536)
#: Texts of which more than this share of the bytes are digits or outside of ASCII, such as tables of numbers
#: or other scripts, have bands of their own: their ratios differ by their alphabet alone.
MOST_OTHER = 0.3


@dataclass(frozen=True)
class Bands:
    """(bytes from, least ratio, largest ratio) of whole texts, and the same of chunks, for plain and other texts."""

    plain: tuple[tuple[int, float, float], ...]
    other: tuple[tuple[int, float, float], ...]
    plain_chunk: tuple[float, float]
    other_chunk: tuple[float, float]


#: Limits that prose, code and markup of any kind keep, with room on both sides. Text compresses better
#: the longer it is; one below its band is random or encoded, one above it repeats itself.
_WIDE = (
    (0, 0.0, 3.5),
    (128, 1.0, 3.5),
    (512, 1.15, 3.8),
    (1024, 1.3, 4.2),
    (2048, 1.4, 5.0),
    (4096, 1.5, 5.5),
    (8192, 1.6, 6.5),
    (16384, 1.7, 7.5),
    (65536, 1.8, 9.0),
)
WIDE = Bands(_WIDE, _WIDE, (1.4, 6.0), (1.3, 6.0))
#: Quantiles of good documents at which fitted limits lie, and the margins beyond them.
QUANTILES = (0.001, 0.999)
MARGINS = (0.95, 1.01)
#: Documents, or chunks, that it takes to fit a limit; with fewer the wide one holds.
LEAST_FITTED = 50
#: A text goes when more than this share of its chunks is out of band.
MAX_BAD_CHUNKS = 0.25

_OF_WORDS = np.ones(256, bool)
_OF_WORDS[list(SPACES)] = False
_OF_WORDS[0x80:0xC0] = False  # all but the first byte of a code point
_OTHER = np.zeros(256, bool)
_OTHER[0x30:0x3A] = True
_OTHER[0x80:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType())]
    + [T.StructField(c, T.DoubleType()) for c in ("ratio", "bad_chunks")]
    + [T.StructField("kept", T.BooleanType())]
)


def band(size: int, bands: tuple = WIDE.plain) -> tuple[float, float]:
    return next((low, high) for start, low, high in reversed(bands) if size >= start)


def chunk_ratios(text: bytes, compressor) -> list[float]:
    chunks = [text[a : a + CHUNK] for a in range(0, len(text), CHUNK)]
    return [len(c) / len(compressor.compress(c)) for c in chunks if len(c) >= CHUNK // 2]


def ratios(text: bytes, compressor, chunk_band: tuple[float, float] = WIDE.plain_chunk) -> tuple[float, float]:
    """Ratio of the whole text, and the share of its chunks that are out of band; of no text 1 and 0."""
    if not text:
        return 1.0, 0.0
    whole = len(text) / len(compressor.compress(text))
    low, high = chunk_band
    found = chunk_ratios(text, compressor)
    return whole, sum(not low <= x <= high for x in found) / len(found) if found else 0.0


def repeated_words(words: Words) -> np.ndarray:
    """Per document the words in windows that occur twice or more in it."""
    n = len(words)
    h = window_hashes(words.hashes, REPEAT_WINDOW)
    at = np.flatnonzero(words.left()[: len(h)] >= REPEAT_WINDOW)
    own = mix(h[at] + _BYTE[0] * words.doc_of_word()[at].astype(U64))
    _, place, times = np.unique(own, return_inverse=True, return_counts=True)
    start = at[times[place] > 1]
    steps = np.zeros(n + 1, np.int64)
    steps[start] += 1
    steps[start + REPEAT_WINDOW] -= 1
    covered = np.cumsum(steps[:n]) > 0
    return np.diff(np.append(0, np.cumsum(covered))[words.first])


def _per_document(marks: np.ndarray, words: Words) -> np.ndarray:
    low, high = words.offsets[0], words.offsets[-1]
    sums = np.append(0, np.cumsum(marks[words.data[low:high]]))
    return np.diff(sums[words.offsets - low])


def quality(bands: Bands = WIDE):
    """A function from texts to their figures and verdicts; see ``judge``."""

    @arrow_udf(RESULT)
    def figures(text: pa.Array) -> pa.Array:
        parts = [_quality(text.slice(a, b - a), bands) for a, b in byte_slices(text)]
        return pa.concat_arrays(parts) if parts else _quality(text, bands)

    return figures


def _base(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Repeated words of each text, and whether it fails the base rule."""
    n_words, repeated = words.counts, repeated_words(words)
    return repeated, (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n_words)


def _quality(text: pa.Array, bands: Bands = WIDE) -> pa.Array:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    words = Words(text)
    repeated, base_failed = _base(words)
    others = _per_document(_OTHER, words)
    dup_lines, whole, bad, kept = [], [], [], []
    for d, failed in enumerate(base_failed):
        raw = words.bytes_of(d)
        lines = [line for line in raw.split(b"\n") if line.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
        plain = others[d] <= MOST_OTHER * len(raw)
        ratio, bad_share = ratios(raw, compressor, bands.plain_chunk if plain else bands.other_chunk)
        low, high = band(len(raw), bands.plain if plain else bands.other)
        whole.append(ratio)
        bad.append(bad_share)
        kept.append(bool(not failed and low <= ratio <= high and bad_share <= MAX_BAD_CHUNKS))
    columns = {
        "n_words": pa.array(words.counts, pa.int64()),
        "word_chars": pa.array(_per_document(_OF_WORDS, words), pa.int64()),
        "n_symbols": pa.array(_per_document(_SYMBOL, words), pa.int64()),
        "n_dup_lines": pa.array(dup_lines, pa.int64()),
        "n_repeat_words": pa.array(repeated, pa.int64()),
        "base_failed": pa.array(base_failed),
        "ratio": pa.array(whole, pa.float64()),
        "bad_chunks": pa.array(bad, pa.float64()),
        "kept": pa.array(kept, pa.bool_()),
    }
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts that pass the base rule: their doc_id, whether they are of the other kind, their band, ratio and chunk ratios."""
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for a, b in byte_slices(batch.column("text")):
            words = Words(batch.column("text").slice(a, b - a))
            _, failed = _base(words)
            others, out = _per_document(_OTHER, words), []
            at = np.flatnonzero(~failed)
            for d in at.tolist():
                raw = words.bytes_of(d)
                start = max(x for x in STARTS if x <= len(raw))
                chunks = chunk_ratios(raw, compressor)
                out.append((bool(others[d] > MOST_OTHER * len(raw)), start, len(raw) / len(compressor.compress(raw)), chunks))
            columns = zip(*out) if out else ((), (), (), ())
            types = (pa.bool_(), pa.int32(), pa.float64(), pa.list_(pa.float64()))
            ids = batch.column("doc_id").slice(a, b - a).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "other", "start", "ratio", "chunks"])


def fit_bands(docs: DataFrame, labels: DataFrame, rows: int | None = None) -> Bands:
    """Bands from all documents that ``labels(doc_id, quality)`` call good (1) and that pass the base rule.

    A limit lies at a quantile of the ratios of its length and kind, exact and found without sorting them all,
    with a margin; where there are fewer than ``LEAST_FITTED`` documents the wide limit holds. Rows without a
    label, a doc_id or a text teach nothing. Texts are not shuffled: their ratios are, a few numbers each.
    ``rows`` bounds the documents to about as many by a hash of doc_id; by default all count.
    """
    spark = docs.sparkSession
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    good = good.where("good = 1").select("doc_id")
    if rows is not None:
        good = stage(good, "good")
        share = min(rows / max(good.count(), 1), 1.0)
        good = good.where(F.pmod(F.xxhash64("doc_id", F.lit("bands")), F.lit(1 << 30)) < int(share * (1 << 30)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    figures = texts.mapInArrow(_figures, f"doc_id {kind}, other boolean, start int, ratio double, chunks array<double>")
    found = stage(figures.join(good, "doc_id", "left_semi").select("other", "start", "ratio", "chunks"), "ratios")
    chunks = found.select("other", F.explode("chunks").alias("ratio"))

    def fitted(of: DataFrame, keys: list[str]) -> dict:
        sizes = of.groupBy(*keys).agg(F.count("*").alias("n"))
        quantiles = exact_quantiles(of, ["ratio"], {"low": QUANTILES[0], "high": QUANTILES[1]}, keys)
        return {tuple(r[k] for k in keys): r for r in sizes.join(quantiles, keys).collect()}

    with staging.scope(spark):
        whole, chunks = fitted(found, ["other", "start"]), fitted(chunks, ["other"])

    def limits(row, wide: tuple[float, float]) -> tuple[float, float]:
        if row is None or row.n < LEAST_FITTED:
            return wide
        return row.low * MARGINS[0], row.high * MARGINS[1]

    def of_kind(other: bool) -> tuple[tuple[int, float, float], ...]:
        return tuple((start, *limits(whole.get((other, start)), band(start, _WIDE))) for start in STARTS)

    return Bands(of_kind(False), of_kind(True), limits(chunks.get((False,)), WIDE.plain_chunk), limits(chunks.get((True,)), WIDE.other_chunk))


def judge(docs: DataFrame, bands: Bands = WIDE) -> DataFrame:
    """Figures and verdict of each of ``docs(doc_id, text)``, without a shuffle.

    ``base_failed`` texts have under 50 words or more than half of their words
    in three-word windows that occur twice or more. Of the others those are
    kept whose zstandard ratio lies in the band of their length and of whose
    chunks at most a quarter is out of band: repetitive text is above, random
    or encoded text below. ``bands`` come from ``fit_bands`` or are the wide ones.

    Returns one row per input row: ``doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, ratio, bad_chunks, kept``. A null
    or empty text has no words and fails; doc_ids may be null or repeated;
    other columns are not read.
    """
    return docs.select("doc_id", quality(bands)("text").alias("quality")).select("doc_id", "quality.*")


def is_kept(text: Column, bands: Bands = WIDE) -> Column:
    """The verdict alone, for filters."""
    return quality(bands)(text)["kept"]
