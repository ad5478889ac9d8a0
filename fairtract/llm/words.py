"""Vectorised word hashes of Arrow text columns, and packed arrays for shuffles.

A word is a run of bytes other than the six ASCII white-space bytes, so it is
the same as the pattern ``[^\\x20\\x09-\\x0D]+`` on code points. All work is on
numpy arrays over the bytes of whole texts; a null text counts as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: White space of the word pattern.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same words for Spark's and DuckDB's regular expressions.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256).astype(U64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(int(_BASE), -1, 2**64))
_STEP = U64(0xD6E8FEB86659FD93)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed at once; a longer document makes a longer slice.
SLICE = 1 << 20
#: Bytes of whole texts that an operator works on at once.
SLICE_BYTES = 8_000_000
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        grown = np.full(max(n, 1 << 16), base, U64)
        grown[0] = 1
        known = _powers[name] = np.cumprod(grown, dtype=U64)
    return known


class Words:
    """Words of a batch of documents: document ``d`` has words ``first[d]`` to ``first[d + 1]``.

    ``starts`` and ``ends`` are byte positions in ``data``; ``hashes`` are
    64-bit hashes of the words' bytes.
    """

    def __init__(self, texts, lower: bool = False):
        data, offsets = _bytes_of(texts)
        self.data, self.offsets = data, offsets
        n = len(offsets) - 1
        starts, ends, hashes, first = [], [], [], [0]
        a = 0
        while a < n:
            # Whole documents, about SLICE bytes of them.
            b = int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1
            b = min(max(b, a + 1), n)
            s, e, h, counts = _words(data, offsets[a : b + 1], lower)
            starts.append(s)
            ends.append(e)
            hashes.append(h)
            first.extend((first[-1] + np.cumsum(counts)).tolist())
            a = b
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.first = np.array(first, np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """For each word, how many words its document has from there on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))

    def bytes_of(self, d: int) -> bytes:
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes()


def byte_slices(texts: pa.Array, size: int = SLICE_BYTES):
    """Bounds of runs of whole texts of about ``size`` bytes, a longer text alone."""
    upto = np.cumsum(pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = upto[start - 1] if start else 0
        stop = max(int(np.searchsorted(upto, done + size, "right")), start + 1)
        yield start, stop
        start = stop


def _bytes_of(texts) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32) if len(texts) else np.zeros(1, np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2] if len(texts) else None
    return np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8), offsets


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool):
    low, high = offsets[0], offsets[-1]
    body = data[low:high]
    size = len(body)
    counts = np.zeros(len(offsets) - 1, np.int64)
    if not size:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64), counts
    if lower:
        body = _LOWER[body]
    blank = _IS_SPACE[body]
    bounds = offsets - low
    opens = np.ones(size, bool)
    opens[1:] = blank[:-1]
    opens[bounds[:-1][bounds[:-1] < size]] = True
    opens &= ~blank
    closes = np.ones(size, bool)
    closes[:-1] = blank[1:]
    inner = bounds[1:]
    closes[inner[inner > 0] - 1] = True
    closes &= ~blank
    s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    sums = np.zeros(size + 1, U64)
    np.cumsum(_BYTE[body] * _power("up", _BASE, size)[:size], out=sums[1:])
    h = mix((sums[e] - sums[s]) * _power("down", _BASE_INV, size)[s] + (e - s).astype(U64) * _STEP)
    counts = np.diff(np.searchsorted(s, bounds))
    return s + low, e + low, h, counts


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """For each position the hash of the ``k`` items from there; ends without ``k`` items are cut."""
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= _STEP
        out += h[j : j + n]
    return mix(out)


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned values, byte position by byte position.

    Sorted or small values have runs in their high bytes, which the shuffle's
    compression then removes.
    """
    wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(wide[:, :width].T).tobytes()


def unplanes(packed: bytes, n: int, width: int, at: int = 0) -> tuple[np.ndarray, int]:
    """Values written by ``planes`` at byte ``at``, and the position after them."""
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8, n * width, at).reshape(width, n).T
    return out.reshape(-1).view("<u8"), at + n * width


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_values), bool)
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    return np.flatnonzero(new)
