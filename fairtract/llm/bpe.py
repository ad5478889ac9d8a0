"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: White space of the tokenizer's patterns, spelled out: Python's own set is wider.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPLIT = re.compile(f"[{_SPACE}]+")
_ONLY_PYTHON = re.compile("[\x1c-\x1f]")
#: Bytes of words and ids that a worker remembers, half of them met lately, and the longest word that it does:
#: longer ones, such as whole lines of scripts without spaces or encoded data, hardly come again.
REMEMBERED = 96_000_000
LONGEST = 64
#: Bytes of an entry besides its word and ids.
ENTRY = 250
#: Characters that are encoded into one batch of results: decoding takes some thirty bytes for each while it runs.
BATCH_CHARS = 500_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next letter from 256 on."""
    letters, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class Encoder:
    """Exact merges of a vocabulary with word ends, without a merge loop.

    An automaton finds the longest token from each position. A token may
    follow another if merging both alone would leave them as they are; the
    encoding is the only chain of tokens in which each may follow the one
    before. From the longest match on, shorter prefixes are tried, and a
    position from which nothing fits is not tried again, so a word is read in
    linear time.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(
            spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", f"[^{_SPACE}")
        )
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        # One letter stands for the word end, so that it takes one step in the automaton.
        self.closing = "\x00"
        self.letters = [byte_letters()[b] for b in range(256)]
        self.ids = {self._short(token): i for token, i in vocab.items()}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.formed = [-1] * size
        self.rank: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = (vocab[a], vocab[b])
            self.rank[pair] = r
            whole = vocab[a + b]
            if self.halves[whole] is None:
                self.halves[whole], self.formed[whole] = pair, r
        self.length = [0] * size
        self.prefix = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token, i)
            self.length[i] = len(token)
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in self.ids:
                    self.prefix[i] = self.ids[token[:n]]
                    break
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        strings = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            strings[i] = token
        pieces = [b" " + s.encode() for s in strings]
        self.table = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.append(0, np.cumsum([len(p) for p in pieces]))
        # Words that were met lately, and those from before that.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.room = REMEMBERED // 2

    def _short(self, token: str) -> str:
        return token.removesuffix(self.end) + self.closing if token.endswith(self.end) else token

    def may_follow(self, a: int, b: int) -> bool:
        """Whether ``a b`` stays as it is: no pair across their border merges before they are formed.

        The two are taken apart in the opposite order of their merges, the
        later one first; of equal ranks the right one is later, as merges go
        from left to right.
        """
        key = (a, b)
        known = self.fits.get(key)
        if known is not None:
            return known
        fine = key not in self.rank
        while fine:
            if self.formed[a] < 0 and self.formed[b] < 0:
                break
            if self.formed[a] > self.formed[b]:
                limit, a = self.formed[a], self.halves[a][1]
            else:
                limit, b = self.formed[b] + 1, self.halves[b][0]
            fine = self.rank.get((a, b), limit) >= limit
        self.fits[key] = fine
        return fine

    def piece(self, text: str) -> list[int]:
        """Ids of one piece of the pattern, given in byte letters with the word end."""
        whole = self.ids.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest, length = [-1] * n, self.length
        for stop, token in self.automaton.iter(text):
            start = stop + 1 - length[token]
            if longest[start] < 0 or length[token] > length[longest[start]]:
                longest[start] = token
        chain: list[int] = []
        dead = bytearray(n + 1)
        fits, prefix = self.fits, self.prefix
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                stop = at + length[token]
                if not dead[stop] and (stop == n or longest[stop] >= 0):
                    if not chain:
                        break
                    fine = fits.get((chain[-1], token))
                    if self.may_follow(chain[-1], token) if fine is None else fine:
                        break
                token = prefix[token]
            if token >= 0:
                chain.append(token)
                at = stop
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                last = chain.pop()
                at -= length[last]
                token = prefix[last]
        return chain

    def word(self, word: str) -> bytes:
        """Ids of a text without white space, as bytes of 32-bit numbers."""
        out: list[int] = []
        for part in self.special_pattern.split(word) if "<|" in word else (word,):
            if part in self.special:
                out.append(self.special[part])
                continue
            # Letter by letter: a final sigma is like any other.
            plain = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for piece in self.pattern.findall(plain):
                # Printable ASCII stands for itself.
                same = piece.isascii() and piece.isprintable()
                out += self.piece((piece if same else "".join([self.letters[b] for b in piece.encode()])) + self.closing)
        return array("i", out).tobytes()

    def encode(self, text: str) -> bytes:
        known, parts = self.words, []
        for word in _SPLIT.split(text) if _ONLY_PYTHON.search(text) else text.split():
            ids = known.get(word)
            if ids is None:
                ids = self.older.get(word)
                if ids is None:
                    ids = self.word(word)
                if len(word) <= LONGEST:
                    self.remember(word, ids)
                    known = self.words
            parts.append(ids)
        return b"".join(parts)

    def remember(self, word: str, ids: bytes) -> None:
        if self.room <= 0:
            self.older, self.words = self.words, {}
            self.room = REMEMBERED // 2
        self.words[word] = ids
        self.room -= ENTRY + 4 * len(word) + len(ids)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the token strings joined by one space, and where each document begins.

        ``first`` holds where each document's ids begin, and their number.
        Each token's bytes are copied from the table, the space before it left
        out for the first one of a document.
        """
        starts, sizes = self.offsets[ids], np.diff(self.offsets)[ids]
        leads = first[:-1][np.diff(first) > 0]
        starts[leads] += 1
        sizes[leads] -= 1
        ends = np.cumsum(sizes)
        bounds = np.append(0, ends)[first]
        source = np.repeat(starts - (ends - sizes), sizes)
        source += np.arange(len(source))
        return self.table[source], bounds


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _slices(sizes: list[int | None]):
    """Bounds of runs of whole texts of about BATCH_CHARS, by their numbers of characters."""
    start, chars = 0, 0
    for i, size in enumerate(sizes):
        chars += size or 0
        if chars >= BATCH_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _coded(path: str):
    def coded(batches):
        code = encoder(path)
        for batch in batches:
            rest = [n for n in batch.schema.names if n != "text"]
            # Only the texts of a run become Python strings at once.
            for a, b in _slices(pc.utf8_length(batch.column("text")).to_pylist()):
                own = batch.slice(a, b - a)
                parts = [code.encode(t or "") for t in own.column("text").to_pylist()]
                first = np.append(0, np.cumsum([len(p) // 4 for p in parts]))
                ids = np.frombuffer(b"".join(parts), np.int32)
                body, bounds = code.decode(ids, first)
                decoded = pa.Array.from_buffers(
                    pa.string(), b - a, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(body)]
                )
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(n) for n in rest), lists, decoded], [*rest, "ids", "decoded"]
                )

    return coded


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Token ids of whole texts and the text that they decode to.

    ``path`` names a vocabulary file of the kind ``word_bpe``: merges with word
    ends over byte letters, lower case, white space dropped. Special tokens
    spelled in a text are single ids. Decoding joins the token strings by one
    space.

    Returns ``doc_id, ids, decoded``, one row per input row in any order; null
    and empty texts have no ids and decode to an empty text. Null or repeated
    doc_ids are passed through; other columns are not read. Each worker keeps
    the ids of the short words it meets, up to ``REMEMBERED`` bytes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_coded(path), f"doc_id {kind}, ids array<int>, decoded string")
