"""Words, hashes and packed arrays."""

import random
import re

import numpy as np
import pyarrow as pa

from fairtract.llm import words as w

TEXTS = ["", None, "a", " a ", "a b  c\n\nd\te\x0b\x0cf\r", "\x1ca\x85b\xa0c", "é É ß", "x" * 5000, "A a", " \n", "b c"] * 3


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_equal_the_pattern():
    for lower in (False, True):
        found = w.Words(pa.array(TEXTS), lower)
        for d, text in enumerate(TEXTS):
            rows = slice(found.first[d], found.first[d + 1])
            own = [found.data[a:b].tobytes().decode() for a, b in zip(found.starts[rows], found.ends[rows])]
            assert own == plain(text)
        by_word = {}
        for text, rows in zip(TEXTS, zip(found.first[:-1], found.first[1:])):
            for word, h in zip(plain(text), found.hashes[slice(*rows)]):
                key = re.sub("[A-Z]", lambda m: m[0].lower(), word) if lower else word
                assert by_word.setdefault(key, h) == h
        assert len(set(by_word.values())) == len(by_word)


def test_words_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(2)
    texts = pa.array(["".join(rng.choice("abé \n") for _ in range(rng.randrange(300))) for _ in range(200)])
    whole = w.Words(texts)
    monkeypatch.setattr(w, "SLICE", 64)
    cut = w.Words(texts.slice(0, 200))
    np.testing.assert_array_equal(whole.hashes, cut.hashes)
    np.testing.assert_array_equal(whole.first, cut.first)
    part = w.Words(texts.slice(50, 20))
    np.testing.assert_array_equal(part.hashes, whole.hashes[whole.first[50] : whole.first[70]])
    bounds = list(w.byte_slices(texts, 1000))
    assert bounds[0][0] == 0 and bounds[-1][1] == 200 and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))


def test_planes_round_trip():
    values = np.array([0, 1, 255, 256, 2**40 - 1, 77], np.uint64)
    packed = b"xx" + w.planes(values, 5) + w.planes(values[:2], 8)
    first, at = w.unplanes(packed, 6, 5, 2)
    second, at = w.unplanes(packed, 2, 8, at)
    assert first.tolist() == values.tolist() and second.tolist() == [0, 1] and at == len(packed)
