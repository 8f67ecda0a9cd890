"""Segment hashes of a batch of lines at once: lines within the edits have one in common, and unlike segments have none."""

import random

import numpy as np
import pyarrow as pa
import pytest

from hindcast.llm import lines as L


def keys(texts, edits, min_chars=10):
    counts, key, own, which = L._line_keys(pa.array(["é!", *texts])[1:], edits, min_chars, [np.zeros(0, np.uint64)] * 2)
    cut = np.cumsum(counts)[:-1]
    return [set(zip(*(x.tolist() for x in part), strict=True)) for part in zip(*(np.split(a, cut) for a in (key, own, which)), strict=True)]


def edited(rng, text, times):
    chars = list(text)
    for _ in range(times):
        at = rng.randrange(len(chars))
        chars[at:at + 1] = rng.choice([[], ["ß"], [chars[at], "木"], ["\U0001f40e", chars[at]]])
    return "".join(chars)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_lines_share_a_key(edits):
    rng = random.Random(edits)
    texts = ["".join(rng.choice("abcé木") for _ in range(rng.randint(12, 60))) for _ in range(300)]
    for a, b in zip(*(iter(keys([x for t in texts for x in (t, edited(rng, t, edits))], edits, 1)),) * 2, strict=True):
        assert {k for k, own, _ in a if own} & {k for k, _, _ in b} or {k for k, own, _ in b if own} & {k for k, _, _ in a}


def test_keys_are_those_of_segments():
    """A key tells a segment's characters, its number and the length of the text whose own it is, wherever it stands in the batch."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab木") for _ in range(rng.randint(0, 24))) for _ in range(400)]
    told = {}
    for text, found in zip(texts, keys(texts, 2), strict=True):
        n, want = len(text), 0
        places = L._places(2)
        for key, own, which in found:
            i, less, shift = places[which]
            start, stop = (n - less) * (i - 1) // 3, (n - less) * i // 3
            assert own == (less == shift == 0) and n - less >= 10
            segment = (text[start + shift:stop + shift], i, n - less)
            assert told.setdefault(key, segment) == segment
        for i, less, shift in places:
            want += n - less >= 10 and (n - less) * (i - 1) // 3 + shift >= 0 and (n - less) * i // 3 + shift <= n
        assert len(found) == want
    assert len(set(told.values())) == len(told)


def test_empty_batch():
    counts, key, *_ = L._line_keys(pa.array([], pa.string()), 2, 20, [np.zeros(0, np.uint64)] * 2)
    assert len(counts) == len(key) == 0
