"""Flat text helpers and rule statistics against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest

from wakeline.llm import quality_rules
from wakeline.llm.text import ALNUM, LOWER, SOLID, Rolling, Spans, flat, occurrence, shingles

TEXTS = [
    "", None, " ", "a", "A b\nA b\n\n  \nA b", "é|è #x# é|è", "one two three four five one two three four five six", "\n\n", "x" * 5000, "a a a a a a a a a",
    "tail space \ntail space", "tail space \ntail space ", "1 2 3 4 5 6 1 2 3 4 5\t\x0b\x0c\r1 2 3 4 5", " word  <&>", "b\nB\nb",
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)]


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[::-1], [], [None], TEXTS * 3])
def test_statistics_equal_plain_ones(texts):
    offsets, data = flat(pa.array(texts, pa.string()))
    found = np.stack(quality_rules.text_stats(offsets, data), axis=1) if texts else []
    assert [list(map(int, x)) for x in found] == [plain(t) for t in texts]


def test_words_and_shingles():
    offsets, data = flat(pa.array(["Be or Not", "", "be or not to Be or noT", "x"]))
    low = LOWER[data]
    words = Spans(low, offsets, ALNUM)
    assert np.diff(words.first).tolist() == [3, 0, 7, 1]
    hashes = Rolling(low).of(words.start, words.end)
    assert hashes[0] == hashes[3] == hashes[7] and hashes[1] != hashes[0]
    grams, bounds = shingles(hashes, words.first, 3)
    assert np.diff(bounds).tolist() == [1, 0, 5, 1]
    assert grams[0] == grams[1] == grams[5]
    assert occurrence(np.array([5, 5, 5], np.uint64), np.array([0, 1, 0]))[0].tolist() == [0, 0, 1]
    assert SOLID[ord("a")] and not SOLID[0x0B]
