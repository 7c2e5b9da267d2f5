"""Near duplicates against all pairs."""

import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wakeline.llm import near_dup
from wakeline.llm.near_dup import OrderMinHash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingled(text, k=5):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    seen, out = Counter(), []
    for i in range(max(1, len(words) - k + 1) if words else 0):
        gram = tuple(words[i : i + k])
        out.append((gram, seen[gram]))
        seen[gram] += 1
    return out


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def classes(texts, least=0.8):
    grams = [shingled(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            n, m = len(grams[i]), len(grams[j])
            same = grams[i] == grams[j]
            if same or (min(n, m) >= least * max(n, m) and n and (s := common(grams[i], grams[j])) / (n + m - s) >= least):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 30), unique=True, max_size=25), st.lists(st.integers(0, 30), unique=True, max_size=25))
def test_alignment_equals_common_subsequence(a, b):
    s = common(a, b)
    expected = s / (len(a) + len(b) - s) if a and b else 0.0
    got = near_dup.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
    assert got == (expected if expected >= 0.8 else got if got < 0.8 else -1)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + rng.randint(0, 1)] = [f"new{rng.randrange(10_000)}"] * rng.randint(0, 1)
    return " ".join(words)


@pytest.mark.parametrize(("rounds", "block"), [(2, 6 << 20), (1, 4000)])
def test_classes_equal_all_pairs(spark, rounds, block):
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(30, 160))] for _ in range(8)]
    texts = [edited(rng, b, rng.randint(0, 9)) for b in bases for _ in range(9)]
    texts += [texts[0].upper(), texts[3] + "!", "", None, " .,", "one two", "One, two", "one two three four five", "é" * 20_000]
    docs = spark.createDataFrame([(100 + i, t, "own", i) for i, t in enumerate(texts)], "doc_id long, text string, row string, same int").coalesce(2)
    how = OrderMinHash(rounds=rounds, block_bytes=block)
    got = {r.doc_id: r for r in near_dup.duplicate_classes(docs, how).collect()}
    assert [got[100 + i].class_id - 100 for i in range(len(texts))] == classes(texts)
    assert sum(r.kept for r in got.values()) == len({r.class_id for r in got.values()})
    stay = near_dup.without_duplicates(docs, how).collect()
    assert sorted(r.doc_id for r in stay) == sorted({r.class_id for r in got.values()}) and {r.row for r in stay} == {"own"}


def test_nulls_repeats_and_empty(spark):
    long = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([(None, long), (7, long), (7, long), (None, "alone here"), (9, None)], "doc_id long, text string")
    rows = [(r.doc_id, r.class_id, r.kept) for r in near_dup.duplicate_classes(docs).collect()]
    assert sorted(rows, key=str) == sorted([(None, 7, False), (7, 7, True), (7, 7, False), (None, None, True), (9, 9, True)], key=str)
    assert near_dup.duplicate_classes(docs.limit(0)).count() == 0


def test_blocks_find_links_that_stars_miss():
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words), " ".join(words[:-6]), " ".join(words[:-12])]
    table = pa.table({"row": [1, 2, 3, 3], "component": [1, 2, 3, 3], "text": [*texts, texts[2]], "probe": [True, False, True, False]}).combine_chunks()
    assert sorted(zip(*near_dup._block_links(table, OrderMinHash()), strict=True)) == [(1, 2), (2, 3)]
