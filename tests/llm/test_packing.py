"""Tokens by chunks against whole-text tokenizing; plans and packed pieces against their definition."""

import functools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wakeline.llm import packing, text

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

TEXTS = [
    "", None, " ", "\n\n", "Hello, world!", "it's  don't,\n\n  x  ", "été «là» ×!÷? ×a", "a  b　 c   d\u0085 e", "naïve, café's; 123abc,45 . ..", "日本語 テスト　 です", "<|endoftext|> <|im_end|>", "a<|endoftext|><|endoftext|>b <|endoftext", "<|im_start|>user",
    "tab\there\r\nthere \x1c x\x1f y", "😀 😀! 😀", "' 's 'S'll", "x" * 3000, "word " * 900,
]


@functools.cache
def whole():
    return tokenizers.Tokenizer.from_file(PATH)


def plain(text):
    return whole().encode(text or "", add_special_tokens=False).ids


def test_chunked_tokens_equal_whole_ones():
    ids, bounds = packing.Tokens.of(PATH)(pa.array(TEXTS, pa.string()), 0)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain(t) + [0] for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB1é×÷ß '.,!\n\t 　 語😀s"), max_size=25), min_size=1, max_size=4))
def test_chunked_tokens_equal_whole_ones_on_any_text(texts):
    ids, bounds = packing.Tokens.of(PATH)(pa.array(texts), 0)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain(t) + [0] for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 500), max_size=12))
def test_plan_places_every_rest_once(histogram):
    slots, sequences, _ = packing.plan(histogram, 64)
    seen, filled = defaultdict(list), defaultdict(list)
    for s in slots:
        for rank in range(s.low, s.high):
            x = s.begins + rank - s.low
            seen[s.length, rank].append((s.cut_at, s.size))
            filled[s.sequence + x // s.each].append((s.offset + x % s.each * s.size, s.size))
    assert sorted(seen) == sorted((m, r) for m, n in histogram.items() for r in range(n))
    for (length, _), parts in seen.items():
        at = 0
        for cut, size in sorted(parts):
            assert cut == at
            at += size
        assert at == length
    short = 0
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        short += at < 64
    assert len(filled) == sequences and short <= 1


def test_least_squares_matches_a_solvable_histogram():
    combos = packing.combinations(32)
    counts = np.zeros(32, np.int64)
    for i, j, k in combos[::7]:
        for c in (i, j, k):
            counts[c] += 100
    counts[0] = 0
    x = packing.least_squares(counts, combos, 1e-5)
    made = sum(np.bincount(c, weights=x, minlength=32) for c in combos.T)
    assert np.abs(made[1:] - counts[1:]).max() < 5


def test_least_squares_places_most_rests():
    """On the given documents four fifths of the rests and more lie in solved combinations; the fewest sequences that can hold all suffice."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    _, bounds = packing.Tokens.of(PATH)(texts, 0)
    lengths = np.diff(bounds) % 1024
    histogram = dict(zip(*(a.tolist() for a in np.unique(lengths[lengths > 0], return_counts=True)), strict=True))
    _, sequences, solved = packing.plan(histogram, 1024)
    assert solved >= 0.8 * sum(histogram.values()) and sequences == -(-int(lengths.sum()) // 1024)


def test_packed_pieces(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (4, TEXTS[4])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, length int").repartition(3)
    got = packing.packing_digests(packing.pack_documents(docs, PATH, 128)).collect()
    parts = defaultdict(list)
    for r in got:
        parts[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for i, t in enumerate(TEXTS):
        ids = np.array(plain(t) + [0], "<u4")
        times = 2 if i == 4 else 1
        assert sum(p[1] for p in parts[i]) == len(ids) * times
        for start, length, crc, total in parts[i]:
            assert total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, PATH).count() == 0


def test_a_worker_holds_one_tokenizer(spark, monkeypatch):
    """A run's tokenizer goes before the next run's is made, and a worker that takes up another stage keeps none."""
    held = []
    made = packing.Tokens.__init__
    monkeypatch.setattr(packing.Tokens, "__init__", lambda self, path: (held.append(sum(isinstance(x[1], packing.Tokens) for x in text.kept.values())), made(self, path))[1])
    text.kept.clear()
    one = packing.Tokens.of(PATH, "a")
    assert packing.Tokens.of(PATH, "a") is one and packing.Tokens.of(PATH, "b") is not one
    assert held == [0, 0] and len(text.kept) == 1

    def left(batches):
        for part in text.pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(text.kept)])], names=["n"])

    def tokenized(batches):
        for part in text.pieces(batches):
            packing.Tokens.of(PATH, "a")(part.column("text"), 0)
            yield pa.RecordBatch.from_arrays([pa.array([len(text.kept)])], names=["n"])

    docs = spark.range(4).selectExpr("'some words' AS text").repartition(4)
    assert {r.n for r in docs.mapInArrow(tokenized, "n long").collect()} == {1}
    assert {r.n for r in docs.mapInArrow(left, "n long").collect()} == {0}
