"""Tree search against all distances; codebooks and codes against plain integers and the query's SQL."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wakeline.llm import queries, vector_codes

SF = "/root/testdata/sf0.001"


def nearest(part, book):
    return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(book))


def plain(rows, parts=8, entries=16, rounds=6):
    """``vec_id, code, error, label_error, digest`` of ``vec_id, vector, label``."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[r][p] for r in range(min(entries, len(kept)))] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for row in cut:
                held[nearest(row[p], books[p])[1]].append(row[p])
            for e, of in held.items():
                books[p][e] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    found = [[nearest(row[p], books[p]) for p in range(parts)] for row in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), error in zip(kept, errors, strict=True):
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in f), error, by_label[label], digest) for (i, _, label), f, error in zip(kept, found, errors, strict=True)]


@pytest.mark.parametrize("spread", [1, 3, 50, 4096, vector_codes.LARGEST])
def test_search_finds_the_nearest_with_ties(spread):
    draw = np.random.default_rng(spread)
    for entries in (1, 2, 5, 16, 33):
        book = draw.integers(-spread, spread + 1, (entries, 4))
        book[entries // 2] = book[0]  # equal entries: the lower index
        points = np.concatenate([draw.integers(-spread, spread + 1, (400, 4)), book])
        index, apart = vector_codes.Search(book, vector_codes.grown(book, leaf=2))(points)
        every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (apart == every.min(axis=1)).all()


def test_search_leaves_far_entries_out():
    draw = np.random.default_rng(1)
    book = np.concatenate([draw.integers(0, 100, (8, 8)), draw.integers(9000, 9100, (8, 8))])
    search = vector_codes.Search(book)
    search(draw.integers(0, 100, (1000, 8)))
    assert search.visited < 11 * 1000


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"code": F.lit("x"), "error": F.lit(None).cast("int"), "_n": F.lit(1)})


def made(n, width=16, seed=2):
    draw = random.Random(seed)
    return [(i, [draw.choice([-0.5, 0.25, draw.uniform(-1, 1)]) for _ in range(width)], draw.choice([None, 0, 0, 0, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 9, 16, 150])
def test_codes_equal_plain_ones(spark, n):
    rows = made(n)
    bad = [(1000, None, 1), (-5, [None] + [0.0] * 15, 1), (-6, [float("nan")] * 16, 1), (-7, [float("inf")] + [0.0] * 15, None), (None, [0.25] * 16, None)]
    rows += bad + rows[: n // 3]  # repeated rows, too
    codes, books = vector_codes.compressed(frame(spark, rows))
    got = [tuple(r) for r in vector_codes.code_digests(codes, books).collect()]
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert Counter(got) == Counter(plain(rounded))


def test_labels_hot_and_rare(spark):
    codes = spark.createDataFrame([(i, (i % 50 if i % 2 else None) if i else 7, i) for i in range(400)], "vec_id long, label int, error long")
    want = Counter()
    for r in codes.collect():
        want[r.label] += r.error
    for share in (1, 3, 60, 1000):
        assert {(r.vec_id, r.label_error) for r in vector_codes.with_label_error(codes, share).collect()} == {(r.vec_id, want[r.label]) for r in codes.collect()}


def test_empty_odd_and_large(spark):
    none = frame(spark, made(3)).limit(0)
    codes, books = vector_codes.compressed(none)
    assert vector_codes.code_digests(codes, books).count() == 0
    for rows in ([(1, [0.5] * 12, 1)], [(1, [0.5] * 16, 1), (2, [0.5] * 24, 1)], [(1, [1e30] * 16, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compressed(frame(spark, rows))


def test_decoded_vectors_lie_near(spark):
    rows = made(12)
    codes, books = vector_codes.compressed(frame(spark, rows))
    back = {r.vec_id: r.vector for r in vector_codes.decode(codes, books).collect()}
    assert all(abs(x - y) <= 1 / 4096 for i, v, _ in rows for x, y in zip(v, back[i], strict=True))  # an entry for each row


def test_query_equals_plain_and_sql(spark):
    got = [tuple(r) for r in entry.queries()["op13_vector_codes"](spark, SF).collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert Counter(got) == Counter(plain(rows)) == Counter(con.execute(queries.oracle_sql()["op13_vector_codes"]).fetchall())
