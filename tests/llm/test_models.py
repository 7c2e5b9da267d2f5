"""Decontamination, WARC, the line CRF and quality rules against brute force, round trips and held-out rows."""

import base64
import hashlib
import itertools
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wakeline.llm import decontaminate, quality_crf, quality_rules, warc
from wakeline.llm.text import flat

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def grams(words, k=5):
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def plain_leaks(docs, items, least=0.8):
    out = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        w, target = words_of(text), words_of(item)
        best = None
        for s in range(len(w) - len(target) + 1) if target else ():
            a, b = grams(w[s : s + len(target)]), grams(target)
            similarity = sum((a & b).values()) / sum((a | b).values())
            if similarity >= least and (best is None or similarity > best[0]):
                best = (similarity, s)
        if best:
            out.add((d, i, best[1], len(target), round(best[0], 9)))
    return out


def test_leaks_equal_all_windows(spark):
    rng = random.Random(9)
    items = [(i, " ".join(f"t{rng.randrange(90)}" for _ in range(rng.randint(6, 60)))) for i in range(12)] + [(50, "only Three words"), (51, ""), (52, None), (None, "an item without any id at all"), (60, "a b a b a b a b a b a b a b")]
    docs = []
    for d in range(60):
        item = words_of(rng.choice(items)[1])
        for _ in range(rng.randint(0, 3)):
            if item:
                item[rng.randrange(len(item))] = "zz"
        pad = lambda: [f"t{rng.randrange(90)}" for _ in range(rng.randint(0, 30))]
        docs.append((d, " ".join([*pad(), *item, *pad()])))
    docs += [(70, "Only, three WORDS!"), (71, None), (72, ""), (73, "x " * 9000 + items[0][1]), (74, "b a b a b a b a b a b a b a b"), (None, items[1][1])]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    expected = plain_leaks(docs, items)
    for block in (32 << 20, 300):
        got = {(r.doc_id, r.item_id, r.start_word, r.n_words, round(r.similarity, 9)) for r in decontaminate.find_leaks(frame, bench, block_bytes=block).collect()}
        assert got == expected
    clean = {d for d, _ in docs} - {d for d, *_ in expected}
    assert {r.doc_id for r in decontaminate.decontaminated(frame, bench).collect()} == clean
    in_blocks = decontaminate.decontaminated(frame, bench, block_bytes=100)
    assert in_blocks.columns == frame.columns and {r.doc_id for r in in_blocks.collect()} == clean
    # Many blocks, but no Python node above another.
    plan = [line for line in in_blocks._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line]
    assert len(plan) > 5 and len({len(line) - len(line.lstrip(" +:-|")) for line in plan}) == 1
    assert decontaminate.decontaminated(frame, bench.limit(0), block_bytes=100).count() == len(docs) and decontaminate.decontaminated(frame.limit(0), bench, block_bytes=100).count() == 0
    assert decontaminate.find_leaks(frame, bench.limit(0)).count() == 0 and decontaminate.find_leaks(frame.limit(0), bench).count() == 0


def test_texts_shorter_than_an_item_are_compared_whole(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"t{rng.randrange(60)}" for _ in range(rng.randint(5, 60)))) for i in range(10)] + [(20, "one two three four"), (21, "a b " * 12)]
    docs = []
    for _, item in items:
        w = words_of(item)
        docs += [w[1:], w[:-1], w[: len(w) // 2] + w[len(w) // 2 + 1 :], w[: int(len(w) * 0.85)], w[: len(w) * 2 // 3], w[:4]]
    docs = [(d, " ".join(w)) for d, w in enumerate(docs)]
    expected = plain_leaks(docs, items)
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = grams(words_of(text)), grams(words_of(item))
        if len(words_of(text)) < len(words_of(item)) and a and sum((a & b).values()) / sum((a | b).values()) >= 0.8:
            expected.add((d, i, 0, len(words_of(text)), round(sum((a & b).values()) / sum((a | b).values()), 9)))
    assert len(expected) > 20
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words, round(r.similarity, 9)) for r in decontaminate.find_leaks(frame, bench).collect()}
    assert got == expected
    assert {r.doc_id for r in decontaminate.decontaminated(frame, bench).collect()} == {d for d, _ in docs} - {d for d, *_ in expected}


def test_archive_round_trip(spark):
    pages = [(i, f"http://h/{i}", "<p>é" + "x" * (i % 4) * 50) for i in range(40)] + [(50, None, None), (51, "http://a b\r\nX: y", ""), (52, "u", "z" * 300_000), (None, "n", "once"), (53, "u", "once"), (53, "u", "once")]
    df = spark.createDataFrame([(*p, "d") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.archive_round_trip(df).collect()
    keeper = {}
    for i, _, h in pages:
        keeper[h or ""] = max(keeper.get(h or "", -1), -1 if i is None else i)
    expected = Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        first = keeper[h or ""] == (-1 if i is None else i)
        expected[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else keeper[h or ""]] += 1
    assert Counter(tuple(r) for r in got) == expected
    moved = warc.deduplicated(df, most_broadcast=0)
    assert {tuple(r) for r in moved.collect()} == {tuple(r) for r in warc.deduplicated(df).collect()}
    least = warc.archive_round_trip(df, least_bytes=60).collect()
    assert all(r.record_type == "response" for r in least if r.payload_bytes < 60) and any(r.record_type == "revisit" for r in least)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_archives_of_others(spark, tmp_path):
    import gzip

    a = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<a>")], b"software: x")
    b = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<b>"), ("Content-Type", "application/http")], b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\nmore")
    (tmp_path / "one.warc").write_bytes(a + b)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(a) + gzip.compress(b))
    (tmp_path / "three.warc.gz").write_bytes(warc.member(a, 6) + warc.member(b, 6))
    warc.register(spark)
    df = spark.read.format("warc").load(f"file://{tmp_path}")
    assert df.count() == 6
    got = df.filter("record_type = 'response'").collect()
    assert [bytes(r.payload) for r in got] == [b"body\r\n\r\nmore"] * 3
    only = spark.read.format("warc").option("payloads", "false").load(f"file://{tmp_path}").filter(F.col("record_id").isin("<a>", "<c>")).collect()
    assert len(only) == 3 and all(r.payload is None for r in only)


def test_records_without_a_length(spark, tmp_path):
    import gzip

    part = lambda name, block: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{name}>\r\n\r\n".encode() + block + b"\r\n\r\n"
    whole = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<c>")], b"three")
    (tmp_path / "one.warc").write_bytes(part("a", b"one\r\n\r\nline") + part("b", b"") + whole + part("d", b"x" * 9000))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(part("e", b"five")) + gzip.compress(whole))
    (tmp_path / "three.warc").write_bytes(b"")
    warc.register(spark)
    for payloads in ("true", "false"):
        df = spark.read.format("warc").option("payloads", payloads).option("bufferBytes", 64).load(f"file://{tmp_path}")
        got = sorted((r.record_id, r.payload and bytes(r.payload)) for r in df.collect())
        said = {"<a>": b"one\r\n\r\nline", "<b>": b"", "<c>": b"three", "<d>": b"x" * 9000, "<e>": b"five"}
        assert got == sorted((i, (said[i] or b"") if payloads == "true" else None) for i in ["<a>", "<b>", "<c>", "<c>", "<d>", "<e>"])


def test_repeated_ids_do_not_fill_the_forests_sample(spark):
    stats = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), *[F.when(F.col("id") % 3 > 0, F.lit(40 + i)).otherwise(F.col("id") * (i + 2) % 97 + 10).alias(c) for i, c in enumerate(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])])
    got = quality_rules.scored(stats, trees=20, sample_rows=500).groupBy("doc_id").agg(F.max("anomaly").alias("a")).collect()
    assert len({round(r.a, 6) for r in got}) > 60


def good_and_bad(n, seed, every=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(1, 6)):
            words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(4, 20))]
            lines.append(" ".join(w + rng.choice(["###", "$$$", ""]) for w in words) if i % every == 0 else " ".join(words).capitalize() + ".")
        out.append((i, "\n".join(lines), int(i % every > 0)))
    return out


def test_classifier_on_held_out_rows(spark):
    rows = good_and_bad(600, 1) + [(1000, None, None), (1001, "", None), (1002, " \n ", None), (1003, "word " * 20_000, None)]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t, _ in rows] + [(None, "no id.", "x", 5)], "doc_id long, text string, score string, first int")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if q is not None] + [(None, 1, 0), (1, None, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_crf.score_quality(docs, labels).collect()}
    held = [i for i, *_ in rows if got[i].held_out]
    assert held == [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0] and not got[None].held_out
    truth = {i: q for i, _, q in rows if q is not None}
    assert np.mean([got[i].predicted == truth[i] for i in held if i in truth]) > 0.97
    assert got[1000].score == got[1001].score == got[1002].score and all(0 <= r.score <= 1 for r in got.values())
    kept = quality_crf.good_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    one = quality_crf.score_quality(docs, labels.filter("quality = 1")).select("score").distinct().collect()
    assert [r.score for r in one] == [1.0]
    assert quality_crf.score_quality(docs.limit(0), labels.limit(0)).count() == 0


def test_lines_of_both_kinds_are_told_apart():
    """Only documents are labelled, many hold some lines of the other kind."""
    rng = random.Random(1)
    words = lambda: ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(4, 20))]
    kinds = {False: lambda: " ".join(w + rng.choice(["###", "$$$", ""]) for w in words()), True: lambda: " ".join(words()).capitalize() + "."}
    texts, good = [], []
    for i in range(400):
        good.append(i % 3 > 0)
        texts.append("\n".join([kinds[good[-1]]() for _ in range(rng.randint(3, 8))] + [kinds[not good[-1]]() for _ in range(rng.random() < 0.4)]))
    chain = quality_crf.fit(quality_crf.Lines(*quality_crf.line_features(*flat(pa.array(texts))), np.array(good)), quality_crf.Training())
    truth = [[True] * 5 + [False] * 4, [True] * 6 + [False], [False] * 5 + [True], [True, False] * 6, [True], [False]]
    x, _, first = quality_crf.line_features(*flat(pa.array(["\n".join(kinds[k]() for k in lines) for lines in truth])))
    p = chain.marginals(x, first)
    assert ((p > 0.5) == np.concatenate(truth)).mean() >= 0.95
    for lines, a, b in zip(truth[:4], first[:-1], first[1:], strict=False):
        assert p[a:b].min() < 0.4 and p[a:b].max() > 0.6 and len(lines) == b - a


def test_pulled_labels_give_each_document_its_share():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 7, 50)
    lines = quality_crf.Lines(rng.normal(size=(n.sum(), quality_crf.N_FEATURES)), rng.integers(1, 90, n.sum()), np.concatenate([[0], np.cumsum(n)]), rng.random(50) < 0.5)
    chain, how = quality_crf.Chain(rng.normal(size=quality_crf.N_FEATURES), rng.normal(size=(2, 2))), quality_crf.Training()
    label, pairs = lines.pulled(chain, how)
    share = lines.share(label)
    assert (share[lines.good] >= how.good_share - 1e-9).all() and (share[~lines.good] <= how.bad_share + 1e-9).all()
    assert np.isclose(pairs.sum(), (n - 1).sum())
    free = lines.share(chain.marginals(lines.x, lines.first))
    kept = np.where(lines.good, free >= how.good_share, free <= how.bad_share)
    assert kept.any() and np.allclose(share[kept], free[kept])


def test_line_share_is_the_largest_that_fits():
    rng = np.random.default_rng(5)
    for most in (1, 7, 40, 200, 10_000):
        lines = rng.integers(1, 60, 20)
        fits = [c for c in range(1, 61) if np.minimum(lines, c).sum() <= most] or [1]
        assert np.minimum(lines, quality_crf.line_share(lines, most)).sum() == np.minimum(lines, max(fits)).sum()
    assert quality_crf.line_share(np.array([5, 10**9]), 100) == 95


def test_one_long_text_does_not_end_the_training_draw(spark):
    rows = good_and_bad(400, 4)
    drawn = spark.createDataFrame([(i,) for i, *_ in rows], "doc_id long").filter(~quality_crf.is_held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).first()[0]
    whole = {i: [t] for i, t, _ in rows} | {drawn: ["\n".join(["Many plain words here."] * 3000)]}
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    how = quality_crf.Training(lines=1500)
    docs = spark.createDataFrame([(i, t) for i, ts in whole.items() for t in ts], "doc_id long, text string")
    assert quality_crf.trained(docs, labels, how)[0] is not None
    got = {r.doc_id: r for r in quality_crf.score_quality(docs, labels, how=how).collect()}
    assert np.mean([got[i].predicted == q for i, _, q in rows if got[i].held_out]) > 0.95


def test_repeated_doc_id_trains_once(spark):
    rows = good_and_bad(200, 6)
    again = next(i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    more = docs.unionByName(spark.createDataFrame([(again, rows[again][1])] * 300 + [(again, ""), (again, None)], docs.schema))
    (a, share), (b, other) = quality_crf.trained(docs, labels), quality_crf.trained(more, labels)
    assert share == other and np.allclose(a.weights, b.weights) and np.allclose(a.pairs, b.pairs)


def test_chain_equals_all_label_sequences():
    rng = np.random.default_rng(0)
    chain = quality_crf.Chain(rng.normal(size=3), rng.normal(size=(2, 2)))
    x, first = rng.normal(size=(9, 3)), np.array([0, 4, 4, 5, 9])
    p = chain.marginals(x, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        total, good = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            score = sum(y[t] * (x[a + t] @ chain.weights) for t in range(b - a)) + sum(chain.pairs[y[t - 1], y[t]] for t in range(1, b - a))
            total += np.exp(score)
            good += np.exp(score) * np.array(y)
        assert np.allclose(p[a:b], good / total if b > a else [])


def plain_path(rows, forest, x):
    total = 0.0
    for root in forest["roots"]:
        at = root
        while forest["left"][at] != at:
            at = forest["left"][at] if x[forest["feature"][at]] <= forest["cut"][at] else forest["right"][at]
        total += forest["path"][at]
    return 2 ** (-total / len(forest["roots"]) / forest["norm"])


def test_forest_scores_equal_plain_walks():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(size=(400, 4)), [[9, 9, 9, 9]]])
    forest = quality_rules.grow(rows, 30, 64, 1)
    got = quality_rules.anomaly(forest, rows)
    assert np.allclose(got[::37], [plain_path(rows, forest, x) for x in rows[::37]]) and got.argmax() == 400


def test_rules_keep_good_documents(spark):
    rows = good_and_bad(600, 2, every=7)  # as many bad ones as the given labels have
    docs = spark.createDataFrame([(i, t, True) for i, t, _ in rows] + [(None, None, True), (700, "a b c d e " * 30, True)], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.judge_quality(docs, labels).collect()}
    share = defaultdict(list)
    for i, _, q in rows:
        if not got[i].base_failed:
            share[q].append(got[i].kept)
    assert np.mean(share[1]) >= 0.98 and np.mean(share[0]) < 0.3
    assert got[None].base_failed and got[700].base_failed and not got[700].kept
    assert quality_rules.judge_quality(docs.limit(0), labels.limit(0)).count() == 0


def test_rules_without_anything_to_tell_apart(spark):
    plain = " ".join(f"word{i} of" for i in range(40))
    some = " ".join(f"x{i}" for i in range(25))
    long = " ".join(f"word{i}" for i in range(400_000))
    labels = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, quality int")
    for rows, labelled in (
        ([(1, plain)], [(9, 1)]), ([(1, plain)] * 5, [(9, 1)]), ([(1, plain)], [(1, 0)]), ([(1, plain), (2, plain)], [(1, 1), (2, 0)]),
        ([(i, plain) for i in range(9)], [(0, 1), (1, 0), (2, 0)]), ([(1, plain), (2, some), (3, long)], [(9, 0)]),
    ):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = quality_rules.judge_quality(docs, labels(*labelled)).collect()
        assert len(got) == len(rows) and all(r.kept and not r.base_failed for r in got)
    assert max(r.n_words for r in got) == 400_000
    got = quality_rules.judge_quality(docs, labels(*labelled).limit(0)).collect()
    assert all(r.kept for r in got)


def test_registered_leaks_equal_all_windows(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {i: set(grams(words_of(x))) for i, x in items}
    near = []  # pairs that share enough different shingles; others can't reach the similarity
    for d, t in docs:
        here = set(grams(words_of(t)))
        near += [((d, t), (i, x)) for i, x in items if held[i] and len(here & held[i]) >= 0.5 * len(held[i])]
    want = set().union(*(plain_leaks([d], [i]) for d, i in near))
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words, round(r.similarity, 9)) for r in entry.queries()["op2_decontaminate"](spark, sf).collect()}
    shorter = {r for r in got if r[3] < len(words_of(dict(items)[r[1]]))}  # texts shorter than the item
    assert got - shorter == want and want and all(dict(docs)[r[0]] and len(words_of(dict(docs)[r[0]])) == r[3] for r in shorter)


@pytest.mark.parametrize("name", ["op2_decontaminate", "op5_warc", "op9_quality_rules"])
def test_queries_cover_whole_tables(spark, name):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = entry.queries()[name](spark, sf)
    if name == "op2_decontaminate":
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
        held = {(d, i) for d, t in docs for i, x in items if " ".join(words_of(x)) in " ".join(words_of(t))}
        assert held <= {(r.doc_id, r.item_id) for r in got.collect()}
    else:
        assert got.count() == spark.read.parquet(f"{sf}/{'pages' if 'warc' in name else 'documents'}.parquet").count()
