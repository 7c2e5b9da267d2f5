"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_line_dedup import distance
from tests.llm.test_models import grams, words_of
from tests.llm.test_near_dup import common, shingled

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents, then what each stage returned, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    kept = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], SF).write.parquet(f"{folder}/{name}")
        kept.append(spark.read.parquet(f"{folder}/{name}"))
    return kept


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dup", "decontaminate", "packing"]


def test_classifier_keeps_good_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = texts(stages[0]), texts(stages[1])
    assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
    kept = defaultdict(list)
    for i in before.keys() & labels.keys():
        kept[labels[i]].append(i in after)
    assert np.mean(kept[1]) > 0.97 and np.mean(kept[0]) < 0.3


def test_lines(stages):
    before, after = texts(stages[1]), texts(stages[2])
    met, by_length, expected = set(), defaultdict(list), {}
    for i in sorted(before):
        lines = []
        for line in (before[i] or "").split("\n"):
            if not line.strip("\x20\t\n\x0b\x0c\r"):
                lines.append(line)
                continue
            bag = Counter(line)
            near = line in met or len(line) >= 20 and any(
                sum(((bag - b) + (b - bag)).values()) <= 4 and distance(line, m) <= 2 for n in range(len(line) - 2, len(line) + 3) if n >= 20 for m, b in by_length[n]
            )
            if line not in met:
                met.add(line)
                by_length[len(line)].append((line, bag))
            if not near:
                lines.append(line)
        text = "\n".join(lines)
        if text.strip() or text == (before[i] or ""):
            expected[i] = text
    assert {i: t or "" for i, t in after.items()} == expected
    assert all(r.n_chars == len(r.text) for r in stages[2].collect() if r.text is not None and r.text != before[r.doc_id])


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[2]), texts(stages[3])
    ids = sorted(before)
    bags = {i: Counter(g for g, _ in shingled(before[i])) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in ((a, b) for n, a in enumerate(ids) for b in ids[:n]):
        x, y = sum(bags[a].values()), sum(bags[b].values())
        shared = sum((bags[a] & bags[b]).values()) if min(x, y) >= 0.8 * max(x, y) else 0
        if x == y == 0 or (shared and shared >= 0.8 * (x + y - shared)):
            s = common(shingled(before[a]), shingled(before[b]))
            if x == y == 0 or s / (x + y - s) >= 0.8:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert set(after) == {find(i) for i in ids} and all(after[i] == before[i] for i in after)


def test_leaks_go(spark, stages):
    before, after = texts(stages[3]), texts(stages[4])
    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = set()
    for i, text in before.items():
        w = words_of(text)
        mine = set(grams(w))
        for item in items:
            target = grams(item)
            if sum(g in mine for g in target) >= 0.8 * len(target):
                for s in range(len(w) - len(item) + 1):
                    a = grams(w[s : s + len(item)])
                    if sum((a & target).values()) >= 0.8 * sum((a | target).values()):
                        leaks.add(i)
                        break
    assert set(after) == set(before) - leaks


def test_packing_holds_every_document(stages):
    total = defaultdict(int)
    spans = defaultdict(list)
    for r in stages[5].collect():
        total[r.doc_id, r.doc_tokens] += r.length
        spans[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    assert {i for i, _ in total} == set(texts(stages[4])) and all(n == t for (_, t), n in total.items())
    lengths = []
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        lengths.append(at)
    assert max(lengths) <= 1024 and sum(n < 1024 for n in lengths) <= 1


def test_run_is_the_stages_in_a_row(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[5].columns
    key = lambda df: sorted((r.doc_id, r.start, r.length, bytes(r.ids)) for r in df.collect())
    assert [k[0] for k in key(got)] == [k[0] for k in key(stages[5])]
    assert re.fullmatch(r"[a-z_]+", corpus_pipeline.STAGES[0][0])


def test_stages_take_odd_tables(spark, tmp_path):
    """Null and empty values in all columns, repeated rows, a very long text, columns named like inner ones; then no rows at all."""
    good = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = [
        (None, None, None, None, None), (None, "a text that has no id of its own but some words", None, "s", 48), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9002, "", "en", "s", 0), (9003, " \n\t\n ", "en", None, 5),
        (9004, "One line of plain words.\n" * 3, "en", "s", 75), (9005, " ".join(f"word{i}" for i in range(60_000)) + ".", "en", "s", 1), (9006, "\n".join(f"Line number {i} says what {i * 7} is." for i in range(3000)), "en", "s", 2),
        (9007, "😀 <|endoftext|> \u0085é", "xx", "s", 18),
    ]
    odd = good.unionByName(spark.createDataFrame(rows, good.schema)).unionByName(good.limit(5))
    inner = ("row", "doc", "same", "sketch", "n", "text_", "dropped", "h", "quality", "score", "lines", "ids", "length", "component", "class_row", "seg", "task")
    odd = odd.selectExpr("*", *[f"cast(null as string) as {c}" for c in inner])
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}-0")
        kept = [spark.read.parquet(f"{tmp_path}/{name}-0")]
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
            stage(spark, kept[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{name}-{k}")
            kept.append(spark.read.parquet(f"{tmp_path}/{name}-{k}"))
        assert all(df.columns == docs.columns for df in kept[1:-1])
        if name == "none":
            assert all(df.count() == 0 for df in kept)
            continue
        ids = [sorted(str(r.doc_id) for r in df.select("doc_id").collect()) for df in kept]
        # Of the texts without words one stays; of repeated rows one keeps its lines.
        assert ids[1].count("9002") == 2 and "9001" in ids[1] and len(set(ids[3]) & {"9001", "9002", "9003"}) == 1 and ids[3].count("9002") <= 1
        assert {r.doc_id: r.text for r in kept[2].filter("doc_id = 9004").collect()} in ({9004: "One line of plain words.\n"}, {9004: "One line of plain words."}, {})
        assert all(ids[3].count(i) == 1 for i in set(ids[3]) - {"None"}) and {"9005", "9007"} <= set(ids[3])
        packed = kept[5].collect()
        assert sorted({str(r.doc_id) for r in packed}) == sorted(set(ids[4]))
        total = defaultdict(int)
        for r in packed:
            total[r.doc_id] += r.length
        assert total[9005] > 60_000 and all(r.doc_tokens == total[r.doc_id] for r in packed if r.doc_id is not None)
