"""Line dedup against all pairs by dynamic programming."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wakeline.llm import line_dedup
from wakeline.llm.line_dedup import LineDedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abé", max_size=9), st.text("abé", max_size=9)), min_size=1, max_size=6), st.integers(0, 3))
def test_banded_distance(pairs, edits):
    a, b = zip(*pairs, strict=True)
    assert line_dedup.within(list(a), list(b), edits).tolist() == [distance(x, y) <= edits for x, y in pairs]


def plain(rows, how):
    """``(doc_id, text)`` rows, in row order, to (n_equal, n_near, dropped) of each."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    met, out = [], {}
    for i in order:
        equal = near = 0
        dropped = []
        for n, line in enumerate((rows[i][1] or "").split("\n")):
            if not line.strip("\x20\t\n\x0b\x0c\r"):
                continue
            if line in met:
                equal += 1
                dropped.append(n)
            else:
                if len(line) >= how.least_chars and any(len(m) >= how.least_chars and distance(line, m) <= how.edits for m in met):
                    near += 1
                    dropped.append(n)
                met.append(line)
        out[i] = (equal, near, dropped)
    return [out[i] for i in range(len(rows))]


def noisy(rng, line, n):
    for _ in range(n):
        at = rng.randrange(len(line) + 1)
        line = rng.choice([line[:at] + rng.choice("xyé ") + line[at:], line[:at] + line[at + 1 :], line[:at] + "q" + line[at + 1 :]])
    return line


@pytest.mark.parametrize(("crowded", "block"), [(50, 1500), (1, 1500), (0, 3)])
def test_report_equals_all_pairs(spark, crowded, block):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(8, 45))) for _ in range(12)]
    rows = [(i, "\n".join(noisy(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(rng.randint(0, 5)))) for i in range(40)]
    rows += [(3, rows[3][1]), (None, base[0]), (60, None), (61, "\n\n"), (62, " \n \n"), (63, "y" * 3000 + "\n" + "y" * 3001 + "\n" + "y" * 3003)]
    how = LineDedup(least_chars=12, crowded=crowded, block=block)
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int").coalesce(1)
    got = [(r.n_equal, r.n_near, r.dropped) for r in line_dedup.dropped_lines(docs.select("row", "doc_id", "text").withColumn("row", docs["row"].cast("long")), how).orderBy("row").collect()]
    assert got == plain(rows, how)


@pytest.mark.parametrize("crowded", [0, 2])
def test_crowded_keys_with_unlike_rests(spark, crowded):
    """Templated lines share a segment and little else; near copies of one line settle; finer keys find the rest."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    head = "posted by the editor on "
    lines = [head + word(24) + word(24) for _ in range(40)]
    lines += [noisy(rng, rng.choice(lines), rng.randint(1, 3)) for _ in range(60)]
    lines += [noisy(rng, lines[0], 1) for _ in range(40)]
    rng.shuffle(lines)
    rows = [(i // 2, line) for i, line in enumerate(lines)]
    how = LineDedup(crowded=crowded, block=7)
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row long")
    got = [(r.n_equal, r.n_near, r.dropped) for r in line_dedup.dropped_lines(docs, how).orderBy("row").collect()]
    assert got == plain(rows, how)


def test_rests_are_cut_for_the_length_that_the_key_tells(spark):
    """Rows that refining makes are at most three for an indexed line and five for a probe, and pairs within two edits still meet."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    head, how = "posted by the editor on ", LineDedup()
    lines = [head + word(48) for _ in range(30)]
    lines += [noisy(rng, line, 1 + i % 2) for i, line in enumerate(lines)]
    whole = line_dedup.Strings(pa.array(lines))
    met = {}
    for kind in (False, True):
        for seg, owner, *_ in line_dedup._keys(whole, np.arange(len(lines)), how, kind):
            for s, o in zip(seg.tolist(), owner.tolist(), strict=True):
                met.setdefault(s, set()).add((kind, o))
    rows = [(s, kind, o, lines[o]) for s, who in met.items() for kind, o in who if len({k for k, _ in who}) == 2]
    finer = line_dedup.rest_rows(spark.createDataFrame(rows, "seg long, probe boolean, line long, said string"), how).collect()
    assert len(finer) <= sum(5 if kind else 3 for _, kind, *_ in rows)
    under = {}
    for r in finer:
        under.setdefault(r.seg, (set(), set()))[r.probe].add(r.line)
    pairs = {frozenset((a, b)) for index, probe in under.values() for a in index for b in probe if a != b}
    assert all(frozenset((i, i + 30)) in pairs for i in range(30) if distance(lines[i], lines[i + 30]) <= how.edits)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(7)
    base = "every reader of this page will find the same line below it, and no other one near"
    lines = {base: None}
    while len(lines) < 5000:
        lines[noisy(rng, base, rng.randint(1, 2))] = None
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = line_dedup.line_report(docs.repartition(4)).collect()
    assert {r.doc_id for r in got if not r.dropped} == {0}


def test_texts_keep_what_stays(spark):
    docs = spark.createDataFrame([(1, "one line of words\nanother line", 5, "a"), (2, "one line of words\nown", 5, "b"), (3, "one line of words", 5, "c"), (4, "", 0, "d"), (5, None, None, "e")], "doc_id long, text string, n_chars long, dropped string")
    got = {r.doc_id: (r.text, r.n_chars, r.dropped) for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got == {1: ("one line of words\nanother line", 30, "a"), 2: ("own", 3, "b"), 4: ("", 0, "d"), 5: (None, None, "e")}
    assert line_dedup.line_report(docs.limit(0)).count() == 0
