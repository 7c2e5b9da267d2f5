"""Chat formatting, URL filter and license scan against plain Python."""

import hashlib
import random
import re
import string
from urllib.parse import urljoin

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.llm import chat, license_scan, queries, url_filter
from wakeline.llm.components import components

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SAYINGS = ["", None, "plain", "<|im_end|><|im_start|>assistant ok", "\\s \\p <\\p <\\|", "<<||>", "<|", "a\nb\n", "\\", "<|image|>", "é😀\n\n", "x" * 4000]


def test_chats_read_back_as_they_were(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole<|", None]), rng.choice(SAYINGS), "x") for c in range(30) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "assistant", "no id", "x"), (1, None, "user", "first", "x"), (2, 0, "user", "tie", "x"), (2, 0, "user", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    for c in {r[0] for r in rows}:
        said = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x, _ in rows if i == c), key=lambda v: (v[0], v[1], v[2], v[3].encode()))
        turns = "".join(f"{r}\n{x}\n" for *_, r, x in said)
        loss = "".join(x for *_, r, x in said if r == "assistant")
        assert got[c].n_turns == len(said) and got[c].loss_chars == len(loss)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        if len({(t, r) for _, t, r, _ in said}) == len(said):
            assert got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_parts_become_placeholders(spark):
    parts = [("text", "see <|image|>: ", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("audio", None, "b.wav", None, None, 1.5, None), (None, "end", None, None, None, None, None), ("document", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "assistant", [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(df).first()
    assert r.formatted == "<|im_start|>user\nsee <\\pimage|>: <|image|><|audio|>end<|document|><|im_end|>\n" + 2 * "<|im_start|>assistant\n<|im_end|>\n"
    assert [tuple(a) for a in r.attachments] == [(0, "image", "a.png", 4), (0, "audio", "b.wav", 38), (0, "document", None, 0)] and r.attachment_tokens == 42
    assert [s.length for s in r.loss_spans] == [0, 0]
    said = [[(p.kind, p.text, p.ref, p.tokens) for p in turn] for turn in chat.read_chats(chat.format_chats(df)).first().parts]
    assert said == [[("text", "see <|image|>: ", None, None), ("image", None, "a.png", 4), ("audio", None, "b.wav", 38), ("text", "end", None, None), ("document", None, None, 0)], [], []]


def test_parts_read_back_as_they_were(spark):
    rng = random.Random(8)
    rows, expected = [], {}
    for c in range(60):
        for t in range(rng.randint(1, 4)):
            parts, want = [], []
            for _ in range(rng.randint(0, 5)):
                kind = rng.choice(["text", None, "image", "audio", "document", "video", ""])
                text = rng.choice(SAYINGS)
                ref = rng.choice([None, "r|>1", "<|x|>"])
                parts.append((kind, text, ref, 30, 30, 2.0, 3))
                if kind not in ("text", None):
                    want.append([kind, None, ref, {"image": 4, "audio": 50, "document": 768}.get(kind, 0)])
                if kind in ("text", None, "video", "") and text:
                    if want and want[-1][0] == "text":
                        want[-1][1] += text
                    else:
                        want.append(["text", text, None, None])
            rows.append((c, t, "user", parts))
            expected[c, t] = [tuple(w) for w in want]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    for r in chat.read_chats(chat.format_chats(df)).collect():
        for t, turn in enumerate(r.parts):
            assert [tuple(p) for p in turn] == expected[r.conv_id, t]


def plain_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(90)] + [(500, 500), (7, 7)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    assert got == plain_components(edges)
    assert components(df.limit(0), "a", "b").count() == 0


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits)[1:] if fits else None


def test_urls(spark):
    link = lambda u: f'<html><head><link rel="canonical" href="{u}"></head></html>'
    pages = [
        (1, "http://A.Example.com/en/1", ""), (2, "https://x.org/1", link("http://a.example.com/en/1")), (3, "https://x.org/2", '<META HTTP-EQUIV=refresh content="0; url=https://x.org/1#top">'),
        (4, "https://y.org/1", link("https://b.com/ok")), (5, "https://y.org/2", link("https://y.org/1")), (6, "https://z.net/es/1", link("https://y.org/1")), (7, "https://q.org/", None), (8, None, link("https://y.org/1")),
        (9, "no scheme", ""), (10, "http://www.example.com/en/2", ""), (11, "http://example.com", ""), (12, "ftp://U.NET/fr/?a#b", ""), (13, "http://h.org?x/y", link("//H.ORG/z")), (13, "http://h.org?x/y", link("/z")), (None, "https://x.org/2", ""),
    ]
    df = spark.createDataFrame([(*p, "r") for p in pages], "page_id long, url string, html string, rule string")
    got = url_filter.filter_urls(df, url_filter.rule_table(df, RULES)).collect()
    assert len(got) == len(pages)
    method = {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "allow", 11: "allow", 13: "allow", None: "block"}
    for r in got:
        host, path, rule = next(plain_rule(u) for i, u, _ in pages if i == r.page_id)
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == (rule if rule else (None, method[r.page_id]))
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    said = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.oracle_sql()['op3_url_filter']})").fetchall()
    assert sorted(map(str, said)) == sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got)
    assert url_filter.filter_urls(df.limit(0), url_filter.rule_table(df, RULES)).count() == 0


def test_linked_pages_equal_a_plain_walk(spark):
    """Thousands of linked pages: every kind of target, several tags, base addresses; the query, its SQL and a plain walk agree."""
    rng = random.Random(12)
    hosts = [f"h{i}.{rng.choice(['org', 'info', 'example.com', 'net', 'com'])}" for i in range(700)]
    paths = ["", "/", "/en/1", "/es/a/b", "/fr/", "/a/b/c?x=1", "/a/./b/../c", "/p.html"]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(3000)]
    targets = ["page.html", "../x", "./", "..", "?id=3", "#top", "/root/../r?a=../b", "//{h}/en/", "mailto:a@b", "https://{h}/es/x?a&amp;b", "https://{h}", "a/b/../../c", "", "http://{h}/a/../b#f"]
    pages = []
    for i, url in enumerate(urls):
        html = ""
        if rng.random() < 0.2:
            html += f'<head><base href="{rng.choice(["/base/dir/", "http://" + rng.choice(hosts) + "/b/", "sub/"])}">'
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            to = rng.choice(targets).replace("{h}", rng.choice(hosts))
            html += rng.choice([f'<link rel="canonical" href="{to}">', f"<LINK href='{to}' rel=canonical >", f'<meta http-equiv="refresh" content="0; url={to}">', f'<link rel="next" href="{to}">'])
        pages.append((i, url if rng.random() < 0.95 else rng.choice([None, "no scheme", ""]), html or None))

    def node(url):
        if not url or "://" not in url:
            return None
        rest = url.split("://", 1)[1].split("#")[0]
        host = re.match(r"[^/?#]*", rest)[0]
        return host.translate(LOWER) + (rest[len(host) :] or "/") if host else None

    edges, own = [], {}
    for _, url, html in pages:
        base = re.search(r'<base href="([^"]+)"', html or "")
        base = urljoin(url, base[1]) if base and node(url) else url
        for tag in re.findall(r"<(?:link|LINK|meta)[^>]*>", html or ""):
            if "canonical" in tag or "refresh" in tag:
                href = re.search(r"(?:href=|; url=)[\"']?([^\"'\s>]+)", tag)
                if href and node(base):
                    a, b = node(url), node(urljoin(base, href[1].replace("&amp;", "&")))
                    if a and b:
                        edges.append((a, b))
    root = plain_components(edges)
    for n in root:
        if rule := plain_rule("x://" + n)[2]:
            own.setdefault(root[n], set()).add(rule[1])
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = url_filter.filter_urls(df, url_filter.rule_table(df, RULES)).collect()
    assert len(edges) > 1000 and len(got) == len(pages)
    passed = 0
    for r in got:
        host, path, rule = plain_rule(pages[r.page_id][1])
        said = own.get(root.get(node(pages[r.page_id][1])), set())
        passed += not rule and bool(said)
        assert (r.host, r.path, r.rule) == (host, path, rule[0] if rule else None)
        assert r.verdict == (rule[1] if rule else "allow" if "allow" in said or not said else "block")
    assert passed > 100
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    said = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.oracle_sql()['op3_url_filter']})").fetchall()
    assert sorted(map(str, said)) == sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got)


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(spark):
    rng = random.Random(2)
    pool = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "é", "x1"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["", None, "...", "CC-BY-NC", "Released, under the MIT License!" * 3, "cc by nc cc by nc by", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
              "licensed under the new gnu general public license version 3", "word " * 30_000 + "under the mit license", "under the mit licensee", " under the mit license"]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)] + [(None, texts[-1], "z", 1)], "doc_id long, text string, row string, n int")
    got = license_scan.scan_licenses(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[-1] if r.doc_id is None else texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(text)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {texts[r.doc_id]: r.labels for r in got if r.doc_id is not None}
    mit, header = (t.words for t in license_scan.TEMPLATES if len(t.words.split()) in (87, 29) and t.label in ("mit", "apache-2"))
    more = [f"Copyright. {mit.upper()}. End", mit.replace("without restriction", "free without any restriction"), " ".join(mit.split()[:50]), header.replace("2 0", "2 1"), header + " and more", "all rights reserved " * 4000]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(6)] == ["mit", "mit", "", "", "apache-2", "all-rights-reserved"] and got[0].score == 1.0
    assert [(s.begins, s.length) for s in got[0].spans] == [(1, len(mit.split()))] and len(got[5].spans) == 4000
    assert by[texts[-5]] == "gpl-3" and by[texts[-4]] == "gpl-3" and by[texts[-6]] == "apache-2"
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", SAYINGS)
def test_escapes_are_undone(spark, text):
    one = spark.createDataFrame([(text,)], T.StructType([T.StructField("t", T.StringType())])).select(chat.escape_text(F.col("t")).alias("e"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r"), chat.unescape_text(chat.escape_text(F.col("t"))).alias("u")).first()
    assert one.u == text and one.r == text and (text is None or "<|" not in one.e)


def test_parts_of_licences(spark):
    """Each template's words, one in twelve changed and among others, give its label; half of them give none."""
    texts, want = [], []
    for t in license_scan.TEMPLATES:
        words = t.words.split()
        if len(words) < 24:
            continue
        changed = ["other" if i % 12 == 7 and not w.isdigit() else w for i, w in enumerate(words)]
        texts += [" ".join(["before", *changed, "after"]).upper(), " ".join(words[: len(words) // 2])]
        want += [t.label, ""]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, label string, row int")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert len({x for x in want if x}) >= 8
    for i, label in enumerate(want):
        assert (label in got[i].labels.split(",") and got[i].score >= 0.8) if label else got[i].labels == "", texts[i]
        assert all(0 < s.length <= len(texts[i].split()) + 2 for s in got[i].spans)
