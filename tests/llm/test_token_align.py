"""Alignment against whole-text tokenizing and plain byte positions; corpus-wide counts against counters."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wakeline.llm import token_align

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"

TEXTS = [
    None, "", " ", "  ", "a", "a ", " a", "a  b   c", "Hello, world!", "naïve café, straße", "日本語 テスト", "😀 😀!", "tab\there\r\nthere", "a▁b", "▁", "<s> </s> <unk> <0x41>", "<|endoftext|> x<|endoftext|>", "a\u0000b", "ﬁ ｆ é  x y",
    "trailing   ", "word " * 700, "x" * 5000, "é" * 3000, "\n\n \n",
]


class Plain:
    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.byte = {chr(b) if b in visible else chr(next(rest)): b for b in range(256)}

    def tokens(self, text):
        """Ids and end offsets by A and by B; none where bytes differ."""
        if not text:
            return None
        whole = (" " + text).encode()
        one = self.a.encode(" " + text, add_special_tokens=False)
        two = self.b.encode(text)
        bytes_a = [bytes(self.byte[c] for c in t) for t in one.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in two for p in [self.b.id_to_piece(i)]]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return None
        ends = [np.cumsum([len(x) for x in xs]).tolist() for xs in (bytes_a, bytes_b)]
        return one.ids, ends[0], two, ends[1]

    def groups(self, found):
        ids_a, end_a, ids_b, end_b = found
        out, i, j = [], 0, 0
        for cut in sorted(set(end_a) & set(end_b)):
            p, q = end_a.index(cut) + 1, end_b.index(cut) + 1
            out.append((ids_a[i:p], ids_b[j:q]))
            i, j = p, q
        return out


def digests(texts):
    plain = Plain()
    groups = [plain.groups(t) if (t := plain.tokens(x)) else [] for x in texts]
    links = [[(a[-1], b[-1]) for a, b in g] for g in groups]
    count = Counter(x for ls in links for x in ls)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    for g, ls in zip(groups, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(ls),
            sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(text.encode()).hexdigest() if g else "",
        )


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_chunks_give_whole_tokens():
    draw = random.Random(3)
    pool = [*"ab.,'1 ▁é\n", "  ", " the", "ing", "<s>", "日", "😀", "<|endoftext|>"]
    texts = [" " + t for t in TEXTS if t] + [" " + "".join(draw.choices(pool, k=draw.randint(1, 40))) for _ in range(2000)]
    plain = Plain()
    a, b = token_align.ByteTokens(A), token_align.PieceTokens(B)
    assert b.in_chunks
    for tokens, whole in ((a, lambda t: plain.a.encode(t, add_special_tokens=False).ids), (b, lambda t: plain.b.encode(t[1:]))):
        known = [t for t in texts if tokens is a or "▁" not in t]  # with that sign bytes differ anyway
        for some in (known[:500], known):  # the second time from memory
            ids, n = tokens.ids(pa.array(some, pa.large_string()))
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole(t) for t in some]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 20])
def test_owners_of_bytes(block):
    draw = random.Random(block)
    for _ in range(200):
        sizes = []
        for _ in "ab":
            ends = sorted({*draw.sample(range(1, 30), draw.randint(0, 20)), 30})
            sizes.append(np.diff([0, *ends]))
        got = token_align.owners(*sizes, block=block)
        own = [np.repeat(np.arange(len(s)), s) for s in sizes]
        pairs = list(dict.fromkeys(zip(*(o.tolist() for o in own), strict=True)))
        assert list(zip(got.left.tolist(), got.right.tolist(), strict=True)) == pairs
        assert got.shared.tolist() == [sum((x, y) == p for x, y in zip(*own, strict=True)) for p in pairs]
        end_a, end_b = (np.cumsum(s).tolist() for s in sizes)
        cuts = sorted(set(end_a) & set(end_b))
        assert got.a.tolist() == [end_a.index(c) + 1 for c in cuts] and got.b.tolist() == [end_b.index(c) + 1 for c in cuts]
    empty = token_align.owners(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert not len(empty.a) and not len(empty.left)


@pytest.mark.parametrize("hot_share", [1, 30, 65_536])
def test_digests_of_all_kinds_of_texts(spark, hot_share):
    texts = TEXTS + ["the same words again and again"] * 5
    rows = [(None if i % 7 == 3 else i // 2, t) for i, t in enumerate(texts)]  # null and repeated ids
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "pairs": F.lit("x"), "count": F.lit(None).cast("int")})
    got = token_align.link_digests(df, A, B, hot_share).collect()
    want = [(i, *d) for (i, _), d in zip(rows, digests([t for _, t in rows]), strict=True)]
    assert Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in got) == Counter(want)
    assert token_align.link_digests(df.limit(0), A, B, hot_share).count() == 0


def test_alignments_and_overlaps(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plain = Plain()
    for r in token_align.alignments(df, A, B, overlaps=True).collect():
        found = plain.tokens(TEXTS[r.doc_id])
        if not found:
            assert r.a_ids == r.b_ids == r.a_cuts == r.a_at == r.n_bytes == []
            continue
        ids_a, end_a, ids_b, end_b = found
        assert (r.a_ids, r.b_ids) == (ids_a, ids_b)
        cuts = sorted(set(end_a) & set(end_b))
        assert [end_a[c - 1] for c in r.a_cuts] == [end_b[c - 1] for c in r.b_cuts] == cuts
        own = [np.repeat(np.arange(len(e)), np.diff([0, *e])) for e in (end_a, end_b)]
        shared = Counter(zip(*(o.tolist() for o in own), strict=True))
        assert dict(zip(zip(r.a_at, r.b_at, strict=True), r.n_bytes, strict=True)) == shared


def test_query_over_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = entry.queries()["op12_token_align"](spark, SF).collect()
    want = [(d.doc_id, *x) for d, x in zip(docs, digests([d.text for d in docs]), strict=True)]
    assert Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in got) == Counter(want)
