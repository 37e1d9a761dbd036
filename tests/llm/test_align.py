"""Token alignment against a walk over every byte, and on odd tables."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from kerbside.llm import align, common

JSON = tokenizers.Tokenizer.from_file(align.BYTES_MODEL)
JSON.encode_special_tokens = True
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def tokens(both, text):
    """Each side's (id, begin, end) for a whole text; None where the bytes differ."""
    out = []
    raw = f" {text}".encode()
    for ids, spelled in ((JSON.encode(f" {text}", add_special_tokens=False).ids, both.a_bytes), (both.b.encode(text), both.b_bytes)):
        at, own = 0, []
        for i in ids:
            own.append((i, at, at + len(spelled[i])))
            at += len(spelled[i])
        if b"".join(spelled[i] for i in ids) != raw:
            return None
        out.append(own)
    return out


def expected(both, texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text."""
    every = [tokens(both, t) if t else None for t in texts]
    links = []
    for found in every:
        own = []
        if found:
            for a, low, high in found[0]:
                own += [(a, b) for b, x, y in found[1] if x < high and low < y]
        links.append(own)
    count = collections.Counter(p for own in links for p in set(own))
    top = collections.Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    rows = []
    for found, own in zip(every, links, strict=True):
        if not found:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b = found
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        low, groups = 0, []
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, x, e in side if low < e <= cut) for side in (a, b)))
            low = cut
        rows.append((len(a), len(b), len(groups), len(own), sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


ODD = [
    None, "", " ", "  ", " a", "  a b", "a  b", "a   b ", "\n", "a\n b", "a \n b", "a\tb c  d", "one", "one", "one two", "é 漢字 🎉 </s>[INST] <|endoftext|> x\x00y", "a▁b c", "▁", "x ▁ y",
    "'s don't we'll 12345 67 !!! ?", "ünïcödé " * 9, "e" * 3000, "ab" * 2000 + " c", "北京大学 图书馆　x", "\x1c x \x1c", "a b   c", "\r\n x\r\n  y", " \t x", "－ｆｕｌｌ ﬁ",
]


@pytest.mark.parametrize("block", [1, 200, 1 << 24])
def test_alignment(spark, block):
    rng = random.Random(5)
    letters = "abcde éß,.\n漢 "
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    common.prepare(spark)
    both = align.tokenizers_of(align.BYTES_MODEL, align.PIECES_MODEL)
    rows = align.aligned(docs(spark, texts).withColumn("block", F.lit("x")), block=block).collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows}
    assert len(rows) == len(texts)
    for i, want in enumerate(expected(both, texts)):
        assert got[i] == want, (i, texts[i])


def test_whole_documents_have_the_tokens_of_their_chunks(spark):
    both = align.tokenizers_of(align.BYTES_MODEL, align.PIECES_MODEL)
    texts = [r.text for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect() if r.text]
    for t in texts + [t for t in ODD if t]:
        chunks = align.chunks_of(t)
        assert "".join(f" {c}" for c in chunks) == f" {t}"
        if tokens(both, t):
            for side in (lambda x: JSON.encode(f" {x}", add_special_tokens=False).ids, both.b.encode):
                assert [i for c in chunks for i in side(c)] == side(t)


def test_query_against_the_walk(spark):
    both = align.tokenizers_of(align.BYTES_MODEL, align.PIECES_MODEL)
    small = common.table(spark, "/root/testdata/sf0.001", "documents").where("length(text) < 3000").orderBy("doc_id")
    texts = [(r.doc_id, r.text) for r in small.collect()]
    common.prepare(spark)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in align.aligned(small).collect()}
    assert got == dict(zip([i for i, _ in texts], expected(both, [t for _, t in texts]), strict=True))


def test_alignment_of_odd_tables(spark):
    common.prepare(spark)
    assert align.aligned(docs(spark, ["x"]).limit(0)).count() == 0
    assert align.aligned(docs(spark, [None, ""])).select("n_a", "groups_sha256").collect() == [(0, ""), (0, "")]
    same = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (7, "c")], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_a, r.count_sum) for r in align.aligned(same).collect())
    assert rows == [(0, 2, 6), (7, 1, 1), (7, 2, 6), (7, 2, 6)]


def test_intervals(spark):
    """Groups and links as rows: windows and one equi-join, without Python and without products."""
    token = lambda i, n: i + (n << align.BITS)
    rows = [(0, [token(1, 2), token(2, 2), token(5, 1)], [token(3, 1), token(4, 3), token(6, 1)]), (1, [token(1, 1)], [token(3, 1)])]
    got = align.align(spark.createDataFrame(rows, "segment long, a array<int>, b array<int>"), ["segment"])
    assert sorted(map(tuple, got.collect()), key=repr) == [
        (0, 1, 2, None, 3, 1, 3), (0, 2, 2, 1, None, 1, 4), (0, 4, 2, 2, 4, 2, 4), (0, 5, 1, 5, 6, 5, 6), (1, 1, 1, 1, 3, 1, 3),
    ]
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_long_chunks_are_encoded_like_short_ones():
    both = align.tokenizers_of(align.BYTES_MODEL, align.PIECES_MODEL)
    rng = random.Random(2)
    chunks = ["ab" * 40_000, "x", "", " ", "<|endoftext|>", "don't", "'ll", "a\n", "b ", "\n"] + ["".join(rng.choice("abc.é漢1\n") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    chunks = [c for c in chunks if c and not c[0].isspace()]
    at = 0
    for a, n, *_ in both.encode(chunks, 50):
        for k, ids in enumerate(np.split(a, np.cumsum(n)[:-1])):
            assert ids.tolist() == JSON.encode(f" {chunks[at + k]}", add_special_tokens=False).ids
        at += len(n)
    assert at == len(chunks)


def test_chunks_of_one_shape_are_aligned_once(spark):
    """Blocks that hold chunks of few shapes: an alignment for each shape, however many chunks and blocks have it."""
    common.prepare(spark)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    cut = align._cut(docs(spark, [" ".join(words)] * 3).coalesce(1), align.BYTES_MODEL, align.PIECES_MODEL, 1).cache()
    shapes = {tuple(map(tuple, r)) for r in cut.where("kind = 2").select("a", "b").collect()}
    assert 0 < len(shapes) < len(words) / 4
    rows = align._aligned_shapes(cut).collect()
    assert len(rows) == len({r.segment for r in rows}) == cut.where("kind = 2").count() == 3 * len(shapes)
    assert all(r.ends[-1] == "3" and set(r.ends) <= set("123") for r in rows)


def test_lists_as_bytes():
    lists = [np.array(x, np.int32) for x in ([], [1, 2, 1 << 20], [0], [], [-1, 1 << 30])]
    flat, at = align._unpacked(align._packed(lists))
    assert flat.tolist() == [1, 2, 1 << 20, 0, -1, 1 << 30] and at.tolist() == [0, 0, 3, 4, 4, 6]
