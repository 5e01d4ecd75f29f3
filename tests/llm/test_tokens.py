"""Pre-tokens, BPE encoding and packing against the public libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe_codec, packing, pretok

MULTI, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TEXTS = ["", " ", "It's they'll we're 'tis 'start x''s I'd've", "  two  spaces\n\nand\tlines \r\n end  ", "Größe ÀÉÎ ½ ² ٣ 12345 日本語 Σ ΑΣ ẞ İ", "é à ́x", "a" * 3000, "!!! ??? $$$'s", "'", "'l", "'re", " 'll", "\n'll x", " a 　 b ", "<|endoftext|> x"]
piece = st.sampled_from(["'", "s", "ll", "re", " ", "  ", "\n", "\t", "a", "É", "é", "1", "²", "!", "日", "́", " ", "S", "ve", "-"])


def tokens(texts, words):
    cp = pretok.code_points(texts)
    start, stop = pretok.split(cp, words)
    bounds = pretok.doc_of(cp, start, len(texts))
    found = pretok.word_text(cp, start, stop)
    word, first = pretok.distinct(cp, start, stop)
    assert [found[i] for i in first[word]] == found and len(set(found)) == len(first)
    return [found[a:b] for a, b in zip(bounds, bounds[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(piece, max_size=14).map("".join), min_size=1, max_size=5))
def test_split_equals_patterns(texts):
    assert tokens(texts, False) == [regex.findall(P.PATTERN, t) for t in texts]
    assert tokens(texts, True) == [regex.findall(WORD_PATTERN, t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.lists(piece, max_size=14).map("".join), st.text(st.characters(codec="utf-8"), max_size=20)), min_size=1, max_size=5))
def test_word_ids_equal_library(texts):
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in packing.WordIds(WORDS).of(texts)] == want


def reference(text):
    ranks = bpe_codec.load_ranks(MULTI)
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None])] + [(3, TEXTS[3], "y"), (3, "other", "y"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_bpe_digests(spark, docs):
    got = sorted(map(tuple, bpe_codec.digests(docs, MULTI, P.PATTERN).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = reference(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe_codec.digests(docs.limit(0), MULTI, P.PATTERN).count() == 0


def test_bpe_encode_decode(spark, docs):
    got = bpe_codec.decode(bpe_codec.encode(docs, MULTI, P.PATTERN), MULTI).collect()
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in got) == sorted((str(r.doc_id), reference(r.text), (r.text or "").encode()) for r in docs.collect())


def check_pieces(pieces, want):
    """pieces: rows of packing.SCHEMA; want: ids by document (unique ids)."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p[0], []).append(p)
        by_seq.setdefault(p[5], []).append(p)
    assert set(by_doc) == set(want)
    for doc, ps in by_doc.items():
        at, ids = 0, want[doc]
        for _, start, length, crc, total, *_ in sorted(ps, key=lambda p: p[1]):
            assert start == at and length > 0 and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at == 2048 or at & (at - 1) == 0 and at < 2048


def test_packing(spark, docs):
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    rows = docs.filter("doc_id <> 3").unionByName(spark.createDataFrame([(100 + i, f"word{i} " * (37 * i), "") for i in range(80)], docs.schema))
    want = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows.collect()}
    pieces = [tuple(r) for r in packing.pack_sequences(rows, WORDS).collect()]
    check_pieces(pieces, want)
    assert packing.pack_sequences(rows.limit(0), WORDS).count() == 0
    again = packing.pack_sequences(docs, WORDS)
    assert again.groupBy("doc_id").count().count() == docs.select("doc_id").distinct().count()


def test_sum_of_squares_rule():
    rng = np.random.default_rng(0)
    p = packing.Packer(0, 16)
    for _ in range(500):
        size = int(rng.integers(1, 16))
        cost = {}
        for h in range(0, 16 - size + 1):
            if h and not p.count[h]:
                continue
            c = p.count.copy()
            c[h] -= h > 0
            if h + size < 16:
                c[h + size] += 1
            cost[h] = int((c[1:16] ** 2).sum())
        level = p.level_for(size)
        assert cost[level] == min(cost.values())
        p.place(0, np.zeros(size, np.uint32))
