"""Repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import suffix_dedup


def brute(rows, length):
    """rows: (id or None, text); in the order of (id, text)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, (rows[i][1] or "").encode()))
    seen, out = set(), [None] * len(rows)
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (rows[i][0], len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return sorted(map(str, out))


def documents(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line, base = prose(40), prose(9), prose(150)
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(0, 60))]
        if i % 3 == 0:
            a = rng.randint(0, 40)
            parts.append(passage[a : a + rng.randint(60, 200)])
        if i % 4 == 1:
            parts += [line, prose(2), line]
        if i % 7 == 2:
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "#"
            parts.append("".join(copy))
        rows.append((rng.randint(-5, 10**12) if i % 2 else i, rng.choice([" ", "", "\n"]).join([*parts, prose(5)])))
    rows += [(500, "a" * 700), (501, "ab" * 300 + "a" * 120), (502, None), (503, ""), (504, "x" * 99), (505, "x" * 100), (506, "x" * 101), (507, prose(3000)), (507, "dup " * 50), (507, "dup " * 50), (None, passage), (None, base)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(suffix_dedup, "BATCH", 50)
        monkeypatch.setattr(suffix_dedup, "CANDIDATES", 10**6)  # all in few parts, so that levels are scanned and merged
    rows = documents(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_bytes string").repartition(3)
    got = suffix_dedup.repeat_digests(df)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, 100)
    if seed == 1:
        assert suffix_dedup.repeat_digests(df.limit(0)).count() == 0
        kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.without_repeats(df).collect()}
        assert kept[504] == b"x" * 99 and kept[506] == b""


def test_sample_depends_on_content_only():
    rng = np.random.default_rng(0)
    passage = rng.integers(97, 101, 300).astype(np.uint8)
    docs = [np.concatenate((rng.integers(97, 123, int(n)).astype(np.uint8), passage, rng.integers(97, 123, 80).astype(np.uint8))) for n in (0, 5, 111, 64)]
    seen = []
    for d in docs:
        *_, lo, hi, place = suffix_dedup.sampled(d, np.array([0, len(d)]))
        assert lo[0] == 0 and hi[-1] == len(d) - 100 and (lo[1:] == hi[:-1] + 1).all()
        assert (place >= hi).all() and (place + suffix_dedup.SEED <= lo + 100).all()
        seen.append(set((place[(lo >= len(d) - 380) & (hi + 100 <= len(d) - 80)] - (len(d) - 380)).tolist()))
    assert set.intersection(*seen) == min(seen, key=len)


def contexts(rng, n, length, seed):
    """Contexts (bytes, place of the suffix) around one of a few seeds, with long and short repeats on both sides."""
    sides = ["".join(rng.choice("ab") for _ in range(3 * length)) for _ in range(3)]
    out = []
    for _ in range(n):
        middle = "s" * (seed - 1) + rng.choice("tu")
        cut = rng.randint(0, length - seed)
        before = (rng.choice(sides)[: rng.randint(0, 20)] + rng.choice(sides)[-rng.randint(1, length) :])[-(length - seed) :][cut:]
        after = (rng.choice(sides)[: rng.randint(0, length - seed)] + rng.choice("xyz") * length)[: length - seed - rng.randint(0, len(before))]
        text = (before + middle + after).encode()
        if len(text) >= length:
            out.append((text, len(before)))
    return out


@pytest.mark.parametrize("step", [1, 7, 400])
def test_log_family(step):
    """Windows found by suffix arrays, batch after batch, against a set of all windows seen."""
    rng, length = random.Random(5), 48
    rows = contexts(rng, 2500, length, suffix_dedup.SEED)[: 60 if step == 1 else 900]
    family, seen = suffix_dedup.LogFamily(length), set()
    hits = 0
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        found = family.add([t for t, _ in part], np.array([h for _, h in part]))
        assert found.shape == (len(part), length - suffix_dedup.SEED + 1)
        for (text, high), mine in zip(part, found.tolist()):
            for k in range(len(mine)):
                start = high - k
                inside = 0 <= start and start + length <= len(text)
                w = text[start : start + length] if inside else None
                assert mine[k] == (inside and (k, w) in seen)
                hits += mine[k]
                seen.add((k, w))
    assert hits > 20
    sizes = [len(x) for x in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) <= len(rows)
    for x in family.levels:
        assert list(x.ahead) == sorted(x.ahead)


def test_zero_bytes():
    """Bytes of value zero are bytes like others, also at a context's end."""
    texts = [b"\0" * 100, b"\0" * 101, b"a" + b"\0" * 99, b"\0" * 99 + b"a"]
    found = suffix_dedup.LogFamily().add(texts, np.array([0, 1, 1, 0]))
    assert found.any(1).tolist() == [False, True, False, False] and found[1, :2].tolist() == [True, False]
    assert suffix_dedup.lcp(np.array([[1, 2], [1, 2]]), np.array([[1, 3], [1, 2]])).tolist() == [1, 2]


def test_parts_without_repeats():
    rows = pd.DataFrame({"key": [1, 2], "pos": [0, 0], "at": [0, 0], "bytes": [b"a" * 100, b"b" * 100]})
    assert len(suffix_dedup._match_part(rows, 100)) == 0


def test_boilerplate_in_every_document(spark):
    """95 bytes that all documents share, each time in another surrounding: no window repeats, and no part gets them all."""
    rng = random.Random(13)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase = "".join(rng.choice("ijklmnop") for _ in range(95))
    rows = [(i, noise(150) + phrase + noise(150)) for i in range(600)] + [(2000, phrase + "tail" * 3), (2001, phrase + "tail" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(str(tuple(r)) for r in suffix_dedup.repeat_digests(df).collect()) == brute(rows, 100)


def test_hot_seeds(spark):
    """A phrase with a new surrounding each time: its seed is in more suffixes than a part should hold."""
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase = "the quick brown fox jumps over the lazy dog and then some more"
    rows = [(i, "".join(noise(rng.randint(30, 70)) + phrase for _ in range(12))) for i in range(150)] + [(999, noise(40) + phrase + noise(40))] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts, _ = suffix_dedup.keyed(df)
    index = texts.mapInPandas(lambda b: suffix_dedup._index(b, 100, 8), suffix_dedup._INDEX).filter("extent > 0")
    counts = {r.seed: r["count"] for r in index.groupBy("seed").count().collect()}
    total, hot = sum(counts.values()), {r.seed for r in suffix_dedup._hot(index, 8).collect()}
    assert hot and len(hot) <= 16 and {s for s, n in counts.items() if n * 8 > total} <= hot
    assert sorted(str(tuple(r)) for r in suffix_dedup.repeat_digests(df).collect()) == brute(rows, 100)
