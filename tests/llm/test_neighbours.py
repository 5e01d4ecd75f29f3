"""Embedding near-dedup, exact top-k, SimHash and components against brute force."""

import math
import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import embed_dedup, simhash, topk_search
from tidemark.llm.components import connected_components, forest

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def union(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in edges:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    rows = [(i, [float(np.float32(c)) for c in x], 0, "z") for i, x in enumerate(base)]
    rows += [(100 + i, [float(np.float32(c)) for c in base[i % 7] + rng.normal(size=8) * 0.15 * (i % 4)], 1, None) for i in range(90)]
    rows += [(300, None, 0, ""), (301, [0.0] * 8, 0, ""), (302, [1.0, None] + [0.0] * 6, 0, ""), (303, [float("nan")] * 8, 0, ""), (304, [float("inf")] + [1.0] * 7, 0, "")]
    rows += [(305, [1.0, 2.0], 0, ""), (306, [2.0, 4.0], 0, ""), (307, [], 0, ""), (308, [3.0], 0, ""), (7, [float(np.float32(c)) for c in base[7]], 3, ""), (None, rows[1][1], 0, ""), (None, [9.0, -1.0], 0, "")]
    return rows


def valid(x):
    return bool(x) and all(c is not None and math.isfinite(c) for c in x) and any(x)


@pytest.mark.parametrize("interval", [8192, 20])
def test_embedding_near_duplicates(spark, monkeypatch, interval):
    monkeypatch.setattr(embed_dedup, "INTERVAL", interval)
    rows = vectors()
    edges, links = [], [0] * len(rows)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i < j and valid(a[1]) and valid(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9:
                    edges.append((i, j))
                    links[i] += 1
                    links[j] += 1
    root = union(len(rows), edges)
    least = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, 10**9), rows[i][0])
    want = [(rows[i][0], links[i], least.get(r), rows[i][0] is not None and least.get(r) == rows[i][0]) for i, r in enumerate(root)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = embed_dedup.near_duplicates(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_top_k(spark, monkeypatch):
    rows = [r for r in vectors() if r[0] != 308]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)

    def check():
        ok = [r for r in rows if r[0] is not None and r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
        ints = [(r[0], [math.floor(256 * c) for c in r[1]]) for r in ok]
        want = []
        for q, x in ints:
            if q % 7 == 0:
                found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ints if i != q and len(x) == len(y))
                want.append((q, [(i, -s) for s, i in found]))
        got = topk_search.top_k(df, lambda c: c % 7 == 0).collect()
        for q in {q for q, _ in want}:
            mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
            first = sorted(((i, s) for a, f in want if a == q for i, s in f), key=lambda t: (-t[1], t[0]))[:5]
            assert [m[1:] for m in mine] == first and [m[0] for m in mine] == list(range(1, len(first) + 1))

    check()
    monkeypatch.setattr(topk_search, "ROW_BLOCK", 17)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(topk_search, "DIM_BLOCK", 3)
    check()
    assert topk_search.top_k(df.limit(0), lambda c: c % 7 == 0).count() == 0


def test_search_block_is_exact():
    rng = np.random.default_rng(1)
    for dims in (1, 16, 40, 64):
        r = rng.integers(-300, 300, (200, dims))
        r[50:90] = r[3]
        ids = rng.permutation(1000)[:200]
        q, i, s = topk_search.search_block(ids[:20], r[:20], ids, r, 5)
        for n in range(20):
            score = r @ r[n]
            best = [k for k in np.lexsort((ids, -score)) if ids[k] != ids[n]][:5]
            assert i[q == ids[n]].tolist() == ids[best].tolist() and s[q == ids[n]].tolist() == score[best].tolist()


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def documents():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        text = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        rows.append((i, " ".join(text)))
        for j in range(i % 5):
            copy = list(text)
            for _ in range(j // 2):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 - 10 * i - j, "\n ".join(copy).upper() if j == 2 else " ".join(copy)))
    return [(a, b, "x") for a, b in [*rows, (2000, None), (2001, ""), (2002, " \n"), (2003, "a b c"), (2004, "one two"), (5, "other text"), (None, "one two"), (2005, "long " * 30_000)]]


def test_fingerprints_and_components(spark):
    rows = documents()
    prints = [brute_print(t) for _, t, _ in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = union(len(rows), edges)
    least = {}
    for r, (i, *_) in zip(root, rows):
        if i is not None:
            least[r] = min(least.get(r, 10**9), i)
    want = sorted(str((i, f"{p:016x}", least.get(r))) for (i, *_), p, r in zip(rows, prints, root))
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)
    got = simhash.near_duplicates(df)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    back = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(back) == len(set(root))
    assert {root[[(a, b) for a, b, _ in rows].index(x)] for x in back} == set(root)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_anchor_search_finds_all_links(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 50, dtype=np.uint64) * np.uint64(2)
    prints = set(base.tolist())
    for b in base.tolist():
        for _ in range(12):
            b ^= sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 5), replace=False))
            prints.add(b)
    prints = sorted(prints)
    want = union(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    groups = {}
    for p, r in zip(prints, want):
        groups.setdefault(r, []).append(p)
    for split in (50_000, 3):
        monkeypatch.setattr(simhash, "SPLIT", split)
        df = spark.createDataFrame([(0, simhash.signed(p)) for p in prints], "key long, fp long").repartition(2)
        links = simhash.near_links(df.select("fp", df.fp.alias("rep"))).collect()
        at = {simhash.signed(p): i for i, p in enumerate(prints)}
        got = union(len(prints), [(at[r.u], at[r.v]) for r in links])
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(200, 300)] + [(500, 400 + i) for i in range(60)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(7, 7)]
    root = union(600, edges)
    least = {}
    for i in range(600):
        least.setdefault(root[i], i)
    want = {i: least[root[i]] for i in range(600) if least[root[i]] != i}
    got = connected_components(spark.createDataFrame([*edges, (None, 3)], "u long, v long").repartition(7))
    assert {r.node: r.component for r in got.collect()} == want
    u, v = forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert dict(zip(u.tolist(), v.tolist())) == want
    assert connected_components(got.limit(0).toDF("u", "v")).count() == 0
