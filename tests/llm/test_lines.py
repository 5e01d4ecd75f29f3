"""Line dedup against brute force."""

import hashlib
import random

from tidemark.llm import line_dedup


def brute(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, (rows[i][1] or "").encode()))
    seen, out = set(), [None] * len(rows)
    for i in order:
        lines = (rows[i][1] or "").split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for at in range(len(full)):
            words = 0
            for m in range(1, 4):
                if at + m > len(full):
                    break
                words += lines[full[at + m - 1]].strip(" ").count(" ") + 1
                if words >= 50 or m == 3:
                    run = full[at : at + m]
                    key = tuple(lines[k] for k in run)
                    if key in seen:
                        gone |= set(run)
                    seen.add(key)
                    break
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out[i] = (rows[i][0], len(lines), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def documents():
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choice(["aa", "bé", "cc", "d", "e"]) for _ in range(n))
    common, passage, long = line(6), [line(5) for _ in range(7)], line(60)
    rows = []
    for i in range(80):
        parts = [line(rng.randint(1, 12)) for _ in range(rng.randint(0, 5))]
        if i % 3 == 0:
            a = rng.randint(0, 3)
            parts += passage[a : a + rng.randint(2, 6)]
        if i % 4 == 0:
            parts += [common, "", "  "]
        if i % 5 == 0:
            parts.insert(rng.randint(0, len(parts)), long)
        if i % 9 == 0:
            parts += [line(30), "", line(30)] if i % 2 else ["same " * 20, "thing " * 31]
        rows.append((i * 7 % 83, "\n".join(parts)))
    rows += [(200, None), (201, ""), (202, "\n\n\n"), (203, "x\nx\nx\nx\nx\nx"), (204, "\n".join(passage)), (204, "\n".join(passage)), (204, "z"), (None, "\n".join(passage[1:5])), (205, "w\n" * 20_000)]
    return rows


def test_lines(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, "x", r[0]) for r in rows], "doc_id long, text string, n_lines string, fp long").repartition(3)
    want = brute(rows)
    got = line_dedup.dedup_report(df)
    assert got.columns == ["doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(w[:5]) for w in want)
    assert sum(w[2] for w in want) > 100
    kept = line_dedup.without_later_runs(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(w[0]), w[5]) for w in want)
    assert line_dedup.dedup_report(df.limit(0)).count() == 0


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string")
    plan = line_dedup.dedup_report(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
