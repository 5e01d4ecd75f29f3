"""Quality classifier: held-out accuracy, shrinkage, odd inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    test = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) == 0
    model = quality.train(docs, labels.filter(~test))
    got = quality.scores(docs, model).join(labels.filter(test).withColumnRenamed("quality", "good"), "doc_id").select("keep", "good").toPandas()
    assert len(got) > 80 and (got.keep == (got.good > 0)).mean() > 0.97


def test_filter_keeps_columns_and_odd_rows(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    more = docs.select("doc_id", "text", "lang", "source", F.rand(1).alias("quality"), F.lit(1).alias("n")).limit(50)
    more = more.unionByName(spark.createDataFrame([(1, None, None, None, 0.3, 1), (None, "", "en", None, 0.1, 2), (1, "a " * 50_000, "en", "src0", 0.1, 2)], more.schema))
    assert quality.scores(more, model).count() == 53
    kept = quality.keep_good(more, model)
    assert kept.columns == more.columns and 0 < kept.count() <= 53
    assert quality.scores(more.limit(0), model).count() == 0 and quality.keep_good(more.limit(0), model).count() == 0


def test_no_labels(tables):
    docs, labels = tables
    for some in (labels.limit(0), labels.filter("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        model = quality.train(docs, some)
        assert not len(model.weights)
        assert quality.scores(docs.limit(20), model).filter("keep").count() == 20


def test_shrinkage(spark):
    rows = [("big", f"p{i % 2}", 0.95 if i % 2 else 0.85) for i in range(400)] + [("low", "p", 0.2)] * 300 + [("one", "p", 0.0), (None, None, 1.0)]
    got = {(r.host, r.path): r for r in quality.group_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    mean = np.mean([r[2] for r in rows])
    assert len(got) == 5 and abs(got[("low", "p")].global_mean - mean) < 1e-9
    assert abs(got[("low", "p")].path_mean - 0.2) < 0.05 and abs(got[("big", "p1")].path_mean - 0.95) < 0.05
    assert 0.1 < got[("one", "p")].path_mean < mean  # one document hardly moves its site
    assert mean < got[(None, None)].path_mean < 0.95


def brute_scores(rows, model, threshold=quality.THRESHOLD):
    """(evidence, host_mean, path_mean, quality, keep) of rows (host, path, text), in plain Python."""
    evidence = [float(model.log_odds([t])[0]) for _, _, t in rows]
    p = [1 / (1 + math.exp(-e)) for e in evidence]

    def means(groups, towards):
        """Shrunk means of groups {name: [p]} towards {name: mean above}."""
        q = w = t = t2 = b = 0.0
        for g, xs in groups.items():
            m, n = towards[g], len(xs)
            q += (sum(xs) - n * m) ** 2 / n
            w += m * (1 - m)
            t += n
            t2 += n * n
            b += m * (1 - m) / len(groups)
        spread = max(1e-12, (q - w) / max(1e-9, t - t2 / t))
        k = min(10_000.0, max(1.0, b / spread))
        return {g: (sum(xs) + k * towards[g]) / (len(xs) + k) for g, xs in groups.items()}

    hosts, paths = {}, {}
    for (h, path, _), x in zip(rows, p, strict=True):
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, path), []).append(x)
    every = sum(p) / len(p)
    host_mean = means(hosts, dict.fromkeys(hosts, every))
    path_mean = means(paths, {k: host_mean[k[0]] for k in paths})
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    out = []
    for (h, path, _), e in zip(rows, evidence, strict=True):
        total = e + logit(path_mean[h, path]) - logit(every)
        out.append((e, host_mean[h], path_mean[h, path], 1 / (1 + math.exp(-total)), 1 / (1 + math.exp(-total)) >= threshold))
    return out


def test_every_row_against_brute_force(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    rows = [(r.source, r.lang, r.text) for r in docs.collect()] + [(None, None, None), (None, "en", ""), ("alone", None, "a b c"), ("alone", None, "a b c"), ("alone", "x", "word " * 30_000)]
    odd = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, lang string, text string").repartition(4)
    got = {r.doc_id: (r.evidence, r.host_mean, r.path_mean, r.quality, r.keep) for r in quality.scores(odd, model).collect()}
    want = brute_scores(rows, model)
    assert len(got) == len(want)
    for i, w in enumerate(want):
        assert np.allclose(got[i][:4], w[:4], rtol=1e-6, atol=1e-9) and (got[i][4] == w[4] or abs(w[3] - quality.THRESHOLD) < 1e-9), (i, got[i], w)
    kept = {r.doc_id for r in quality.keep_good(odd, model).select("doc_id").collect()}
    assert kept == {i for i, w in enumerate(want) if w[4]}
