"""The registered queries against their SQL, and the pipeline's stages against what they must do."""

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm import queries, quality, simhash


def rows(found):
    return sorted(str(tuple(r)) for r in found)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.select(columns).collect()) == rows(want.fetchall())


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        kept[name] = docs
        if name != "packing":
            assert docs.columns == first.columns
    model = quality.train(first, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in quality.scores(first, model).filter("keep").select("doc_id").collect()}
    assert {r.doc_id for r in kept["quality"].collect()} == good and 0 < len(good) < first.count()
    assert kept["line_dedup"].count() == len(good)
    prints = [simhash.fingerprint(r.text) for r in kept["near_dedup"].collect()]
    assert not any((a ^ b).bit_count() <= 3 for i, a in enumerate(prints) for b in prints[:i])
    assert {r.doc_id for r in kept["packing"].collect()} == {r.doc_id for r in kept["pii"].collect()} == {r.doc_id for r in kept["near_dedup"].collect()}
    assert not any("n_chars" in r and r.n_chars != len(r.text) for r in kept["pii"].collect())
    assert corpus_pipeline.run(spark, sf_dir).columns == kept["packing"].columns
