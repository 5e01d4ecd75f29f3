"""The pipeline's stages on odd tables: nulls, repeated ids, empty tables, columns of any name."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, line_dedup, near_copies, pii, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key long, _ord int, _text string, _gone string, _row long, _fp long, _doc string, `a.b` int, best string, tie string, row int, fp string"


def odd_documents():
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = "\n".join(line(12) for _ in range(5))
    body = line(80)
    texts = [body, body, body + " omega", passage + "\n" + line(30), line(20) + "\n" + passage, None, "", "   \n\t", "mail me@example.org now", line(6000)]
    texts += [line(rng.randint(1, 60)) for _ in range(20)]
    out = []
    for i, t in enumerate(texts):
        key = None if i % 9 == 8 else i // 2 if i % 3 else 7
        out.append((key, t, "en" if i % 4 else None, "web" if i % 5 else None, 3, 10 + i, 20 + i, f"t{i}", f"g{i}", 30 + i, 40 + i, f"d{i}", i, f"b{i}", f"x{i}", 50 + i, f"f{i}"))
    return out


EXTRA = [c.split()[0].strip("`") for c in SCHEMA.split(", ")][5:]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3)


def extras(df):
    """The extra columns, which tell each row of the fixture apart."""
    return sorted(tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in EXTRA]).collect())


def test_columns_of_any_name_pass_through(odd):
    every = extras(odd)
    cut = line_dedup.without_later_runs(odd)
    assert cut.columns == odd.columns and extras(cut) == every
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and extras(clean) == every
    for one_of_each in (near_copies.one_of_each, simhash.one_of_each):
        kept = one_of_each(odd)
        assert kept.columns == odd.columns and set(extras(kept)) < set(every)
    labels = odd.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    good = quality.keep_good(odd, quality.train(odd, labels))
    assert good.columns == odd.columns and set(extras(good)) <= set(every)


def test_which_copy_stays_does_not_depend_on_the_partitions(spark):
    rows = [(5, "one two three four five six", "a"), (5, "ONE two three four five six", "b"), (None, "one two three four five six", "c"), (9, "one two three four five six", "d")]
    for one_of_each in (near_copies.one_of_each, simhash.one_of_each):
        found = set()
        for n in (1, 2, 4):
            for order in (rows, rows[::-1]):
                found.add(tuple(one_of_each(spark.createDataFrame(order, "doc_id long, text string, tag string").repartition(n)).collect()))
        assert len(found) == 1 and next(iter(found))[0].doc_id == 5


def test_pipeline_on_odd_and_empty_tables(spark, odd, tmp_path):
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        d = f"file://{tmp_path}/{name}"
        docs.write.parquet(f"{d}/documents.parquet")
        docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{d}/labels.parquet")
        now = spark.read.parquet(f"{d}/documents.parquet")
        for step, function in corpus_pipeline.STAGES[:-1]:
            after = common.materialize(function(spark, now, d), step)
            assert after.columns == docs.columns and after.count() <= now.count(), step
            now = after
        packed = corpus_pipeline.run(spark, d)
        assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        assert packed.agg(F.sum("length")).first()[0] == (now.count() and packed.filter("start = 0").agg(F.sum("doc_tokens")).first()[0] or None)
        assert packed.filter("start = 0").count() == now.count()


def test_many_rows_of_one_id(spark):
    """Rows that share an id are numbered by their texts, however they are dealt."""
    rng = random.Random(3)
    rows = [(7 if i % 3 else None if i % 2 else i, "".join(rng.choice("abé") for _ in range(rng.randint(0, 9)))) for i in range(400)]
    numbered, size = common.keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = sorted((r["_key"], r["_ord"], bytes(r["_text"])) for r in numbered.collect())
    want, last, n = [], None, 0
    for key, text in sorted((common.NULL_ID if k is None else k, t.encode()) for k, t in rows):
        n = n + 1 if key == last else 0
        want.append((key, n, text))
        last = key
    assert got == want and size == sum(len(t) for _, _, t in want)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = type("conf", (), {"get": staticmethod(lambda k, d: d)})
        sparkContext = type("context", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
