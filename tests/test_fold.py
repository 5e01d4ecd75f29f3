"""coroutine_fold with a user who has most of the events."""

from pyspark.sql import functions as F

from tidemark.operators import small
from tidemark.plans import catalogue


def test_hot_user_is_never_one_array(spark, tmp_path, monkeypatch):
    events = spark.range(60_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 7 == 0, F.col("id") % 5).otherwise(9).alias("user_id"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    fold = small.fold

    def short(values, step, start):
        return F.when(F.size(values) > 10_000, F.raise_error(F.lit("one large array"))).otherwise(fold(values, step, start))

    monkeypatch.setattr(small, "fold", short)
    want = {}
    for r in events.collect():
        want[r.user_id] = want.get(r.user_id, 0) + r.event_id + 1
    assert {r.user_id: r.total for r in catalogue.coroutine_fold(spark, str(tmp_path)).collect()} == want
