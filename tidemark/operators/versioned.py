"""Versioned key-value tables and ordered indexes over op logs.

A log has a total order (seq), a key, a tombstone flag and a value. Resolution is one partially aggregated group by
key (max_by of the whole entry), so filters on the key reach the scan and no key's history is sorted or collected."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F


def in_range(key: Column, low=None, high=None) -> Column:
    """key in [low, high); None is open."""
    out = F.lit(True)
    if low is not None:
        out = out & (key >= F.lit(low))
    if high is not None:
        out = out & (key < F.lit(high))
    return out


def latest(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The newest entry of each key, tombstones included (they hide what is older)."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_e")).select(key, *[F.col(f"_e.{c}").alias(c) for c in rest])


def scan(log: DataFrame, low=None, high=None, key: str = "key", seq: str = "seq") -> DataFrame:
    """Live entries of [low, high) in the order of their keys: versions are resolved first, tombstones dropped after."""
    return latest(log.filter(in_range(F.col(key), low, high)), key, seq).filter(~F.col("tombstone")).orderBy(key)


def get(log: DataFrame, keys: list, key: str = "key", seq: str = "seq") -> DataFrame:
    return latest(log.filter(F.col(key).isin(keys)), key, seq).filter(~F.col("tombstone"))


def with_previous(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Each operation with what it replaced: previous is the live value just before it, null if there was none."""
    order = Window.partitionBy(key).orderBy(seq)
    before = F.lag(F.when(~F.col("tombstone"), F.col("value"))).over(order)
    return log.withColumn("previous", before)


def generations(log: DataFrame, parts: int, seq: str = "seq") -> DataFrame:
    """Split a log into runs of equal seq ranges (gen 0 is the oldest); the bounds are one small aggregate."""
    low, high = log.agg(F.min(seq), F.max(seq)).first()
    if low is None:
        return log.withColumn("gen", F.lit(0))
    width = (high - low) // parts + 1
    return log.withColumn("gen", F.floor((F.col(seq) - F.lit(low)) / F.lit(width)).cast("int"))


def flush(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """A log's tail as the run that a flush writes: newest entry per key, tombstones kept."""
    return latest(log, key, seq)


def flush_generations(log: DataFrame, key: str = "key", seq: str = "seq", gen: str = "gen") -> DataFrame:
    """flush() of every generation of a log at once."""
    rest = [c for c in log.columns if c not in (key, gen)]
    return log.groupBy(gen, key).agg(F.max_by(F.struct(*rest), seq).alias("_e")).select(gen, key, *[F.col(f"_e.{c}").alias(c) for c in rest])


def run_range(run: DataFrame, low=None, high=None, key: str = "key", seq: str = "seq") -> DataFrame:
    """The entries of one run in [low, high), in order, tombstones kept."""
    return flush(run.filter(in_range(F.col(key), low, high)), key, seq).orderBy(key)


def compact(runs: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """All runs folded into one; tombstones are dropped for good."""
    return latest(runs, key, seq).filter(~F.col("tombstone"))


def entry_bytes(key: Column, value: Column, overhead: int = 24) -> Column:
    """What an entry counts towards a memtable's limit."""
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + F.lit(overhead)


_ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row in it below


def _ranged(df: DataFrame, *keys: str) -> DataFrame:
    """df in ranges of its keys, sorted in each, with _id (the range's number above the row's). The number of ranges is
    given, so that it is the same wherever the plan is used."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())


def _earlier():
    """Over one row per range: the ranges before."""
    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df ordered by a key with pos, its row number from 0: numbered inside each range of keys, and shifted by the ranges'
    counts (one row each), so no single task sees all rows."""
    local = _ranged(df, key).withColumn("_part", F.shiftright("_id", _ROW_BITS))
    shift = local.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(_earlier()), F.lit(0)).alias("_before"))
    pos = F.col("_before") + F.col("_id").bitwiseAND(F.lit(2**_ROW_BITS - 1))
    return local.join(F.broadcast(shift), "_part").withColumn("pos", pos).drop("_part", "_before", "_id")


def sparse_index(df: DataFrame, key: str, every: int = 64) -> DataFrame:
    """Every every-th key in order, with its row number."""
    return numbered(df, key).filter(F.col("pos") % every == 0)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_k, _q, _i, _id) of a range in order: _i becomes the last value that is not null."""
    last = None
    for batch in batches:
        filled = pc.fill_null_forward(batch.column("_i"))
        if last is not None:
            filled = pc.fill_null(filled, last)
        if len(filled) and filled[-1].is_valid:
            last = filled[-1]
        yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_q"), filled, batch.column("_id")], batch.schema.names)


def floor_probe(probes: DataFrame, index: DataFrame, probe: str, key: str) -> DataFrame:
    """For each probe the largest indexed key not above it (null if none), for keys of any one ordered type. Probes and keys
    are ordered together in ranges; the last key of each range is carried to the next ones as one row per range."""
    kind = index.schema[key].dataType.simpleString()
    both = probes.select(F.col(probe).alias("_k"), F.lit(1).alias("_q"), F.lit(None).cast(kind).alias("_i"))
    both = both.unionByName(index.select(F.col(key).cast(probes.schema[probe].dataType).alias("_k"), F.lit(0).alias("_q"), F.col(key).alias("_i")))
    parts = _ranged(both, "_k", "_q")
    part = F.shiftright("_id", _ROW_BITS).alias("_part")
    ends = parts.groupBy(part).agg(F.max("_i").alias("_m")).select("_part", F.max("_m").over(_earlier()).alias("_c"))
    found = parts.mapInArrow(_carried, parts.schema).filter("_q = 1").select("_k", "_i", part)
    return found.join(F.broadcast(ends), "_part").select(F.col("_k").alias(probe), F.coalesce("_i", "_c").alias("floor_key"))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range's rows (_k, _id) in order: its number, first and last key, and how many keys are not above the one before."""
    part = first = last = None
    wrong = 0
    kind = None
    for batch in batches:
        keys = batch.column("_k")
        if not len(keys):
            continue
        kind = keys.type
        if part is None:
            part, first = batch.column("_id")[0].as_py() >> _ROW_BITS, keys[0].as_py()
        elif not (last is not None and keys[0].is_valid and last < keys[0].as_py()):
            wrong += 1
        if len(keys) > 1:
            above = pc.fill_null(pc.greater(keys.slice(1), keys.slice(0, len(keys) - 1)), False)
            wrong += len(above) - pc.sum(above).as_py()
        last = keys[-1].as_py()
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([first], kind), pa.array([last], kind), pa.array([wrong], pa.int64())], ["_part", "first", "last", "wrong"])


def chain(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row: n_broken, how many keys, followed in the order of another column, are not above the key before."""
    kind = df.schema[key].dataType.simpleString()
    rows = _ranged(df.select(F.col(order).alias("_o"), F.col(key).alias("_k")), "_o").select("_k", "_id")
    ends = rows.mapInArrow(_links, f"_part long, first {kind}, last {kind}, wrong long")
    before = F.lag("last").over(Window.orderBy("_part"))  # one row per range
    ends = ends.select("wrong", ((F.row_number().over(Window.orderBy("_part")) > 1) & ~F.coalesce(before < F.col("first"), F.lit(False))).cast("long").alias("border"))
    return ends.agg(F.coalesce(F.sum(F.col("wrong") + F.col("border")), F.lit(0)).cast("long").alias("n_broken"))


def height(n: int, fanout: int = 64) -> int:
    """The least height of an ordered tree over n keys (0: empty)."""
    out = 0
    while n > 0:
        out, n = out + 1, 0 if n <= fanout else -(-n // fanout)
    return out


def audit(df: DataFrame, key: str) -> DataFrame:
    """One row: keys, distinct keys, nulls, and whether each key stands once."""
    per_key = df.groupBy(key).count()
    return per_key.agg(
        F.sum("count").cast("long").alias("n_entries"), F.count(key).cast("long").alias("n_keys"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("count"))), F.lit(0)).cast("long").alias("n_null"),
        F.coalesce(F.sum((F.col("count") > 1).cast("long")), F.lit(0)).alias("n_repeated"),
    )
