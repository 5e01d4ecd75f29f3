"""Helpers shared by the training-data operators: the shared folder, intermediate tables, keys, packed blobs."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Stands for a null document id inside the operators; it sorts before every other id.
NULL_ID = -(2**63)
#: Bytes of text that a task holds at once; a longer document is a chunk of its own.
CHUNK_BYTES = 4_000_000
#: Bytes of an Arrow batch between an executor and its Python workers; a longer row is a batch of its own.
BATCH_BYTES = 4_000_000

_own_dirs: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and all tasks run on this machine
    (local mode, as in tests). A cluster without the setting is an error: no folder of one machine will do."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by BATCH_BYTES, unless they are bounded closer: what a task holds then
    depends on bytes and not on how many rows happen to be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def trim() -> None:
    """Give free memory back to the system: Python workers outlive their tasks, and would keep each stage's peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slim(frames):
    """The frames of a task, with free memory given back at its end."""
    try:
        yield from frames
    finally:
        trim()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return it reread: lineage ends there, and losing an
    executor costs no recomputation. cleanup() or the end of the driver process removes the tables."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of the actions inside go at the end of each action. Otherwise they stay until the driver happens to
    collect garbage, and a method of many steps holds the shuffles of all of them. Only for steps that are written or
    counted once: a result that is returned unread must be built outside."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def drop_table(df: DataFrame) -> None:
    """Remove an intermediate table that nothing will read again."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        _remove(df.sparkSession, f)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession | None = None) -> None:
    """Remove every intermediate table written so far (results that still read them become unreadable)."""
    while _written:
        s, path = _written.pop()
        try:
            _remove(spark or s, path)
        except Exception:  # the session may be gone at exit
            continue


atexit.register(cleanup)


def pack(*arrays) -> bytes:
    """Arrays, bytes and lists as one compressed blob; for the operators' own shuffles only."""
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def unpack(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fair_join(rows: DataFrame, table: DataFrame, on: list[str], how: str, total: int) -> DataFrame:
    """rows joined (inner or left_semi) to table: one row a key, with _n, the number of rows that have the key, of total.

    Keys with more than a partition's fair share of rows are broadcast: at most as many keys as partitions can have that
    many. So their rows stay where they are, and only the others are shuffled."""
    share = F.col("_n") * n_partitions(rows.sparkSession)
    hot = F.broadcast(table.filter(share > total).drop("_n"))
    cold = table.filter(share <= total).drop("_n")
    return rows.join(hot, on, how).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on, how))


def spread_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined to table, one row a key whose other columns may be large. A key with more than a partition's fair share
    of rows is copied to as many tasks as it has shares of them (so at most twice as many copies as there are
    partitions), and its rows are dealt to these by a hash of all their columns; nothing but such keys is broadcast."""
    n, total = n_partitions(rows.sparkSession), rows.count()
    shares = F.least(F.ceil(F.col("_n") * n / F.lit(max(total, 1))), F.col("_n")).cast("int")
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") * n > total).select(key, shares.alias("_copies"))
    hot = F.broadcast(materialize(hot, "hot-keys"))
    copies = F.coalesce("_copies", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), copies).cast("int")).drop("_copies")
    copied = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def prime_from(n: int) -> int:
    """The smallest prime that is at least n."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def whole(docs: DataFrame):
    """All columns of a row of docs as one struct, so that no column of ours can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> tuple[DataFrame, int]:
    """(_key long, _ord int, _text binary) of docs (keep: and _row, all its own columns as a struct), and the bytes of all
    texts.

    _key is the id (NULL_ID for null), _ord numbers the rows that repeat an id by the order of their texts (0 where
    ids are unique, which one cheap pass over ids and lengths tells). Null texts are empty. An id that many rows share
    is numbered in ranges of its texts, by their first 64 bytes, so no task gathers them all."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    own = [whole(docs).alias("_row")] if keep else []
    rows = docs.select(*own, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("_key"), text.alias("_text"))
    found = rows.groupBy("_key").agg(F.count("*").alias("n"), F.sum(F.octet_length("_text")).alias("b")).agg(F.max("n"), F.sum("b")).first()
    own = ["_row"] if keep else []
    if (found[0] or 0) <= 1:
        return rows.select(*own, "_key", F.lit(0).alias("_ord"), "_text"), int(found[1] or 0)
    # a global sort by id and text (ranges are split wherever rows differ); numbers inside a partition, and before it
    # one row per partition and id that it starts or ends with
    n = n_partitions(docs.sparkSession)
    ordered = rows.repartitionByRange(n, "_key", F.substring("_text", 1, 64)).sortWithinPartitions("_key", "_text").withColumn("_pid", F.spark_partition_id())
    ordered = materialize(ordered, "by-id")
    from pyspark.sql import Window

    counts = ordered.groupBy("_pid", "_key").agg(F.count("*").alias("_c"))
    many = counts.groupBy("_key").agg(F.count("*").alias("_p")).filter("_p > 1").select("_key")
    # ids that cross partitions: at most one per border, so few rows, and each at most once per partition
    crossing = counts.join(F.broadcast(many), "_key", "left_semi")
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_key").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    crossing = crossing.select("_pid", "_key", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("_pid", "_key").orderBy("_text")) - 1
    numbered = ordered.withColumn("_n", local).join(F.broadcast(crossing), ["_pid", "_key"], "left")
    number = (F.col("_n") + F.coalesce("_before", F.lit(0))).cast("int")
    return numbered.select(*own, "_key", number.alias("_ord"), "_text"), int(found[1] or 0)


def id_of(key):
    """A column with the original id of an internal key."""
    return F.when(F.col(key) == NULL_ID, None).otherwise(F.col(key))


def chunks(batches, size_of, limit: int = CHUNK_BYTES):
    """Regroup the pandas batches of a mapInPandas input to lists of rows (tuples) of about limit bytes."""
    held, total = [], 0
    for pdf in batches:
        for row in pdf.itertuples(index=False, name=None):
            size = size_of(row)
            if held and total + size > limit:
                yield held
                held, total = [], 0
            held.append(row)
            total += size
    if held:
        yield held


def varint_encode(values: np.ndarray) -> np.ndarray:
    """Unsigned integers as base-128 bytes, low groups first, all values at once."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        more = v >= np.uint64(1) << np.uint64(bits)
        if not more.any():
            break
        size += more
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        here = size > k
        part = (v[here] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[here] + k] = part.astype(np.uint8) | np.where(size[here] > k + 1, 128, 0).astype(np.uint8)
    return out


def varint_decode(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.empty(0, np.int64)
    first = np.concatenate(([0], last[:-1] + 1))
    size = last - first + 1
    out = np.zeros(len(last), np.uint64)
    for k in range(int(size.max())):
        here = size > k
        out[here] |= (data[first[here] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return out.astype(np.int64)


class Rolling:
    """Polynomial hashes modulo 2**64 of any slices of a sequence of small integers.

    Each symbol is first mapped to a random 64-bit number (by a fixed mixer), so that structure in the symbols does not
    carry over; callers that need certainty compare two independent hashes."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    def __init__(self, symbols: np.ndarray, which: int = 0):
        n = len(symbols)
        power, self.inverse = self._upto(n + 1, which)
        with np.errstate(over="ignore"):
            self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self._table(symbols, which) * power[:n], dtype=np.uint64)))

    @classmethod
    def _upto(cls, n: int, which: int):
        have = cls._powers.get(which)
        if have is None or len(have[0]) < n:
            base = cls.BASES[which]
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                p, q = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
                p[0] = q[0] = 1
                have = (np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64))
            if n <= 2 * CHUNK_BYTES:
                cls._powers[which] = have
        return have

    @staticmethod
    def _table(symbols: np.ndarray, which: int) -> np.ndarray:
        if symbols.dtype == np.uint8:
            return mix64(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * which))[symbols]
        return mix64(symbols.astype(np.uint64) + np.uint64(1 + 10_000_019 * which))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.prefix[end] - self.prefix[start]) * self.inverse[start]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))
