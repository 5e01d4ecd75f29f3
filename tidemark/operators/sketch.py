"""Mergeable distinct-count sketches and Bloom filters, as small tables of registers or bits.

Registers are (group, idx, rank) rows and merge by max; bits are (word, bits) rows and merge by or. Both are built by
partial aggregates, so what is shuffled is bounded by the sketch's size per task and group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import wrapping as W

MIN_P, MAX_P = 4, 18


def check_precision(p: int) -> None:
    if not MIN_P <= p <= MAX_P:
        raise ValueError(f"precision {p} is not in {MIN_P} to {MAX_P}")


def alpha(m: int) -> float:
    # The bias constants of the estimator.
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def standard_error(p: int) -> float:
    return 1.04 / math.sqrt(2**p)


def memory_bytes(p: int) -> int:
    """Of a sketch with a byte per register."""
    check_precision(p)
    return 2**p


def precision(sketch: DataFrame) -> int | None:
    """The precision that a table of registers was built with; it travels as metadata of idx, also through Parquet."""
    return sketch.schema["idx"].metadata.get("precision")


def _check_same(p: int, *sketches: DataFrame) -> None:
    for s in sketches:
        if (found := precision(s)) not in (None, p):
            raise ValueError(f"sketches of precision {found} and {p} do not go together")


def registers(df: DataFrame, item: Column, p: int, by: tuple[str, ...] = (), hashed=W.hash_long) -> DataFrame:
    """(by..., idx, rank): the highest rank seen in each register that is not empty; null items are not counted."""
    check_precision(p)
    rows = hashed(df.select(*by, item.alias("_item")).filter("_item is not null"), F.col("_item"), "_h")
    rest = F.shiftleft("_h", p)
    rows = rows.select(*by, F.shiftrightunsigned("_h", 64 - p).cast("int").alias("idx"), rest.alias("_rest"))
    rank = F.when(F.col("_rest") == 0, F.lit(64 - p + 1)).otherwise(F.lit(65) - F.length(F.bin("_rest")))
    found = rows.groupBy(*by, "idx").agg(F.max(rank.cast("int")).alias("rank"))
    return found.withMetadata("idx", {"precision": p})


def merge(*sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The sketch of the union of what the sketches have seen. Sketches of different precision are an error."""
    known = {p for s in sketches if (p := precision(s)) is not None}
    if len(known) > 1:
        raise ValueError(f"sketches of precisions {sorted(known)} do not go together")
    every = sketches[0]
    for s in sketches[1:]:
        every = every.unionByName(s)
    merged = every.groupBy(*by, "idx").agg(F.max("rank").alias("rank"))
    return merged.withMetadata("idx", {"precision": known.pop()}) if known else merged


def estimate(sketch: DataFrame, p: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., estimate): harmonic mean, or linear counting below 2.5 m; an empty sketch (no by) gives 0."""
    check_precision(p)
    _check_same(p, sketch)
    m = 2**p
    ranks = sketch.groupBy(*by, "rank").count()
    total = ranks.groupBy(*by).agg(F.sum(F.col("count") * F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.sum("count").alias("n"))
    zeros = F.lit(m) - F.coalesce("n", F.lit(0))
    raw = F.lit(alpha(m) * m * m) / (F.coalesce("s", F.lit(0.0)) + zeros)
    linear = F.lit(float(m)) * F.log(F.lit(float(m)) / F.when(zeros > 0, zeros))
    value = F.when((raw <= 2.5 * m) & (zeros > 0), linear).otherwise(raw)
    return total.select(*by, F.floor(value + 0.5).cast("long").alias("estimate"))


def bloom_size(n: int, fpp: float) -> tuple[int, int]:
    """(bits, hashes) for n keys at a false positive rate."""
    n = max(1, n)
    bits = max(64, math.ceil(-n * math.log(fpp) / math.log(2) ** 2))
    return bits, max(1, math.floor(bits / n * math.log(2) + 0.5))


#: Filters of at most so many bits (8 MB) are broadcast to the keys that are probed; larger ones are joined by word.
BROADCAST_BITS = 1 << 26


def bloom_words(df: DataFrame, key: Column, bits: int, hashes: int) -> DataFrame:
    """(word, bits): the filter of the keys, as words of 64 bits; words without a bit are left out."""
    pos = df.select(F.explode(W.bloom_positions(key, bits, hashes)).alias("pos"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))
    return pos.groupBy(F.shiftright("pos", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))


def _has(word: Column, pos: Column) -> Column:
    return F.call_function("shiftright", word, (pos % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def bloom_probe(df: DataFrame, key: Column, words: DataFrame, bits: int, hashes: int, limit: int = BROADCAST_BITS) -> DataFrame:
    """df with maybe (0 or 1): whether all bits of its key are set (0 for a null key)."""
    if bits <= limit:
        asked = df.withColumn("_pos", W.bloom_positions(key, bits, hashes))
        empty = df.sparkSession.range(-(-bits // 64)).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
        dense = words.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        one = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("_words"))
        all_set = F.forall("_pos", lambda p: _has(F.get("_words", F.shiftright(p, 6).cast("int")), p))
        probed = asked.crossJoin(F.broadcast(one))  # one row of at most limit bits
        return probed.select(*df.columns, F.coalesce(all_set, F.lit(False)).cast("int").alias("maybe"))
    # joined back by the key: a row number made twice differs wherever the order of rows does, as after a shuffle
    keyed = df.withColumn("_key", key)
    each = keyed.select("_key").filter("_key is not null").distinct().withColumn("_pos", W.bloom_positions(F.col("_key"), bits, hashes))
    each = each.select("_key", F.explode("_pos").alias("pos")).withColumn("word", F.shiftright("pos", 6).cast("int"))
    found = each.join(words, "word", "left").groupBy("_key").agg(F.min(F.coalesce(_has(F.col("bits"), F.col("pos")), F.lit(False)).cast("int")).alias("maybe"))
    return keyed.join(found, "_key", "left").select(*df.columns, F.coalesce("maybe", F.lit(0)).alias("maybe"))


def bloom_save(words: DataFrame, bits: int, hashes: int, path: str) -> None:
    """Write a filter with its header (bit count and hash count), so that it can be probed later."""
    words.write.mode("overwrite").parquet(f"{path}/words")
    words.sparkSession.createDataFrame([(bits, hashes)], "bits long, hashes int").write.mode("overwrite").parquet(f"{path}/header")


def bloom_load(spark, path: str) -> tuple[DataFrame, int, int]:
    """(words, bits, hashes) of a filter that bloom_save wrote."""
    header = spark.read.parquet(f"{path}/header").first()
    return spark.read.parquet(f"{path}/words"), header.bits, header.hashes
