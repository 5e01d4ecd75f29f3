"""64-bit arithmetic that wraps, as column expressions that stay in the JVM and hold under ANSI mode.

Numbers are BIGINT bit patterns. A product is put together from 16-bit limbs, none of whose sums can overflow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

_LOW32 = 0xFFFFFFFF


def signed(x: int) -> int:
    x &= 2**64 - 1
    return x - 2**64 if x >> 63 else x


def add64(x: Column, y: Column) -> Column:
    low = x.bitwiseAND(F.lit(_LOW32)) + y.bitwiseAND(F.lit(_LOW32))
    high = F.shiftrightunsigned(x, 32) + F.shiftrightunsigned(y, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW32)))


def mul64(x: Column, k: int) -> Column:
    """x times a constant: the low half of x in two limbs, of the crossed products only what stays below 2**64."""
    k &= 2**64 - 1
    limb = [F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)]
    low, high = F.lit(k & _LOW32), F.lit(k >> 32)
    first = limb[0] * low
    middle = limb[1] * low + F.shiftrightunsigned(first, 16)
    part = lambda p: F.shiftleft(p.bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    top = F.shiftrightunsigned(middle, 16) + limb[0] * high + part(limb[1] * high) + limb[2] * low + part(limb[3] * low)
    return F.shiftleft(top, 32).bitwiseOR(part(middle)).bitwiseOR(first.bitwiseAND(F.lit(0xFFFF).cast("long")))


def xor_shift(x: Column, n: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, n))


# SplitMix64's increment and multipliers; FNV-1a's offset and prime; the Bloom hash's seeds and multiplier.
GOLDEN, SPLIT_1, SPLIT_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
BLOOM_SEEDS, BLOOM_MULTIPLIER = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 0xFF51AFD7ED558CCD


def staged(df: DataFrame, out: str, *steps) -> DataFrame:
    """Column out of df taken through the steps, each in a projection of its own: what a step uses twice is computed once, and
    all of them compile to one loop."""
    for step in steps:
        df = df.withColumn(out, step(F.col(out)))
    return df


def hash_long(df: DataFrame, item: Column, out: str = "hash") -> DataFrame:
    """df with SplitMix64's finalizer of a BIGINT."""
    return staged(
        df.withColumn(out, item.cast("long")), out, lambda z: add64(z, F.lit(signed(GOLDEN))), lambda z: xor_shift(z, 30), lambda z: mul64(z, SPLIT_1),
        lambda z: xor_shift(z, 27), lambda z: mul64(z, SPLIT_2), lambda z: xor_shift(z, 31),
    )


# Strings have no bytes to loop over in compiled expressions, so their hashes take Arrow batches to numpy: one step for each
# byte position, over all strings of the batch that are that long.


def fnv1a(values: list[bytes], seed: int = 0) -> np.ndarray:
    size = np.fromiter(map(len, values), np.int64, len(values))
    data = np.frombuffer(b"".join(values), np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    h = np.full(len(values), (seed ^ FNV_OFFSET) & (2**64 - 1), np.uint64)
    order = np.argsort(-size, kind="stable")
    count = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
    with np.errstate(over="ignore"):
        for k, n in enumerate(count.tolist()):
            here = order[:n]
            h[here] = (h[here] ^ data[start[here] + k]) * np.uint64(FNV_PRIME)
    return h


def _shift(h: np.ndarray, n: int) -> np.ndarray:
    return h ^ (h >> np.uint64(n))


def _bytes_of(s: pd.Series) -> tuple[np.ndarray, list[bytes]]:
    some = s.notna().to_numpy()
    return some, [x.encode() if isinstance(x, str) else bytes(x) for x in s[some]]


@F.pandas_udf(T.LongType())
def _hash_bytes(s: pd.Series) -> pd.Series:
    some, values = _bytes_of(s)
    with np.errstate(over="ignore"):
        z = _shift(fnv1a(values) + np.uint64(GOLDEN), 30)
        z = _shift(z * np.uint64(SPLIT_1), 27)
        z = _shift(z * np.uint64(SPLIT_2), 31)
    out = pd.Series(pd.array([pd.NA] * len(s), dtype="Int64"))
    out[some] = z.view(np.int64)
    return out


def hash_bytes(df: DataFrame, item: Column, out: str = "hash") -> DataFrame:
    """df with the sketch's hash of a string (its UTF-8 bytes) or binary."""
    return df.withColumn(out, _hash_bytes(item))


def bloom_positions(key: Column, bits: int, hashes: int) -> Column:
    """The bit positions of a string's or binary's UTF-8 bytes, as an array of BIGINT (null for null)."""

    @F.pandas_udf("array<bigint>")
    def positions(s: pd.Series) -> pd.Series:
        some, values = _bytes_of(s)
        with np.errstate(over="ignore"):
            a, b = (_shift(_shift(fnv1a(values, seed), 33) * np.uint64(BLOOM_MULTIPLIER), 33) for seed in BLOOM_SEEDS)
            steps = a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)
        out = pd.Series([None] * len(s), dtype=object)
        out[some] = pd.Series(list(steps.view(np.int64) % bits), dtype=object, index=out.index[some])
        return out

    return positions(key)
