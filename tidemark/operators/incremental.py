"""Derived values that change only when their inputs do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def changes(df: DataFrame, node: str, seq: str, value: str) -> DataFrame:
    """Writes that change their node's value (the first always does)."""
    order = Window.partitionBy(node).orderBy(seq)
    return df.withColumns({"_b": F.lag(value).over(order), "_n": F.row_number().over(order)}).filter((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_b"))).drop("_b", "_n")


def batch_last(df: DataFrame, node: str, seq: str, value: str, width: int) -> DataFrame:
    """Writes coalesced by batches of width sequence numbers: a node's last value in each."""
    batch = F.floor(F.col(seq) / F.lit(width)).cast("long")
    return df.groupBy(node, batch.alias("batch")).agg(F.max_by(value, seq).alias(value))


def diamond(df: DataFrame, value: str, depth: int) -> DataFrame:
    """A chain of diamonds over value: every layer is the sum of two branches of the layer above, evaluated together, so
    a row never mixes old and new values."""
    for k in range(depth):
        df = df.withColumns({"left": F.col(value) + 1, "right": F.col(value) - 1}).withColumn(value, (F.col("left") + F.col("right")) / 2)
        if k % 8 == 7:
            df = df.select(*df.columns)
    return df.drop("left", "right")
