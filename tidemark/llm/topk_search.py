"""Exact top-k search by columnar branch and bound.

Rows and queries are dealt to cells of a grid (a block of queries by a block of rows), so that a task holds one block of
each whatever the table's size. Inside a cell the rows lie in vertical layout: one array per dimension, the dimensions
with most mass first. Scores are accumulated dimension block by block; after each block a candidate stays only if its
score so far plus the most that the remaining dimensions can give (the product of the two remaining masses,
Cauchy-Schwarz) reaches the k-th best lower bound, and the columns of the surviving candidates are compacted. Each cell
sends k rows per query; a query's cells are merged by a partial top-k.

Scores are integers and exact: products are summed in doubles while they are below 2**53, else in 64-bit integers. Defined
results: vectors that are null or hold null or non-finite components take no part, and neither do those whose scores no
long could hold (as integers, a squared length of 2**62 or more), nor rows or queries without id; pairs of different lengths are not compared; rows that repeat an id all are candidates, but
none for a query of that id; empty vectors score 0; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import materialize, slim, small_batches, trim

QUERY_BLOCK, ROW_BLOCK, DIM_BLOCK = 2048, 16_384, 16
#: Queries whose first scores are in memory at once.
STRIP = 64
#: No score of two vectors whose squared lengths stay below this passes 64 bits, nor does any part of its sum.
MOST = 2.0**62
SCALE = 256


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int64).reshape(len(blobs), -1)


def search_block(q_ids, q, r_ids, r, k: int):
    """(query id, row id, score) of the k best rows of a block for each query: scores descending, ties to smaller ids.

    Up to k rows of each query whose id differs; q and r are int64 matrices of equal width."""
    n, dims = r.shape
    mass = max(np.abs(q).max(initial=0), 1) * max(np.abs(r).max(initial=0), 1) * max(dims, 1)
    kind = np.float64 if float(mass) < 2**53 else np.int64
    order = np.argsort(-(r.astype(np.float64) ** 2).sum(0), kind="stable")
    q, columns = q[:, order].astype(kind), np.ascontiguousarray(r[:, order].T.astype(kind))  # vertical: a dimension a row
    steps = [(a, min(a + DIM_BLOCK, dims)) for a in range(0, dims, DIM_BLOCK)] or [(0, 0)]
    qf, rf = q.astype(np.float64), columns.astype(np.float64)
    q_rest = [np.sqrt((qf[:, b:] ** 2).sum(1)) for _, b in steps]
    r_rest = [np.sqrt((rf[b:] ** 2).sum(0)) for _, b in steps]
    out_q, out_r, out_s = [], [], []
    for i in range(len(q)):
        if i % STRIP == 0:  # the first block for a strip of queries at once
            first = q[i : i + STRIP, : steps[0][1]] @ columns[: steps[0][1]]
        alive = np.flatnonzero(r_ids != q_ids[i])
        score = first[i % STRIP, alive]
        mine, base = columns, 0  # the survivors' columns, from dimension base on
        for t, (a, b) in enumerate(steps):
            if t:
                score = score + q[i, a:b] @ mine[a - base : b - base]
            if b >= dims or len(alive) <= k:
                if b < dims:
                    score = score + q[i, b:] @ (mine[b:, alive] if mine is columns else mine[b - base :])
                break
            reach = q_rest[t][i] * r_rest[t][alive] * (1 + 1e-9) + 1e-6
            bound = np.partition(score - reach, len(score) - k)[len(score) - k]
            keep = score + reach >= bound
            if mine is columns or keep.sum() < 0.75 * len(keep):  # compact the survivors
                alive, score = alive[keep], score[keep]
                mine, base = columns[b:, alive] if mine is columns else mine[b - base :, keep], b
        best = np.lexsort((r_ids[alive], -score))[:k]
        out_q.append(np.full(len(best), q_ids[i]))
        out_r.append(r_ids[alive][best])
        out_s.append(score[best].astype(np.int64))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_q]), np.concatenate([none, *out_r]), np.concatenate([none, *out_s])


def _cell(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    asked, rows = pdf[pdf["query"]], pdf[~pdf["query"]]
    if not len(asked) or not len(rows):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    q, r, s = search_block(asked.id.to_numpy(), _matrix(asked.vector), rows.id.to_numpy(), _matrix(rows.vector), k)
    trim()
    return pd.DataFrame({"query_id": q, "vec_id": r, "score": s})


def _to_integers(batches, scale: float):
    for pdf in batches:
        ok, out = [], []
        for i, x in zip(pdf.id, pdf.x, strict=True):
            if x is None or i is None or any(c is None for c in x):
                continue
            with np.errstate(over="ignore"):
                v = np.floor(np.asarray(x, np.float64) * scale)
                large = not (v * v).sum() < MOST
            if np.isfinite(v).all() and not large:
                ok.append(i)
                out.append(v.astype(np.int64).tobytes())
        yield pd.DataFrame({"id": np.array(ok, np.int64), "vector": out})


def top_k(rows: DataFrame, is_query, k: int = 5, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (integer inner product of floor(scale * x)) of the k best rows of each
    row for which the column expression is_query (of id_col) holds, among all rows of other ids; ties to smaller ids."""
    spark = rows.sparkSession
    small_batches(spark)
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x")).filter("id is not null")
    whole = materialize(given.mapInPandas(lambda b: slim(_to_integers(b, scale)), "id long, vector binary").withColumn("seq", F.monotonically_increasing_id()), "integers")
    whole = whole.withColumn("dim", F.octet_length("vector"))
    asked = whole.filter(is_query(F.col("id")))
    counts = whole.agg(F.count("*").alias("n"), F.count(F.when(is_query(F.col("id")), 1)).alias("q")).first()
    q_blocks, r_blocks = max(1, -(-counts.q // QUERY_BLOCK)), max(1, -(-counts.n // ROW_BLOCK))
    spread = lambda n: F.pmod(F.xxhash64("seq"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asked.select(F.lit(True).alias("query"), "id", "vector", "dim", spread(q_blocks).alias("qb"), every(r_blocks).alias("rb"))
    b = whole.select(F.lit(False).alias("query"), "id", "vector", "dim", every(q_blocks).alias("qb"), spread(r_blocks).alias("rb"))
    cells = a.unionByName(b).groupBy("dim", "qb", "rb").applyInPandas(lambda p: _cell(p, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cells.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
