"""Embedding near-dedup by an epsilon grid order join.

Vectors of cosine c or more lie, scaled to length one, within eps = sqrt(2 - 2c). The scaled vectors are turned to
principal axes (fitted on a bounded sample; any rotation gives the same links), cut into cells of width eps on the leading
axes and sorted by cell: the epsilon grid order. Intervals of that order are joined pairwise; a pair is skipped where
the bounding boxes on the leading axes, with the spread of the remaining length as one more axis, are provably
further apart than eps. A task that joins two intervals halves them and skips again, down to leaves that one matrix
product in double precision compares.

Identical vectors meet as one class with its number of copies. A pair of intervals sends back each class's number of
links and a forest of the links it found, never the links themselves, so a large group of copies or near copies gives rows
in proportion to its vectors.

Defined results: a null or zero vector, or one that holds null or non-finite components, has no links and is its own
component; vectors of different lengths never link; rows that repeat an id are one vector each, a component being named
by the smallest id; a null id takes part but never names a component (its own, if alone, is null); extra columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import NULL_ID, fair_join, id_of, materialize, n_partitions, slim, small_batches, trim
from tidemark.llm.components import connected_components, forest

#: Vectors sampled to fit the axes; vectors in an interval; vectors in a leaf; leading axes of boxes; of the grid.
SAMPLE, INTERVAL, LEAF, AXES, GRID = 4096, 8192, 512, 12, 6


def _decoded(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest component, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _axes(sample: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(np.atleast_2d(np.cov(sample.T)) if len(sample) > 1 else np.eye(sample.shape[1]))
    return vectors[:, ::-1]


def _boxed(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates for bounding boxes: the leading axes and the length of the rest. Distances only shrink."""
    y = u @ axes
    return np.hstack((y[:, :AXES], np.sqrt((y[:, AXES:] ** 2).sum(1, keepdims=True))))


def _gap(a, b) -> float:
    """The square of the least distance of two boxes (low, high)."""
    d = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float((d * d).sum())


class _Side:
    """An interval of the grid order: unit vectors, their classes, copies and box coordinates."""

    def __init__(self, pdf: pd.DataFrame, axes: np.ndarray, eps: float):
        u = unit(_decoded(pdf.vector))
        box = _boxed(u, axes)
        order = np.lexsort(np.floor(box[:, :GRID] / eps).T[::-1])
        self.u, self.box = u[order], box[order]
        self.rep, self.n = pdf.rep.to_numpy()[order], pdf.n.to_numpy()[order]
        self.links = np.zeros(len(u), np.int64)

    def bounds(self, a: int, b: int):
        part = self.box[a:b]
        return part.min(0), part.max(0)


def _join(x: _Side, y: _Side, same: bool, threshold: float, limit: float, out: list) -> None:
    """Join two intervals (or one with itself) recursively."""
    stack = [(0, len(x.u), 0, len(y.u))]
    while stack:
        a, b, c, d = stack.pop()
        if a >= b or c >= d or same and a > c or _gap(x.bounds(a, b), y.bounds(c, d)) > limit:
            continue
        if b - a > LEAF or d - c > LEAF:
            m, k = (a + b) // 2, (c + d) // 2
            if same and (a, b) == (c, d):
                stack += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
            else:
                stack += [(i, j, p, q) for i, j in ((a, m), (m, b)) for p, q in ((c, k), (k, d))]
            continue
        s = x.u[a:b] @ y.u[c:d].T
        hit = s >= threshold
        if same and (a, b) == (c, d):
            np.fill_diagonal(hit, False)
            x.links[a:b] += hit @ y.n[c:d]
            hit = np.triu(hit)
        else:
            x.links[a:b] += hit @ y.n[c:d]
            y.links[c:d] += x.n[a:b] @ hit
        i, j = np.nonzero(hit)
        if len(i):
            out.append(forest(x.rep[a:b][i], y.rep[c:d][j]))


def _cell(pdf: pd.DataFrame, axes: dict[int, np.ndarray], threshold: float) -> pd.DataFrame:
    """A pair of intervals (left, right): links of each class, and edges of a forest."""
    one = pdf.iloc[0]
    eps2 = max(0.0, 2 - 2 * threshold)
    turn, eps = axes[int(one.dim)], max(np.sqrt(eps2), 1e-9)
    left = _Side(pdf[pdf.part == one.left], turn, eps)
    same = one.left == one.right
    right = left if same else _Side(pdf[pdf.part == one.right], turn, eps)
    edges: list = []
    _join(left, right, same, threshold, eps2 + 1e-9, edges)
    rows = []
    for side in (left,) if same else (left, right):
        hit = side.links > 0
        rows.append(pd.DataFrame({"u": side.rep[hit], "v": side.rep[hit], "links": side.links[hit]}))
    if edges:
        u, v = forest(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
        rows.append(pd.DataFrame({"u": u, "v": v, "links": 0}))
    trim()
    return pd.concat(rows, ignore_index=True)


def classes_of(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(key, vector binary or null) of each row as a written table, and its classes (cls, vector, n, rep) of equal valid vectors."""
    x = F.col("_x")
    usable = F.coalesce(F.exists(x, lambda c: c != 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"), F.col(vec_col).cast("array<double>").alias("_x"))
    rows = rows.select("key", F.when(usable, F.transform(x, lambda c: c + F.lit(0.0))).alias("_x"))  # -0.0 and 0.0 are one
    flat = materialize(rows.mapInPandas(lambda b: slim(_flatten(b)), "key long, vector binary"), "vectors")
    rep = F.min(F.when(F.col("key") != NULL_ID, F.col("key")))
    classes = flat.filter("vector is not null").groupBy("vector").agg(F.count("*").alias("n"), rep.alias("rep"))
    classes = classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("dim", (F.octet_length("vector") / 8).cast("int"))
    return flat, materialize(classes, "classes")


def _flatten(batches):
    for pdf in batches:
        yield pd.DataFrame({"key": pdf["key"], "vector": [None if x is None else np.asarray(x, np.float64).tobytes() for x in pdf["_x"]]})


def _number(batches):
    from pyspark import TaskContext

    pid, at, dim = TaskContext.get().partitionId(), 0, None
    for pdf in batches:
        for d, block in pdf.groupby("dim"):
            at, dim = (at, dim) if d == dim else (0, d)
            yield block.assign(pid=pid, at=np.arange(at, at + len(block)))[["pid", "at", "dim", "cls", "vector", "n", "box"]]
            at += len(block)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id_col, n_links (vectors of cosine >= threshold, itself not counted), component_id (smallest id reachable) and kept
    (whether this row's id is the component's) of every row."""
    small_batches(vectors.sparkSession)
    flat, classes = classes_of(vectors, id_col, vec_col)
    sizes = {r.dim: r["count"] for r in classes.groupBy("dim").count().collect()}  # one row per vector length
    axes = {}
    for dim in sizes:
        sample = classes.filter(F.col("dim") == dim).orderBy(F.xxhash64("vector")).limit(SAMPLE).toPandas()
        axes[dim] = _axes(unit(_decoded(sample.vector)))
    eps = max(np.sqrt(max(0.0, 2 - 2 * threshold)), 1e-9)

    def place(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                box = _boxed(unit(_decoded(part.vector)), axes[dim])
                cell = np.floor(box[:, : min(GRID, box.shape[1])] / eps).clip(-30_000, 30_000).astype(np.int64) + 32_768
                yield pd.DataFrame({"dim": part.dim, "grid": [row.astype(">u2").tobytes() for row in cell], "cls": part.cls, "vector": part.vector, "n": part.n, "box": list(box)})

    cells = classes.mapInPandas(place, "dim int, grid binary, cls long, vector binary, n long, box array<double>")
    total = sum(sizes.values())
    parts = max(1, -(-total // INTERVAL))
    # the order: range partitions, and in each the rows' numbers by vector length; with the partitions' counts (one
    # row per partition and length on the driver) these give the intervals
    ordered = cells.repartitionByRange(parts, "dim", "grid", "cls").sortWithinPartitions("dim", "grid", "cls")
    schema = "pid int, at long, dim int, cls long, vector binary, n long, box array<double>"
    numbered = materialize(ordered.mapInPandas(_number, schema), "ordered")
    seen: dict[int, int] = {}
    offsets = []
    for r in numbered.groupBy("dim", "pid").count().orderBy("dim", "pid").collect():
        offsets.append((r.dim, r.pid, seen.get(r.dim, 0)))
        seen[r.dim] = seen.get(r.dim, 0) + r["count"]
    spark = vectors.sparkSession
    before = spark.createDataFrame(offsets, "dim int, pid int, before long")
    part = F.col("dim").cast("long") * F.lit(2**32) + F.floor((F.col("before") + F.col("at")) / INTERVAL)
    placed = numbered.join(F.broadcast(before), ["dim", "pid"]).select(part.alias("part"), "dim", "cls", "vector", "n", "box")
    # bounding boxes of intervals; pairs of them that are not provably distant
    size = AXES + 1
    low = [F.min(F.get("box", F.lit(i))).alias(f"l{i}") for i in range(size)]
    high = [F.max(F.get("box", F.lit(i))).alias(f"h{i}") for i in range(size)]
    boxes = placed.groupBy("dim", "part").agg(*low, *high)
    apart = [F.greatest(F.lit(0.0), F.col(f"a.l{i}") - F.col(f"b.h{i}"), F.col(f"b.l{i}") - F.col(f"a.h{i}")) for i in range(size)]
    gap = F.coalesce(sum((x * x for x in apart[1:]), apart[0] * apart[0]), F.lit(0.0))
    salts = min(n_partitions(spark), parts)  # the list of pairs is made by as many tasks
    one = boxes.withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(salts))).alias("a")
    two = boxes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).alias("b")
    near = (F.col("a.dim") == F.col("b.dim")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.part") <= F.col("b.part")) & (gap <= float(eps * eps + 1e-9))
    pairs = one.join(two, near)
    pairs = materialize(pairs.select(F.col("a.part").alias("left"), F.col("b.part").alias("right")), "pairs")
    wanted = pairs.select("left", "right", F.col("left").alias("part")).union(pairs.filter("left <> right").select("left", "right", F.col("right").alias("part")))
    joined = placed.select("part", "dim", F.col("cls").alias("rep"), "vector", "n").join(wanted, "part")
    joined = joined.repartition(n_partitions(spark), "left", "right")
    found = materialize(joined.groupBy("left", "right").applyInPandas(lambda p: _cell(p, axes, threshold), "u long, v long, links long"), "links")
    roots = connected_components(found.filter("u <> v").select("u", "v"))
    links = found.filter("links > 0").groupBy("u").agg(F.sum("links").alias("links"))
    named = classes.join(links, classes.cls == links.u, "left").join(roots, classes.cls == roots.node, "left")
    named = named.select("vector", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(least, "root").join(classes.select("vector", F.col("n").alias("_n")), "vector").select("vector", "n_links", "component_id", "_n"), "named-classes")
    # a vector that many rows have is broadcast to them; those without a usable one join nothing
    out = fair_join(flat.filter("vector is not null"), named, ["vector"], "inner", flat.count())
    out = out.unionByName(flat.filter("vector is null"), allowMissingColumns=True)
    alone = F.when(F.col("vector").isNull(), id_of("key")).otherwise(F.col("component_id"))
    return out.select(id_of("key").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), alone.alias("component_id"), F.coalesce(alone.eqNullSafe(id_of("key")) & (F.col("key") != NULL_ID), F.lit(False)).alias("kept"))
