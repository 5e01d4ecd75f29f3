"""Conflict-free counters, sets and sequences as tables whose merges commute, associate and are idempotent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def counter_merge(*states: DataFrame) -> DataFrame:
    """Counters (counter, replica, p, n): the highest count of each replica."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy("counter", "replica").agg(F.max("p").alias("p"), F.max("n").alias("n"))


def counter_value(state: DataFrame) -> DataFrame:
    return state.groupBy("counter").agg((F.sum("p") - F.sum("n")).alias("value"))


def checked_increment(amount):
    """A grow-only counter's increment; a negative one is an error when it is read."""
    return F.when(amount < 0, F.raise_error(F.lit("a grow-only counter cannot shrink")).cast("long")).otherwise(amount)


def set_merge(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Observed-remove sets (adds(element, tag), removed(tag)): unions."""
    return a[0].unionByName(b[0]).distinct(), a[1].unionByName(b[1]).distinct()


def set_values(adds: DataFrame, removed: DataFrame) -> DataFrame:
    """Elements with a tag that is not retired, in order."""
    return adds.join(removed, "tag", "left_anti").select("element").distinct().orderBy("element")


def set_add(adds: DataFrame, elements: DataFrame, replica: str) -> DataFrame:
    """adds with a fresh tag (replica:number) for each element; numbers go on above the replica's highest."""
    mine = F.split("tag", ":")
    used = adds.filter(F.element_at(mine, 1) == replica).agg(F.max(F.element_at(mine, 2).cast("long"))).first()[0]
    tag = F.concat(F.lit(f"{replica}:"), (F.monotonically_increasing_id() + F.lit((used or 0) + 1)).cast("string"))
    return adds.unionByName(elements.select("element", tag.alias("tag")))


def set_remove(adds: DataFrame, removed: DataFrame, elements: DataFrame) -> DataFrame:
    """removed with all tags observed of the elements: what is added later, or unseen elsewhere, stays."""
    return removed.unionByName(adds.join(elements.select("element").distinct(), "element", "left_semi").select("tag")).distinct()


def equal(a: DataFrame, b: DataFrame) -> bool:
    return not a.exceptAll(b).head(1) and not b.exceptAll(a).head(1)


# Sequences: ops (doc, type, c, r, after, target, value); a node's key is c:r, the root ''.

_ORDERED = "doc long, key string, parent string, value string, pos long, deleted boolean, pending boolean"


def _preorder(doc: int, ops: list[tuple]) -> Iterator[tuple]:
    """One document's nodes in preorder, from its ops (type, c, r, after, target, value); siblings by clock, then replica,
    both descending. Nodes whose ancestors are missing are pending. An explicit stack, since typing makes trees as deep
    as the text."""
    nodes: dict[tuple[int, str], tuple[str, str]] = {}
    gone: set[str] = set()
    for kind, c, r, after, target, value in ops:
        if kind == "ins":
            nodes.setdefault((c, r), (after or "", value))
        elif kind == "del":
            gone.add(target)
    children: dict[str, list[tuple[int, str]]] = {}
    for node in sorted(nodes):
        children.setdefault(nodes[node][0], []).append(node)
    seen: set[tuple[int, str]] = set()
    stack, pos = list(children.get("", ())), 0
    while stack:
        node = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        key = f"{node[0]}:{node[1]}"
        dead = key in gone
        yield doc, key, *nodes[node], None if dead else pos, dead, False
        pos += not dead
        stack += children.get(key, ())
    for node, found in nodes.items():
        if node not in seen:
            key = f"{node[0]}:{node[1]}"
            yield doc, key, *found, None, key in gone, True


def _ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents whose ops follow each other; many of them leave in one frame."""
    columns = [c.split()[0] for c in _ORDERED.split(", ")]
    rows: list[tuple] = []

    def frame() -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns).astype({"pos": "Int64", "doc": "int64"})
        rows.clear()
        return out

    doc, ops = None, []
    for pdf in batches:
        clocks = [None if pd.isna(c) else int(c) for c in pdf.c]
        cells = (pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("type", "r", "after", "target", "value"))
        for d, c, kind, r, after, target, value in zip(pdf.doc.tolist(), clocks, *cells, strict=True):
            if d != doc:
                rows += _preorder(doc, ops)
                doc, ops = d, []
                if len(rows) > 20_000:
                    yield frame()
            ops.append((kind, c, r, after, target, value))
    rows += _preorder(doc, ops)
    yield frame()


def sequence_order(ops: DataFrame) -> DataFrame:
    """Every node with its place among the visible ones (null if deleted or pending). A document's ops are read together:
    its order is one walk, and documents are bounded by what a person types; a task walks many documents, one after another."""
    rows = ops.filter("doc is not null").select("doc", "type", "c", "r", "after", "target", "value")
    n = int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "doc").sortWithinPartitions("doc").mapInPandas(_ordered, _ORDERED)


def sequence_text(ops: DataFrame, separator: str = "") -> DataFrame:
    seen = sequence_order(ops).filter("pos is not null").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("x"))
    return seen.select("doc", F.array_join(F.transform("x", lambda p: p["value"]), separator).alias("text"))


def insert_at(ops: DataFrame, doc: int, index: int, replica: str, value: str) -> dict:
    """The op that inserts value at a place of a document (<= 0: first), with the next clock."""
    mine = ops.filter(F.col("doc") == doc)
    clock = mine.agg(F.max("c")).first()[0] or 0
    after = ""
    if index > 0:
        row = sequence_order(mine).filter(F.col("pos") == index - 1).head()
        after = row.key if row else ""
    return {"doc": doc, "type": "ins", "c": clock + 1, "r": replica, "after": after, "target": None, "value": value}


def delete_at(ops: DataFrame, doc: int, index: int) -> dict | None:
    """The op that deletes the node at a place, or None out of range."""
    row = sequence_order(ops.filter(F.col("doc") == doc)).filter(F.col("pos") == index).head()
    return row and {"doc": doc, "type": "del", "c": None, "r": None, "after": None, "target": row.key, "value": None}
