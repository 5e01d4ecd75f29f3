"""Streaming forms: change-suppressed values, effects per micro-batch, and causal delivery of sequence ops."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPS = "doc long, type string, c long, r string, after string, target string, value string"


class Running:
    """A started effect. stop() ends the query and runs the cleanup of its last batch."""

    def __init__(self, query, cleanups: list):
        self.query, self._cleanups = query, cleanups

    def awaitTermination(self, timeout: float | None = None):
        return self.query.awaitTermination(timeout) if timeout else self.query.awaitTermination()

    def stop(self) -> None:
        self.query.stop()
        _clean(self._cleanups)


def _clean(cleanups: list) -> None:
    while cleanups:
        cleanups.pop()()


def effect(stream: DataFrame, run, checkpoint: str, **trigger) -> Running:
    """Start a query that calls run(batch DataFrame, batch id) for every micro-batch. What run returns, if anything, is called
    before the next batch and at stop()."""
    cleanups: list = []

    def batch(df: DataFrame, number: int) -> None:
        _clean(cleanups)
        cleanup = run(df, number)
        if callable(cleanup):
            cleanups.append(cleanup)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return Running(writer.trigger(**(trigger or {"availableNow": True})).start(), cleanups)


def with_snapshot(stream: DataFrame, table: DataFrame, on: str, how: str = "left") -> DataFrame:
    """A stream joined to a table as it stands when the query starts: changes of the table are not followed."""
    return stream.join(table, on, how)


def last_per_batch(key: str, seq: str, value: str, sink):
    """An effect that hands sink one row per key and batch: writes inside a batch are coalesced."""

    def run(batch: DataFrame, number: int) -> None:
        sink(batch.groupBy(key).agg(F.max_by(value, seq).alias(value)), number)

    return run


def _changed(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known, old = state.get if state.exists else (False, None)
    pdf = pd.concat(list(frames)).sort_values("seq")
    out = []
    for seq, value in zip(pdf.seq, pdf.value, strict=True):
        value = None if pd.isna(value) else float(value)
        if not known or value != old:
            out.append((key[0], int(seq), value))
        known, old = True, value
    state.update((known, old))
    yield pd.DataFrame(out, columns=["node", "seq", "value"])


def changes(stream: DataFrame) -> DataFrame:
    """Of a stream (node long, seq long, value double), in order by batch, the writes that change a node's value."""
    return stream.groupBy("node").applyInPandasWithState(_changed, "node long, seq long, value double", "known boolean, old double", "append", GroupStateTimeout.NoTimeout)


def _deliver(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Ops leave when what they refer to has left; repeats leave once. State: keys delivered, ops waiting."""
    done, waiting = state.get if state.exists else ([], [])
    done, waiting = set(done), [tuple(x) for x in waiting]
    for pdf in frames:
        pdf = pdf.astype(object).where(pdf.notna(), None)
        waiting += [tuple(None if v is None else str(v) for v in r) for r in zip(pdf.type, pdf.c, pdf.r, pdf.after, pdf.target, pdf.value, strict=True)]
    out, moved = [], True
    while moved:
        moved, left = False, []
        for op in waiting:
            kind, c, r, after, target, _ = op
            name = f"{int(float(c))}:{r}" if kind == "ins" else f"-{target}"
            if name in done:
                continue
            need = after if kind == "ins" else target
            if need in (None, "") or need in done:
                done.add(name)
                out.append(op)
                moved = True
            else:
                left.append(op)
        waiting = left
    state.update((sorted(done), [list(x) for x in waiting]))
    rows = [(key[0], t, None if c is None else int(float(c)), r, a, g, v) for t, c, r, a, g, v in out]
    result = pd.DataFrame(rows, columns=["doc", "type", "c", "r", "after", "target", "value"])
    yield result.astype({"c": "Int64", "doc": "int64"})


def causal(stream: DataFrame) -> DataFrame:
    """A stream of sequence ops (OPS) in causal order: late parents release what waited for them."""
    return stream.groupBy("doc").applyInPandasWithState(_deliver, OPS, "done array<string>, waiting array<array<string>>", "append", GroupStateTimeout.NoTimeout)
