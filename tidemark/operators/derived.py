"""Derived tables that know when they are out of date.

A Source holds a table and a version. A Derived is a function of sources and other deriveds: it runs when it is first read and
again only after something that it depends on has changed, keeps its rows cached in between, and cannot be written to. What
its function reads through snapshot() is not a dependency. An Effect runs an action after changes, at most once for each
flush(), and its cleanup before the next run and when it is disposed of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Stats:
    """How often deriveds and effects have been run, by name."""

    def __init__(self):
        self.computations: dict[str, int] = {}

    def count(self, name: str) -> None:
        self.computations[name] = self.computations.get(name, 0) + 1


class Source:
    def __init__(self, table: DataFrame):
        self._table, self._version = table, 0

    def read(self) -> DataFrame:
        return self._table

    def write(self, table: DataFrame) -> None:
        """Another table; the same plan again changes nothing."""
        if not table.sameSemantics(self._table):
            self._table, self._version = table, self._version + 1

    def state(self) -> tuple:
        return (self._version,)


class Derived:
    def __init__(self, run: Callable[..., DataFrame], *inputs: Source | Derived, name: str = "derived", stats: Stats | None = None):
        self._run, self._inputs, self._name, self._stats = run, inputs, name, stats
        self._seen: tuple | None = None
        self._table: DataFrame | None = None

    def state(self) -> tuple:
        return tuple(x.state() for x in self._inputs)

    def read(self) -> DataFrame:
        now = self.state()
        if self._table is None or now != self._seen:
            self.release()
            if self._stats:
                self._stats.count(self._name)
            self._table, self._seen = self._run(*(x.read() for x in self._inputs)).cache(), now
        return self._table

    def release(self) -> None:
        """Give up the cached rows; the next read computes them again."""
        if self._table is not None:
            self._table.unpersist()
            self._table = None


def snapshot(node: Source | Derived) -> DataFrame:
    """A node's table as it is now, for joins that shall not follow its later changes."""
    return node.read()


class Effect:
    """run(tables of the inputs...) may return a cleanup, a function without arguments."""

    def __init__(self, run: Callable, *inputs: Source | Derived, name: str = "effect", stats: Stats | None = None):
        self._run, self._inputs, self._name, self._stats = run, inputs, name, stats
        self._seen: tuple | None = None
        self._cleanup: Callable[[], None] | None = None
        self._done = False
        self.flush()

    def flush(self) -> bool:
        """Run if an input has changed since the last run, however often; whether it ran."""
        now = tuple(x.state() for x in self._inputs)
        if self._done or now == self._seen:
            return False
        self._clean()
        if self._stats:
            self._stats.count(self._name)
        self._seen = now
        self._cleanup = self._run(*(x.read() for x in self._inputs))
        return True

    def _clean(self) -> None:
        cleanup, self._cleanup = self._cleanup, None
        if cleanup:
            cleanup()

    def dispose(self) -> None:
        self._clean()
        self._done = True
