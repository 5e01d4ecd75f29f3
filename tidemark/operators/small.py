"""Labels, exactly-once accounting, generators, folds and concurrent actions."""

from __future__ import annotations

import threading
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import udtf


def label(code: Column, names: list[tuple[int, str]]) -> Column:
    """A code's name (the first of aliases), or the code as text."""
    first: dict[int, str] = {}
    for k, v in names:
        first.setdefault(k, v)
    table = F.create_map(*[F.lit(x) for kv in first.items() for x in kv]) if first else F.create_map()
    return F.coalesce(F.try_element_at(table, code), code.cast("string"))


def defined(code: Column, names: list[tuple[int, str]]) -> Column:
    return code.isin(sorted({k for k, _ in names}))


def size_class(size: Column, classes: int = 16, least: int = 32) -> Column:
    """The log2 bucket of a size: 0 below least, doubling from there, capped."""
    units = F.floor(size / least).cast("long")
    return F.when(units <= 0, 0).otherwise(F.least(F.lit(classes - 1), F.length(F.bin(units)))).cast("int")


def exactly_once(done: DataFrame, id_col: str, expected: DataFrame) -> DataFrame:
    """One row: total, repeated and missing ids of done against expected (one column of the same name)."""
    per = done.groupBy(id_col).count()
    found = per.agg(F.sum("count").cast("long").alias("total"), F.coalesce(F.sum((F.col("count") > 1).cast("long")), F.lit(0)).alias("repeated"))
    missing = expected.join(per, id_col, "left_anti").agg(F.count("*").alias("missing"))
    return found.crossJoin(missing)  # one row each


@udtf(returnType=T.StructType([T.StructField("value", T.LongType())]))
class Counter:
    """Rows 0 to n - 1, one by one: a generator."""

    def eval(self, n: int):
        yield from ((i,) for i in range(n or 0))


def generator_rows(spark: SparkSession, n: int) -> DataFrame:
    return Counter(F.lit(n))


def fold(values: Column, step, start: Column) -> Column:
    """A receive-and-send loop over an array: step(state, value)."""
    return F.aggregate(values, start, step)


def gather(actions: list, threads: int = 4) -> list:
    """Run Spark actions concurrently; results in order, or the first failure."""
    with ThreadPoolExecutor(max(1, threads)) as pool:
        futures: list[Future] = [pool.submit(a) for a in actions]
        for f in futures:
            f.exception() and wait(futures)
        return [f.result() for f in futures]


def first_completed(actions: list, threads: int = 4):
    """The outcome of whichever action ends first."""
    pool = ThreadPoolExecutor(max(1, threads))
    try:
        done, _ = wait([pool.submit(a) for a in actions], return_when=FIRST_COMPLETED)
        return next(iter(done)).result()
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


class Pool:
    """Actions on a bounded number of threads. A task may submit tasks: they run at once, in its own thread, so that waiting
    for them cannot use up the threads."""

    def __init__(self, threads: int = 4):
        self.size = max(1, threads)
        self._pool = ThreadPoolExecutor(self.size)
        self._open: set[Future] = set()
        self._lock, self._inside = threading.Lock(), threading.local()

    def submit(self, action, *args) -> Future:
        if getattr(self._inside, "yes", False):
            done: Future = Future()
            try:
                done.set_result(action(*args))
            except Exception as e:
                done.set_exception(e)
            return done

        def run():
            self._inside.yes = True
            return action(*args)

        with self._lock:
            f = self._pool.submit(run)
            self._open.add(f)
        f.add_done_callback(self._open.discard)
        return f

    def wait_idle(self) -> None:
        while self._open:
            wait(list(self._open))

    def close(self) -> None:
        self._pool.shutdown()


def map_partitions(df: DataFrame, function, schema: str) -> DataFrame:
    """function(pandas frame) -> pandas frame over bounded batches of rows, on the executors."""
    return df.mapInPandas(lambda frames: (function(f) for f in frames), schema)
