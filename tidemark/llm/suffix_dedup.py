"""Exact removal of repeated byte strings by a logarithmic family of (sampled) suffix arrays.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier: in a document with a smaller id, or earlier
in the same document. Strings are judged on the input.

Not every suffix is indexed. Of the windows of LENGTH bytes, each owns one suffix: the one whose first SEED bytes have the
least hash in the window. Equal windows own suffixes at the same place, so equal windows meet at equal suffixes, and about
one suffix in 35 is indexed. The windows of one suffix are consecutive; together they are its context.

1. Each scan task samples the suffixes of bounded chunks of documents. Copies are put together first: of contexts that are
   equal as a whole only the first goes on (in a chunk, then in all), later ones are repeats already. Suffixes whose first
   SEED bytes stand nowhere else are dropped.
2. What remains gets its bytes and is dealt by seed. A part takes its suffixes in batches, in document order. Each
   batch becomes a suffix array (sorted by the bytes that follow, with a second array sorted by those that precede, backwards).
   It is merge-scanned against the existing levels: the longest common extensions of neighbours, ahead and behind, put
   windows into classes, and a window of a class that has an earlier one is a repeat. Then the batch becomes a level, and
   levels of about equal size are merged, linearly.
3. Seeds with more than a part's fair share of the suffixes (a common phrase with many surroundings) would fill one part:
   their windows are compared one by one by hash, in partially aggregated groups. See _hot.
4. Each document's repeated strings are merged, cut out and digested.

The suffix arrays compare bytes; contexts (1) and windows of hot seeds (3) are compared by two hashes of 64 bits. Defined
results: a null text is empty; rows that repeat an id follow each other as parts of one document, ordered by text, matches
not crossing them; a null id sorts first; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import CHUNK_BYTES, Rolling, chunks, fair_join, id_of, keyed, materialize, mix64, n_partitions, prime_from, slim, trim

LENGTH, SEED = 100, 32
#: Suffixes in a batch; bytes of text in a bucket of documents; suffixes in a part of step 2.
BATCH, BUCKET_BYTES, CANDIDATES = 4096, 3_000_000, 10_000
_ORD = 40  # a position is the row's number among those of its id, shifted by this, plus the place in its text
_INDEX = "seed long, context long, key long, pos long, extent int, often boolean"
def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def sampled(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH):
    """(seed hash, context hash, document, low, high, place) of the indexed suffixes of the documents in data: the
    suffix starts at place and owns the windows that start at low to high."""
    size = np.diff(bounds)
    count = np.maximum(0, size - length + 1)
    n = len(data)
    if not count.sum():
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    doc = np.repeat(np.arange(len(size)), count)
    first = _bounds(count)[:-1]
    window = np.arange(int(count.sum())) + np.repeat(bounds[:-1] - first, count)
    one = Rolling(data, 0)
    at = np.arange(n - SEED + 1)
    seed = mix64(one.of(at, at + SEED))
    mask = np.uint64((1 << n.bit_length()) - 1)
    low = (seed & ~mask) | at.astype(np.uint64)  # ties go to the leftmost
    width, step = length - SEED + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    place = (low[window] & mask).astype(np.int64)
    del low
    start = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1))))
    stop = np.append(start[1:], len(window)) - 1
    lo, hi, place, doc = window[start], window[stop], place[start], doc[start]
    shape = ((place - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64)
    context = mix64(Rolling(data, 1).of(lo, hi + length) ^ mix64(shape))
    return seed[place], context, doc, lo, hi, place


def _index(batches: Iterator[pd.DataFrame], length: int, shares: int) -> Iterator[pd.DataFrame]:
    """Rows of _INDEX: first occurrences of contexts in a chunk; repeats in it have extent < 0. often: the seed has more
    than one in 2 * shares of the chunk's rows."""
    for rows in chunks(batches, lambda r: len(r[2]), CHUNK_BYTES // 4):
        rows.sort(key=lambda r: (r[0], r[1]))  # so documents are numbered in order
        key, order = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
        bounds = _bounds(np.fromiter((len(r[2]) for r in rows), np.int64, len(rows)))
        data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        seed, context, doc, lo, hi, _ = sampled(data, bounds, length)
        by = np.lexsort((lo, context, seed))
        again = np.zeros(len(by), bool)
        again[by[1:]] = (seed[by[1:]] == seed[by[:-1]]) & (context[by[1:]] == context[by[:-1]])
        extent = (hi - lo + length).astype(np.int32)
        pos = (order[doc] << _ORD) + lo - bounds[doc]
        of, count = np.unique(seed[~again], return_inverse=True, return_counts=True)[1:]
        often = np.zeros(len(by), bool)
        often[~again] = (count * 2 * shares > len(of))[of]
        yield pd.DataFrame({"seed": seed.view(np.int64), "context": context.view(np.int64), "key": key[doc], "pos": pos, "extent": np.where(again, -extent, extent), "often": often})


def _hot(firsts: DataFrame, shares: int) -> DataFrame:
    """The seeds (at most 2 * shares) with more than one in 2 * shares of all rows among the rows marked often.

    All seeds with more than one in shares of the rows are there: where they are not marked, they have at most half of
    that. So only marked rows need to be counted."""
    total = firsts.count()
    return firsts.filter("often").groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") * 2 * shares > total).select("seed", F.lit(True).alias("hot"))


def _scan_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the rows of whole seeds: (key, pos, extent, seed, again). again: repeats of an earlier context; the others are first of
    their context and share their seed with another context. Suffixes that stand alone leave here."""
    rows = pdf.sort_values(["seed", "context", "key", "pos"], ignore_index=True)
    seed, context = rows.seed.to_numpy(), rows.context.to_numpy()
    same = seed[1:] == seed[:-1]
    again = np.concatenate(([False], same & (context[1:] == context[:-1])))[: len(rows)]
    other = same & (context[1:] != context[:-1])
    # a seed with a second context, somewhere in its run
    of = np.cumsum(np.concatenate(([0], ~same)))[: len(rows)]
    several = np.bincount(of, np.concatenate(([0], other))[: len(rows)], minlength=1)[of] > 0
    out = rows.loc[again | several, ["key", "pos", "extent", "seed"]].assign(again=again[again | several])
    trim()
    return out


# ---- suffix arrays


def lcp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes the rows of two matrices have in common."""
    wrong = a != b
    return np.where(wrong.any(1), wrong.argmax(1), a.shape[1])


class Suffixes:
    """Suffixes in the order of the bytes that follow them: ahead (from the suffix on) and behind (before it, backwards), as
    fixed strings of bytes; low and high, how far before the suffix its windows start; number, its place in the part's
    order of documents."""

    def __init__(self, ahead: np.ndarray, behind: np.ndarray, low: np.ndarray, high: np.ndarray, number: np.ndarray):
        self.ahead, self.behind, self.low, self.high, self.number = ahead, behind, low, high, number

    def __len__(self) -> int:
        return len(self.number)

    def take(self, index: np.ndarray) -> Suffixes:
        return Suffixes(self.ahead[index], self.behind[index], self.low[index], self.high[index], self.number[index])

    @classmethod
    def sorted(cls, texts: list[bytes], high: np.ndarray, number: np.ndarray, length: int) -> Suffixes:
        """A batch's suffix array. texts: contexts; high: where in them the suffix is."""
        width = length - SEED
        # a last byte that is not zero, since fixed strings are compared without zeros at their ends
        ahead = np.array([t[h:].ljust(length, b"\0") + b"\1" for t, h in zip(texts, high.tolist(), strict=True)], f"S{length + 1}")
        behind = np.array([t[:h][::-1].ljust(width, b"\0") + b"\1" for t, h in zip(texts, high.tolist(), strict=True)], f"S{width + 1}")
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        return cls(ahead, behind, high - (size - length), high, number).take(np.argsort(ahead, kind="stable"))

    def merge(self, other: Suffixes) -> Suffixes:
        """One array of two, linearly."""
        at = np.searchsorted(self.ahead, other.ahead, "right")
        index = np.insert(np.arange(len(self)), at, len(self) + np.arange(len(other)))
        both = (np.concatenate(x) for x in ((self.ahead, other.ahead), (self.behind, other.behind), (self.low, other.low), (self.high, other.high), (self.number, other.number)))
        return Suffixes(*both).take(index)


def _bytes(fixed: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(fixed).view(np.uint8).reshape(len(fixed), fixed.itemsize)[:, :-1]


def repeated_windows(level: Suffixes | None, batch: Suffixes, first: int, length: int) -> np.ndarray:
    """(suffix, how far before it a window starts) of the batch, numbered from first: whether the window stands earlier, in the
    level or in the batch."""
    width = length - SEED
    out = np.zeros((len(batch), width + 1), bool)
    s = level.merge(batch) if level is not None else batch
    if len(s) < 2:
        return out
    text = _bytes(s.ahead)
    common = lcp(text[:-1], text[1:])
    # neighbours with a seed in common; stretches of them that have a suffix of the batch
    of = np.cumsum(np.concatenate(([0], common < SEED)))
    size, new = np.bincount(of), np.bincount(of, s.number >= first)
    keep = np.flatnonzero((size[of] > 1) & (new[of] > 0))
    if not len(keep):
        return out
    common = np.where(of[keep[1:]] == of[keep[:-1]], common[keep[1:] - 1], 0)
    s = s.take(keep)
    order = np.argsort(s.behind, kind="stable")
    text = _bytes(s.behind[order])
    before = lcp(text[:-1], text[1:])
    left = np.empty(len(s), np.int64)
    for k in range(width + 1):
        here = np.flatnonzero((s.low <= k) & (k <= s.high))
        if len(here) < 2:
            continue
        # a window is equal to another where k bytes before and length - k after the suffix are
        right = np.cumsum(np.concatenate(([0], common < length - k)))
        left[order] = np.cumsum(np.concatenate(([0], before < k)))
        kind = right[here] * len(s) + left[here]
        by = np.lexsort((s.number[here], kind))
        again = here[by[1:][kind[by[1:]] == kind[by[:-1]]]]
        number = s.number[again]
        out[number[number >= first] - first, k] = True
    return out


class LogFamily:
    """Suffix arrays whose sizes shrink geometrically. add() takes the next batch and returns its repeated windows."""

    def __init__(self, length: int = LENGTH):
        self.levels: list[Suffixes] = []
        self.length, self.next = length, 0

    def add(self, texts: list[bytes], high: np.ndarray) -> np.ndarray:
        """(suffix in the order given, how far before it a window starts): whether the window stands earlier."""
        first, self.next = self.next, self.next + len(texts)
        batch = Suffixes.sorted(texts, high, np.arange(first, self.next), self.length)
        found = repeated_windows(None, batch, first, self.length)
        for level in self.levels:
            found |= repeated_windows(level, batch, first, self.length)
        # a suffix whose windows all stand earlier adds nothing
        known = found.sum(1)[batch.number - first] == batch.high - batch.low + 1
        self.levels.append(batch.take(np.flatnonzero(~known)))
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            last = self.levels.pop()
            self.levels.append(self.levels.pop().merge(last))
        return found


def _match_part(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """(key, pos, extent) of the repeated strings among the contexts (key, pos, at, bytes) of a part."""
    rows = pdf.sort_values(["key", "pos"], ignore_index=True)
    family, out = LogFamily(length), []
    none = np.zeros((1, 1), bool)
    for a in range(0, len(rows), BATCH):
        part = rows.iloc[a : a + BATCH]
        high = part["at"].to_numpy().astype(np.int64)
        found = family.add(part.bytes.tolist(), high)
        # neighbouring windows make one string: from the one that starts furthest before the suffix
        edge = np.broadcast_to(none, (len(found), 1))
        row, near = np.nonzero(found & ~np.hstack((edge, found[:, :-1])))
        _, far = np.nonzero(found & ~np.hstack((found[:, 1:], edge)))
        out.append(pd.DataFrame({"key": part.key.to_numpy()[row], "pos": part.pos.to_numpy()[row] + high[row] - far, "extent": far - near + length}))
    trim()
    return pd.concat(out, ignore_index=True).astype({"key": "int64", "pos": "int64", "extent": "int32"})


def _each_window(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """(a, b, key, pos) of all windows of contexts (key, pos, bytes): two hashes of each."""
    for pdf in batches:
        for at in range(0, len(pdf), BATCH):
            part = pdf.iloc[at : at + BATCH]
            bounds = _bounds(np.fromiter(map(len, part.bytes), np.int64, len(part)))
            data, n = np.frombuffer(b"".join(part.bytes), np.uint8), np.diff(bounds) - length + 1
            row = np.repeat(np.arange(len(part)), n)
            within = np.arange(int(n.sum())) - np.repeat(_bounds(n)[:-1], n)
            start = bounds[:-1][row] + within
            a, b = (Rolling(data, k).of(start, start + length).view(np.int64) for k in (0, 1))
            yield pd.DataFrame({"a": a, "b": b, "key": part.key.to_numpy()[row], "pos": part.pos.to_numpy()[row] + within})


def _texts(docs: pd.DataFrame):
    """A bucket's rows in order, as bytes with bounds, and the row number of each (key, ord)."""
    docs = docs.sort_values(["_key", "_ord"], ignore_index=True)
    bounds = _bounds(np.fromiter(map(len, docs["_text"]), np.int64, len(docs)))
    data = np.frombuffer(b"".join(docs["_text"]), np.uint8)
    return docs, bounds, data


def _starts(docs: pd.DataFrame, bounds: np.ndarray, spans: pd.DataFrame) -> np.ndarray:
    """Where each span of (key, pos) starts in the bucket's bytes."""
    pos = spans.pos.to_numpy()
    row = pd.MultiIndex.from_arrays([docs["_key"], docs["_ord"].astype("int64")]).get_indexer(pd.MultiIndex.from_arrays([spans.key, pos >> _ORD]))
    return bounds[row] + (pos & ((1 << _ORD) - 1))


def _fetch(docs: pd.DataFrame, look: pd.DataFrame, length: int) -> pd.DataFrame:
    """The contexts to look into, with their bytes and the place of the suffix in these."""
    out = {"seed": look.seed.to_numpy(), "hot": look.hot.to_numpy(), "key": look.key.to_numpy(), "pos": look.pos.to_numpy(), "at": [], "bytes": []}
    if len(look):
        docs, bounds, data = _texts(docs)
        start, extent = _starts(docs, bounds, look), look.extent.to_numpy()
        # each context's suffix again: the least seed hash, leftmost
        raw = data.tobytes()
        seed_at = np.arange(max(0, len(data) - SEED + 1))
        seed = mix64(Rolling(data, 0).of(seed_at, seed_at + SEED))
        for lo, size in zip(start.tolist(), extent.tolist(), strict=True):
            hi = lo + size - length  # the suffix is in all its windows, so from here on
            out["at"].append(hi - lo + int(np.argmin(seed[hi : lo + length - SEED + 1])))
            out["bytes"].append(raw[lo : lo + size])
    trim()
    return pd.DataFrame(out).astype({"seed": "int64", "hot": "bool", "key": "int64", "pos": "int64", "at": "int32"})


def _mask(docs: pd.DataFrame, spans: pd.DataFrame):
    docs, bounds, data = _texts(docs)
    cover = np.zeros(len(data) + 1, np.int32)
    if len(spans):
        start = _starts(docs, bounds, spans)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + spans.extent.to_numpy(), -1)
    return docs, bounds, data, np.cumsum(cover[:-1]) > 0


def _digest(docs: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    docs, bounds, data, gone = _mask(docs, spans)
    out = []
    for key, a, b in zip(docs["_key"].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        mine = gone[a:b]
        runs = int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum())
        out.append((key, b - a, int(mine.sum()), runs, hashlib.sha256(data[a:b][~mine].tobytes()).hexdigest()))
    return pd.DataFrame(out, columns=["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cut(docs: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    docs, bounds, data, gone = _mask(docs, spans)
    kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return pd.DataFrame({"_key": docs["_key"], "kept": kept})


def _with_repeats(docs: DataFrame, function, schema_out: str, id_col: str, text_col: str, length: int) -> DataFrame:
    """function(texts of a bucket of documents, their repeated strings) over all buckets."""
    spark = docs.sparkSession
    rows, total = keyed(docs, id_col, text_col)
    n = max(n_partitions(spark), total // BUCKET_BYTES + 1)
    buckets, parts = prime_from(2 * n), prime_from(n)
    bucket = lambda key, order: F.pmod(F.xxhash64(key, order), F.lit(buckets)).alias("_bucket")
    of_span = bucket(F.col("key"), F.shiftright("pos", _ORD).cast("int"))
    index = materialize(rows.mapInPandas(lambda b: slim(_index(b, length, n)), _INDEX), "suffix-index")
    firsts = index.filter("extent > 0")
    dealt = firsts.drop("often").join(F.broadcast(materialize(_hot(firsts, n), "hot-seeds")), "seed", "left")
    cold = dealt.filter("hot is null").drop("hot").groupBy(F.pmod("seed", F.lit(parts)).alias("_part"))
    found = materialize(cold.applyInPandas(_scan_part, "key long, pos long, extent int, seed long, again boolean"), "suffixes")
    # contexts of hot seeds: the first of each, by a partial aggregate, and the others as repeats of it
    hot = dealt.filter("hot").drop("hot")
    place = F.struct("key", "pos")
    once = materialize(hot.groupBy("seed", "context").agg(F.min(F.struct("key", "pos", "extent")).alias("first"), F.count("*").alias("_n")), "hot-contexts")
    later = fair_join(hot, once.filter("_n > 1"), ["seed", "context"], "inner", hot.count()).filter(place > F.struct("first.key", "first.pos"))
    look = found.filter("not again").select("key", "pos", "extent", "seed", F.lit(False).alias("hot"))
    look = look.unionByName(once.select("first.key", "first.pos", "first.extent", "seed", F.lit(True).alias("hot"))).withColumn("_bucket", of_span)
    texts = rows.withColumn("_bucket", bucket(F.col("_key"), F.col("_ord").cast("int")))
    schema = "seed long, hot boolean, key long, pos long, at int, bytes binary"
    fetched = materialize(texts.groupBy("_bucket").cogroup(look.groupBy("_bucket")).applyInPandas(lambda d, s: _fetch(d, s, length), schema), "contexts")
    span = ["key", "pos", "extent"]
    many = prime_from(max(n, look.count() // CANDIDATES))
    matched = fetched.filter("not hot").groupBy(F.pmod("seed", F.lit(many)).alias("_part")).applyInPandas(lambda p: _match_part(p, length), "key long, pos long, extent int")
    windows = materialize(fetched.filter("hot").select("key", "pos", "bytes").mapInPandas(lambda b: slim(_each_window(b, length)), "a long, b long, key long, pos long"), "hot-windows")
    ahead = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("_n")).filter("_n > 1")
    equal = fair_join(windows, materialize(ahead, "first-windows"), ["a", "b"], "inner", windows.count()).filter(place > F.col("first"))
    again = index.filter("extent < 0").withColumn("extent", -F.col("extent"))
    spans = found.filter("again").select(*span).unionByName(again.select(*span)).unionByName(later.select(*span)).unionByName(matched)
    spans = spans.unionByName(equal.select("key", "pos", F.lit(length).alias("extent"))).withColumn("_bucket", of_span)
    return texts.groupBy("_bucket").cogroup(spans.groupBy("_bucket")).applyInPandas(function, schema_out)


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the remaining bytes) of every row."""
    out = _with_repeats(docs, _digest, "_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col, text_col, length)
    return out.select(id_of("_key").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id_col and kept (binary: the remaining bytes, which may cut a character) of every row."""
    out = _with_repeats(docs, _cut, "_key long, kept binary", id_col, text_col, length)
    return out.select(id_of("_key").alias(id_col), "kept")
