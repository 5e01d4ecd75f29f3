"""SimHash fingerprints of word shingles, and near duplicates by anchor points of a covering code.

Two fingerprints of 64 bits that differ in at most 3 differ in at most 1 within one of their halves of 32 bits. In each
half the anchors are the words of a covering code: the perfect Hamming code of length 31 (radius 1) with the last bit
free. Every half lies within the covering radius, 1, of an anchor, so two halves that differ in at most 1 bit lie within
radius + 1 = 2 of the anchor nearest to either. Each distinct fingerprint is replicated to all anchors within 2 of its
halves (17 a half at most), and fingerprints that meet at an anchor are compared.

An anchor's fingerprints are searched breadth first, each reached one against those not reached yet, and only the edges
of the search tree leave, so that a large group of near copies gives neither all its pairs nor all its comparisons.
Anchors with more than SPLIT fingerprints are cut into blocks, and each pair of blocks is a group of its own.

Copies meet as one fingerprint. Defined results: a null or wordless text has fingerprint zero, linked like any other;
every row is a node, also where rows repeat an id; a row without id takes part in links but never names a component
(null where no row of the component has an id); extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.common import NULL_ID, fair_join, id_of, materialize, n_partitions, small_batches, trim, whole
from tidemark.llm.components import connected_components, forest

THRESHOLD, SHINGLE, SEED = 3, 3, 42
#: Fingerprints compared in one group.
SPLIT = 50_000
#: Fingerprints replicated at once (an Arrow batch may hand over fewer).
STEP = 5_000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """A-Z lower-cased, words between ASCII white space, shingles of width words (repeats included; fewer words: the whole
    sequence), and a bit where over half the shingles' XXH64 (seed 42) have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), end[last : last + n].tolist(), strict=True)], np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that over half the 64-bit hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(width: int):
    @F.pandas_udf(T.LongType())
    def fp(text: pd.Series) -> pd.Series:
        out = pd.Series([signed(fingerprint(t if isinstance(t, str) else None, width)) for t in text], dtype="int64")
        trim()
        return out

    return fp


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of words of 31 bits (bit i stands for position i + 1): the exclusive or of the positions of its ones."""
    s = np.zeros(len(x), np.uint64)
    for i in range(31):
        s ^= ((x >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return s


def _flip(x: np.ndarray, position: np.ndarray) -> np.ndarray:
    """x with the bit at a position from 1 to 31 flipped; position 0 flips nothing."""
    return np.where(position > 0, x ^ (np.uint64(1) << ((position - np.uint64(1)) & np.uint64(63))), x)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into half, anchor): all code words within 2 of halves of 32 bits. The code: 31 bits whose syndrome is zero,
    and any 32nd bit."""
    low, top = half & np.uint64(0x7FFFFFFF), half & np.uint64(0x80000000)
    s = _syndrome(low)
    index, out = [np.arange(len(half))] * 2, []
    near = _flip(low, s)
    out += [near | top, near | (top ^ np.uint64(0x80000000))]  # at distance 0 or 1; 1 or 2
    for i in range(1, 32):  # two flips i < j with i ^ j = s
        j = s ^ np.uint64(i)
        here = np.flatnonzero((j > i) & (s > 0))
        index.append(here)
        out.append(_flip(_flip(low[here], np.full(len(here), i, np.uint64)), j[here]) | top[here])
    return np.concatenate(index), np.concatenate(out)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fp, rep) in pieces of STEP rows, the last one shorter."""
    fp, rep = np.empty(0, np.int64), np.empty(0, np.int64)
    for pdf in batches:
        fp, rep = np.concatenate((fp, pdf.fp.to_numpy())), np.concatenate((rep, pdf.rep.to_numpy()))
        while len(fp) >= STEP:
            yield fp[:STEP], rep[:STEP]
            fp, rep = fp[STEP:], rep[STEP:]
    if len(fp):
        yield fp, rep


def _replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for fp, rep in _pieces(batches):
        u = fp.view(np.uint64)
        for half in (0, 1):
            i, a = anchors((u >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF))
            yield pd.DataFrame({"anchor": a.astype(np.int64) << 1 | half, "fp": fp[i], "rep": rep[i]})


def links_of(fp: np.ndarray, rep: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between fingerprints: breadth-first search, reached ones against the rest."""
    left_fp, left_rep = fp[1:], rep[1:]
    queue, a, b = [(fp[0], rep[0])], [], []
    while len(left_fp):
        if not queue:
            queue = [(left_fp[0], left_rep[0])]
            left_fp, left_rep = left_fp[1:], left_rep[1:]
            continue
        f, r = queue.pop()
        hit = np.bitwise_count(left_fp ^ f) <= threshold
        if hit.any():
            new = left_rep[hit]
            a.append(new)
            b.append(np.full(len(new), r))
            queue.extend(zip(left_fp[hit], new, strict=True))
            left_fp, left_rep = left_fp[~hit], left_rep[~hit]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by group: links inside each group. A group that a batch's end cuts is carried over."""
    held = None
    for pdf in batches:
        pdf = pd.concat([held, pdf], ignore_index=True) if held is not None else pdf
        group = pdf.anchor.to_numpy()
        cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
        held = pdf.iloc[cut:]
        yield _links(pdf.iloc[:cut])
    if held is not None:
        yield _links(held)


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    group, fp, rep = pdf.anchor.to_numpy(), pdf.fp.to_numpy().view(np.uint64), pdf.rep.to_numpy()
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if len(group) else np.zeros(1, np.int64)
    size = np.diff(edge)
    pair = edge[:-1][size == 2]
    pair = pair[np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= THRESHOLD]
    a, b = [rep[pair]], [rep[pair + 1]]
    for at, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
        x, y = links_of(fp[at : at + n], rep[at : at + n])
        a.append(x)
        b.append(y)
    u, v = forest(np.concatenate(a), np.concatenate(b))
    return pd.DataFrame({"u": u, "v": v})


def near_links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) between the rep values of distinct fingerprints (fp long, rep long), a written table: their
    components are those of all pairs that differ in at most 3 bits."""
    n, total, tasks = n_partitions(prints.sparkSession), prints.count(), prints.rdd.getNumPartitions()
    met = prints.mapInPandas(_replicate, "anchor long, fp long, rep long")
    # Each task regroups what it is handed to pieces of STEP rows, its last one being shorter; so there are at most so many
    # pieces, and an anchor met more than SPLIT times is met at least this often in one of them
    often = max(1, SPLIT // (total // STEP + tasks))
    suspects = prints.mapInPandas(lambda b: _frequent(b, often), "anchor long").distinct()
    counted = met.join(suspects, "anchor", "left_semi").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT)
    large = materialize(counted.select("anchor", F.ceil(F.col("n") / SPLIT).cast("int").alias("blocks")), "large-anchors")
    if total > SPLIT and large.head(1):  # cut these groups into pairs of blocks
        cut = met.join(large, "anchor").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select(F.xxhash64("anchor", F.least("block", "other"), F.greatest("block", "other")).alias("anchor"), "fp", "rep")
        met = met.join(large, "anchor", "left_anti").unionByName(cells)
    dealt = met.repartition(n, "anchor").sortWithinPartitions("anchor")
    return materialize(dealt.mapInPandas(_compare, "u long, v long"), "links")


def _frequent(batches: Iterator[pd.DataFrame], often: int) -> Iterator[pd.DataFrame]:
    for half_one in _replicate(batches):
        a, n = np.unique(half_one.anchor.to_numpy(), return_counts=True)
        yield pd.DataFrame({"anchor": a[n >= often]})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(key long, fp long) of every row, as a written table."""
    small_batches(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key")
    return materialize(docs.select(key, _fingerprints(width)(F.col(text_col).cast("string")).alias("fp")), "fingerprints")


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """fp, component (smallest key reachable) and root (a fingerprint that names it) of every distinct fingerprint of prints (key, fp). Null keys (NULL_ID)
    name a component only where no other key does."""
    rep = materialize(prints.groupBy("fp").agg(F.coalesce(F.min(F.when(F.col("key") != NULL_ID, F.col("key"))), F.lit(NULL_ID)).alias("rep")), "distinct-fingerprints")
    # fingerprints are the nodes: ids may be null or repeated
    links = near_links(rep.select("fp", F.col("fp").alias("rep")))
    roots = connected_components(links)
    named = rep.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min(F.when(F.col("rep") != NULL_ID, F.col("rep"))).alias("component"))
    return named.join(least, "root").select("fp", "component", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hexadecimal digits) and component_id (the smallest id reachable by links of at most 3
    differing bits, itself included) of every row."""
    prints = fingerprints(docs, id_col, text_col)
    named = fingerprint_components(prints)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    # a fingerprint that many rows have is broadcast to them, and not they gathered at it
    counts = prints.groupBy("fp").agg(F.count("*").alias("_n"))
    named = materialize(named.select("fp", "component").join(counts, "fp"), "named-fingerprints")
    return fair_join(prints, named, ["fp"], "inner", prints.count()).select(id_of("key").alias(id_col), hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns (of any name), of which one is kept of each group of near duplicates: that with the
    smallest id (nulls last), of rows that repeat it that whose text has the least hash, of equal texts the first row."""
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))
    marked = docs.select(whole(docs).alias("_doc"), key.alias("key"), F.xxhash64(text).alias("tie"), _fingerprints(SHINGLE)(text).alias("fp"), F.monotonically_increasing_id().alias("row"))
    marked = materialize(marked, "marked")
    named = fingerprint_components(marked.select("key", "fp"))
    # a partial aggregate by fingerprint first, so that a common one is a row per task
    best = F.min(F.struct((F.col("key") == NULL_ID).alias("none"), "key", "tie", "row")).alias("best")
    first = marked.groupBy("fp").agg(best).join(named, "fp")
    chosen = first.groupBy("root").agg(F.min("best").alias("best")).select("best.row")
    return marked.join(chosen, "row", "left_semi").select("_doc.*")
