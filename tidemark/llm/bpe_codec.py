"""Byte-level BPE encoding and decoding through one global shuffle of distinct words.

Each scan task splits bounded chunks of texts into pre-tokens. Every distinct word of a chunk goes to its shard (packed:
one row per chunk and shard), where a task encodes each distinct word once and sends the ids back to the chunk. There
they are joined with the chunk's positions (one packed row: the number of the word at each position, frequent words
first) and put in order again. Positions thus travel once, and words once each way per chunk, so a word that makes up a
third of all tokens costs one entry per chunk.

The words and the positions of a chunk come from two passes over the texts. Rows are sorted inside their partition before,
so both see the same chunks; a chunk is named by its place and a hash of its contents, and one whose passes differ all
the same raises an error.

Defined results: a null text counts as empty (no ids); rows that repeat an id are encoded one by one; a null id stays
null; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import pretok
from tidemark.llm.common import chunks, materialize, n_partitions, pack, slim, small_batches, trim, unpack, varint_decode, varint_encode, whole

PACKED = "shard int, chunk long, digest long, blob binary"
_COLUMNS = ["shard", "chunk", "digest", "blob"]


@functools.lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(4)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("tidemark", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@functools.lru_cache(4)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: a token's bytes at its id (its size is that of the vocabulary file)."""
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _chunked(batches: Iterator[pd.DataFrame]):
    """(chunk, digest, rows, bounds of the rows' tokens, word number of each token, words): numbers by falling frequency."""
    part = TaskContext.get().partitionId()
    for number, rows in enumerate(chunks(batches, lambda r: len(r[1] or ""))):
        texts = [r[1] or "" for r in rows]
        cp = pretok.code_points(texts)
        digest = xxhash.xxh64_intdigest(cp.tobytes(), len(rows)) >> 1
        start, stop = pretok.split(cp, words=False)
        bounds = pretok.doc_of(cp, start, len(texts))
        word, first = pretok.distinct(cp, start, stop)
        by = np.argsort(-np.bincount(word, minlength=len(first)), kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        first = first[by]
        yield part << 32 | number, digest, rows, bounds, rank[word] if len(by) else word, (cp, start[first], stop[first])


def _words(batches: Iterator[pd.DataFrame], shards: int) -> Iterator[pd.DataFrame]:
    """Each chunk's distinct words by shard, with their numbers."""
    for chunk, digest, _, _, _, at in _chunked(batches):
        words = [w.encode() for w in pretok.word_text(*at)]
        shard = np.fromiter((zlib.crc32(w) % shards for w in words), np.int64, len(words))
        by = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[by], np.arange(shards + 1))
        out = []
        for s in np.flatnonzero(np.diff(edge)).tolist():
            here = by[edge[s] : edge[s + 1]]
            mine = [words[i] for i in here.tolist()]
            sizes = np.fromiter(map(len, mine), np.int64, len(mine))
            out.append((s, chunk, digest, pack(varint_encode(np.diff(here, prepend=0)), varint_encode(sizes), b"".join(mine))))
        yield pd.DataFrame(out, columns=_COLUMNS)


def _sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each chunk's documents, their numbers of tokens, and the word number at each position."""
    for chunk, digest, rows, bounds, word, at in _chunked(batches):
        ids = [None if pd.isna(r[0]) else int(r[0]) for r in rows]
        yield pd.DataFrame([(0, chunk, digest, pack(ids, np.diff(bounds).astype(np.int32), len(at[1]), varint_encode(word)))], columns=_COLUMNS)


def _encode_words(batches: Iterator[pd.DataFrame], path: str, pattern: str) -> Iterator[pd.DataFrame]:
    encode = _encoder(path, pattern)._core_bpe.encode_single_piece
    seen: dict[bytes, list[int]] = {}
    kind = np.uint16 if len(token_bytes(path)) <= 65_536 else np.uint32
    for pdf in batches:
        out = []
        for shard, chunk, digest, blob in pdf.itertuples(index=False, name=None):
            numbers, sizes, data = unpack(blob)
            ids, at = [], 0
            for size in varint_decode(sizes).tolist():
                w = data[at : at + size]
                at += size
                got = seen.get(w)
                if got is None:
                    got = seen[w] = encode(w)
                ids.append(got)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            out.append((shard, chunk, digest, pack(numbers, varint_encode(n), np.fromiter((i for x in ids for i in x), kind, int(n.sum())))))
            if len(seen) > 1_000_000:  # memory; a word that comes again is encoded again
                seen.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)


def _rebuild(coded: pd.DataFrame, sequence: pd.DataFrame):
    """A chunk's documents: ids, tokens of each, the word number at each position; for each word number its token ids."""
    if not len(sequence):
        raise ValueError("a chunk's words came without its positions: its two passes differ")
    docs, sizes, known, word = unpack(sequence.blob.iloc[0])
    numbers, lengths, ids = [], [], []
    for blob in coded.blob:
        gaps, n, values = unpack(blob)
        numbers.append(np.cumsum(varint_decode(gaps)))
        lengths.append(varint_decode(n))
        ids.append(values)
    none = np.empty(0, np.int64)
    number, length = np.concatenate([none, *numbers]), np.concatenate([none, *lengths])
    if len(number) != known:
        raise ValueError("a chunk's positions came without its words: its two passes differ")
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint16)
    begin = np.cumsum(length) - length
    by = np.empty(known, np.int64)
    by[number] = np.arange(known)
    return docs, sizes, varint_decode(word), begin[by], length[by], flat


def _digest(coded: pd.DataFrame, sequence: pd.DataFrame, path: str) -> pd.DataFrame:
    docs, sizes, word, begin, length, flat = _rebuild(coded, sequence)
    table = token_bytes(path)
    values = flat.tolist()
    text, raw = [], []
    for a, n in zip(begin.tolist(), length.tolist(), strict=True):
        mine = values[a : a + n]
        text.append(",".join(map(str, mine)).encode())
        raw.append(b"".join([table[i] for i in mine]))
    n_tokens = np.concatenate(([0], np.cumsum(length[word])))
    out, at = [], 0
    for doc, size in zip(docs, sizes.tolist(), strict=True):
        mine = word[at : at + size].tolist()
        ids = hashlib.sha256(b",".join([text[i] for i in mine])).hexdigest()
        decoded = hashlib.sha256(b"".join([raw[i] for i in mine])).hexdigest()
        out.append((doc, int(n_tokens[at + size] - n_tokens[at]), ids, decoded))
        at += size
    return _frame(out, ["n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(coded: pd.DataFrame, sequence: pd.DataFrame) -> pd.DataFrame:
    docs, sizes, word, begin, length, flat = _rebuild(coded, sequence)
    out, at = [], 0
    for doc, size in zip(docs, sizes.tolist(), strict=True):
        mine = word[at : at + size].tolist()
        at += size
        out.append((doc, np.concatenate([np.empty(0, np.int64), *[flat[begin[i] : begin[i] + length[i]] for i in mine]]).astype(np.int64)))
    return _frame(out, ["ids"])


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    trim()
    pdf = pd.DataFrame(rows, columns=["_id", *columns])
    pdf["_id"] = pdf["_id"].astype("Int64")
    return pdf


def _through_words(docs: DataFrame, function, schema: str, path: str, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """function(a chunk's words with ids, its positions) over all chunks."""
    small_batches(docs.sparkSession)
    n = n_partitions(docs.sparkSession)
    shards = min(n, 1024)
    salts = max(1, n // shards)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).sortWithinPartitions("_id", "_text")
    words = rows.mapInPandas(lambda b: slim(_words(b, shards)), PACKED).repartition(n, "shard", F.pmod("chunk", F.lit(salts)))
    coded = words.mapInPandas(lambda b: slim(_encode_words(b, path, pattern)), PACKED)
    sequences = rows.mapInPandas(lambda b: slim(_sequences(b)), PACKED)
    both = coded.groupBy("chunk", "digest").cogroup(sequences.groupBy("chunk", "digest"))
    return both.applyInPandas(function, schema).withColumnRenamed("_id", id_col)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (array of long) of every row of docs: the ids that the vocabulary at path gives its text, each
    match of pattern encoded on its own, without special tokens. pattern must be the byte-level pattern of pretok."""
    return _through_words(docs, _ids, "_id long, ids array<bigint>", path, pattern, id_col, text_col)


def token_table(spark, path: str) -> DataFrame:
    """(_token, _piece): the token-byte table, bounded by the vocabulary."""
    table = pa.table({"_token": pa.array(range(len(token_bytes(path))), pa.int64()), "_piece": pa.array(token_bytes(path), pa.binary())})
    return spark.createDataFrame(table)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded (binary): the bytes of its ids (null for null), by a join of ids and positions with the
    token-byte table, put in order again by position. An id outside the table raises."""
    spark = encoded.sparkSession
    rows = materialize(encoded.select(whole(encoded).alias("_doc"), F.col(f"`{ids_col}`").alias("_ids")).withColumn("_at", F.monotonically_increasing_id()), "to-decode")
    each = rows.select("_at", F.posexplode("_ids").alias("_pos", "_token"))
    piece = F.coalesce("_piece", F.raise_error(F.concat(F.lit("no token has the id "), F.coalesce(F.col("_token").cast("string"), F.lit("null")))).cast("binary"))
    joined = each.join(F.broadcast(token_table(spark, path)), "_token", "left").select("_at", "_pos", piece.alias("_piece"))
    # in pieces of up to 4096 tokens, so that no list of single tokens is as long as a document
    parts = joined.groupBy("_at", F.shiftright("_pos", 12).alias("_part")).agg(F.sort_array(F.collect_list(F.struct("_pos", "_piece"))).alias("_list"))
    text = lambda c: F.unhex(F.array_join(F.transform(c, lambda x: F.hex(x["_piece"])), ""))
    parts = parts.select("_at", F.col("_part").alias("_pos"), text(F.col("_list")).alias("_piece"))
    whole_texts = parts.groupBy("_at").agg(text(F.sort_array(F.collect_list(F.struct("_pos", "_piece")))).alias("decoded"))
    empty = F.when(F.col("_ids").isNotNull(), F.lit(b""))
    return rows.join(whole_texts, "_at", "left").select("_doc.*", F.coalesce("decoded", empty).alias("decoded"))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 (of the ids in decimal, joined by commas) and decoded_sha256 (of the decoded bytes)."""
    schema = "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _through_words(docs, lambda coded, sequence: _digest(coded, sequence, path), schema, path, pattern, id_col, text_col)
