"""Sum-of-squares online packing of token sequences.

Every scan task tokenizes its documents and packs them as they come: whole windows of a long document are windows of
their own, and the rest goes to the fill level that leaves the sum of squared counts of partially filled windows
smallest (a level array of window + 1 counts; ties go to the fullest level). At the end of a task the few windows that
are still open are poured together, cut freely, and the last tokens leave as sequences of power-of-two lengths, which
need no padding. So packing needs no shuffle, and a task holds only its open windows.

Defined results: a null text counts as empty, so its document is the end token alone; rows that repeat an id are packed
one by one; a null id stays null; extra columns are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import pretok
from tidemark.llm.common import chunks, slim, small_batches

WINDOW = 2048
END_ID = 1
#: Bytes of text tokenized at once.
PART_BYTES = 2_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True  # their strings in a text are ordinary text
    return model


class WordIds:
    """Ids of whole texts through their distinct words: the vocabulary's model never looks across two pre-tokens, so each
    distinct word is encoded once (and kept while memory allows). Known words are arrays sorted by one hash, checked by
    another; only words that are new become strings."""

    LIMIT = 400_000

    def __init__(self, path: str):
        self.model = _tokenizer(path)
        self._forget()

    def _forget(self) -> None:
        none = np.empty(0, np.int64)
        self.one, self.two, self.at, self.size, self.flat = none.view(np.uint64), none.view(np.uint64), none, none, np.empty(0, np.uint32)

    def _known(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word stands among the known ones, and whether it does."""
        if not len(self.one):
            return np.zeros(len(one), np.int64), np.zeros(len(one), bool)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return at, (self.one[at] == one) & (self.two[at] == two)

    def _learn(self, words: list[str], one: np.ndarray, two: np.ndarray) -> None:
        ids = []
        for at in range(0, len(words), 5000):
            ids += [e.ids for e in self.model.encode_batch_fast(words[at : at + 5000], add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        by = np.argsort(one, kind="stable")
        place = np.searchsorted(self.one, one[by])
        self.at = np.insert(self.at, place, (len(self.flat) + np.cumsum(size) - size)[by])
        self.size = np.insert(self.size, place, size[by])
        self.two = np.insert(self.two, place, two[by])
        self.one = np.insert(self.one, place, one[by])
        self.flat = np.concatenate((self.flat, flat))

    def of(self, texts: list[str]) -> list[np.ndarray]:
        if strange := {i for i, t in enumerate(texts) if pretok.odd(t)}:
            out = self.of([t if i not in strange else "" for i, t in enumerate(texts)])
            for i in strange:
                out[i] = np.array(self.model.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            return out
        cp = pretok.code_points([pretok.normal(t) for t in texts])
        start, stop = pretok.split(cp, words=True)
        bounds = pretok.doc_of(cp, start, len(texts))
        word, first, one, two = pretok.distinct_hashed(cp, start, stop)
        _, have = self._known(one, two)
        new = np.flatnonzero(~have)
        if len(self.one) + len(new) > self.LIMIT and len(self.one):
            self._forget()
            new = np.arange(len(first))
        if len(new):
            self._learn(pretok.word_text(cp, start[first[new]], stop[first[new]]), one[new], two[new])
        at, have = self._known(one, two)
        begin, size = self.at[at], self.size[at]
        flat = self.flat
        if not have.all():  # words that share the first hash with another
            for w in np.flatnonzero(~have).tolist():
                ids = np.array(self.model.encode(pretok.word_text(cp, start[first[w : w + 1]], stop[first[w : w + 1]])[0], add_special_tokens=False).ids, np.uint32)
                begin[w], size[w] = len(flat), len(ids)
                flat = np.concatenate((flat, ids))
        each = size[word]
        total = np.concatenate(([0], np.cumsum(each)))
        # position k of the output stems from word w at begin[w] + (k - where that token starts)
        flat = flat[np.repeat(begin[word] - total[:-1], each) + np.arange(total[-1])]
        return np.split(flat, total[bounds[1:-1]]) if len(texts) > 1 else [flat]


class Packer:
    """Packs documents in the order they come; place() and close() return rows of SCHEMA."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.next = window, first_sequence
        self.count = np.zeros(window + 1, np.int64)  # count[h]: open windows filled up to h
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The level (0: a new window) where size tokens leave the smallest sum of squares; ties to the fullest."""
        top = self.window - size
        before, after = self.count[1 : top + 1], self.count[1 + size : top + 1 + size]
        change = 2 * (after - before) + 2
        if top >= 1:
            change[-1] = 1 - 2 * before[-1]  # the window gets full and is no longer counted
            change = np.where(before > 0, change, np.iinfo(np.int64).max)
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= 2 * self.count[size] + 1:
                return best + 1
        return 0

    def place(self, doc, ids: np.ndarray) -> list[tuple]:
        out, n = [], len(ids)
        whole = n - n % self.window
        for at in range(0, whole, self.window):
            out += self._emit([(doc, at, ids[at : at + self.window], n)])
        if n == whole:
            return out
        rest = n - whole
        level = self.level_for(rest)
        pieces = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        pieces.append((doc, whole, ids[whole:], n))
        if level + rest == self.window:
            return out + self._emit(pieces)
        self.count[level + rest] += 1
        self.open[level + rest].append(pieces)
        return out

    def _emit(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for doc, start, ids, total in pieces:
            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
            out.append((doc, start, len(ids), crc, total, self.next, offset))
            offset += len(ids)
        self.next += 1
        return out

    def close(self) -> list[tuple]:
        """Pour the open windows, fullest first, into full ones; the last tokens leave by powers of two."""
        left = [p for level in reversed(self.open) for pieces in level for p in pieces]
        total = sum(len(p[2]) for p in left)
        sizes = [self.window] * (total // self.window)
        sizes += [1 << b for b in reversed(range(self.window.bit_length())) if total % self.window >> b & 1]
        out, at = [], 0
        left.reverse()
        for size in sizes:
            pieces = []
            while size:
                doc, start, ids, n = left.pop()
                take = min(size, len(ids))
                pieces.append((doc, start, ids[:take], n))
                if take < len(ids):
                    left.append((doc, start + take, ids[take:], n))
                size -= take
            out += self._emit(pieces)
        return out


def _pack(batches: Iterator[pd.DataFrame], path: str, window: int, end_id: int) -> Iterator[pd.DataFrame]:
    words, packer = WordIds(path), Packer(TaskContext.get().partitionId() << 40, window)
    end = np.array([end_id], np.uint32)
    for rows in chunks(batches, lambda r: len(r[1] or ""), PART_BYTES):
        out = []
        for (doc, _), ids in zip(rows, words.of([r[1] or "" for r in rows]), strict=True):
            out += packer.place(None if pd.isna(doc) else int(doc), np.concatenate((ids, end)))
        yield _frame(out)
    yield _frame(packer.close())


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    pdf["doc_id"] = pdf["doc_id"].astype("Int64")
    return pdf.astype(dict.fromkeys(pdf.columns[1:], "int64"))


def pack_sequences(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document (SCHEMA, the first column named id_col): where it starts in the document's ids
    and in its sequence. Each id of a document, the end token included, lies in exactly one piece; sequences have window
    tokens but for a few per task whose lengths are powers of two. window must be a power of two."""
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInPandas(lambda b: slim(_pack(b, path, window, end_id)), SCHEMA).withColumnRenamed("doc_id", id_col)
