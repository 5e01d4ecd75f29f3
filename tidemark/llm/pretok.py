"""Pre-tokens of many texts at once, as numpy arrays.

Both patterns split a text by character classes (letters, numbers, white space, others), with the English contractions
first; so the runs of classes give the pre-tokens, and a few fix-ups at run borders give the rest. tests/llm compare
this with the patterns themselves."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pandas as pd
import regex

from tidemark.llm.common import Rolling, mix64

SPACE, LETTER, NUMBER, OTHER, BORDER = range(5)
_END = 0x110000  # a code point that no text has: the border between two texts
#: The code points with Unicode's White_Space property.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, by the regex module's Unicode tables (newer than unicodedata's)."""
    out = np.full(_END + 1, OTHER, np.uint8)
    every = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
    at = lambda k: k if k < 0xD800 else k + 0x800
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            out[at(m.start()) : at(m.end() - 1) + 1] = kind
    out[list(WHITE)] = SPACE
    out[_END] = BORDER
    return out


@functools.lru_cache(1)
def unknown() -> np.ndarray:
    """The code points that unicodedata has not heard of: their case and normal form are left to the library."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


def odd(text: str) -> bool:
    return not text.isascii() and bool(unknown()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any())


def code_points(texts: list[str]) -> np.ndarray:
    """All texts, each followed by a border."""
    end = _END.to_bytes(4, "little")
    return np.frombuffer(b"".join(x for t in texts for x in (t.encode("utf-32-le", "surrogatepass"), end)), np.dtype("<u4"))


def split(cp: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of code_points(texts), borders left out.

    words=False: the byte-level pattern (a blank joins the token after it; white space is kept).
    words=True: the word pattern (white space is dropped, each number is a token)."""
    n = len(cp)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cls = classes()[cp]
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(cls[1:], cls[:-1], out=begin[1:])
    begin |= cls == BORDER
    run = np.flatnonzero(begin)
    end = np.append(run[1:], n)
    kind = cls[run]
    if words:
        begin |= cls == NUMBER
    else:
        after = np.append(kind[1:], BORDER)
        held = (kind == SPACE) & (after != BORDER)
        last = end[held] - 1
        blank = cp[last] == 0x20
        begin[last] = True
        begin[end[held][blank]] = False
    # contractions: an apostrophe alone, at the start of a token, and the letters after it
    apostrophe = run[(kind == OTHER) & (end - run == 1) & (cp[run] == 0x27)]
    apostrophe = apostrophe[begin[apostrophe]]
    if len(apostrophe):
        apostrophe = apostrophe[apostrophe + 2 < n]  # the text's border follows the letter
        first, second = cp[apostrophe + 1], cp[apostrophe + 2]
        c = lambda *x: np.isin(first, [ord(y) for y in x])
        two = ((c("r") | c("v")) & (second == ord("e"))) | (c("l") & (second == ord("l")))
        size = np.where(c("s", "t", "m", "d"), 1, np.where(two, 2, 0))
        apostrophe, size = apostrophe[size > 0], size[size > 0]
        begin[apostrophe + 1] = False
        rest = apostrophe + 1 + size
        begin[rest[cls[rest] == LETTER]] = True
    start = np.flatnonzero(begin)
    stop = np.append(start[1:], n)
    keep = cls[start] != BORDER
    if words:
        keep &= cls[start] != SPACE
    return start[keep], stop[keep]


def _hashes(cp: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of each token: the sum of its mixed code points times powers of an odd base."""
    size = stop - start
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), Rolling.BASES[which], np.uint64), dtype=np.uint64)[place]
        power *= mix64(cp[np.repeat(start, size) + place].astype(np.uint64) + np.uint64(1 + 10_000_019 * which))
    return np.add.reduceat(power, np.cumsum(size) - size)


def distinct_hashed(cp: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token the number of its distinct word (by first occurrence), and for each word its first token and two
    independent hashes of 64 bits, by which words are told apart."""
    if not len(start):
        none = np.empty(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    one = _hashes(cp, start, stop, 0)
    two = _hashes(cp, start, stop, 1) ^ (stop - start).astype(np.uint64)
    codes, uniques = pd.factorize(one)
    first = np.empty(len(uniques), np.int64)
    first[codes[::-1]] = np.arange(len(start) - 1, -1, -1)
    if not np.array_equal(two[first][codes], two):  # a collision of the first hash
        codes, uniques = pd.factorize(pd.MultiIndex.from_arrays([one, two]))
        first = np.empty(len(uniques), np.int64)
        first[codes[::-1]] = np.arange(len(start) - 1, -1, -1)
    return codes, first, one[first], two[first]


def distinct(cp: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the number of its distinct word (by first occurrence), and for each word its first token."""
    return distinct_hashed(cp, start, stop)[:2]


def word_text(cp: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[str]:
    data = cp.tobytes()
    return [data[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") for a, b in zip(start.tolist(), stop.tolist(), strict=True)]


def doc_of(cp: np.ndarray, start: np.ndarray, n_docs: int) -> np.ndarray:
    """Where each text's tokens begin in start (n_docs + 1 bounds)."""
    ends = np.flatnonzero(cp == _END)
    return np.concatenate(([0], np.searchsorted(start, ends)))[: n_docs + 1]


def normal(text: str) -> str:
    """What the word vocabulary's normalizer does: NFC, then lower case character by character (white space is dropped later)."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()
