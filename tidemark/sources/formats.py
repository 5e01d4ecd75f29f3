"""CSV and JSON text with exact rules, and a byte codec, as columns.

Spark's own readers differ from the rules in places (blank CSV lines, empty fields, trailing JSON text, repeated keys), so
the strict forms parse Arrow batches; csv_fields and the JSON accessors are the native forms for well-formed text."""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


#: A row: up to a line end outside quotes, which any quote opens, wherever it stands; the text's end closes an open one.
_ROW = re.compile(r'(?:[^"\r\n]++|"(?:[^"]++|"")*+(?:"|\Z))*+')
_LINE_END = re.compile(r"\r\n?|\n")


@functools.lru_cache(16)
def _field(delimiter: str) -> re.Pattern:
    return re.compile(rf'"((?:[^"]++|"")*+)"?|([^{re.escape(delimiter)}]*+)')


def split_rows(text: str) -> Iterator[str]:
    """The raw rows of a CSV text: LF, CR or CRLF outside quotes end a row; no row follows the last line end."""
    at = 0
    while at < len(text):
        m = _ROW.match(text, at)
        yield m[0]
        end = _LINE_END.match(text, m.end())
        at = end.end() if end else len(text)


def split_fields(row: str, delimiter: str = ",") -> Iterator[tuple[str, bool]]:
    """(content, whether it holds doubled quotes) of a raw row's fields. A field is quoted if it starts with a quote; what
    follows its closing quote must be a delimiter, anything else ends the row."""
    at, pattern = 0, _field(delimiter)
    while True:
        m = pattern.match(row, at)
        if m[1] is not None:
            yield m[1], '""' in m[1]
        else:
            yield m[2], False
        if row[m.end() : m.end() + 1] != delimiter:
            return
        at = m.end() + 1


def parse_csv(text: str, delimiter: str = ",") -> list[list[str]]:
    """Rows of fields, all text, doubled quotes of quoted fields being one; a blank line is a row of one empty field."""
    return [[c.replace('""', '"') if doubled else c for c, doubled in split_fields(r, delimiter)] for r in split_rows(text)]


def csv_rows(df: DataFrame, text: str, *keep: str, delimiter: str = ",") -> DataFrame:
    """(keep..., row from 0, raw, fields, escaped) for every CSV row of a text column; null text has none. raw is the row as it
    stands, escaped tells which fields held doubled quotes."""
    if len(delimiter) != 1 or delimiter in '"\r\n':
        raise ValueError("a delimiter is one character that is no quote and no line end")

    @F.pandas_udf("array<struct<raw: string, fields: array<string>, escaped: array<boolean>>>")
    def parsed(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            rows = []
            for raw in split_rows(x or ""):
                fields = list(split_fields(raw, delimiter))
                rows.append({"raw": raw, "fields": [c.replace('""', '"') if d else c for c, d in fields], "escaped": [d for _, d in fields]})
            out.append(None if x is None else rows)
        return pd.Series(out, dtype=object)

    return df.select(*keep, F.posexplode(parsed(text)).alias("row", "_r")).select(*keep, "row", "_r.raw", "_r.fields", "_r.escaped")


def csv_fields(line: Column, schema: str) -> Column:
    """A one-line CSV row as a struct of strings, empty fields being ''."""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    row = F.from_csv(line, schema, {"escape": '"', "emptyValue": ""})
    return F.struct(*[F.coalesce(row[n], F.lit("")).alias(n) for n in names])


def to_int(c: Column) -> Column:
    return c.try_cast("int")


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def unescape(c: Column) -> Column:
    return F.replace(c, F.lit('""'), F.lit('"'))


# ---- JSON


class _Bad(ValueError):
    """at: the offset, in bytes of UTF-8, of the first token that cannot stand where it does."""

    def __init__(self, text: str, at: int):
        self.at = len(text[:at].encode("utf-8", "surrogatepass"))
        super().__init__(f"malformed at {self.at}")


_BLANK = re.compile(r"[ \t\r\n]*+")
_TOKEN = re.compile(r'([{}\[\],:])|"((?:[^"\\]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+)"|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)|(true|false|null)')
_ESCAPE = re.compile(r"\\(u[dD][89abAB][0-9A-Fa-f]{2}(?:\\u([0-9A-Fa-f]{4}))?|u[0-9A-Fa-f]{4}|.)")
_SHORT = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_WORDS = {"true": True, "false": False, "null": None}


def _unescaped(text: str, m: re.Match) -> str:
    """A string token's value. A high surrogate needs a low one after it; a low one may stand alone."""

    def one(e: re.Match) -> str:
        x = e[1]
        if x[0] != "u" or len(x) == 1:
            return _SHORT.get(x, x)
        code = int(x[1:5], 16)
        if 0xD800 <= code < 0xDC00:
            low = int(e[2], 16) if e[2] else 0
            if not 0xDC00 <= low < 0xE000:
                raise _Bad(text, m.start(2) + e.start())
            return chr(0x10000 + (code - 0xD800) * 0x400 + low - 0xDC00)
        return chr(code)

    return _ESCAPE.sub(one, m[2]) if "\\" in m[2] else m[2]


def parse_json(text: str):
    """A JSON value; objects are {"object": [(key, value), ...]}, in order and with repeats. Numbers are doubles. ValueError,
    with the offset in bytes as .at, on anything malformed: numbers out of range and lone high surrogates included."""
    at, stack, keys = 0, [], []  # open containers; the key that each open object waits for a value of
    want = "value"  # or: first (a value or the end of an array), key, first key, colon, next, end
    while True:
        at = _BLANK.match(text, at).end()
        if want == "end":
            if at < len(text):
                raise _Bad(text, at)
            return value
        m = _TOKEN.match(text, at)
        if not m:
            raise _Bad(text, at)
        mark = m[1]
        if want in ("key", "first key") and m[2] is not None:
            keys[-1], want = _unescaped(text, m), "colon"
        elif want == "colon" and mark == ":":
            want = "value"
        elif want == "next" and mark == ",":
            want = "value" if isinstance(stack[-1], list) else "key"
        elif want in ("value", "first") and mark in ("{", "["):
            stack.append([] if mark == "[" else {"object": []})
            keys.append(None)
            want = "first" if mark == "[" else "first key"
        else:
            if want in ("value", "first") and mark is None:
                if m[2] is not None:
                    value = _unescaped(text, m)
                elif m[3] is not None:
                    value = float(m[3])
                    if math.isinf(value):
                        raise _Bad(text, at)
                else:
                    value = _WORDS[m[4]]
            elif stack and mark == ("]" if isinstance(stack[-1], list) else "}") and want in ("next", "first", "first key"):
                value = stack.pop()
                keys.pop()
            else:
                raise _Bad(text, at)
            if stack:
                stack[-1].append(value) if isinstance(stack[-1], list) else stack[-1]["object"].append((keys[-1], value))
            want = "next" if stack else "end"
        at = m.end()


def same_json(a: str, b: str) -> bool | None:
    """Structural equality; objects compare in order. None if either is malformed."""
    try:
        return parse_json(a) == parse_json(b)
    except ValueError:
        return None


@F.pandas_udf(T.BooleanType())
def json_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    """same_json() of two text columns; null where either is null or malformed."""
    return pd.Series([None if x is None or y is None else same_json(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


_STRICT = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("kind", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("error_at", T.IntegerType())])


@F.pandas_udf(_STRICT)
def strict_json(s: pd.Series) -> pd.DataFrame:
    """Strict check of a JSON text: ok, kind, size (of arrays and objects, else 0), error_at (in bytes, -1 if ok)."""
    rows = []
    for x in s:
        try:
            v = parse_json(x) if x is not None else None
        except ValueError as e:
            rows.append((False, None, 0, getattr(e, "at", 0)))
            continue
        kinds = {bool: "bool", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}
        size = len(v) if isinstance(v, list) else len(v["object"]) if isinstance(v, dict) else 0
        rows.append((True, kinds[type(v)], size, -1) if x is not None else (None, None, None, None))
    return pd.DataFrame(rows, columns=["ok", "kind", "size", "error_at"])


def json_find(c: Column, key: str) -> Column:
    """The first value under key of an object, as JSON text; null if there is none."""
    return F.get_json_object(c, f"$['{key}']")


def json_size(c: Column) -> Column:
    return F.coalesce(F.json_array_length(c), F.size(F.json_object_keys(c)), F.lit(0)).cast("int")


def json_kind(c: Column) -> Column:
    """null, bool, number, string, array or object of well-formed JSON text."""
    t = F.substr(F.ltrim(c), F.lit(1), F.lit(1))
    return (
        F.when(t == "{", "object").when(t == "[", "array").when(t == '"', "string").when(t == "n", "null")
        .when(t.isin("t", "f"), "bool").when(t.isNotNull(), "number")
    )


# ---- bytes

RAW, GZIP = -15, 31


def deflate_bound(length: Column) -> Column:
    return length + (F.floor(length / 65535) + 1) * 5 + 8


def compress(c: Column, level: int = 6, wbits: int = RAW) -> Column:
    """Deflate (or gzip) a binary column; levels outside 0 to 9 mean 6."""
    level = level if 0 <= level <= 9 else 6

    @F.pandas_udf(T.BinaryType())
    def packed(s: pd.Series) -> pd.Series:
        def one(x):
            z = zlib.compressobj(level, zlib.DEFLATED, wbits)
            return z.compress(x) + z.flush()

        return pd.Series([None if x is None else one(bytes(x)) for x in s], dtype=object)

    return packed(c)


# The codec's result codes (output limit passed, input cut short, malformed stream, no memory).
OK, TOO_LARGE, TRUNCATED, CORRUPT, NO_MEMORY = 0, -1, -2, -3, -4


def inflate(data: bytes, wbits: int = RAW, limit: int | None = None) -> tuple[bytes | None, int]:
    """(bytes, 0), or (None, error code) for streams that are cut short, corrupt, or longer than limit when decoded."""
    z = zlib.decompressobj(wbits)
    try:
        out = z.decompress(data, limit + 1 if limit is not None else 0)
    except zlib.error:
        return None, CORRUPT
    except MemoryError:
        return None, NO_MEMORY
    if limit is not None and len(out) > limit:
        return None, TOO_LARGE
    return (out, OK) if z.eof else (None, TRUNCATED)


def decompress(c: Column, wbits: int = RAW, limit: int | None = None) -> Column:
    """STRUCT<data BINARY, err INT> of a compressed binary column."""

    @F.pandas_udf("data binary, err int")
    def unpacked(s: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if x is None else inflate(bytes(x), wbits, limit) for x in s]
        return pd.DataFrame({"data": pd.Series([r[0] for r in rows], dtype=object), "err": pd.Series([r[1] for r in rows], dtype="Int32")})

    return unpacked(c)


# RFC 1951's bases of length and distance codes, from its rule (groups of 4 and of 2, each twice as wide).
LENGTH_BASES = [*range(3, 11), *(b for e in range(1, 6) for b in range(3 + 2 ** (e + 2), 3 + 2 ** (e + 3), 2**e)), 258]
DISTANCE_BASES = [1, 2, 3, 4, *(b for e in range(1, 14) for b in range(1 + 2 ** (e + 1), 1 + 2 ** (e + 2), 2**e))]


def code_of(value: Column, bases: list[int]) -> Column:
    """The number of the largest base not above value (0 if all are above)."""
    return F.greatest(F.lit(0), F.size(F.filter(F.array(*map(F.lit, bases)), lambda b: b <= value)) - 1)


def hash3(a: Column, b: Column, c: Column) -> Column:
    """The 15-bit hash of three byte values."""
    return F.shiftleft(a, 10).bitwiseXOR(F.shiftleft(b, 5)).bitwiseXOR(c).bitwiseAND(F.lit(0x7FFF))


def code_lengths(freqs: dict[int, int], limit: int = 15) -> dict[int, int]:
    """Length-limited prefix code lengths: frequencies are halved until the tree fits."""
    import heapq

    freqs = {s: f for s, f in freqs.items() if f > 0}
    if len(freqs) <= 1:
        return dict.fromkeys(freqs, 1)
    while True:
        heap = [(f, n, (s,)) for n, (s, f) in enumerate(sorted(freqs.items()))]
        heapq.heapify(heap)
        depth = dict.fromkeys(freqs, 0)
        n = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in (*a[2], *b[2]):
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], n, (*a[2], *b[2])))
            n += 1
        if max(depth.values()) <= limit:
            return depth
        freqs = {s: f // 2 + 1 for s, f in freqs.items()}


def canonical_codes(lengths: dict[int, int]) -> dict[int, str]:
    """Codes as bit strings: shorter first, then by symbol, counting up."""
    code, before, out = 0, 0, {}
    for length, symbol in sorted((n, s) for s, n in lengths.items()):
        code <<= length - before
        out[symbol] = f"{code:0{length}b}"
        code, before = code + 1, length
    return out


def huffman_lengths(counts: DataFrame, *by: str, limit: int = 15) -> DataFrame:
    """(by..., symbol, length) of counts (by..., symbol int, n long): code_lengths() of each group. An alphabet has at most a few
    hundred symbols, so a group is small whatever was counted."""
    kinds = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in by)

    def lengths(pdf: pd.DataFrame) -> pd.DataFrame:
        found = code_lengths(dict(zip(pdf.symbol.tolist(), pdf.n.tolist(), strict=True)), limit)
        out = pd.DataFrame(sorted(found.items()), columns=["symbol", "length"])
        for c in reversed(by):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    return counts.groupBy(*by).applyInPandas(lengths, f"{kinds}, symbol int, length int")


def huffman_codes(lengths: DataFrame, *by: str) -> DataFrame:
    """lengths (by..., symbol, length up to 30) with code: canonical codes as bit strings. A code is the sum of the shares that all
    codes before it take, in 2**-length."""
    order = Window.partitionBy(*by).orderBy("length", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    share = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(30) - F.col("length"))
    taken = F.coalesce(F.sum(share).over(order), F.lit(0)).cast("long")
    number = F.call_function("shiftright", taken, F.lit(30) - F.col("length"))
    return lengths.withColumn("code", F.lpad(F.bin(number), F.col("length"), F.lit("0")))
