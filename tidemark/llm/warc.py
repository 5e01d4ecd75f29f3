"""WARC archives: writing pages, and reading archives back with their segments put together.

write_archives makes WARC 1.1 files with Spark's text sink (records are byte strings that end in CR LF CR LF, so the
sink's line feed is the record's own last byte), gzip-compressed, in the shared folder. A response record carries an HTTP
response whose body is in chunked transfer framing; blocks longer than SEGMENT are cut into a first segment and
continuation records, which may land in other files. So no record is longer than a segment and its headers, and a file,
which has a fixed number of records at most, is bounded however long the pages are. Of equal payloads of MIN_REVISIT
bytes or more, one is a response and the others are revisit records. Payloads that very many pages share are not
gathered: their digests are broadcast.

read_archives reads any such files through Spark's binaryFile source: each file is decompressed and parsed once, as a
stream; continuation records are grouped by the identifier of their origin, ordered by segment number, checked for gaps
and against the total length, and the transfer framing is decoded. Only segmented records are shuffled.

Defined results: a null payload is empty; a null address is an empty one; rows with a null id or that repeat an id are
records of their own (a null id never is what others refer to: where no row of a group has an id, all are responses; a
group whose largest id is held by several rows has several responses); extra columns are not read; an empty table
gives no records. Segments that are missing, repeated with other contents, or of wrong total length raise an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import materialize, n_partitions, new_path, slim, small_batches

SEGMENT, MIN_REVISIT, HTTP_CHUNK = 4096, 1000, 2048
#: Of an archive file at most, before compression (addresses beyond HEADERS bytes not counted).
FILE_BYTES, HEADERS = 32_000_000, 1000
DATE = "2024-01-01T00:00:00Z"  # pages have no time of their own
_PAGE = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: A segment's origin, number, total length and block, and the page of a whole record (or what a first segment says of it).
_PARSED = "origin string, segment long, total long, block binary, " + _PAGE


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record but for its last byte (a line feed)."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r"


def chunked(payload: bytes, size: int = HTTP_CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decode chunked transfer framing (extensions are skipped, trailers dropped); errors are ValueError."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def _records(batches: Iterator[pd.DataFrame], segment: int) -> Iterator[pd.DataFrame]:
    part, row = TaskContext.get().partitionId(), 0
    for pdf in batches:
        out = []
        for page, url, payload, digest, refers in zip(pdf["_id"], pdf["_url"], pdf["_payload"], pdf["_digest"], pdf["_refers"], strict=True):
            row += 1
            name = lambda n, p=part, r=row: f"<urn:tidemark:{p}-{r}-{n}>"
            page = None if pd.isna(page) else int(page)
            url = "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url or "")
            head = [("WARC-Record-ID", name(0)), ("WARC-Date", DATE), ("WARC-Target-URI", url or None), ("X-Page-ID", page)]
            sha = ("WARC-Payload-Digest", f"sha1:{digest}")
            http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
            kind = ("Content-Type", "application/http;msgtype=response")
            if payload is None:
                profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                out.append(record([("WARC-Type", "revisit"), *head, sha, ("WARC-Profile", profile), ("X-Refers-To-Page-ID", int(refers)), kind], http))
                continue
            block = http + chunked(bytes(payload))
            if len(block) <= segment:
                out.append(record([("WARC-Type", "response"), *head, sha, kind], block))
                continue
            parts = [block[i : i + segment] for i in range(0, len(block), segment)]
            out.append(record([("WARC-Type", "response"), *head, sha, kind, ("WARC-Segment-Number", 1)], parts[0]))
            for n, p in enumerate(parts[1:], 2):
                more = [("WARC-Type", "continuation"), ("WARC-Record-ID", name(n)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name(0)), ("WARC-Segment-Number", n)]
                out.append(record([*more, ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)], p))
        yield pd.DataFrame({"record": out})


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment: int = SEGMENT) -> None:
    """Write one record (and its continuations) per row of pages to gzip-compressed WARC files under path."""
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload"))
    rows = rows.withColumns({"_digest": F.sha1("_payload"), "_bytes": F.octet_length("_payload")})
    equal = rows.filter(F.col("_bytes") >= MIN_REVISIT).groupBy("_digest").agg(F.max("_id").alias("_first"), F.count("*").alias("_n"))
    equal = materialize(equal.filter("_n > 1"), "equal-payloads")  # only payloads that repeat
    share = F.col("_n") * n_partitions(pages.sparkSession) > rows.count()
    hot = rows.join(F.broadcast(equal.filter(share).withColumnRenamed("_n", "_hot")), "_digest", "left")
    cold = hot.filter("_hot is null").drop("_first", "_hot").join(equal.filter(~share).drop("_n"), "_digest", "left")
    marked = hot.filter("_hot is not null").drop("_hot").unionByName(cold)
    refers = F.when(F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("_refers")
    # a revisit has no payload
    payload = F.when(refers.isNull(), F.col("_payload")).alias("_payload")
    marked = marked.select("_id", "_url", payload, "_digest", refers)
    built = marked.mapInPandas(lambda b: slim(_records(b, segment)), "record binary")
    per_file = max(1, FILE_BYTES // (segment + HEADERS))
    built.select(F.col("record").cast("string")).write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)


def parse(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of the records in a stream of bytes."""
    buffer = bytearray()
    ended = False

    def want(n: int | None) -> bool:
        """Until the buffer holds n bytes, or a header's end if n is None."""
        nonlocal ended
        while (buffer.find(b"\r\n\r\n") < 0) if n is None else len(buffer) < n:
            more = next(data, None)
            if more is None:
                ended = True
                return False
            buffer.extend(more)
        return True

    while want(None):
        end = buffer.find(b"\r\n\r\n")
        first, *lines = bytes(buffer[:end]).decode().split("\r\n")
        if not first.lstrip().startswith("WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        if not want(end + 8 + size):
            raise ValueError("a record is cut short")
        yield headers, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 8 + size]
    if buffer.strip():
        raise ValueError("a record is cut short")


def _stream(content: bytes) -> Iterator[bytes]:
    """Pieces of a file, decompressed if it is gzip (any number of members)."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    unzip = zlib.decompressobj(31)
    while at < len(view):
        piece = view[at : at + 262_144]
        at += len(piece)
        out = unzip.decompress(piece)
        while unzip.eof:
            yield out
            rest = unzip.unused_data
            out = b""
            if not rest:
                rest = bytes(view[at : at + 262_144])
                at += len(rest)
                if not rest:
                    return
            unzip = zlib.decompressobj(31)
            out = unzip.decompress(rest)
        yield out
    if not unzip.eof:
        raise ValueError("a gzip member is cut short")


def _parsed(batches: Iterator[pd.DataFrame], payloads: bool) -> Iterator[pd.DataFrame]:
    """Rows of _PARSED: the pages of whole records, and the segments of the others."""
    columns = [c.split()[0] for c in _PARSED.split(", ")]
    for pdf in batches:
        for content in pdf.content:
            rows, held = [], 0
            for h, block in parse(_stream(content)):
                if h["warc-type"] not in ("response", "revisit", "continuation"):
                    continue
                number = lambda k, h=h: int(h[k]) if k in h else None
                digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                head = (number("x-page-id"), h.get("warc-target-uri"))
                segment = number("warc-segment-number")
                if segment is None:
                    rows.append((None, None, None, None, *_page(*head, h["warc-type"], number("x-refers-to-page-id"), digest, block, payloads)))
                else:
                    rows.append((h.get("warc-segment-origin-id", h["warc-record-id"]), segment, number("warc-segment-total-length"), block, *head, None, None, digest, h["warc-type"], number("x-refers-to-page-id")))
                held += len(block)
                if held > 4_000_000:
                    yield _typed(rows, columns)
                    rows, held = [], 0
            yield _typed(rows, columns)


def _typed(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=columns)
    return pdf.astype({c: "Int64" for c in ("segment", "total", "page_id", "payload_bytes", "refers_to") if c in columns})


def assemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a segmented record from its (number, total length or None, block) in any order."""
    by_number: dict[int, bytes] = {}
    total = None
    for number, length, block in segments:
        if by_number.setdefault(number, block) != block:
            raise ValueError(f"segment {number} comes twice, with different contents")
        total = length if length is not None else total
    if sorted(by_number) != list(range(1, len(by_number) + 1)):
        raise ValueError("a segment is missing")
    out = b"".join(by_number[n] for n in sorted(by_number))
    if total is None or total != len(out):
        raise ValueError(f"segments of {len(out)} bytes; the total length is {total}")
    return out


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _page(page, url, kind, refers, digest, block: bytes, payloads: bool) -> tuple:
    payload = size = None
    if kind == "response":
        payload = _payload(block)
        size, found = len(payload), hashlib.sha1(payload).hexdigest()
        if digest and found != digest:
            raise ValueError(f"page {page}: the payload's digest is {found}, not {digest}")
        digest = found
    return (page, url, payload if payloads else None, size, digest, kind, refers)


def _segments(batches: Iterator[pd.DataFrame], payloads: bool) -> Iterator[pd.DataFrame]:
    """Segments sorted by origin: the pages of their records. One record's segments are in memory at once."""
    columns = [c.split()[0] for c in _PAGE.split(", ")]
    origin, held, out, size = None, [], [], 0

    def finish() -> int:
        first = next((r for r in held if r[1] == 1 and r[7] != "continuation"), None)
        if first is None:
            raise ValueError("a record's first segment is missing")
        block = assemble([r[1:4] for r in held])
        out.append(_page(first[4], first[5], first[7], first[8], first[6], block, payloads))
        return len(block)

    for pdf in batches:
        cells = (pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("origin", "segment", "total", "block", "page_id", "url", "payload_digest", "record_type", "refers_to"))
        for row in zip(*cells, strict=True):
            if row[0] != origin:
                if held:
                    size += finish()
                    if size > 4_000_000:
                        yield _typed(out, columns)
                        out.clear()
                        size = 0
                origin, held = row[0], []
            held.append(row)
    if held:
        finish()
    yield _typed(out, columns)


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload (null for revisits, or without payloads), payload_bytes, payload_digest, record_type and refers_to
    of the records under path."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = materialize(files.mapInPandas(lambda b: slim(_parsed(b, payloads)), _PARSED), "parsed-records")
    columns = [c.split()[0] for c in _PAGE.split(", ")]
    cut = parsed.filter("origin is not null").repartition(n_partitions(spark), "origin").sortWithinPartitions("origin", "segment")
    joined = cut.mapInPandas(lambda b: slim(_segments(b, payloads)), _PAGE)
    return parsed.filter("origin is null").select(*columns).unionByName(joined)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to per row of pages, read back from archives."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col)
    if not pages.head(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    back = materialize(read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    # a revisit's payload is that of the response it refers to
    sizes = back.filter("record_type = 'response'").groupBy(F.col("page_id").alias("to"), F.col("payload_digest").alias("of")).agg(F.max("payload_bytes").alias("size"))
    revisits = back.filter("record_type = 'revisit'").join(sizes, (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("of")), "left")
    revisits = revisits.select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return back.filter("record_type = 'response'").unionByName(revisits)
