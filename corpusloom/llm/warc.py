"""WARC archives: a deduplicating writer and a salvage reader.

``write_archives`` writes a record per page, each a gzip member of its own, into files of the shared
folder. Of pages with equal payloads of ``min_bytes`` or more, that with the smallest id is a response
and the others revisit it. A file counts only once its row stands in the returned manifest, so files of
lost or repeated attempts are never read.

``read_archives`` checks every record: the gzip trailer, the version line, the length, and the block's
and payload's digests. After a failed check it searches on for the next gzip member or version line that
passes them all, goes on from there, and logs the bytes between as a quarantined gap. Archives without
compression are read as well. Memory holds one record, as long as its header says, and a search window.
Gaps are rows of the result; ``quarantined`` keeps them in a table of their own.

Defined results: null html is an empty payload, a null url gives no target; pages of a null id are
always responses and refer to nothing; pages that share the smallest id of a payload are all responses;
an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh_path, join_counted, table, written

#: Compressed bytes after which a task begins its next file; bytes read at once.
FILE_BYTES, WINDOW = 64 << 20, 1 << 18
#: A header that is longer counts as damaged.
HEADER_BYTES = 1 << 18
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "<urn:x-page:%s>"

READ_SCHEMA = "path string, offset long, size long, problem string, record_type string, page_id long, refers_to long, target string, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value holds no control characters: they are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """An uncompressed record; a revisit's block ends with the HTTP header."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", "WARC-Record-ID: " + (f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else _PAGE % page_id), f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _clean(url))
    if revisit:
        head += ["WARC-Refers-To: " + _PAGE % refers_to, "WARC-Profile: " + PROFILE]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def first_pages(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(digest, size, first_id, n) of the payloads that more than one page has, from partial counts."""
    counted = pages.groupBy("digest", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    return counted.where((F.col("n") > 1) & (F.col("size") >= min_bytes))


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Writes pages (page_id, url, html); returns the manifest (path, records, bytes).

    Pages of the most frequent payloads meet their first page by broadcast, all others by a shuffled join.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    firsts = written(first_pages(rows, min_bytes), "warc-firsts")
    joined = join_counted(rows, firsts, ["digest", "size"], "n", pages.count())
    ready = joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"))
    folder = fresh_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, n, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for page_id, url, text, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                made = record(page_id.as_py(), url.as_py(), text.as_py().encode(), base64.b32encode(bytes.fromhex(digest.as_py())).decode(), refers_to.as_py(), date)
                packer = zlib.compressobj(level, wbits=31)
                member = packer.compress(made) + packer.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return written(ready.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


class _Source:
    """A file read by position, a window at a time."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size

    def at(self, pos: int, n: int) -> bytes:
        self.file.seek(pos)
        return self.file.read(min(n, max(0, self.size - pos)))

    def find(self, pos: int) -> int:
        """The next place from ``pos`` on where a member or a record may begin; the size if there is none."""
        overlap = max(len(GZIP), len(VERSION)) - 1
        while pos < self.size:
            part = self.at(pos, WINDOW + overlap)
            hits = [i for i in (part.find(GZIP), part.find(VERSION)) if 0 <= i < WINDOW]
            if hits:
                return pos + min(hits)
            pos += WINDOW
        return self.size


class Damaged(ValueError):
    """A record that fails a check."""


def _whole(data: bytes | bytearray) -> tuple[int, int] | None:
    """Where the header of a record ends and where the record does; None while the header isn't there in full."""
    end = data.find(b"\r\n\r\n", 0, HEADER_BYTES)
    if end < 0:
        if len(data) >= HEADER_BYTES:
            raise Damaged("the header has no end")
        return None
    length = _headers(bytes(data[:end])).get("content-length", "")
    if not length.isdecimal():
        raise Damaged("there is no length")
    return end + 4, end + 4 + int(length) + 4


def _member(source: _Source, pos: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``pos``, and where it ends. No more is unpacked than its record's header says."""
    unpack, out, most = zlib.decompressobj(wbits=31), bytearray(), None
    data = b""
    try:
        while not unpack.eof:
            if not data:
                data = source.at(pos, WINDOW)
                pos += len(data)
                if not data:
                    raise Damaged("the member is cut short")
            out += unpack.decompress(data, WINDOW)
            data = unpack.unconsumed_tail
            if not out.startswith(VERSION[: len(out)]):
                raise Damaged("there is no version line")
            most = most or _whole(out)
            if most and len(out) > most[1]:
                raise Damaged("the length is wrong")
    except zlib.error as error:
        raise Damaged(f"the member is damaged: {error}") from error
    return bytes(out), pos - len(unpack.unused_data)


def _plain(source: _Source, pos: int) -> tuple[bytes, int]:
    """The uncompressed record at ``pos``, and where it ends."""
    bounds = _whole(source.at(pos, HEADER_BYTES))
    if bounds is None:
        raise Damaged("the header is cut short")
    if pos + bounds[1] > source.size:
        raise Damaged("the block is cut short")
    return source.at(pos, bounds[1]), pos + bounds[1]


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines[1:]) if colon}


def _page(value: str | None) -> int | None:
    start, end = _PAGE.split("%s")
    number = value[len(start) : -len(end)] if value and value.startswith(start) and value.endswith(end) else ""
    return int(number) if number.lstrip("-").isdecimal() else None


def check_record(data: bytes) -> dict:
    """The checked parts of one whole record; Damaged if any check fails."""
    if not data.startswith(VERSION):
        raise Damaged("there is no version line")
    head, blank, rest = data.partition(b"\r\n\r\n")
    fields = _headers(head)
    length = fields.get("content-length", "")
    if not blank or not length.isdecimal() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise Damaged("the length is wrong")
    block = rest[:-4]
    if (said := fields.get("warc-block-digest", "").removeprefix("sha1:")) and said != base32_sha1(block):
        raise Damaged("the block's digest is wrong")
    kind, said = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    http, cut, payload = block.partition(b"\r\n\r\n")
    payload = payload if cut and "application/http" in fields.get("content-type", "") else block
    if kind == "revisit":
        size, digest, payload = int(fields.get("x-payload-length") or 0), said, None
    else:
        size, digest = len(payload), base32_sha1(payload)
        if said and said != digest:
            raise Damaged("the payload's digest is wrong")
    return {"record_type": kind, "page_id": _page(fields.get("warc-record-id")), "refers_to": _page(fields.get("warc-refers-to")), "target": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "payload": payload}


def salvage(source: _Source) -> Iterator[dict]:
    """Records (offset, size and the parts of check_record) and gaps (offset, size, problem) of a file, in order."""
    pos = gap = 0
    problem = ""
    while pos < source.size:
        try:
            start = source.at(pos, len(VERSION))
            if start.startswith(GZIP):
                data, end = _member(source, pos)
            elif start == VERSION:
                data, end = _plain(source, pos)
            else:
                raise Damaged("neither a member nor a version line")
            found = check_record(data)
        except Damaged as error:
            problem = problem or str(error)
            pos = source.find(pos + 1)
            continue
        if gap < pos:
            yield {"offset": gap, "size": pos - gap, "problem": problem}
        yield found | {"offset": pos, "size": end - pos}
        pos = gap = end
        problem = ""
    if gap < source.size:
        yield {"offset": gap, "size": source.size - gap, "problem": problem}


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps (``problem`` isn't null) of the archives in column path, by READ_SCHEMA."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = FileSystem.from_uri(path)
                with fs.open_input_file(name) as file:
                    rows, held = [], 0
                    for row in salvage(_Source(file, file.size())):
                        row["path"] = path
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += 200 + len(row.get("payload") or b"")
                        if held > (4 << 20):
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return paths.select("path").mapInArrow(read, READ_SCHEMA)


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_ARROW = pa.schema([(n, _KINDS[t]) for n, t in (f.split() for f in READ_SCHEMA.split(", "))])


def quarantined(read: DataFrame) -> DataFrame:
    """The log of gaps (path, offset, size, problem) of what read_archives gave, as a written table."""
    return written(read.where("problem IS NOT NULL").select("path", "offset", "size", "problem"), "warc-gaps")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records read back; gaps, of which archives just written should have none, are logged in a table beside."""
    manifest = write_archives(table(spark, sf_dir, "pages"))
    files = manifest.repartition(max(1, manifest.count()))
    got = written(read_archives(files, payloads=False).drop("payload", "target"), "warc-read")
    quarantined(got)
    return got.where("problem IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p
"""
