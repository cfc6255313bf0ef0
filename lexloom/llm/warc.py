"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. The reader deals out byte ranges of the files. A task scans its range for the
gzip magic, takes a place as a member only if it decodes to a WARC header, and owns the records whose members start in
its range, the last of which it reads past the range's end. From one member it steps to the next, so it scans again only
where a member is broken. A payload may itself hold gzipped WARC records byte for byte; a place inside a record that
started earlier is dropped, as only one that lies behind all records before it is real.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import open_new, open_old
from .scratch import Scratch, small_batches

MAGIC, SPLIT_BYTES, FILE_BYTES, READ_BYTES, LEVEL = b"\x1f\x8b\x08", 64 << 20, 1 << 30, 1 << 20, 3
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url: str | None, digest: str, n: int, payload: bytes | None, refers_to=None) -> bytes:
    """A gzip member with a response (payload given) or a revisit record."""
    http = HTTP.format(n).encode()
    block = http if payload is None else http + payload
    uri = quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {uri}"] if uri else []
    if payload is None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def base32_sha1(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def _write(folder: str):
    def run(batches):
        out, uri, size, n = None, "", 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, sha, length, html, refers = (batch.column(k)[i].as_py() for k in range(6))
                data = record(page, url, base32_sha1(sha), length, html, refers)
                if out is None or size + len(data) > FILE_BYTES:
                    if out:
                        out.close()
                        yield pa.RecordBatch.from_pydict({"path": [uri], "bytes": [size], "records": [n]})
                    uri, out = open_new(folder, ".warc.gz")
                    size = n = 0
                out.write(data)
                size, n = size + len(data), n + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [uri], "bytes": [size], "records": [n]})

    return run


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 0) -> DataFrame:
    """Write a record per row of pages; returns the committed manifest: path, bytes, records.

    Of rows with equal payloads of at least revisit_bytes bytes, the one with the least id (a null id comes last) is the
    response and the others revisit it; rows that repeat an id and payload make one response and else revisits. Smaller
    payloads are all responses. Null payload: empty. Null url: no WARC-Target-URI. Empty table: no files. Extra columns
    are not read. A payload travels once for each distinct one and map task; other rows travel without it.
    """
    small_batches(pages.sparkSession)
    s = Scratch(pages.sparkSession, "warc")
    data = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), data.alias("data"))
    p = p.select("page_id", "url", F.sha1("data").alias("sha"), F.octet_length("data").cast("long").alias("n"), "data")
    large = p.filter(F.col("n") >= revisit_bytes)
    key = F.struct(F.col("page_id").isNull().alias("z"), "page_id", "url")
    light = s.cut(large.groupBy("sha", "n", "page_id", "url").agg(F.count("*").alias("copies")), "rows")
    first = s.cut(light.groupBy("sha", "n").agg(F.min(key).alias("first")), "first")
    # Equal digests and lengths: any of the payloads is the payload.
    payload = large.select("sha", "n", "data").groupBy("sha", "n").agg(F.first("data").alias("data"))
    answers = payload.join(first, ["sha", "n"]).select(F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url"), "sha", "n", "data", F.lit(None).cast("long").alias("refers_to"))
    again = light.join(first, ["sha", "n"])
    is_first = key.eqNullSafe(F.col("first"))
    again = again.select("page_id", "url", "sha", "n", F.col("first.page_id").alias("refers_to"), F.explode(F.array_repeat(F.lit(1), (F.col("copies") - is_first.cast("int")).cast("int"))))
    again = again.select("page_id", "url", "sha", "n", F.lit(None).cast("binary").alias("data"), "refers_to")
    rows = answers.unionByName(again)
    if revisit_bytes > 0:
        rows = rows.unionByName(p.filter(F.col("n") < revisit_bytes).withColumn("refers_to", F.lit(None).cast("long")))
    found = rows.select("page_id", "url", "sha", "n", "data", "refers_to").mapInArrow(_write(s.at("files")), "path string, bytes long, records long")
    return s.cut(found, "manifest")


class Members:
    """The gzip members of a file that start in [start, end): (offset, end, decoded bytes), decoded a chunk at a time."""

    def __init__(self, f, start: int, end: int, chunk: int = READ_BYTES):
        self.f, self.at, self.end, self.chunk = f, start, end, chunk
        self.buffer, self.base = b"", start  # the buffer's bytes start at offset base

    def _more(self) -> bool:
        self.f.seek(self.base + len(self.buffer))
        data = self.f.read(self.chunk)
        self.buffer += data
        return bool(data)

    def _drop(self, at: int) -> None:
        self.buffer, self.base = self.buffer[at - self.base :], at

    def _header(self, at: int) -> bool:
        """Whether the bytes at `at` are a gzip member that begins with a WARC version line."""
        while len(self.buffer) < at - self.base + 4096 and self._more():
            pass
        z = zlib.decompressobj(31)
        try:
            head = z.decompress(self.buffer[at - self.base : at - self.base + 4096], 16)
        except zlib.error:
            return False
        return head[:7] in (b"WARC/1.", b"WARC/0.")

    def _find(self) -> bool:
        """Move to the next member that starts before the end of the range."""
        while True:
            i = self.buffer.find(MAGIC, self.at - self.base)
            if i >= 0:
                at = self.base + i
                if at >= self.end:
                    return False
                if self._header(at):
                    self.at = at
                    return True
                self.at = at + 1
                continue
            self.at = max(self.at, self.base + len(self.buffer) - len(MAGIC) + 1)
            if self.at >= self.end:
                return False
            self._drop(self.at)
            if not self._more():
                return False

    def __iter__(self):
        while self._find():
            start, z, parts, at = self.at, zlib.decompressobj(31), [], self.at
            self._drop(start)
            try:
                while not z.eof:
                    data = self.buffer[at - self.base :]
                    if not data:
                        self._drop(at)
                        if not self._more():
                            break
                        continue
                    parts.append(z.decompress(data))
                    at += len(data) - len(z.unused_data)
            except zlib.error:
                parts = None
            if parts is None or not z.eof:  # broken or cut off: scan on behind its first byte
                self.buffer, self.base, self.at = b"", start + 1, start + 1
                continue
            self.at = at
            yield start, at, b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return headers, rest[: int(headers.get("content-length", len(rest)))]


def http_payload(headers: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """The payload of an HTTP record and the length its HTTP header states (a revisit has only that)."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block, len(block)
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return body, int(value)
    return body, len(body)


_FIELDS = "path string, start long, offset long, stop long, record_type string, record_id string, refers_to string, uri string, digest string, stated long, n long, sha1 string"


def _read(with_payload: bool):
    names = [x.split()[0] for x in _FIELDS.split(", ")] + ["payload"] * with_payload

    def run(batches):
        for batch in batches:
            for path, start, end in zip(*(batch.column(k).to_pylist() for k in range(3))):
                with open_old(path) as f:
                    rows, held = [], 0
                    for a, b, data in Members(f, start, end):
                        h, block = parse(data)
                        body, stated = http_payload(h, block)
                        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
                        rows.append((path, start, a, b, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), stated, len(body), sha, *[body] * with_payload))
                        held += len(body) if with_payload else 200
                        if held > 1 << 21:
                            yield _batch(names, rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(names, rows)

    return run


def _batch(names, rows):
    kinds = {"start": pa.int64(), "offset": pa.int64(), "stop": pa.int64(), "stated": pa.int64(), "n": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.string())) for k, c in zip(names, zip(*rows))], names=names)


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """Records of the files listed in files(path, bytes): place, type, ids, uri, stated and computed digest and length.

    Only gzip members are records; broken ones are skipped. An empty list gives no rows, a path that is null or can't be
    opened fails. payload comes if asked for. Extra columns are not read; a file listed twice is read twice.
    """
    spark = files.sparkSession
    s = Scratch(spark, "warc-read")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("bytes") - 1), F.lit(split_bytes).cast("long"))
    ranges = s.cut(files.select("path", F.explode(starts).alias("start")).withColumn("end", F.col("start") + split_bytes), "ranges")
    schema = _FIELDS + ", payload binary" * with_payload
    found = s.cut(ranges.repartition(max(1, ranges.count()), "path", "start").mapInArrow(_read(with_payload), schema), "found", "zstd")
    # A range's records that lie in one that an earlier range owns begin before that one's end; a row per range tells it.
    ends = found.groupBy("path", "start").agg(F.max("stop").alias("last"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("path", "start", F.max("last").over(earlier).alias("before"))
    return found.join(ends, ["path", "start"]).filter("before IS NULL OR offset >= before").drop("before", "start")
