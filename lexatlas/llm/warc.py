"""WARC archives: writing, normalising whole-file gzip, and reading through an offset index.

``write_archives`` writes one monolithic gzip stream per task (every record in
one member, as careless crawlers do). ``normalise`` inflates each such stream
once, rewrites every record as a gzip member of its own and writes a sidecar
index (offset, length, record id) beside the file. ``read_archives`` seeks by
that index and inflates single members.

Files go to the shared folder through pyarrow's file systems; a file's name is
unique to the task attempt and only the manifest of committed attempts is
followed, so lost executors and repeated tasks leave no half-read archive.
Records are held one at a time.

Defined results: a null html is an empty payload; payloads below 100 bytes are
always responses; of equal payloads of at least 100 bytes the smallest page_id
is the response (rows that repeat that id as well), a row without an id only
when no row of the group has one; control characters in a url are escaped; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.runtime import lean, materialize, open_uri, remove, scratch, ship_package

MIN_DEDUP_BYTES = 100
#: A task begins a further archive after so many payload bytes.
ARCHIVE_BYTES = 1 << 30
_READ = 1 << 20
#: Payload bytes that leave a reader together.
_HELD = 4 << 20
_GZIP = 16 + zlib.MAX_WBITS
_MANIFEST = "path string, records long"


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit carries the response head without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}|{digest}|{uri}'.encode()).hexdigest()[:32])}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Inflated:
    """A gzip file, of one member or many, as a byte stream read once."""

    def __init__(self, source) -> None:
        self.source, self.z, self.buffer, self.over = source, zlib.decompressobj(_GZIP), bytearray(), False

    def _more(self) -> bool:
        while not self.over:
            data = self.z.unconsumed_tail or self.z.unused_data or self.source.read(_READ)
            if self.z.eof:
                if not data:
                    self.over = True
                    return False
                self.z = zlib.decompressobj(_GZIP)
            elif not data:
                raise EOFError("gzip stream ends early")
            out = self.z.decompress(data, 4 * _READ)
            if out:
                self.buffer += out
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to ``mark``, which is skipped; None at the end."""
        at = 0
        while (i := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                if self.buffer.strip():
                    raise EOFError("record head ends early")
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise EOFError("record ends early")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(source) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, head bytes, block) of each record of a gzip stream."""
    stream = Inflated(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        fields = parse_head(head)
        yield fields, head, stream.take(int(fields["content-length"]))
        stream.take(4)


def with_decisions(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size, first_id (smallest page_id of equal payloads)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    firsts = p.where(F.col("size") >= MIN_DEDUP_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return p.join(firsts, "digest", "left")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 5) -> DataFrame:
    """Write ``pages`` as monolithic gzip WARC files; the manifest of files, already run."""
    ship_package(pages.sparkSession)
    ready = with_decisions(pages).select("page_id", "url", "payload", "digest", "size", "first_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []

        def close() -> None:
            nonlocal out
            if out:
                out[1].write(out[2].flush())
                out[1].close()
                done.append((out[0], out[4]))
                out = None

        for batch in batches:
            for page_id, url, payload, digest, size, first in zip(*(batch.column(i) for i in range(6)), strict=True):
                page_id, first = page_id.as_py(), first.as_py()
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out = [path, open_uri(path, "w"), zlib.compressobj(level, zlib.DEFLATED, _GZIP), 0, 0]
                revisit = first is not None and page_id != first
                data = record_bytes(page_id, url.as_py(), payload.as_py(), digest.as_py(), size.as_py(), first, revisit)
                out[1].write(out[2].compress(data))
                out[3] += len(data)
                out[4] += 1
                if out[3] >= archive_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return materialize(ready.mapInArrow(lean(run), _MANIFEST), "warc-manifest")


def normalise(manifest: DataFrame, folder: str, level: int = 5) -> DataFrame:
    """Rewrite each archive of ``manifest`` record by record with a sidecar ``.idx``; the new manifest, already run."""
    ship_package(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                n = offset = 0
                with open_uri(path, "r") as source, open_uri(target, "w") as out, open_uri(target + ".idx", "w") as index:
                    for fields, head, block in records(source):
                        z = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                        member = z.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()
                        out.write(member)
                        index.write(f"{offset} {len(member)} {fields['warc-record-id']}\n".encode())
                        offset += len(member)
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], names=["path", "records"])

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialize(manifest.repartition(parts, "path").mapInArrow(lean(run), _MANIFEST), "warc-manifest")


def index_of(manifest: DataFrame) -> DataFrame:
    """path, offset, length, record_id from the sidecar of each archive."""
    ship_package(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_uri(path + ".idx", "r") as f:
                    rows = [x.split(" ", 2) for x in f.read().decode().splitlines()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows), pa.string()), pa.array([int(r[0]) for r in rows], pa.int64()), pa.array([int(r[1]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())],
                    names=["path", "offset", "length", "record_id"],
                )

    return manifest.select("path").mapInArrow(lean(run), "path string, offset long, length long, record_id string")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits, and without ``payloads``)
    of every record, each fetched by its offset and checked against its digest."""
    index = index_of(manifest)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, at = None, None
        for batch in batches:
            rows, held = [], 0
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if path != at:
                    if source:
                        source.close()
                    source, at = open_uri(path, "r"), path
                source.seek(offset)
                data = zlib.decompress(source.read(length), _GZIP)
                head, _, rest = data.partition(b"\r\n\r\n")
                fields = parse_head(head)
                block = rest[: int(fields["content-length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                kind = fields["warc-type"]
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{path} at {offset}: payload does not match its digest")
                number = lambda k: int(fields[k]) if k in fields else None
                rows.append((number("x-page-id"), fields["warc-target-uri"], size, digest, kind, number("x-refers-to-page-id"), payload if payloads and kind == "response" else None))
                held += len(payload) if payloads else 0
                if held >= _HELD:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)
        if source:
            source.close()

    return index.mapInArrow(lean(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Write, normalise, and read back; the monolithic files go once they are rewritten."""
    spark = pages.sparkSession
    raw = scratch(spark, "warc-raw")
    manifest = normalise(write_archives(pages, raw), scratch(spark, "warc"))
    remove(spark, raw)
    return read_archives(manifest, payloads)


def op9(spark, sf_dir: str) -> DataFrame:
    from lexatlas.runtime import table

    return round_trip(table(spark, sf_dir, "pages"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select *, min(page_id) over (partition by d) as first_id from p)
select page_id, n as payload_bytes, d as payload_digest,
  case when n >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""
