"""WARC archives: a writer with revisit records and a reader that salvages damaged archives.

The reader checks every record (gzip checksum, header, length, block digest). Where a check fails it
searches on for the next byte from which a whole valid record can be read (a gzip member or a version
line), recovers what follows and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm.common import materialise, scratch_path

VERSION = b"WARC/1.1"
#: The form of revisit this writer makes.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, LINE_START = b"\x1f\x8b\x08", b"WARC/1."

RECORDS = "archive string, at long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, gap_start long, gap_end long, gap_reason string"


def _open(uri: str, how: str):
    """A stream of a file in any store that a URI names; nothing is assumed to be on a local disk."""
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path) if how == "r" else store.open_output_stream(path, compression=None)


def _identity(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record; with ``refers_to`` a revisit, whose block is the HTTP header alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _identity(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)))
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _identity(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    head += [("X-Payload-Length", str(len(payload))), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields (lower-case names), block and length of the record that ``data`` begins with; ValueError if it isn't whole."""
    split = data.find(b"\r\n\r\n")
    if not data.startswith(LINE_START) or split < 0:
        raise ValueError("no header")
    fields = {}
    for line in data[:split].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("malformed header line")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no content length")
    end = split + 4 + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("length doesn't fit")
    block = data[split + 4 : end]
    kind, _, digest = fields.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and digest != hashlib.sha1(block).hexdigest():
        raise ValueError("block digest differs")
    return fields, block, end + 4


class Salvage:
    """Reads a stream of gzip members or plain records; ``gaps`` fills with (start, end, reason) as it goes."""

    def __init__(self, stream, step: int = 1 << 16):
        self.stream, self.step, self.buffer, self.base, self.ended = stream, step, b"", 0, False
        self.gaps: list[tuple[int, int, str]] = []

    def _more(self) -> bool:
        data = b"" if self.ended else self.stream.read(self.step)
        self.ended = not data
        self.buffer += data
        return bool(data)

    def _member(self) -> tuple[bytes, int]:
        inflater, out, fed = zlib.decompressobj(31), [], 0
        while not inflater.eof:
            if fed == len(self.buffer) and not self._more():
                raise ValueError("member is cut off")
            part = self.buffer[fed : fed + self.step]
            fed += len(part)
            try:
                out.append(inflater.decompress(part))
            except zlib.error as e:
                raise ValueError(f"damaged member: {e}") from None
        return b"".join(out), fed - len(inflater.unused_data)

    def _one(self) -> tuple[dict[str, str], bytes, int]:
        """The record at the buffer's start and the bytes it takes there."""
        if self.buffer.startswith(MAGIC):
            data, used = self._member()
            fields, block, length = parse(data)
            if length != len(data):
                raise ValueError("more than a record in a member")
            return fields, block, used
        if self.buffer.startswith(LINE_START):
            while b"\r\n\r\n" not in self.buffer and len(self.buffer) < 1 << 20 and self._more():
                pass
            head, _, _ = self.buffer.partition(b"\r\n\r\n")
            sizes = [x.split(b":", 1)[1].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            want = len(head) + 8 + (int(sizes[0]) if sizes and sizes[0].isdigit() else 0)
            while len(self.buffer) < want and self._more():
                pass
            return parse(self.buffer[:want])
        raise ValueError("neither a member nor a version line")

    def __iter__(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        gap, reason = None, ""
        while True:
            if len(self.buffer) < len(LINE_START):
                self._more()
            if not self.buffer:
                break
            try:
                fields, block, used = self._one()
            except ValueError as e:
                if gap is None:
                    gap, reason = self.base, str(e)
                self._skip()
                continue
            if gap is not None:
                self.gaps.append((gap, self.base, reason))
                gap = None
            at = self.base
            self.buffer, self.base = self.buffer[used:], self.base + used
            yield at, fields, block
        if gap is not None:
            self.gaps.append((gap, self.base, reason))

    def _skip(self) -> None:
        """Drops at least a byte, up to the next place where a record may begin."""
        found = [x for x in (self.buffer.find(MAGIC, 1), self.buffer.find(LINE_START, 1)) if x > 0]
        while not found:
            keep = min(len(LINE_START) - 1, len(self.buffer) - 1)
            self.base += len(self.buffer) - keep
            self.buffer = self.buffer[len(self.buffer) - keep :]
            if not self._more():
                self.base, self.buffer = self.base + len(self.buffer), b""
                return
            found = [x for x in (self.buffer.find(MAGIC), self.buffer.find(LINE_START)) if x >= 0]
        self.base, self.buffer = self.base + min(found), self.buffer[min(found) :]


def _referred(pages: DataFrame, least: int) -> DataFrame:
    """``page_id, digest, response``: for payloads that occur more than once, the largest page id of each."""
    large = pages.select("page_id", "digest", "size").where(F.col("size") >= least)
    chosen = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 AND response IS NOT NULL").drop("n")
    return large.join(chosen, "digest").where(F.col("page_id").isNull() | (F.col("page_id") != F.col("response"))).select("page_id", "digest", "response").distinct()


def write_archives(pages: DataFrame, root: str, least: int = 1000, archive_bytes: int = 256 << 20, level: int = 1, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes one gzip member per row of ``pages`` (``page_id, url, html``) under ``root``; returns the written manifest.

    Of rows with equal payloads of at least ``least`` bytes, that with the largest page_id is a response and
    the others revisit it; rows repeated with its id and payload are responses too. A null html is an empty
    payload, a null url is left out. Each attempt of a task writes names of its own and the manifest, written
    once, names those of the attempts that counted: files of lost attempts are never read. Pages move once,
    by their own id, so equal payloads don't meet in a task; memory is one record."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    refers = _referred(rows, least).withColumnsRenamed({"page_id": "_page", "digest": "_digest"})
    rows = rows.join(refers, rows["page_id"].eqNullSafe(refers["_page"]) & (rows["digest"] == refers["_digest"]), "left").select("page_id", "url", "payload", "digest", "response")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, n, size, done = "", None, 0, 0, []
        for batch in batches:
            for page_id, url, data, digest, response in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    name, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(name, "w")
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id.as_py(), url.as_py(), data.as_py(), digest.as_py(), response.as_py(), date)) + packer.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["archive", "records", "bytes"])

    fs.FileSystem.from_uri(root)[0].create_dir(fs.FileSystem.from_uri(root)[1], recursive=True)
    return materialise(rows.mapInArrow(run, "archive string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives named in ``manifest.archive`` (columns: ``RECORDS``), one task an archive.

    A row with ``gap_start`` isn't a record but a quarantined stretch of bytes. payloads: whether to return
    the payloads, or only their digests and lengths. A response whose payload digest differs from its header's
    is quarantined too. An empty manifest gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with _open(uri, "r") as stream:
                    reader, rows, held = Salvage(stream), [], 0
                    for at, fields, block in reader:
                        payload = block.partition(b"\r\n\r\n")[2] if fields.get("warc-type") == "response" else None
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        if payload is not None and digest and digest != hashlib.sha1(payload).hexdigest():
                            reader.gaps.append((at, reader.base, "payload digest differs"))
                            continue
                        number = {k: int(v) if (v := fields.get(k)) is not None else None for k in ("x-page-id", "x-payload-length", "x-refers-to-page")}
                        size = len(payload) if payload is not None else number["x-payload-length"]
                        rows.append((uri, at, number["x-page-id"], fields.get("warc-target-uri"), size, digest, fields.get("warc-type"), number["x-refers-to-page"], payload if payloads else None, None, None, None))
                        held += len(payload or b"") * payloads + 200
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    rows += [(uri, None, None, None, None, None, None, None, None, *gap) for gap in reader.gaps]
                    if rows:
                        yield _batch(rows)

    n = max(1, min(100_000, manifest.count()))
    return manifest.select("archive").repartition(n).mapInArrow(run, RECORDS)


_ARROW = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("gap_reason", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def archive_root(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
