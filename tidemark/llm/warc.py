"""WARC archives as a chunked record table. A record's bytes (WARC header, HTTP head, payload) are one row if the payload
has at most ``chunk_bytes`` bytes, else rows (record, chunk): a large payload is never one value in the archive, and its
digest is carried on from chunk to chunk when it is read. Header and HTTP head are in the first row whole, however long.
``write_files`` makes .warc files of such a table, and ``read_files`` such a table of .warc or .warc.gz files, its own or others.

Records with equal payloads of at least ``min_bytes`` bytes are one ``response`` (the largest page_id) and
``revisit`` records without payload that refer to it.

Record ids are UUIDs of the archive's name and the row number, so they differ for rows that repeat a page_id or have none; the
page_id itself is an extension field. Pages have no time of their own: ``date`` is that of all records.

Defined cases: null html is an empty payload; a null or empty url is ``about:blank``, and of other urls control characters and
spaces are percent-encoded; a null page_id is archived without an id, loses to any other id and is a response if all equal
payloads have none; rows that repeat a page_id are records of their own, and those whose id is the response's are responses;
other columns are ignored. Records of other kinds in files of others are read with their kind and size; ``intact`` is null for
a record that states no digest, and page ids are null where none are stated.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_row_id, written

ARCHIVE = "record long, chunk int, last boolean, data binary"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def _record_id(name: str, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{name}/{row}')}>"


def _header(kind: str, name: str, row: int, date: str, page: int | None, url: str | None, size: int, digest: str, refers: int | None, refers_row: int | None) -> bytes:
    """WARC header and HTTP head; a revisit's block is the head alone."""
    head = HTTP % size
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(name, row)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", *([] if page is None else [f"X-Page-ID: {page}"])]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(name, refers_row)}", f"X-Refers-To-Page-ID: {refers}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(head) + (0 if kind == 'revisit' else size)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + head


def _parts(buffer, size: int) -> Iterator[memoryview]:
    view = memoryview(buffer)
    for k in range(0, len(view), size):
        yield view[k : k + size]


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages: _row, page_id, url, html. Adds ``refers`` and ``refers_row``, the response's page_id and a row of it, where a row
    is a revisit."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keys = pages.select("_row", "page_id", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size"))
    first = keys.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.max(F.struct("page_id", "_row")).alias("r"), F.count("*").alias("n")).where("n > 1")
    # a table of its own, so that Spark can split the join of a payload that very many pages share
    named = written(first.select("sha", "size", F.col("r.page_id").alias("refers"), F.col("r._row").alias("refers_row")), "payloads")
    revisits = keys.join(named, ["sha", "size"]).where("refers is not null and not page_id <=> refers").select("_row", "refers", "refers_row")
    return pages.join(revisits, "_row", "left")


def write_archive(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = 1 << 16, page: str = "page_id", url: str = "url", html: str = "html", name: str = "pages", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The archive of all pages as a table in the shared folder (``ARCHIVE``); ``name`` sets its record ids apart from those of
    other archives."""
    rows = with_row_id(pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["record", "chunk", "last", "data"])

        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            held = 0
            for row, page_id, target, body, refers, refers_row in zip(*(batch.column(k) for k in range(6)), strict=True):
                payload = body.as_buffer() if body.is_valid else b""
                payload = payload if payload is not None else b""
                sha = hashlib.sha1(usedforsecurity=False)
                for part in _parts(payload, chunk_bytes):
                    sha.update(part)
                size = len(memoryview(payload))
                kind = "response" if refers.as_py() is None else "revisit"
                digest = base64.b32encode(sha.digest()).decode()
                header = _header(kind, name, row.as_py(), date, page_id.as_py(), target.as_py(), size, digest, refers.as_py(), refers_row.as_py())
                whole = kind == "revisit" or size <= chunk_bytes
                count = 1 if whole else 1 - (-size // chunk_bytes)
                parts = _parts(payload, chunk_bytes)
                for k in range(count):
                    value = bytes(next(parts)) if k else header + (bytes(payload) if whole and kind == "response" else b"")
                    for x, v in zip(columns, (row.as_py(), k, k == count - 1, value), strict=True):
                        x.append(v)
                    held += len(value)
                    if held > 4 << 20:
                        yield out()
                        columns, held = ([], [], [], []), 0
            yield out()

    decided = decide(rows, min_bytes).select("_row", "page_id", "url", "html", "refers", "refers_row")
    return written(decided.mapInArrow(chunks, ARCHIVE), "warc")


def read_archive(archive: DataFrame) -> DataFrame:
    """One row per record (``READ``); ``intact`` says that a response's payload has the digest and length of its header.
    The chunks of an oversized record come together in one task in order, and pass through it one by one; records of
    one row are read where they are."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        fields: dict[str, str] = {}
        sha, size = None, 0
        for batch in batches:
            out = []
            for chunk, last, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                view = memoryview(data.as_buffer())
                if chunk == 0:
                    block = bytes(view)  # the first row holds header and HTTP head whole
                    end = block.index(b"\r\n\r\n")
                    head = block[:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
                    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head)}
                    end += 4
                    if fields.get("content-type", "").replace(" ", "").startswith("application/http") and (body := block.find(b"\r\n\r\n", end)) >= 0:
                        end = body + 4
                    sha, size, view = hashlib.sha1(usedforsecurity=False), 0, view[end:]
                sha.update(view)
                size += len(view)
                if last:
                    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    length = int(fields.get("x-payload-length", size))
                    digest = base64.b32encode(sha.digest()).decode()
                    intact = None if stated is None else kind == "revisit" or (stated == digest and length == size)
                    out.append((int(page) if page else None, fields.get("warc-target-uri"), length, stated or digest, kind, int(refers) if refers else None, intact))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    columns = ["chunk", "last", "data"]
    alone = archive.where("chunk = 0 and last").select(*columns)
    large = archive.where("not (chunk = 0 and last)").repartition("record").sortWithinPartitions("record", "chunk").select(*columns)
    return alone.mapInArrow(records, READ).unionByName(large.mapInArrow(records, READ))


def write_files(archive: DataFrame, folder: str) -> DataFrame:
    """Archives as .warc files in a folder that all executors have mounted; returns (path, records, bytes). A retried
    task writes its file again under the same name."""
    import os

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}.warc")
        n = size = 0
        with open(path + ".tmp", "wb") as f:
            for batch in batches:
                for last, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    size += f.write(memoryview(data.as_buffer()))
                    if last:
                        size += f.write(b"\r\n\r\n")
                        n += 1
        os.replace(path + ".tmp", path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    ordered = archive.repartition("record").sortWithinPartitions("record", "chunk")
    return ordered.select("last", "data").mapInArrow(save, "path string, records long, bytes long")


def read_files(spark: SparkSession, folder: str, chunk_bytes: int = 1 << 16) -> DataFrame:
    """The archive (``ARCHIVE``) of the .warc and .warc.gz files in a folder that all executors have mounted, for ``read_archive``.
    A file is one task's, which holds one chunk and one header at a time. Files that end within a record raise an error."""
    import gzip
    from urllib.parse import unquote, urlsplit

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder).select("path")
    numbered = written(files.select("path", F.monotonically_increasing_id().alias("file")), "warc-files")
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary())

    def pieces(f) -> Iterator[tuple[int, bool, bytes]]:
        """(chunk, last, data) of a file's records one after another."""
        while line := f.readline():
            if not line.strip():
                continue  # the two empty lines after a record
            head = line
            while (line := f.readline()).strip():
                head += line
            if not line or not (length := re.search(rb"(?im)^content-length:\s*(\d+)", head)):
                raise EOFError(f"{f.name}: a record's header has no end or no length")
            left = int(length[1])
            if re.search(rb"(?im)^content-type:\s*application/http", head):
                head += line
                while left and (line := f.readline(left)):  # the HTTP head stays with the header
                    head, left = head + line, left - len(line)
                    if not line.strip():
                        break
            else:
                head += line
            part = f.read(min(left, chunk_bytes)) if left <= chunk_bytes else b""
            left -= len(part)
            yield 0, not left, head + part
            k = 0
            while left:
                if not (part := f.read(min(left, chunk_bytes))):
                    raise EOFError(f"{f.name}: the file ends within a record")
                k, left = k + 1, left - len(part)
                yield k, not left, part

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["record", "chunk", "last", "data"])

        for batch in batches:
            for path, file in zip(batch.column("path").to_pylist(), batch.column("file").to_pylist(), strict=True):
                place = unquote(urlsplit(path).path) if "://" in path or path.startswith("file:") else path
                columns: tuple[list, ...] = ([], [], [], [])
                held, record = 0, -1
                with (gzip.open if path.endswith(".gz") else open)(place, "rb") as f:
                    for k, last, data in pieces(f):
                        record += not k
                        for x, v in zip(columns, ((file << 24) + record, k, last, data), strict=True):
                            x.append(v)
                        held += len(data)
                        if held > 4 << 20:
                            yield out()
                            columns, held = ([], [], [], []), 0
                yield out()

    return written(numbered.repartition("path").mapInArrow(each, ARCHIVE), "warc")
