"""Web archives written from and read to rows of bounded size.

A payload is a run of rows (record, chunk_no, data) of at most CHUNK bytes. The writer turns such
rows into gzip members as they come, the reader turns archives back into such rows; both carry a
running SHA-1 and byte count, so no record is ever held whole on either side of an archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import materialize, new_path

CHUNK = 1 << 16
FILE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
REVISIT_FROM = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
NONE = "none"


def payload_chunks(records: DataFrame, payload: str = "payload", chunk: int = CHUNK) -> DataFrame:
    """The other columns of records with chunk_no, data and last: one row for each chunk, one for an empty payload."""
    rest = [c for c in records.columns if c != payload]
    rows = records.select(*rest, F.col(payload).cast("binary").alias("_payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, bytes, bool]] = []
            weight = 0

            def flush() -> pa.RecordBatch:
                own = [batch.column(i).take(pa.array([r[0] for r in rows], pa.int32())) for i in range(len(rest))]  # noqa: B023
                return pa.RecordBatch.from_arrays([*own, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.bool_())], names=[*rest, "chunk_no", "data", "last"])  # noqa: B023

            for k in range(batch.num_rows):
                value = batch.column(len(rest))[k]
                held = value.as_buffer() if value.is_valid else None
                size = held.size if held is not None else 0
                for number, at in enumerate(range(0, max(size, 1), chunk)):
                    rows.append((k, number, held.slice(at, min(chunk, size - at)).to_pybytes() if size else b"", at + chunk >= size))
                    weight += min(chunk, size) + 100
                    if weight > BATCH_BYTES:
                        yield flush()
                        rows, weight = [], 0
            if rows:
                yield flush()

    kinds = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in rest)
    return rows.mapInArrow(run, f"{kinds}, chunk_no long, data binary, last boolean")


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _head(record: str | None, url: str | None, kind: str, refers: str | None, size: int, digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    fields = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:record:{NONE if record is None else record}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url) if url else 'urn:none'}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}",
        *([f"WARC-Refers-To: <urn:record:{refers}>", f"WARC-Profile: {PROFILE}"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if kind == 'response' else 0)}",
    ]
    return ("\r\n".join(fields) + "\r\n\r\n" + http).encode()


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """(path, records, bytes) of the archives written: chunk rows in order, each with record, url, kind, refers, size and digest.

    A file's name holds the task's attempt, and only the attempts that Spark keeps are listed; so
    a repeated task leaves no record twice. A revisit has one chunk row, whose data isn't written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, path, member, running, done = None, "", None, None, []
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            plain = {n: columns[n].to_pylist() for n in ("record", "url", "kind", "refers", "size", "digest", "chunk_no", "last")}
            for k in range(batch.num_rows):
                if out is None:
                    path = f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out = files.open_output_stream(path, compression=None)
                    done.append([path, 0, 0])
                if plain["chunk_no"][k] == 0:
                    member, running = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    head = _head(*(plain[n][k] for n in ("record", "url", "kind", "refers", "size", "digest")))
                    out.write(member.compress(head))
                if plain["kind"][k] == "response":
                    data = columns["data"][k].as_buffer()
                    running.update(data)
                    out.write(member.compress(data))
                if plain["last"][k]:
                    if plain["kind"][k] == "response" and running.hexdigest() != plain["digest"][k]:
                        raise ValueError(f"the payload of record {plain['record'][k]} differs from its digest")
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    done[-1][1] += 1
                    if out.tell() >= FILE_BYTES:
                        done[-1][2] = out.tell()
                        out.close()
                        out = None
        if out is not None:
            done[-1][2] = out.tell()
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done]) for i in range(3)], names=["path", "records", "bytes"])

    return materialize(chunks.mapInArrow(run, "path string, records long, bytes long"), "archives")


def _stream(source, size: int = CHUNK) -> Iterator[bytes]:
    """The content of a file of gzip members."""
    member = zlib.decompressobj(31)
    data = source.read(size)
    while data:
        piece = member.decompress(data, size)
        if piece:
            yield piece
        data = member.unconsumed_tail
        if member.eof:
            data, member = member.unused_data, zlib.decompressobj(31)
        data = data or source.read(size)


class _Reader:
    """Bytes of a stream by line or by number, with little held at a time."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            self.held += piece
        return piece is not None

    def block(self) -> list[str] | None:
        """The lines up to an empty one; None at the end."""
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return None
        lines, self.held = self.held[:at].decode().split("\r\n"), self.held[at + 4 :]
        return lines

    def some(self, most: int) -> bytes:
        if not self.held and not self.more():
            raise ValueError("an archive ends within a record")
        out, self.held = self.held[:most], self.held[most:]
        return out


def read_archives(archives: DataFrame, folder: str, *, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of the archives in archives(path): record, url, kind, refers, digest, chunk_no, data, sha1, bytes, last.

    sha1 and bytes are those of the payload up to and with this chunk; digest is what the header says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(folder)
        names = ["record", "url", "kind", "refers", "digest", "chunk_no", "data", "sha1", "bytes", "last"]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]
        inner = lambda v: None if v is None or v == f"<urn:record:{NONE}>" else v[len("<urn:record:") : -1]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, weight = [], 0
                with files.open_input_stream(path, compression=None) as source:
                    reader = _Reader(_stream(source))
                    while (lines := reader.block()) is not None:
                        head = dict(line.split(": ", 1) for line in lines if ": " in line)
                        http = reader.block()
                        left = int(head["Content-Length"]) - len("\r\n".join(http).encode()) - 4
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        own = (inner(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], inner(head.get("WARC-Refers-To")), digest)
                        running, total, number = hashlib.sha1(), 0, 0
                        while True:
                            data = reader.some(min(left, chunk)) if left else b""
                            left -= len(data)
                            total += len(data)
                            running.update(data)
                            if with_data or not left:
                                rows.append((*own, number, data if with_data else None, running.hexdigest(), total, not left))
                                weight += len(data) * with_data + 200
                            number += 1
                            if weight > BATCH_BYTES:
                                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(10)], names=names)
                                rows, weight = [], 0
                            if not left:
                                break
                        while len(reader.held) < 4 and reader.more():
                            pass
                        reader.held = reader.held[4:]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(10)], names=names)

    paths = archives.select("path")
    dealt = paths.repartition(max(1, archives.count()), "path")
    return dealt.mapInArrow(run, "record string, url string, kind string, refers string, digest string, chunk_no long, data binary, sha1 string, bytes long, last boolean")


def page_records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(record, url, kind, refers, size, digest, payload): pages as records to write.

    Of pages with equal payloads of at least revisit_from bytes that with the largest page_id is
    the response and the others revisit it. A null html is an empty payload; rows with a null
    page_id are never referred to; repeated rows of the largest page_id are all responses.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("size"), body.alias("payload"))
    narrow = rows.select("page_id", "digest", "size").where(F.col("size") >= revisit_from)
    heads = narrow.groupBy("digest", "size").agg(F.max("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1 AND refers IS NOT NULL").drop("n")
    again = materialize(narrow.join(heads, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("refers"))).select("page_id", "digest", "refers").distinct(), "revisits")
    joined = rows.alias("p").join(again.alias("a"), F.col("p.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("p.digest") == F.col("a.digest")), "left")
    revisit = F.col("a.refers").isNotNull()
    return joined.select(F.col("p.page_id").cast("string").alias("record"), "p.url", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.col("a.refers").cast("string").alias("refers"), "p.size", "p.digest", F.when(revisit, F.lit(b"")).otherwise(F.col("p.payload")).alias("payload"))


def op8_archive(pages: DataFrame) -> DataFrame:
    """Archives of all pages, read back; a revisit takes size and digest from the response it refers to."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    archives = write_archives(payload_chunks(page_records(pages)), folder)
    back = materialize(read_archives(archives, folder, with_data=False).where("last").select("record", "kind", "refers", "digest", "sha1", "bytes"), "read")
    response = back.where("kind = 'response'").select(F.col("record").cast("long").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    known = response.select(F.col("page_id").alias("r"), "payload_bytes", "payload_digest").distinct()
    revisit = back.where("kind = 'revisit'").join(known, (F.col("refers").cast("long") == F.col("r")) & (F.col("digest") == F.col("payload_digest")))
    return response.unionByName(revisit.select(F.col("record").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("r").alias("refers_to")))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
h AS (SELECT html, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT p.page_id, p.payload_bytes::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN h.head IS NULL OR h.head = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN h.head <> p.page_id THEN h.head END AS refers_to
FROM p LEFT JOIN h ON p.html = h.html AND p.payload_bytes >= 1000
"""
