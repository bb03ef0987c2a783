"""WARC archives as a Spark data source: a chunked record table, written and read as streams.

A record is a run of rows with ascending ``chunk_no``; a payload of any size is
never held whole. Each chunk carries the digest and the length of the payload
up to its end, so the last chunk's are those of the payload.

    spark.dataSource.register(WarcDataSource)
    chunks.write.format("qvault_warc").mode("append").save(folder)
    spark.read.format("qvault_warc").load(folder)
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from qvault.llm.files import make_folder, resolve, unique_name
from qvault.llm.skew import join_split
from qvault.storage import materialize, new_path

#: Payload bytes of one chunk row.
CHUNK_BYTES = 1 << 16
#: Bytes that the reader takes from a file, or unpacks, at once.
READ_BYTES = 1 << 18
MANIFEST = "_manifest"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, page_id long, record_type string, refers_to string, target_uri string, header_digest string, chunk_no long, data binary, bytes_so_far long, sha1_so_far string"

#: What is written: a record's head, with the length and digest of its whole payload, and a chunk with those up to its end.
CHUNK_SCHEMA = "record_id string, page_id long, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string, chunk_no long, data binary, bytes_so_far long, sha1_so_far string"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


@dataclass
class File(InputPartition):
    uri: str


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcDataSource(DataSource):
    """Options: ``path``; ``payload`` ("false": leave out the chunks' data); ``date`` of the records."""

    @classmethod
    def name(cls) -> str:
        return "qvault_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of CHUNK_SCHEMA.

    The chunks of a record must follow each other in a partition. A file gets
    a name that no other attempt uses; the commit lists the files of the
    attempts that ended in the folder's manifest.
    """

    def __init__(self, options: dict):
        self.folder, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out, member, name = None, None, unique_name(TaskContext.get().partitionId(), ".warc.gz")
        for batch in iterator:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in columns.items()}
                if out is None:
                    system, path = resolve(f"{self.folder}/{name}")
                    out = system.open_output_stream(path)
                if row["chunk_no"] == 0:
                    if member:
                        out.write(member.compress(b"\r\n\r\n") + member.flush())
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(member.compress(self._head(row)))
                if row["record_type"] == "response":
                    out.write(member.compress(row["data"]))
        if out is None:
            return Written(None)
        out.write(member.compress(b"\r\n\r\n") + member.flush())
        out.close()
        return Written(name)

    def _head(self, r: dict) -> bytes:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n"
        block = len(http) + (r["payload_bytes"] if r["record_type"] == "response" else 0)
        uri = (r["target_uri"] or "").replace("\r", "%0D").replace("\n", "%0A")
        fields = [
            ("WARC-Type", r["record_type"]),
            ("WARC-Record-ID", f"<{r['record_id']}>"),
            ("WARC-Date", self.date),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"),
            ("X-Page-Id", "" if r["page_id"] is None else r["page_id"]),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", block),
        ]
        if r["record_type"] == "revisit":
            fields[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{r['refers_to']}>")]
        return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + http).encode()

    def commit(self, messages: list) -> None:
        system, path = resolve(f"{self.folder}/{MANIFEST}-{unique_name(0, '.json')}")
        with system.open_output_stream(path) as f:
            f.write(json.dumps([m.name for m in messages if m and m.name]).encode())

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.name:
                system, path = resolve(f"{self.folder}/{m.name}")
                system.delete_file(path)


class Unpacked:
    """The bytes of a file of gzip members, read and unpacked a piece at a time."""

    def __init__(self, uri: str):
        system, path = resolve(uri)
        self.file = system.open_input_stream(path)
        self.zip, self.packed, self.held, self.at = zlib.decompressobj(31), b"", b"", 0

    def more(self) -> bool:
        """Unpack the next piece; False at the end of the file."""
        while True:
            if self.zip.eof:
                self.packed = self.zip.unused_data
                self.zip = zlib.decompressobj(31)
            if not self.packed:
                self.packed = self.file.read(READ_BYTES)
                if not self.packed:
                    return False
            piece = self.zip.decompress(self.packed, READ_BYTES)
            self.packed = self.zip.unconsumed_tail
            if piece:
                self.held, self.at = self.held[self.at :] + piece, 0
                return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        start = self.at
        while (end := self.held.find(b"\n", start)) < 0:
            if not self.more():
                return None
            start = 0
        found, self.at = self.held[self.at : end].rstrip(b"\r"), end + 1
        return found

    def take(self, n: int) -> bytes:
        """Up to ``n`` bytes, at least one unless the file ends."""
        if self.at == len(self.held) and not self.more():
            return b""
        found = self.held[self.at : self.at + n]
        self.at += len(found)
        return found

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            got = self.take(min(n, READ_BYTES))
            if not got:
                raise ValueError("the archive ends inside a record")
            n -= len(got)
            yield got


def fields_of(source: Unpacked) -> dict[str, str]:
    out = {}
    while line := source.line():
        k, _, v = line.decode().partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def chunk_rows(uri: str, payload: bool) -> Iterator[tuple]:
    """The rows of SCHEMA of one archive, in its order; an empty payload gives one chunk without bytes."""
    source = Unpacked(uri)
    while (line := source.line()) is not None:
        if not line.startswith(b"WARC/"):
            if line:
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            continue
        head = fields_of(source)
        length = int(head["content-length"])
        consumed = 0
        while (line := source.line()) is not None:  # the HTTP head
            consumed += len(line) + 2
            if not line:
                break
        page = head.get("x-page-id", "")
        refers = head.get("warc-refers-to", "").strip("<>") or None
        base = (head["warc-record-id"].strip("<>"), int(page) if page else None, head["warc-type"], refers, head.get("warc-target-uri") or None, head.get("warc-payload-digest", "").removeprefix("sha1:") or None)
        sha, done, chunk_no, parts, size = hashlib.sha1(), 0, 0, [], 0
        for piece in source.exactly(length - consumed):
            view = memoryview(piece)
            while view:
                part = view[: CHUNK_BYTES - size]
                view = view[len(part) :]
                sha.update(part)
                size += len(part)
                done += len(part)
                if payload:
                    parts.append(bytes(part))
                if size == CHUNK_BYTES:
                    yield *base, chunk_no, b"".join(parts) if payload else None, done, base32_sha1(sha.digest())
                    chunk_no, parts, size = chunk_no + 1, [], 0
        if size or not chunk_no:
            yield *base, chunk_no, b"".join(parts) if payload else None, done, base32_sha1(sha.digest())


class WarcReader(DataSourceReader):
    """One partition per file that a commit listed."""

    def __init__(self, options: dict):
        self.folder, self.payload = options["path"], options.get("payload", "true").lower() != "false"

    def partitions(self) -> list[File]:
        from pyarrow import fs

        system, path = resolve(self.folder)
        names = []
        for f in system.get_file_info(fs.FileSelector(path)):
            if f.base_name.startswith(MANIFEST):
                with system.open_input_stream(f.path) as s:
                    names += json.loads(s.read())
        return [File(f"{self.folder}/{n}") for n in sorted(names)] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows, held = [], 0
        for row in chunk_rows(partition.uri, self.payload) if partition.uri else ():
            rows.append(row)
            held += len(row[7] or b"")
            if held >= 4 << 20 or len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def record_table(pages: DataFrame, *, min_revisit_bytes: int = 0) -> DataFrame:
    """The chunk rows to write for ``pages`` (page_id, url, html).

    Of the pages with equal payloads of at least ``min_revisit_bytes`` bytes,
    that with the largest page_id is the response and the others revisit it;
    pages with smaller payloads are all responses. Payloads are compared by
    SHA-256. Only digests are grouped and joined by payload, a payload that
    many pages have in parts; payloads themselves move by page, and those of
    responses alone are cut into chunks.

    Null html counts as empty. Rows with a null page_id are responses. Rows
    that repeat page_id and payload share a record id; their archives hold each,
    and ``records`` gives one row for them. An empty table gives no chunks.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    shared = F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_revisit_bytes)
    keyed = rows.where(shared).select("page_id", "target_uri", "payload_bytes", "sha256", F.unhex(F.sha1("payload")).alias("sha1"))
    last, _ = materialize(keyed.groupBy("sha256").agg(F.max("page_id").alias("last_page"), F.count("*").alias("n")), "payloads")
    name = lambda page: F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("null")), F.hex("sha256"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    ends = ["target_uri", "payload_bytes", "sha1", "payload"]
    winners = rows.where(shared).join(last.select(F.col("last_page").alias("page_id"), "sha256"), ["page_id", "sha256"])
    responses = rows.where(~shared).unionByName(winners).withColumn("sha1", F.lit(None).cast("binary"))
    responses = responses.select(name(F.col("page_id")).alias("record_id"), "page_id", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), *ends)
    older = join_split(keyed, last, "sha256", n="n", by=["page_id"]).where("page_id < last_page").withColumn("payload", F.lit(None).cast("binary"))
    revisits = older.select(name(F.col("page_id")).alias("record_id"), "page_id", F.lit("revisit").alias("record_type"), name(F.col("last_page")).alias("refers_to"), *ends)
    return responses.unionByName(revisits).mapInArrow(_cut, CHUNK_SCHEMA)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows of records: views into the payload, with the digest and the bytes up to their ends."""
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        rows, held = [], 0
        for i in range(b.num_rows):
            head = [b.column(j)[i].as_py() for j in range(6)]
            if head[2] == "revisit":
                digest = base32_sha1(b.column(6)[i].as_py())
                rows.append((*head, digest, 0, b"", head[5], digest))
                continue
            payload = memoryview(b.column(7)[i].as_buffer())
            sha, digests = hashlib.sha1(), []
            for at in range(0, max(1, len(payload)), CHUNK_BYTES):
                sha.update(payload[at : at + CHUNK_BYTES])
                digests.append(base32_sha1(sha.digest()))
            for no, digest in enumerate(digests):
                data = bytes(payload[no * CHUNK_BYTES : (no + 1) * CHUNK_BYTES])
                rows.append((*head, digests[-1], no, data, min(len(payload), (no + 1) * CHUNK_BYTES), digest))
                held += len(data)
                if held >= 4 << 20:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)


def write_warc(chunks: DataFrame, folder: str) -> None:
    """Write chunk rows as archives."""
    spark = chunks.sparkSession
    spark.dataSource.register(WarcDataSource)
    make_folder(folder)
    chunks.write.format("qvault_warc").mode("append").save(folder)


def read_warc(spark: SparkSession, folder: str, *, payload: bool = True) -> DataFrame:
    """The chunk rows of the archives in ``folder``."""
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("qvault_warc").option("payload", str(payload)).load(folder)


def records(chunks: DataFrame) -> DataFrame:
    """One row per page from chunk rows: page_id, payload_bytes, payload_digest, record_type and refers_to (a page_id).

    A revisit's payload is that of the response that it refers to.
    """
    whole = chunks.groupBy("record_id", "page_id", "record_type", "refers_to").agg(F.max("bytes_so_far").alias("payload_bytes"), F.max_by("sha1_so_far", "chunk_no").alias("payload_digest"))
    whole, _ = materialize(whole, "records")
    responses = whole.where("record_type = 'response'")
    target = responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to"])
    revisits = whole.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to").join(target, "refers_to")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).union(revisits.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("to").alias("refers_to")))
