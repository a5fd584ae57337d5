"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. A reader task gets a byte range of
an archive, scans it for the magic bytes of a member, validates a candidate by
decoding it until the first line of a WARC header shows, and then reads
record after record from there; it owns the records that start inside its
range, wherever they end. So one huge archive is read by as many tasks as it
has ranges, and no range needs an index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import OWN, materialise, new_path, table
from .textkit import tidy

#: Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

SPLIT_BYTES, BLOCK, LEVEL = 32 << 20, 1 << 18, 6
LEAST_REVISIT = 1000
PAGE, KIND, REFERS = "<urn:page:%d>", OWN + "kind", OWN + "refers"


def roles(pages: DataFrame, html: str = "html", page_id: str = "page_id", least: int = LEAST_REVISIT) -> DataFrame:
    """pages with KIND (response or revisit) and REFERS (the response's page_id, for revisits).

    Of payloads that are equal (by SHA-1 and length) and have `least` bytes,
    the one with the largest id is the response. Rows that repeat that id are
    all responses; rows without an id are responses and nothing refers to them.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    size, sha = F.octet_length(payload), F.sha1(payload.cast("binary"))
    long = F.when((size >= least) & F.col(page_id).isNotNull(), sha)
    largest = (
        pages.select(long.alias(OWN + "sha"), F.col(page_id).cast("long").alias("id"))
        .filter(F.col(OWN + "sha").isNotNull())
        .groupBy(OWN + "sha")
        .agg(F.max("id").alias(OWN + "largest"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    # what can't be a copy gets keys of its own, so that it isn't all dealt to one task
    alone = F.concat(F.lit("-"), F.xxhash64(page_id, html, *(c for c in pages.columns if c not in (page_id, html))))
    got = pages.withColumn(OWN + "sha", F.coalesce(long, alone)).join(largest, OWN + "sha", "left")
    other = F.col(OWN + "largest") != F.col(page_id)
    return got.select(
        *pages.columns,
        F.when(other, "revisit").otherwise("response").alias(KIND),
        F.when(other, F.col(OWN + "largest")).alias(REFERS),
    )


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers: int | None) -> bytes:
    """One WARC record, not compressed."""
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {f'<urn:uuid:{uuid.uuid4()}>' if page_id is None else PAGE % page_id}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {PAGE % refers}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Writes one archive a partition into the shared folder path; returns their path, bytes and records.

    A null html is an empty payload, a null url no header, a null page_id a
    random record id. An archive gets its name only once it is whole, and only
    archives that the returned table lists count: what a lost attempt left
    behind is never read. An empty table writes nothing. Other columns are
    not written.
    """
    rows = roles(pages.select(html, url, page_id), html, page_id).select(page_id, url, html, KIND, REFERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(path)
        name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, size, count = None, 0, 0
        for batch in batches:
            for values in zip(*batch.columns):
                i, u, h, kind, refers = (v.as_py() for v in values)
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(name + ".tmp")
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(record(i, u, (h or "").encode(), kind, refers)) + packer.flush()
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            store.move(name + ".tmp", name)
            yield pa.RecordBatch.from_pydict({"path": [name[len(folder) + 1 :]], "bytes": [size], "records": [count]})

    got = materialise(rows.mapInArrow(tidy(run), "path string, bytes long, records long"), "archives")
    return got.select(F.concat(F.lit(path.rstrip("/") + "/"), "path").alias("path"), "bytes", "records")


class Members:
    """Gzip members of an open file from a byte on."""

    def __init__(self, file, at: int):
        self.file, self.at, self.buffer = file, at, b""
        file.seek(at)

    def fill(self) -> bool:
        more = self.file.read(BLOCK)
        self.buffer += more
        return bool(more)

    def next_magic(self, end: int) -> bool:
        """Goes to the next magic that starts before end."""
        while self.at < end:
            found = self.buffer.find(MAGIC)
            if found >= 0:
                self.skip(found)
                return self.at < end
            self.skip(max(0, len(self.buffer) - len(MAGIC) + 1))
            if not self.fill():
                return False
        return False

    def skip(self, n: int) -> None:
        self.buffer, self.at = self.buffer[n:], self.at + n

    def is_record(self) -> bool:
        """Whether the bytes here decode to the start of a WARC header."""
        decoder, fed, head = zlib.decompressobj(31), 0, b""
        while len(head) < 5 and not decoder.eof:
            if fed == len(self.buffer) and not self.fill():
                return False
            try:
                head += decoder.decompress(self.buffer[fed : fed + 512], 64)
            except zlib.error:
                return False
            fed = min(len(self.buffer), fed + 512)
        return head.startswith(b"WARC/")

    def read(self) -> bytes:
        """The whole member that starts here; goes to the byte after it. Raises zlib.error or EOFError if it is broken."""
        decoder, out = zlib.decompressobj(31), []
        out.append(decoder.decompress(self.buffer))
        size = len(self.buffer)
        while not decoder.eof:
            more = self.file.read(BLOCK)
            if not more:
                raise EOFError("an archive ends inside a record")
            out.append(decoder.decompress(more))
            size += len(more)
        self.buffer = decoder.unused_data
        self.at += size - len(self.buffer)
        return b"".join(out)


def records(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the records that start in [start, end)."""
    members = Members(file, start)
    while members.next_magic(end):
        at = members.at
        if members.is_record():
            yield at, members.read()
        else:
            members.skip(1)


def parse(raw: bytes) -> dict:
    """The parts of a record: headers (names in lower case), payload, and its length as the HTTP header gives it."""
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = block[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), len(payload))
    return {"headers": headers, "payload": payload, "length": length}


def page_of(value: str | None) -> int | None:
    return int(value[10:-1]) if value and value.startswith("<urn:page:") else None


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """One row a record of the archives (a table of path and bytes).

    page_id, url, record_type, refers_to, payload_bytes, payload_digest (SHA-1
    in hex, of the payload itself for a response), payload (null for a revisit;
    left out on request), path, offset. A response whose payload doesn't have
    the digest or the length of its header raises an error, as does an archive
    that ends inside a record. No archives give no rows.
    """
    splits = archives.select(
        "path", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("bytes") / split_bytes).cast("int") - 1))).alias("k")
    ).select("path", (F.col("k") * F.lit(split_bytes).cast("long")).alias("start"), F.least("bytes", (F.col("k") + 1) * F.lit(split_bytes).cast("long")).alias("end"))
    shape = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, path string, offset long" + ", payload binary" * payload
    names = [x.split(" ")[0] for x in shape.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split(" ")[0], kinds[x.split(" ")[1]]) for x in shape.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                store, where = fs.FileSystem.from_uri(split["path"]) if "://" in split["path"] else (fs.LocalFileSystem(), split["path"])
                out, size = [], 0
                with store.open_input_file(where) as file:
                    for offset, raw in records(file, split["start"], split["end"]):
                        got = parse(raw)
                        head, body = got["headers"], got["payload"]
                        kind = head["warc-type"]
                        sha = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
                        if kind == "response" and (hashlib.sha1(body).hexdigest() != sha or len(body) != got["length"]):
                            raise ValueError(f"{split['path']}: the record at {offset} doesn't have the payload that its header tells")
                        row = (page_of(head["warc-record-id"]), head.get("warc-target-uri"), kind, page_of(head.get("warc-refers-to")), got["length"], sha, split["path"], offset)
                        out.append((*row, body if kind == "response" else None) if payload else row)
                        size += len(raw)
                        if size > 16 << 20 or len(out) >= 5000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema)

    tasks = archives.sparkSession.sparkContext.defaultParallelism
    return splits.repartition(max(tasks, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(tidy(run), shape)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_warc(archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN largest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN largest <> page_id THEN largest END AS refers_to
FROM r
"""
