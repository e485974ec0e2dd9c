"""WARC archives of pages, and a normaliser for monolithic gzip files.

``write_archives`` writes each stretch of rows as one gzip stream over the whole file. ``normalise`` inflates such a stream once,
from front to back, writes every record again as a gzip member of its own and lists the members' offsets in an index file beside
it. ``read_records`` opens archives by that index, a member at a time.

Files are named after the task attempt that wrote them, and only those in the returned tables count: an attempt that was lost or
repeated leaves files behind, never rows. Folders may be any that pyarrow's file systems open on driver and executors.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import attach, key_filter, small_batches, stash, test_filter

#: Payloads below this many bytes are never revisits.
LEAST_PAYLOAD = 100
#: Payload bytes after which a new archive is begun, bytes inflated at a time, compression of stream and members.
ARCHIVE_BYTES, READ_BYTES, LEVEL = 64 << 20, 1 << 20, 4
FILTER_BITS = 1 << 26
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("5b0f27b0-4a0c-5f6e-9d1c-6c1f4c7f8a10")
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, archive string, offset long, length long"


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path there."""
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}:{digest}')}>"


def one_line(text: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in text or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """A whole record: for a revisit the HTTP head alone, which still tells the payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"] + ([f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else [])
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def roles(pages: DataFrame, least: int = LEAST_PAYLOAD, bits: int = FILTER_BITS) -> DataFrame:
    """page_id, url, payload, digest, kind, refers_to of each row; only payloads that may occur twice are shuffled."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("h", F.xxhash64("digest"))
    large = F.octet_length("payload") >= least
    words = stash(key_filter(rows.filter(large).select("h"), bits, 2), "repeated")
    tested = test_filter(rows, words, bits).withColumn("hit", F.col("hit") & large).drop("h")
    alone = tested.filter("NOT hit").drop("hit").withColumn("kind", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long"))
    hits = tested.filter("hit").drop("hit")
    groups = stash(hits.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    again = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    met = attach(hits, groups, "digest", "n", total)
    met = met.withColumn("kind", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first")))
    return alone.unionByName(met.drop("first", "n"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``roles`` as monolithic archives under ``folder``: (archive, records)."""
    small_batches(records.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, root = open_path(folder)
        files.create_dir(root)
        stem = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        done: list[tuple[str, int]] = []
        out = packer = None
        size = count = 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if out is None:
                    name = f"{stem}-{len(done)}.warc.gz"
                    done.append((f"{folder}/{name}", 0))
                    out, packer, size, count = files.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                out.write(packer.compress(record(*row)))
                size += len(row[2])
                count += 1
                done[-1] = (done[-1][0], count)
                if size >= ARCHIVE_BYTES:
                    out.write(packer.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["archive", "records"])

    return stash(records.select("page_id", "url", "payload", "digest", "kind", "refers_to").mapInArrow(work, "archive string, records long"), "archives")


class Inflated:
    """The bytes of a gzip file of one or many members, read from front to back."""

    def __init__(self, source):
        self.source, self.inflate, self.held, self.ended = source, zlib.decompressobj(31), bytearray(), False

    def more(self) -> bool:
        if self.ended:
            return False
        raw = self.source.read(READ_BYTES)
        if not raw:
            self.ended = True
            if not self.inflate.eof:
                raise ValueError("the gzip stream ends early")
            return False
        while raw:
            self.held += self.inflate.decompress(raw)
            raw = self.inflate.unused_data
            if raw:
                self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end of the stream."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends within a record")
                return None
        return self.take(at + len(mark))

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite each ``archive`` with a gzip member per record and an index beside it: (archive, index, records).

    A stream that ends before its trailer, and one with another number of records than were written, is an error.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            done = []
            for path, written in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, place = open_path(path)
                stem = f"{path.removesuffix('.warc.gz')}-{attempt}"
                to, index = f"{stem}.members.warc.gz", f"{stem}.index.jsonl"
                offset = count = 0
                with files.open_input_stream(place, compression=None) as source, files.open_output_stream(open_path(to)[1], compression=None) as out, files.open_output_stream(open_path(index)[1], compression=None) as listed:
                    stream = Inflated(source)
                    while (head := stream.until(b"\r\n\r\n")) is not None:
                        head = head.lstrip(b"\r\n")
                        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        out.write(packer.compress(head))
                        fields = headers(head)
                        left = int(fields["content-length"]) + 4
                        while left:
                            part = stream.take(min(left, READ_BYTES))
                            left -= len(part)
                            out.write(packer.compress(part))
                        out.write(packer.flush())
                        end = out.tell()
                        listed.write((json.dumps({"offset": offset, "length": end - offset, "type": fields["warc-type"], "id": fields["warc-record-id"]}) + "\n").encode())
                        offset, count = end, count + 1
                if count != written:
                    raise ValueError(f"{path} has {count} records, {written} were written")
                done.append((to, index, count))
            columns = list(zip(*done, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["archive", "index", "records"])

    n = max(1, archives.count())
    return stash(archives.select("archive", "records").repartition(n).mapInArrow(work, "archive string, index string, records long"), "members")


def read_records(members: DataFrame, with_payload: bool = True) -> DataFrame:
    """RECORDS: every record of the archives, by offset. A response's digest is taken from its payload and must be the one its head names."""
    small_batches(members.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
        names = [x.split(" ")[0] for x in RECORDS.split(", ")]
        for b in batches:
            for path, index, written in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                files, place = open_path(path)
                with files.open_input_stream(open_path(index)[1], compression=None) as listed:
                    entries = [json.loads(x) for x in listed.read().splitlines()]
                if len(entries) != written:
                    raise ValueError(f"{index} lists {len(entries)} records, {written} were written")
                with files.open_input_file(place) as source:
                    rows, held = [], 0
                    for e in entries:
                        source.seek(e["offset"])
                        raw = zlib.decompress(source.read(e["length"]), 31)
                        head, _, rest = raw.partition(b"\r\n\r\n")
                        fields = headers(head)
                        http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path} at {e['offset']}: the payload does not have the digest of its head")
                        page, first = fields.get("x-page-id"), fields.get("x-refers-to-page")
                        rows.append((None if page is None else int(page), fields.get("warc-target-uri"), fields["warc-type"], int(headers(http)["content-length"]), digest, None if first is None else int(first), payload if with_payload and fields["warc-type"] == "response" else None, path, e["offset"], e["length"]))
                        held += len(payload)
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    n = max(1, members.count())
    return members.select("archive", "index", "records").repartition(n).mapInArrow(work, RECORDS)


def archive_pages(pages: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``folder``, normalise them and read them back: RECORDS.

    Payload is the html in UTF-8; a null is empty. Of equal payloads of LEAST_PAYLOAD bytes or more, the rows with the smallest page_id
    are responses, the others revisits of it; rows repeated with the same id and payload share one role. A null page_id is larger than all others and is left out of the head; signs
    in a url that a header cannot hold are percent-encoded. An empty table gives no archive and an empty result.
    """
    return read_records(normalise(write_archives(roles(pages), folder)), with_payload)
