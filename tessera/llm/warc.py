"""WARC archives with dictionary-compressed records.

Each task writes archives of its own. An archive begins with a skippable frame (magic 0x184D2A5D) that holds a
Zstandard dictionary, trained on the first records that go into the archive; then each record follows as a
frame of its own, compressed with the dictionary. A task holds back at most a sample's worth of records.

Of records with equal payloads, one is a response and the others are revisits that refer to it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filesystem, shared_path, stored, table

#: Fixed values of the formats.
_MAGIC = (0x184D2A5D).to_bytes(4, "little")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records that a dictionary is trained on: at most so many bytes; the dictionary's size; when a new archive begins.
_SAMPLE, _DICTIONARY, _ARCHIVE = 2 << 20, 32 << 10, 256 << 20

_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str, place: str) -> str:
    """A URN of the page, its payload and the record's place in the archives, which no two records share, whatever their page_ids are."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{place}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, place: str) -> bytes:
    """One WARC record. A revisit (refers_to is given) has the HTTP head, which states the payload's length, and no payload.

    Pages go by fields of their own, Page-ID and Refers-To-Page-ID; WARC-Refers-To is optional and left out, as the
    response's place isn't known where a revisit is written.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest, place)), ("WARC-Date", date)]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Profile", _REVISIT), ("Refers-To-Page-ID", str(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _page(number: str | None) -> int | None:
    return None if number is None else int(number)


def train(samples: list[bytes]):
    """A dictionary of the samples; of their bytes as they are where they are too few to train on; None without any."""
    import zstandard

    try:
        return zstandard.train_dictionary(_DICTIONARY, samples)
    except zstandard.ZstdError:
        raw = b"".join(samples)[-_DICTIONARY:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


class _Archive:
    """Records wait until the dictionary is trained, then go out one frame each."""

    def __init__(self, path: str):
        self.path, (self.fs, self.at) = path, filesystem(path)
        self.waiting: list[bytes] | None = []
        self.held = self.records = self.size = 0

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.waiting is None:
            self._put(data)
            return
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= _SAMPLE:
            self._begin()

    def _begin(self) -> None:
        import zstandard

        primed = train(self.waiting)
        self.stream = self.fs.open_output_stream(self.at)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=primed) if primed else zstandard.ZstdCompressor(level=3)
        content = primed.as_bytes() if primed else b""
        self.stream.write(_MAGIC + len(content).to_bytes(4, "little") + content)
        waiting, self.waiting = self.waiting, None
        for data in waiting:
            self._put(data)

    def _put(self, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.stream.write(frame)
        self.size += len(frame)

    def close(self) -> None:
        if self.waiting is not None:
            self._begin()
        self.stream.close()


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(WARC fields by lower-case name, block) of every record of an archive, one record in memory at a time."""
    import zstandard

    fs, at = filesystem(path)
    with fs.open_input_stream(at, buffer_size=1 << 20) as f:
        head = f.read(8)
        if head[:4] != _MAGIC:
            raise ValueError("no dictionary frame at the archive's head")
        content = f.read(int.from_bytes(head[4:], "little"))
        primed = zstandard.ZstdCompressionDict(content) if content else None
        decompressor = zstandard.ZstdDecompressor(dict_data=primed) if primed else zstandard.ZstdDecompressor()
        with decompressor.stream_reader(f, read_across_frames=True) as reader:
            waiting = b""
            while True:
                while b"\r\n\r\n" not in waiting:
                    more = reader.read(1 << 16)
                    if not more:
                        if waiting:
                            raise ValueError("the archive ends within a record")
                        return
                    waiting += more
                head, _, waiting = waiting.partition(b"\r\n\r\n")
                fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in head.decode().split("\r\n")[1:])}
                size = int(fields["content-length"]) + 4
                parts, held = [waiting], len(waiting)
                while held < size:
                    parts.append(reader.read(max(1 << 16, size - held)))
                    if not parts[-1]:
                        raise ValueError("the archive ends within a record")
                    held += len(parts[-1])
                data = b"".join(parts)
                waiting = data[size:]
                yield fields, data[: size - 4]


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100, date: str | None = None) -> DataFrame:
    """Writes a record for every row of pages (page_id, url, html); returns the manifest (path, records).

    Of rows with equal payloads of at least least_bytes the one with the smallest page_id is a response and the
    others refer to it; shorter payloads are all responses. Null html is an empty payload. Repeated rows with
    that smallest page_id are all responses. A null page_id is a revisit where its payload occurs under an id,
    else a response. An empty table gives archives without records, or none. Columns beside these three may have any
    name. ``date`` is when the pages were fetched; without it, the time of the call.

    Only payloads that occur twice or more are joined back; the join is a plain one, so that adaptive execution
    splits the payload that a third of the pages have. Each file bears its attempt's name and counts only if the
    manifest lists it, so lost executors leave no half-written archive behind.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html"), F.lit(""))
    hashed = pages.select("page_id", "url", payload.alias("payload"), F.sha2(F.encode(payload, "UTF-8"), 256).alias("digest"))
    copied = hashed.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("_n"))
    rows = hashed.join(copied.where("_n > 1").select("digest", "first"), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get(), []
        root, begun = filesystem(folder)
        root.create_dir(begun, recursive=True)
        for batch in batches:
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if not done or done[-1].size >= _ARCHIVE:
                    if done:
                        done[-1].close()
                    done.append(_Archive(f"{folder}/pages-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.zst"))
                done[-1].add(record(page_id, url, html, digest, first, date, f"{task.partitionId()}-{len(done)}-{done[-1].records}"))
        if done:
            done[-1].close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([a.path for a in done], pa.string()), "records": pa.array([a.records for a in done], pa.int64())})

    written = rows.select("page_id", "url", F.encode("payload", "UTF-8").alias("payload"), "digest", refers)
    return stored(written.mapInArrow(write, "path string, records long"), "archives")


def read_archives(manifest: DataFrame) -> DataFrame:
    """_READ of every record of the listed archives. A response's length and digest are taken from its payload as read; a revisit's from its HTTP head and its digest field."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for fields, block in read_archive(path):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    if fields["warc-type"] == "response":
                        if (size, digest) != (len(payload), hashlib.sha256(payload).hexdigest()):
                            raise ValueError(f"a payload in {path} differs from its head")
                    rows.append((_page(fields.get("page-id")), size, digest, fields["warc-type"], _page(fields.get("refers-to-page-id"))))
                    if len(rows) == 5000:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], [x.split()[0] for x in _READ.split(", ")])

    return manifest.select("path").repartition(parts, "path").mapInArrow(read, _READ)


def op9_warc_records(spark, sf_dir: str) -> DataFrame:
    """All pages through archives and back."""
    return read_archives(write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "warc")))


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN p.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
