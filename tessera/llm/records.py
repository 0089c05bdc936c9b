"""Token ids in length-delimited binary record files, with an offset index beside each file.

A file is a run of frames: the data's length (unsigned 64-bit little-endian), the masked CRC-32C of these eight
bytes (32-bit), the data, and the masked CRC-32C of the data. A record's data is one flag byte (bit 0: the
document has an id; bits 4 and up: bytes of an id), the document's id (64-bit) and the token ids. The index,
``<file>.idx``, holds each frame's offset as 64 bits, so that a reader can take records in any order.

Files are written by tasks, each under a name of its own attempt; the manifest that the job returns lists the
files of the attempts that succeeded, and readers go by it. A lost executor thus leaves at most an unlisted file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import filesystem, shared_path, stored, table
from tessera.llm.crc32c import crc32c, masked
from tessera.llm.token_ids import TEXT_BYTES, slices, token_ids, vocabulary_path

_HEAD, _TAIL = 12, 4
_MANIFEST = "part int, file int, path string, records long, tokens long"


def frames(data: list[bytes]) -> list[bytes]:
    sizes = [len(x).to_bytes(8, "little") for x in data]
    ends = masked(crc32c(data)).astype("<u4")
    heads = masked(crc32c(sizes)).astype("<u4")
    return [s + h.tobytes() + x + e.tobytes() for s, h, x, e in zip(sizes, heads, data, ends)]


def serialized(doc_id: int | None, ids: np.ndarray) -> bytes:
    flag = (doc_id is not None) | ids.dtype.itemsize << 4
    return bytes([flag]) + (doc_id or 0).to_bytes(8, "little", signed=True) + ids.tobytes()


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id = int.from_bytes(data[1:9], "little", signed=True) if data[0] & 1 else None
    return doc_id, np.frombuffer(data, f"<u{data[0] >> 4}", offset=9)


def checked(heads: list[bytes], data: list[bytes], ends: list[bytes]) -> None:
    """Raises ValueError where a stored checksum differs."""
    for messages, stored_sums in (([h[:8] for h in heads], [h[8:] for h in heads]), (data, ends)):
        if len(messages) and (masked(crc32c(messages)).astype("<u4") != np.frombuffer(b"".join(stored_sums), "<u4")).any():
            raise ValueError("a record's checksum differs")


def read_file(path: str, most_bytes: int = 8 << 20) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """All records of a file in its order, in lists of about most_bytes."""
    fs, at = filesystem(path)
    with fs.open_input_stream(at, buffer_size=1 << 20) as f:
        heads, data, ends, held = [], [], [], 0
        while head := f.read(_HEAD):
            heads.append(head)
            data.append(f.read(int.from_bytes(head[:8], "little")))
            ends.append(f.read(_TAIL))
            held += len(data[-1])
            if held >= most_bytes:
                checked(heads, data, ends)
                yield [parsed(x) for x in data]
                heads, data, ends, held = [], [], [], 0
        checked(heads, data, ends)
        yield [parsed(x) for x in data]


def read_shuffled(path: str, order: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of these numbers, in this order, by way of the index."""
    fs, at = filesystem(path)
    with fs.open_input_file(at + ".idx") as f:
        offsets = np.frombuffer(f.read(), "<u8")
    with fs.open_input_file(at) as f:
        for k in order:
            f.seek(int(offsets[k]))
            head = f.read(_HEAD)
            data = f.read(int.from_bytes(head[:8], "little"))
            checked([head], [data], [f.read(_TAIL)])
            yield parsed(data)


class _File:
    def __init__(self, path: str):
        self.path, (self.fs, self.at) = path, filesystem(path)
        self.stream, self.offsets, self.size, self.tokens = self.fs.open_output_stream(self.at), [], 0, 0

    def add(self, data: list[bytes], tokens: int) -> None:
        for x in frames(data):
            self.offsets.append(self.size)
            self.stream.write(x)
            self.size += len(x)
        self.tokens += tokens

    def close(self) -> None:
        self.stream.close()
        with self.fs.open_output_stream(self.at + ".idx") as f:
            f.write(np.array(self.offsets, "<u8").tobytes())


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int, file_bytes: int = 256 << 20) -> DataFrame:
    """Writes docs (doc_id, text) in ascending order of doc_id; returns the manifest, one row per file in that order.

    Null texts are empty, a null doc_id comes first, and rows of one doc_id follow the hash of their texts. The
    texts are dealt out by ranges of doc_id before they are encoded, so each is encoded once; rows with the same
    id and text are dealt out by their place in the input, so repeated rows don't meet in one task. An empty table
    gives an empty manifest. Columns beside these two may have any name.
    """
    columns = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = columns.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    in_order = keyed.repartitionByRange("doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "_row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = token_ids(vocabulary), TaskContext.get()
        root, begun = filesystem(folder)
        root.create_dir(begun, recursive=True)
        part, name, done = task.partitionId(), f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}", []
        for batch in batches:
            for first, texts in slices(batch.column(1), TEXT_BYTES):
                ids, counts = encoder.encode(texts)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(encoder.dtype)
                ends = np.cumsum(counts + 1)
                doc_ids = batch.column(0).slice(first, len(texts)).to_pylist()
                data = [serialized(d, ids[e - n - 1 : e]) for d, n, e in zip(doc_ids, counts.tolist(), ends.tolist())]
                if not done or done[-1].size >= file_bytes:
                    if done:
                        done[-1].close()
                    done.append(_File(f"{name}-{len(done):04d}.rec"))
                done[-1].add(data, len(ids))
        if done:
            done[-1].close()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part] * len(done), pa.int32()), "file": pa.array(range(len(done)), pa.int32()),
            "path": pa.array([f.path for f in done], pa.string()), "records": pa.array([len(f.offsets) for f in done], pa.int64()),
            "tokens": pa.array([f.tokens for f in done], pa.int64()),
        })

    return stored(in_order.drop("_hash", "_row").mapInArrow(write, _MANIFEST), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), ids (unsigned 32-bit little-endian) of every record, read from the files."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("path", "start")
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for records in read_file(path):
                    counts = np.array([len(ids) for _, ids in records], np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([d for d, _ in records], pa.int64()),
                        "start": pa.array(start + np.cumsum(counts) - counts, pa.int64()),
                        "ids": pa.array([ids.astype("<u4").tobytes() for _, ids in records], pa.binary()),
                    })
                    start += int(counts.sum())

    return files.repartition(parts, "path").mapInArrow(read, "doc_id long, start long, ids binary")


def op10_record_files(spark, sf_dir: str) -> DataFrame:
    """All documents through record files and back: where each begins, its token count and checksum, with the end id 2."""
    docs = table(spark, sf_dir, "documents")
    manifest = write_records(docs, shared_path(spark, "records"), vocabulary_path(), end_id=2)
    ids = F.col("ids")
    return read_records(manifest).select(
        "doc_id", "start", F.floor(F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.crc32(ids).cast("long").alias("ids_crc32")
    )
