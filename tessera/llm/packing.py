"""Packing under a token mixture by deficit round-robin over source queues.

Every source is a queue of its documents' pieces. In each round a source gets a quantum, its share of a window's
tokens, and sends pieces while its deficit, the quanta received less the tokens sent, covers the piece at the
head; what is left is carried to the next round. A piece that ends at token e of its queue is hence sent in
round ceil(e / quantum), whatever the other queues do, so rounds need no driver loop and deficits carry across
windows and partitions alike. The stream of rounds is cut into windows, which are all full but the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import schema_of, stored, table
from tessera.llm.token_ids import TEXT_BYTES, gather, slices, token_ids, vocabulary_path


def _encoded(docs: DataFrame, keep: tuple[str, ...], vocabulary: str, end_id: int) -> DataFrame:
    """For each row of docs (_text, _queue, keep): its ids with the end id, in the vocabulary's narrowest type, and how many tokens of its queue lie ahead of it in its part of the input."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, row = token_ids(vocabulary), TaskContext.get().partitionId(), 0
        sent: dict[str, int] = {}
        for batch in batches:
            for first, texts in slices(batch.column(0), TEXT_BYTES):
                own = batch.slice(first, len(texts))
                ids, counts = encoder.encode(texts)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(encoder.dtype)
                sizes = counts + 1
                ahead = np.empty(len(texts), np.int64)
                for k, (q, n) in enumerate(zip(own.column(1).to_pylist(), sizes.tolist())):
                    ahead[k] = sent.get(q, 0)
                    sent[q] = sent.get(q, 0) + n
                out = {
                    "_row": pa.array((part << 33) + row + np.arange(len(texts))),
                    "_queue": own.column(1),
                    "_part": pa.array(np.full(len(texts), part, np.int32)),
                    "_ahead": pa.array(ahead),
                    "_n": pa.array(sizes),
                    "_ids": _binaries(ids, sizes),
                }
                yield pa.RecordBatch.from_arrays([*out.values(), *own.columns[2:]], [*out, *keep])
                row += len(texts)

    own = schema_of(docs, (), "_row long, _queue string, _part int, _ahead long, _n long, _ids binary")
    return docs.mapInArrow(encode, T.StructType([*own.fields, *(docs.schema[n] for n in keep)]))


def _binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary for each run of values."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


#: Rounds of a block, which hold a window's tokens each at most, and a bound on the number of blocks that larger blocks keep.
_BLOCK_ROUNDS, _BLOCKS = 256, 1_000_000


def _quanta(tokens: DataFrame, window: int, mixture: dict[str | None, float] | None, power: float) -> tuple[DataFrame, float]:
    """(_queue, _part, _base, _quantum): where each part of a queue begins, and the queue's tokens a round; and the last round."""
    parts = tokens.groupBy("_queue", "_part").agg(F.sum("_n").alias("_tokens"))
    queues = parts.groupBy("_queue").agg(F.sum("_tokens").alias("_all"))
    weight = F.col("_all").cast("double") if power == 1 else F.pow(F.col("_all").cast("double"), F.lit(float(power)))
    if mixture:
        total = queues.agg(F.sum(weight)).first()[0] or 1
        weight = weight / total
        for source, share in mixture.items():
            weight = F.when(F.col("_queue") == queue_name(F.lit(source)), F.lit(float(share))).otherwise(weight)
    queues = queues.withColumn("_weight", weight)
    weights = queues.agg(F.sum("_weight"), F.max(F.col("_all") / F.col("_weight"))).first()
    whole, slowest = weights[0] or 1.0, weights[1] or 0.0
    before = Window.partitionBy("_queue").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select("_queue", "_part", F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("_base"))
    quantum = queues.select("_queue", (F.col("_weight") * (window / whole)).alias("_quantum"))
    return begins.join(quantum, "_queue"), slowest * whole / window


def queue_name(source: Column) -> Column:
    """A source's queue; a null source has one too, apart from all strings."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def pack(
    docs: DataFrame, text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None,
    end_id: int = 1, window: int = 2048, piece: int = 64, mixture: dict[str | None, float] | None = None, power: float = 1.0,
) -> DataFrame:
    """Packs every row of docs into windows; one row per piece, with the kept columns of its document.

    Returns keep, sequence_id, offset (in the window, gapless from 0), start (tokens of the document before the
    piece), length, doc_tokens and ids (unsigned 32-bit little-endian). Each token of each document, its end id
    included, lies in exactly one piece.

    mixture gives sources' weights as shares of a window. Without one, and for sources that it leaves out, a
    source's weight is the given power of its tokens, as a share: at 1 the queues run dry together, below it
    small sources have more than their share of a window until they are dry. Documents are cut into
    pieces of at most ``piece`` tokens or their source's quantum, whichever is larger; up to a round, a source
    has sent its quanta but for less than a piece, which later rounds make up for. When a queue is dry the
    others go on at their own proportions.

    A null text is empty and gives its end id alone; a null source is a queue of its own. An empty table gives
    no pieces. Repeated rows are packed as often as they occur. Kept columns must not be named like the results
    or begin with an underscore; all other columns of docs may have any name.
    """
    if any(share <= 0 for share in (mixture or {}).values()):
        raise ValueError("a source's share must be positive")
    clean = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), queue_name(F.col(source)).alias("_queue"), *keep)
    tokens = stored(_encoded(clean, keep, vocabulary or vocabulary_path(), end_id), "tokens")
    width = token_ids(vocabulary or vocabulary_path()).dtype.itemsize
    quanta, rounds = _quanta(tokens, window, mixture, power)

    size = F.greatest(F.lit(piece), F.floor("_quantum")).cast("long")
    cut = tokens.select("_row", "_queue", "_part", "_ahead", "_n").join(quanta, ["_queue", "_part"])
    cut = cut.withColumn("_size", size).withColumn("_begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.col("_size"))))
    cut = cut.withColumn("_length", F.least(F.col("_size"), F.col("_n") - F.col("_begin")))
    cut = cut.withColumn("_end", F.col("_base") + F.col("_ahead") + F.col("_begin") + F.col("_length"))
    cut = cut.withColumn("_round", F.ceil(F.col("_end") / F.col("_quantum")))

    # The stream's order is (round, queue, place in the queue). Blocks of rounds are summed up, then numbered each alone.
    # A round sends a window's tokens at most, however many queues are dry by then, so no block holds more than its rounds' windows.
    cut = cut.withColumn("_block", F.floor(F.col("_round") / max(_BLOCK_ROUNDS, rounds / _BLOCKS)))
    cut = cut.select("_row", "_queue", "_begin", "_length", "_end", "_round", "_block")
    in_blocks = cut.groupBy("_block").agg(F.sum("_length").alias("_held"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    in_blocks = in_blocks.select("_block", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_first"))
    order = Window.partitionBy("_block").orderBy("_round", "_queue", "_end").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("_before", F.coalesce(F.sum("_length").over(order), F.lit(0))).join(in_blocks, "_block")
    placed = placed.withColumn("_at", F.col("_first") + F.col("_before"))

    def whole(x):
        return F.floor(x / F.lit(window)).cast("long")

    last = F.col("_at") + F.col("_length")
    placed = placed.withColumn("sequence_id", F.explode(F.sequence(whole(F.col("_at")), whole(last - 1))))
    low = F.greatest("_at", F.col("sequence_id") * window)
    high = F.least(last, (F.col("sequence_id") + 1) * window)
    one = F.struct("sequence_id", (low - F.col("sequence_id") * window).alias("offset"), (F.col("_begin") + low - F.col("_at")).alias("start"), (high - low).alias("length"))
    by_row = placed.groupBy("_row").agg(F.collect_list(one).alias("_pieces"))

    def slice_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in slices(batch.column(0)):
                own = batch.slice(first, len(held))
                data = np.frombuffer(b"".join(held.to_pylist()), f"<u{width}")
                sizes = np.asarray(own.column(1), np.int64)
                offsets = np.asarray(own.column(2).offsets)
                each = own.column(2).values.slice(offsets[0], offsets[-1] - offsets[0]).flatten()
                owner = np.repeat(np.arange(len(held)), np.diff(offsets))
                start, length = np.asarray(each[2], np.int64), np.asarray(each[3], np.int64)
                ids = gather(data, (np.cumsum(sizes) - sizes)[owner] + start, length).astype("<u4")
                kept = [c.take(pa.array(owner)) for c in own.columns[3:]]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *each, pa.array(sizes[owner]), _binaries(ids, length)],
                    [*keep, "sequence_id", "offset", "start", "length", "doc_tokens", "ids"],
                )

    schema = schema_of(clean, keep, "sequence_id long, offset long, start long, length long, doc_tokens long, ids binary")
    return tokens.join(by_row, "_row").select("_ids", "_n", "_pieces", *keep).mapInArrow(slice_ids, schema)


#: The mixture of op1: a source's target share of a window is proportional to this power of its tokens.
MIXTURE_POWER = 0.7


def op1_packed_pieces(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, mixed in proportion to the sources' tokens to the power of 0.7; one row per piece."""
    pieces = pack(table(spark, sf_dir, "documents"), keep=("doc_id", "source"), power=MIXTURE_POWER)
    crc = F.crc32("ids").cast("long").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset", "source")
