"""Token-id files under a static range asymmetric numeral system.

A segment holds the ids of consecutive documents. Its frequency table is shared by all its
blocks; every block is coded on its own by ``LANES`` interleaved states, and a checkpoint
names each block's place, length and checksum, so blocks can be decoded in any order. All
lanes of all blocks advance together as one vector.

Layout of a segment, little-endian: magic (4 bytes), ids, blocks, steps a block, distinct
ids, documents (5 x u4); distinct ids (u4) and their frequencies (u4); document ids (i8),
null marks (u1) and lengths (u4); checkpoints (u8 first word, u4 words, u4 CRC-32 of a
block's states and words); states (u8 a lane); words (u4); CRC-32 of all before it (u4).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartergrid.llm.tokens import with_end, worker_tokens
from quartergrid.llm.words import slices
from quartergrid.session import shared_folder

MAGIC = b"QGR1"
END_ID = 1
LANES = 32
BLOCK_IDS = 1 << 16
SEGMENT_IDS = 4 << 20
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
CHECKPOINT = np.dtype([("word", "<u8"), ("words", "<u4"), ("crc", "<u4")])


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their shares of ``2**SCALE_BITS``, each 1 at least."""
    present, counts = np.unique(ids, return_counts=True)
    total = 1 << SCALE_BITS
    if len(present) > total:
        raise ValueError(f"a segment may hold {total} distinct ids, found {len(present)}")
    shares = 1 + counts * (total - len(present)) // max(len(ids), 1)
    left = total - int(shares.sum())
    if left and len(present):
        shares[np.argsort(-counts, kind="stable")[np.arange(left) % len(present)]] += 1
    return present, shares


def encode_segment(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """Bytes of one segment; ``lengths`` of the documents sum to the number of ids."""
    n = len(ids)
    blocks = max(-(-n // BLOCK_IDS), 1)
    steps = -(-n // (blocks * LANES))
    present, shares = frequencies(ids)
    starts = np.cumsum(shares) - shares
    padded = np.full(blocks * steps * LANES, present[np.argmax(shares)] if n else 0, np.int64)
    padded[:n] = ids
    ranks = np.searchsorted(present, padded).reshape(blocks, steps, LANES)
    freq, first = shares.astype(np.uint64), starts.astype(np.uint64)
    limit = freq << np.uint64(31 - SCALE_BITS + 32)
    states = np.full((blocks, LANES), LOW)
    words = np.zeros((steps, blocks, LANES), "<u4")
    written = np.zeros((steps, blocks, LANES), bool)
    for step in range(steps - 1, -1, -1):
        rank = ranks[:, step]
        wide = states >= limit[rank]
        words[step][wide] = states[wide].astype("<u4")
        written[step] = wide
        states = np.where(wide, states >> WORD, states)
        f = freq[rank]
        q = states // f
        states = (q << np.uint64(SCALE_BITS)) + (states - q * f) + first[rank]
    points = np.zeros(blocks, CHECKPOINT)
    streams, at = [], 0
    for block in range(blocks):
        own = words[:, block][written[:, block]]
        points[block] = at, len(own), _block_crc(states[block], own)
        streams.append(own.tobytes())
        at += len(own)
    nulls = np.array([d is None for d in doc_ids], "u1")
    body = b"".join(
        [
            MAGIC,
            np.array([n, blocks, steps, len(present), len(doc_ids)], "<u4").tobytes(),
            present.astype("<u4").tobytes(),
            shares.astype("<u4").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            nulls.tobytes(),
            np.asarray(lengths, "<u4").tobytes(),
            points.tobytes(),
            states.astype("<u8").tobytes(),
            *streams,
        ]
    )
    return body + np.array([zlib.crc32(body)], "<u4").tobytes()


def _block_crc(states: np.ndarray, words: np.ndarray) -> int:
    return zlib.crc32(words.astype("<u4").tobytes(), zlib.crc32(states.astype("<u8").tobytes()))


def decode_segment(data: bytes, only: list[int] | None = None) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """Ids, document ids and lengths of a segment; with ``only``, the ids of those blocks alone."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    if only is None and zlib.crc32(data[:-4]) != np.frombuffer(data[-4:], "<u4")[0]:
        raise ValueError("segment checksum differs")
    at = 4

    def take(kind, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    n, blocks, steps, distinct, documents = map(int, take("<u4", 5))
    present, shares = take("<u4", distinct), take("<u4", distinct)
    doc_ids, nulls, lengths = take("<i8", documents), take("u1", documents), take("<u4", documents)
    points, states = take(CHECKPOINT, blocks), take("<u8", blocks * LANES).reshape(blocks, LANES)
    words = np.frombuffer(data[at:-4], "<u4")
    chosen = np.arange(blocks) if only is None else np.asarray(only)
    for block in chosen:
        own = words[int(points["word"][block]) :][: int(points["words"][block])]
        if _block_crc(states[block], own) != points["crc"][block]:
            raise ValueError(f"checksum of block {block} differs")
    ids = _decode(words, points["word"][chosen].astype(np.int64), states[chosen], steps, present, shares)
    if only is None:
        ids = ids.reshape(-1)[:n]
    return ids, [None if z else int(d) for d, z in zip(doc_ids, nulls)], lengths.astype(np.int64)


def _decode(words, place, states, steps, present, shares) -> np.ndarray:
    starts = (np.cumsum(shares.astype(np.int64)) - shares).astype(np.uint64)
    slots = np.repeat(np.arange(len(shares), dtype=np.int32), shares)
    freq = shares.astype(np.uint64)
    mask = np.uint64((1 << SCALE_BITS) - 1)
    words = np.append(words, np.zeros(1, "<u4")).astype(np.uint64)
    out = np.empty((len(place), steps, LANES), np.uint32)
    for step in range(steps):
        slot = states & mask
        rank = slots[slot.astype(np.int64)]
        out[:, step] = present[rank]
        states = freq[rank] * (states >> np.uint64(SCALE_BITS)) + slot - starts[rank]
        low = states < LOW
        ahead = np.cumsum(low, axis=1)
        index = np.where(low, place[:, None] + ahead - 1, len(words) - 1)
        states = np.where(low, (states << WORD) | words[index], states)
        place = place + ahead[:, -1]
    return out


SEGMENTS = "segment long, n_ids long, n_docs long, data binary"
DECODED = "segment long, doc_id long, local_start long, n_tokens long, ids binary"


def encode_table(
    docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID
) -> DataFrame:
    """Segments of all documents in ascending id order; ``segment`` rises in that order.

    Sampled splitters range-partition the documents by id, null first. Null and empty
    texts are documents of ``end_id`` alone; repeated rows are kept side by side; other
    columns are not read; an empty table gives no rows. A segment ends at the first
    document's end past ``SEGMENT_IDS`` ids, which bounds a task's memory.
    """
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_tokens(tokenizer_path)
        number = TaskContext.get().partitionId() << 32
        held_ids, held_docs, held_lengths = [], [], []

        def segment() -> pa.RecordBatch:
            nonlocal held_ids, held_docs, held_lengths, number
            ids, lengths = np.concatenate(held_ids), np.concatenate(held_lengths)
            data = encode_segment(ids, held_docs, lengths)
            row = [[number], [len(ids)], [len(held_docs)], [data]]
            held_ids, held_docs, held_lengths = [], [], []
            number += 1
            return pa.RecordBatch.from_arrays(
                [*map(pa.array, row[:3]), pa.array(row[3], pa.binary())], ["segment", "n_ids", "n_docs", "data"]
            )

        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = with_end(*encoder.ids(part["text"]), end_id)
                held_ids.append(ids)
                held_lengths.append(counts)
                held_docs.extend(part["doc_id"].to_pylist())
                if sum(map(len, held_ids)) >= SEGMENT_IDS:
                    yield segment()
        if held_docs:
            yield segment()

    return ordered.mapInArrow(tasks, SEGMENTS)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    """Write the token files of ``docs`` under ``path``."""
    segments = encode_table(docs, tokenizer_path, **options)
    segments.write.mode("overwrite").option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Decode token files: one row per document with its place and its ids (little-endian u4)."""
    files = spark.read.parquet(path)
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = files.select("segment", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch["segment"].to_pylist(), batch["data"]):
                yield _decoded(key, data.as_py())

    documents = files.select("segment", "data").mapInArrow(tasks, DECODED)
    return documents.join(places, "segment").select(
        "doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def _decoded(key: int, data: bytes) -> pa.RecordBatch:
    ids, doc_ids, lengths = decode_segment(data)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
    packed = pa.Array.from_buffers(
        pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))]
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(lengths), key, np.int64)),
            pa.array(doc_ids, pa.int64()),
            pa.array(starts.astype(np.int64)),
            pa.array(lengths.astype(np.int64)),
            packed,
        ],
        ["segment", "doc_id", "local_start", "n_tokens", "ids"],
    )


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again."""
    path = fresh_path(frame.sparkSession, name)
    # Writers hold a row group in memory, so it is kept small.
    frame.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return frame.sparkSession.read.parquet(path)


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path)
    read = read_tokens(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
