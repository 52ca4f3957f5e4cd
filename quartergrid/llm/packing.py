"""Pack token sequences under simultaneous limits by vector bin packing.

A piece has three sizes: tokens, one segment, and loss-bearing tokens. The open sequence
takes the piece with the largest dot product between the piece's sizes and the room left,
both as shares of the limits. When no whole piece fits, the best one is cut to the room.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartergrid.llm.tokens import worker_tokens
from quartergrid.llm.words import SLICE_BYTES, give_back, slices

END_ID = 2
WINDOW = 1024


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 128
    loss_tokens: int = 4096

    def room(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], float)


@dataclass
class Piece:
    """Part of a document: ids, its place, and how many ids at its front bear no loss."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    prompt: int
    doc_tokens: int

    def sizes(self) -> tuple[int, int, int]:
        return len(self.ids), 1, len(self.ids) - self.prompt

    def cut(self, at: int) -> tuple[Piece, Piece]:
        front = Piece(self.doc_id, self.start, self.ids[:at], min(self.prompt, at), self.doc_tokens)
        rest = Piece(self.doc_id, self.start + at, self.ids[at:], max(self.prompt - at, 0), self.doc_tokens)
        return front, rest


@dataclass
class Packer:
    """Packs the pieces of one task in windows; only an open sequence passes from window to window."""

    limits: Limits
    waiting: list[Piece] = field(default_factory=list)
    open: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Cut off full sequences of a long document and keep the rest for a window."""
        while len(piece.ids) >= self.limits.tokens:
            at = self._longest(piece, self.limits.room())
            front, piece = piece.cut(at)
            yield [front]
        if len(piece.ids):
            self.waiting.append(piece)
        if len(self.waiting) >= WINDOW:
            yield from self._pack()

    def finish(self) -> Iterator[list[Piece]]:
        """Pack what is left; the last open sequence is cut to powers of two, which take no padding."""
        yield from self._pack()
        rest, self.open = self.open, []
        while rest:
            size = 1 << (sum(len(p.ids) for p in rest).bit_length() - 1)
            size, now = min(size, self.limits.tokens), []
            while size:
                piece = rest.pop(0)
                if len(piece.ids) > size:
                    piece, behind = piece.cut(size)
                    rest.insert(0, behind)
                now.append(piece)
                size -= len(piece.ids)
            yield now

    @staticmethod
    def _longest(piece: Piece, room: np.ndarray) -> int:
        """Ids from the piece's front that fit into the room."""
        return int(min(len(piece.ids), room[0], piece.prompt + room[2])) if room[1] >= 1 else 0

    def _pack(self) -> Iterator[list[Piece]]:
        pieces, self.waiting = self.waiting, []
        full = self.limits.room()
        sizes = np.array([p.sizes() for p in pieces], float).reshape(-1, 3)
        shares = sizes / full
        left = np.ones(len(pieces), bool)
        room = full - sum((np.array(p.sizes()) for p in self.open), np.zeros(3))
        for _ in iter(left.any, False):
            products = shares @ (room / full)
            fits = left & (sizes <= room).all(axis=1)
            whole = fits.any()
            at = int(np.argmax(np.where(fits if whole else left, products, -1.0)))
            if whole:
                self.open.append(pieces[at])
                room -= sizes[at]
                left[at] = False
            elif length := self._longest(pieces[at], room):
                front, pieces[at] = pieces[at].cut(length)
                self.open.append(front)
                sizes[at] = pieces[at].sizes()
                shares[at] = sizes[at] / full
            if not whole or room[0] < 1 or room[1] < 1:
                yield self.open
                self.open, room = [], full.copy()


SCHEMA = (
    "doc_id long, start long, length long, prompt_tokens long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    limits: Limits = Limits(),
    doc_id: str = "doc_id",
    text: str = "text",
    prompt: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Sequences of token ids, one row per piece of a document.

    A document is the ids of its prompt (none unless a column is named), those of its
    text, and ``end_id``; prompt ids bear no loss. Every task packs its own split of the
    table, so nothing is shuffled and memory holds one window of pieces. Each id lies in
    exactly one piece. A sequence holds at most ``limits``; it is shorter than
    ``limits.tokens`` only where another limit is met first, or as a power of two at the
    end of a task's split. Null and empty texts are documents of the end id alone; repeated
    rows are packed each; a null id stays null; other columns are not read; an empty table
    gives no rows. ``sequence_id`` is unique, not dense. ``ids`` are little-endian unsigned
    32-bit integers.
    """
    prompts = F.coalesce(docs[prompt].cast("string"), F.lit("")) if prompt else F.lit("")
    rows = docs.select(
        docs[doc_id].cast("long").alias("doc_id"),
        prompts.alias("prompt"),
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"),
    )

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(batches, TaskContext.get().partitionId() << 33, tokenizer_path, limits, end_id)

    return rows.mapInArrow(tasks, SCHEMA)


def packed(
    batches: Iterator[pa.RecordBatch], number: int, path: str, limits: Limits, end_id: int
) -> Iterator[pa.RecordBatch]:
    """The sequences of one task's rows, numbered from ``number``; memory freed by a slice is returned before the next."""
    packer = Packer(limits)
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES // 4):
            ready = [s for piece in _pieces(part, path, end_id) for s in packer.add(piece)]
            if ready:
                yield _rows(ready, number)
                number += len(ready)
            del ready
            give_back()
    ready = list(packer.finish())
    if ready:
        yield _rows(ready, number)


def _pieces(part: pa.RecordBatch, path: str, end_id: int) -> Iterator[Piece]:
    encoder = worker_tokens(path)
    ids, counts = encoder.ids(part["text"])
    has_prompt = bool(pc.any(pc.greater(pc.binary_length(part["prompt"]), 0)).as_py())
    before, prompts = encoder.ids(part["prompt"]) if has_prompt else (ids[:0], counts * 0)
    at, prompt_at, end = 0, 0, np.array([end_id], "<u4")
    for key, n, m in zip(part["doc_id"].to_pylist(), counts.tolist(), prompts.tolist()):
        own = np.concatenate([before[prompt_at : prompt_at + m], ids[at : at + n], end])
        at, prompt_at = at + n, prompt_at + m
        yield Piece(key, 0, own, m, len(own))


def _rows(sequences: list[list[Piece]], number: int) -> pa.RecordBatch:
    pieces = [p for s in sequences for p in s]
    lengths = [len(p.ids) for p in pieces]
    places = [np.cumsum([0] + [len(p.ids) for p in s[:-1]]) for s in sequences]
    columns = {
        "doc_id": pa.array([p.doc_id for p in pieces], pa.int64()),
        "start": pa.array([p.start for p in pieces], pa.int64()),
        "length": pa.array(lengths, pa.int64()),
        "prompt_tokens": pa.array([p.prompt for p in pieces], pa.int64()),
        "doc_tokens": pa.array([p.doc_tokens for p in pieces], pa.int64()),
        "sequence_id": pa.array(np.repeat(number + np.arange(len(sequences)), [len(s) for s in sequences])),
        "offset": pa.array(np.concatenate(places).astype(np.int64)),
        "ids": pa.array([p.ids.astype("<u4").tobytes() for p in pieces], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)


def with_crc(pieces: DataFrame) -> DataFrame:
    """Add the unsigned CRC-32 of each piece's ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids"))
