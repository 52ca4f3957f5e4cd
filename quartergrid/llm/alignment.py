"""Group the tokens that two tokenizers give a text, and measure which token ids belong together.

Every token points to its farthest-right overlapping token of the other side; doubling the
successors leads each token to the last one of its component, where both tokens end
together. Equal stretches of text are aligned once per slice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quartergrid.llm.joins import sized
from quartergrid.llm.tally import Tally, as_batch
from quartergrid.llm.token_files import stored
from quartergrid.llm.tokens import _byte_letters
from quartergrid.llm.words import gather, slices, sums
from quartergrid.session import durable

# A space between two other characters: no token of either side reaches across it.
CUT = re.compile(r"(?<=\S) (?=\S)")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
SPACE_MARK = "▁"
SLICE = 1 << 20
# Encodings take far more memory than their ids.
AT_ONCE = 16


@dataclass(frozen=True)
class Side:
    """Bytes of each token id: all in one pool, by start and length."""

    pool: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Side:
        lengths = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.pool, self.starts[ids], self.lengths[ids])


class TokenizerPair:
    """A byte-level tokenizer (A) and a sentence-piece model (B) that adds a space of its own.

    Where the pieces of B hold a space mark behind other characters, texts are not cut.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {letter: byte for byte, letter in enumerate(_byte_letters())}
        entries = sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=True).items())
        spelled = [b""] * (entries[-1][0] + 1)
        for i, token in entries:
            known = all(letter in letters for letter in token)
            spelled[i] = bytes(letters[letter] for letter in token) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.side_a = Side.of(spelled)
        self.side_b = Side.of([self._piece(p) for p in pieces])
        self.cuts = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = BYTE_PIECE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE_MARK, " ").encode()

    def stretches(self, text: str) -> list[str]:
        """Parts whose tokens are the same alone as inside the text, without their first space."""
        return CUT.split(text) if self.cuts else [text]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides for every text."""
        for first in range(0, len(texts), AT_ONCE):
            some = texts[first : first + AT_ONCE]
            a = self.a.encode_batch_fast([" " + t for t in some], add_special_tokens=False)
            for left, right in zip(a, self.b.encode(some, num_threads=1)):
                yield np.array(left.ids, np.int32), np.array(right, np.int32)


@lru_cache(maxsize=1)
def worker_pair(path_a: str, path_b: str) -> TokenizerPair:
    """The two tokenizers of this Python worker; no texts are kept."""
    return TokenizerPair(path_a, path_b)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A and B token, the A token at which its component ends.

    Both sides must cover the same bytes with non-empty tokens; ``ends`` are their end offsets.
    """
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a)
    over_b = np.searchsorted(ends_a, ends_b)
    together = ends_b[over_a] == ends_a
    points_to = np.concatenate([np.where(together, np.arange(n), n + over_a), over_b])
    while not np.array_equal(farther := points_to[points_to], points_to):
        points_to = farther
    return points_to[:n], points_to[n:]


@dataclass
class Aligned:
    """Distinct stretches with their groups, and the documents' stretches in order."""

    codes: np.ndarray  # stretches of all documents, one after the other
    counts: np.ndarray  # stretches per document; 0 where it has no tokens
    n_a: np.ndarray
    n_b: np.ndarray
    ids_a: np.ndarray  # of all stretches, in order
    ids_b: np.ndarray
    group_a: np.ndarray  # group of each token, numbered through
    group_b: np.ndarray
    n_groups: np.ndarray  # per stretch

    def links(self) -> np.ndarray:
        """The id pair at which each group ends: ``a << 32 | b``."""
        last_a = np.flatnonzero(np.diff(self.group_a, append=-1))
        last_b = np.flatnonzero(np.diff(self.group_b, append=-1))
        return (self.ids_a[last_a].astype(np.int64) << 32) | self.ids_b[last_b].astype(np.int64)

    def written(self) -> list[bytes]:
        """Each stretch's groups as ``a1,a2|b1;a3|b2,b3;``."""
        ids = np.concatenate([self.ids_a, self.ids_b])
        group = np.concatenate([self.group_a, self.group_b])
        is_b = np.arange(len(ids)) >= len(self.ids_a)
        # Stable, so a group's A tokens stay before its B tokens, and both in order.
        order = np.argsort(group, kind="stable")
        ids, group, is_b = ids[order], group[order], is_b[order]
        last = np.diff(group, append=-1) != 0
        turns = np.append(is_b[1:] != is_b[:-1], [True]) & ~last if len(ids) else last
        numbers = [b"%d " % i for i in range(int(ids.max(initial=-1)) + 1)]
        pool = Side.of(numbers)
        letters = pool.spelled(ids)
        ends = np.cumsum(pool.lengths[ids])
        letters[ends - 1] = np.where(last, ord(";"), np.where(turns, ord("|"), ord(",")))
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        whole = letters.tobytes()
        return [whole[start:stop] for start, stop in zip(bounds, bounds[1:])]


def _runs(pair: TokenizerPair, texts: list[str], within: list[list[int]]) -> Iterator[list[tuple[np.ndarray, np.ndarray]] | None]:
    """Both sides of each text as ids and the ids in each of its stretches, or None where they do not spell it.

    ``within`` has the byte offsets, behind the added space, at which a text's stretches end.
    """
    for text, stops, sides in zip(texts, within, pair.encode(texts)):
        wanted, found = b" " + text.encode(), []
        for side, ids in zip((pair.side_a, pair.side_b), sides):
            ends = np.cumsum(side.lengths[ids])
            if side.spelled(ids).tobytes() != wanted:
                break
            last = np.searchsorted(ends, stops)
            if not np.array_equal(ends[last], stops):
                break
            found.append((ids, np.diff(last + 1, prepend=0)))
        yield found if len(found) == 2 else None


NOTHING = (np.zeros(0, np.int32), np.zeros(1, np.int64))
TOGETHER = 256


def _encoded(pair: TokenizerPair, plain: pa.Array, whole: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Ids and ids per stretch of both sides, ``plain`` stretches first, and which of all are spelled out.

    Plain stretches are encoded ``TOGETHER``, which gives them the same tokens as alone.
    """
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = []
    good: list[bool] = []

    def alone(texts: list[str]) -> None:
        for run in _runs(pair, texts, [[len(t.encode()) + 1] for t in texts]):
            parts.append(run or [NOTHING, NOTHING])
            good.append(run is not None)

    chunks = [plain.slice(i, TOGETHER) for i in range(0, len(plain), TOGETHER)]
    stops = [np.cumsum(pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) + 1) for c in chunks]
    for chunk, run in zip(chunks, _runs(pair, [" ".join(c.to_pylist()) for c in chunks], stops)):
        if run is None:
            alone(chunk.to_pylist())
        else:
            parts.append(run)
            good.extend([True] * len(chunk))
    alone(whole)
    sides = zip(*parts) if parts else ([NOTHING], [(NOTHING[0], NOTHING[0])])
    return [tuple(np.concatenate(x) for x in zip(*side)) for side in sides], np.array(good, bool)


def align(pair: TokenizerPair, texts: list[str | None]) -> Aligned:
    """Align both sides' tokens of every text.

    A text that is null, empty, or not spelled out by both sides has no tokens. Where only
    a stretch fails, the whole text decides.
    """
    parts = [pair.stretches(t) if t else [] for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    coded = pa.array([s for p in parts for s in p], pa.large_string()).dictionary_encode()
    codes, stretches = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    # Beside outer white space a stretch could change its neighbours' tokens. Only a text's ends have any.
    odd = np.full(len(stretches), not pair.cuts)
    ends = np.cumsum(counts)
    for own, start, end in zip(parts, (ends - counts).tolist(), ends.tolist()):
        if own and own[0][0].isspace():
            odd[codes[start]] = True
        if own and own[-1][-1].isspace():
            odd[codes[end - 1]] = True
    del parts
    order = np.argsort(odd, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[codes]
    sides, good = _encoded(pair, stretches.filter(pa.array(~odd)), stretches.filter(pa.array(odd)).to_pylist())
    fails = sums((~good)[codes].astype(np.int64), counts) > 0
    if fails.any():
        rows = np.flatnonzero(fails)
        more, spared = _encoded(pair, pa.array([], pa.large_string()), [texts[i] for i in rows])
        kept = codes[np.repeat(~fails, counts)]
        counts[rows] = 0
        places = np.cumsum(counts)[rows]
        codes = np.insert(kept, places[spared], len(good) + np.flatnonzero(spared))
        counts[rows[spared]] = 1
        sides = [tuple(np.concatenate(x) for x in zip(*both)) for both in zip(sides, more)]
    (ids_a, n_a), (ids_b, n_b) = sides
    ends_a, ends_b = np.cumsum(pair.side_a.lengths[ids_a]), np.cumsum(pair.side_b.lengths[ids_b])
    last_a, last_b = terminals(ends_a, ends_b)
    # Terminals ascend with the text and are the same on both sides, so a group's number is that of its run.
    group_a, group_b = (np.cumsum(np.diff(last, prepend=last[:1]) != 0) for last in (last_a, last_b))
    n_groups = sums((np.diff(group_a, append=-1) != 0).astype(np.int64), n_a)
    return Aligned(codes, counts, n_a, n_b, ids_a, ids_b, group_a, group_b, n_groups)


# The links of a text are one value, eight bytes each (``a << 32 | b``): an array would be copied number by
# number whenever it is written or read.
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
LINK = np.dtype("<i8")


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sizes of every text's groups, and the ids of each link in order: the last of a group on both sides."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = align(worker_pair(path_a, path_b), part["text"].to_pylist())
                yield _measured(found, part["doc_id"], row)
                row += part.num_rows

    return rows.mapInArrow(tasks, ALIGNED)


def _measured(found: Aligned, doc_ids: pa.Array, row: int) -> pa.RecordBatch:
    links = found.links()
    starts = np.cumsum(found.n_groups) - found.n_groups
    own = gather(links, starts[found.codes], found.n_groups[found.codes])

    def per_doc(each: np.ndarray) -> np.ndarray:
        return sums(each[found.codes].astype(np.int64), found.counts)

    written, codes, hashes, at = found.written(), found.codes.tolist(), [], 0
    for count in found.counts.tolist():
        mine = b"".join([written[c] for c in codes[at : at + count]])
        hashes.append(hashlib.sha256(mine[:-1]).hexdigest() if count else "")
        at += count
    n_groups = per_doc(found.n_groups)
    offsets = (LINK.itemsize * np.concatenate([[0], np.cumsum(n_groups)])).astype(np.int32)
    columns = {
        "row": pa.array(row + np.arange(len(found.counts))),
        "doc_id": doc_ids,
        "n_a": pa.array(per_doc(found.n_a)),
        "n_b": pa.array(per_doc(found.n_b)),
        "n_groups": pa.array(n_groups),
        "groups_sha256": pa.array(hashes, pa.string()),
        "links": pa.Array.from_buffers(
            pa.binary(), len(n_groups), [None, pa.py_buffer(offsets), pa.py_buffer(own.astype(LINK))]
        ),
    }
    return pa.RecordBatch.from_pydict(columns)


def _portions(batch: pa.RecordBatch, links: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many links; a longer text stands alone."""
    ends = np.cumsum(pc.binary_length(batch["links"]).to_numpy(zero_copy_only=False) // LINK.itemsize)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, before + links, side="right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


def _link_keys(batch: pa.RecordBatch) -> np.ndarray:
    packed = batch["links"].cast(pa.binary())
    _, offsets, values = packed.buffers()
    places = np.frombuffer(offsets, np.int32)[packed.offset : packed.offset + len(packed) + 1] // LINK.itemsize
    return np.frombuffer(values or b"", LINK)[places[0] : places[-1]]


def pair_counts(links: DataFrame) -> DataFrame:
    """``key, a, b, n, best`` of all id pairs of ``aligned`` rows.

    ``key`` is ``a << 32 | b``, ``n`` how many links hold the pair, and ``best`` whether no
    pair of the same B id has more. The ``n`` add up to all links. Without tokens there are
    no rows.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in _portions(batch):
                keys, n = np.unique(_link_keys(part), return_counts=True)
                for found, summed in tally.add(keys, n):
                    yield as_batch({"key": found, "n": summed[:, 0]})
        for found, summed in tally.finish():
            yield as_batch({"key": found, "n": summed[:, 0]})

    counted = durable(links.select("links").mapInArrow(tasks, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    b = F.col("key").bitwiseAND(0xFFFFFFFF)
    counted = counted.select("key", F.shiftright("key", 32).alias("a"), b.alias("b"), "n")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))  # one row per id of B
    return durable(counted.join(sized(most), "b").select("key", "a", "b", "n", (F.col("n") == F.col("most")).alias("best")))


FOUND = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
    "count_sum long, groups_sha256 string, tail array<long>"
)


def alignment_digest(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    doc_id: str = "doc_id",
    text: str = "text",
    head: int = 1_000_000,
) -> DataFrame:
    """Tokens, groups and links of every document, with the corpus-wide counts of its links.

    ``head`` bounds the counts held in memory by each worker: the most frequent id pairs. Links
    of other pairs are joined with their counts on the pair, which none of them can dominate.
    A text that is null, empty, or not spelled out by both tokenizers has zeros and an empty
    ``groups_sha256``. Repeated rows are measured each, a null id stays null, other columns
    are not read, and an empty table gives no rows. The links are written to the shared
    folder once.
    """
    links = stored(aligned(docs, path_a, path_b, doc_id, text), "token-links")
    pairs = pair_counts(links)
    all_fit = pairs.count() <= head
    first = pairs if all_fit else pairs.orderBy(F.desc("n"), "key").limit(head)
    held = first.select("key", "n", "best").toArrow()
    keys = held["key"].to_numpy()
    order = np.argsort(keys)
    known = docs.sparkSession.sparkContext.broadcast(
        (keys[order], held["n"].to_numpy()[order], held["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64))
    )

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch):
                yield _counted(part, *known.value)

    digest = links.mapInArrow(tasks, FOUND)
    if all_fit:
        return digest.drop("row", "tail")
    digest = stored(digest, "token-digest")
    late = (
        digest.select("row", F.explode("tail").alias("key"))
        .join(pairs, "key")
        .groupBy("row")
        .agg(F.sum("n").alias("late_sum"), F.count_if("best").alias("late_best"))
    )
    added = {
        "count_sum": F.col("count_sum") + F.coalesce("late_sum", F.lit(0)),
        "n_best": F.col("n_best") + F.coalesce("late_best", F.lit(0)),
    }
    return digest.join(late, "row", "left").withColumns(added).drop("row", "tail", "late_sum", "late_best")


def _counted(batch: pa.RecordBatch, keys: np.ndarray, counts: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    links = _link_keys(batch)
    each = batch["n_groups"].to_numpy()
    own, back = np.unique(links, return_inverse=True)
    at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
    held = keys[at] == own if len(keys) else np.zeros(len(own), bool)
    n, is_best = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    n[held], is_best[held] = counts[at[held]], best[at[held]]
    late = ~held[back]
    tail_ends = np.concatenate([[0], np.cumsum(sums(late.astype(np.int64), each))]).astype(np.int32)
    columns = {c: batch[c] for c in ("row", "doc_id", "n_a", "n_b", "n_groups")}
    columns |= {
        "n_links": batch["n_groups"],
        "n_best": pa.array(sums(is_best[back], each)),
        "count_sum": pa.array(sums(n[back], each)),
        "groups_sha256": batch["groups_sha256"],
        "tail": pa.ListArray.from_arrays(pa.array(tail_ends), pa.array(links[late])),
    }
    return pa.RecordBatch.from_pydict(columns)


GROUPS = "doc_id long, group long, ids_a array<int>, ids_b array<int>, start long, bytes long"


def token_groups(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The groups themselves: ids of both sides and the place in the space and text, in bytes.

    Texts without tokens give no rows; other edges are those of :func:`alignment_digest`.
    """
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = worker_pair(path_a, path_b)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield _group_rows(pair, align(pair, part["text"].to_pylist()), part["doc_id"])

    return rows.mapInArrow(tasks, GROUPS)


def _group_rows(pair: TokenizerPair, found: Aligned, doc_ids: pa.Array) -> pa.RecordBatch:
    total = int(found.n_groups.sum())
    size_a, size_b = np.bincount(found.group_a, minlength=total), np.bincount(found.group_b, minlength=total)
    width = np.bincount(found.group_a, pair.side_a.lengths[found.ids_a], total).astype(np.int64)
    first = np.cumsum(found.n_groups) - found.n_groups
    pick = gather(np.arange(total), first[found.codes], found.n_groups[found.codes])
    per_doc = sums(found.n_groups[found.codes], found.counts)
    owner = np.repeat(np.arange(len(per_doc)), per_doc)
    ends = np.cumsum(width[pick])
    doc_first = np.cumsum(per_doc) - per_doc

    def lists(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        values = gather(ids, (np.cumsum(sizes) - sizes)[pick], sizes[pick])
        offsets = np.concatenate([[0], np.cumsum(sizes[pick])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))

    before = np.concatenate([[0], ends])[doc_first]
    columns = {
        "doc_id": doc_ids.take(pa.array(owner)),
        "group": pa.array(np.arange(len(pick)) - doc_first[owner]),
        "ids_a": lists(found.ids_a, size_a),
        "ids_b": lists(found.ids_b, size_b),
        "start": pa.array(ends - width[pick] - before[owner]),
        "bytes": pa.array(width[pick]),
    }
    return pa.RecordBatch.from_pydict(columns)
