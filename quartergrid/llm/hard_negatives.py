"""Hard negatives of anchors by a secondary sort on (anchor, descending score, id).

Tasks score their rows against the anchors in blocks and keep only pairs that can still
count. The shuffle sorts the packed keys inside each partition, so one pass per anchor, best
score first, meets each positive before every negative of its window: the iterator opens a
window there and emits negatives from it, and holds no anchor's rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartergrid.llm.metric_topk import EXACT, scaled
from quartergrid.session import durable


@dataclass(frozen=True)
class Mining:
    """``positives`` per anchor, ``negatives`` per positive, whose scores are ``low`` to ``high`` hundredths of its.

    ``wave_bytes`` bounds the anchors that are scored at a time, ``block`` the rows of a block.
    """

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    wave_bytes: int = 32 << 20
    block: int = 2048


SCORED = "anchor int, score long, id long, label long, positive boolean"
MINED = "anchor int, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable_rows(table: DataFrame, scale: int, vector_id: str, vector: str, label: Column) -> DataFrame:
    """``id, label, v`` of the rows that take part, with whole-number components."""
    rows = table.select(
        table[vector_id].cast("long").alias("id"), label.cast("long").alias("label"), scaled(table[vector], scale).alias("v")
    )
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())


def block_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of all anchors with all rows; a product beyond 64 bits raises."""
    width = max(anchors.shape[1], 1)
    bound = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * width
    if bound < EXACT:
        return (anchors.astype(float) @ rows.T.astype(float)).astype(np.int64)
    if bound < 2**63:
        return anchors @ rows.T
    exact = anchors.astype(object) @ rows.T.astype(object)
    if max((abs(x) for x in exact.flat), default=0) >= 2**63:
        raise OverflowError("a score needs more than 64 bits")
    return exact.astype(np.int64)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), flat.size // max(len(vectors), 1))


@dataclass
class Wave:
    """Anchors that are scored together: number, id, label and vector of each, by vector length."""

    numbers: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: dict[int, tuple[np.ndarray, np.ndarray]]  # length: places, matrix

    @classmethod
    def of(cls, rows: pa.Table) -> Wave:
        lengths = np.array([len(v) for v in rows["v"].to_pylist()], np.int64)
        vectors = {}
        for length in np.unique(lengths).tolist():
            places = np.flatnonzero(lengths == length)
            vectors[length] = (places, _matrix(rows["v"].take(pa.array(places)).combine_chunks()))
        number, ids, labels = (rows[c].to_numpy() for c in ("anchor", "id", "label"))
        return cls(number, ids, labels, vectors)


class Best:
    """The first ``keep`` distinct (score, id, label) of every slot, best score first, smaller id first.

    ``bar`` is the score below which a slot takes no more.
    """

    def __init__(self, slots: int, keep: int) -> None:
        self.keep = keep
        self.bar = np.full(slots, np.iinfo(np.int64).min)
        self.kept = np.zeros((0, 4), np.int64)  # slot, score, id, label
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        self.waiting.append(np.column_stack([slot, score, ids, labels]))
        self.size += len(slot)
        if self.size > max(len(self.kept), 100_000):
            self.merge()

    def merge(self) -> None:
        every = np.concatenate([self.kept, *self.waiting])
        self.waiting, self.size = [], 0
        s, v, i, c = every.T
        every = every[np.lexsort((c, i, -v, s))]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]).any(axis=1)
        every = every[new]
        slot = every[:, 0]
        place = np.arange(len(every)) - np.searchsorted(slot, slot)
        self.kept = every[place < self.keep]
        last = every[place == self.keep - 1]
        self.bar[last[:, 0]] = last[:, 1]


def _top(mask: np.ndarray, scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the masked scores that are no worse than the row's ``keep``-th best."""
    if not mask.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hidden = np.where(mask, scores, np.iinfo(np.int64).min)
    if hidden.shape[1] > keep:
        bar = np.partition(hidden, -keep, axis=1)[:, -keep]
        mask = mask & (hidden >= bar[:, None])
    return np.nonzero(mask)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``length, ids, labels, matrix`` of at most ``size`` distinct rows of one vector length."""
    for batch in batches:
        for first in range(0, batch.num_rows, size):
            part = batch.slice(first, size)
            lengths = np.array([len(v) for v in part["v"].to_pylist()], np.int64)
            for length in np.unique(lengths).tolist():
                here = part.take(pa.array(np.flatnonzero(lengths == length)))
                rows = np.column_stack([here["id"].to_numpy(), here["label"].to_numpy(), _matrix(here["v"])])
                # Repeats would fill the places of others.
                rows = np.unique(rows, axis=0)
                yield length, rows[:, 0], rows[:, 1], rows[:, 2:]


def _scored(batches: Iterator[pa.RecordBatch], wave: Wave, plan: Mining) -> Iterator[tuple[np.ndarray, ...]]:
    """``places of anchors, scores, other, ids, labels``: a block's scores and whether a pair may count."""
    for length, ids, labels, matrix in _blocks(batches, plan.block):
        if length not in wave.vectors:
            continue
        places, anchors = wave.vectors[length]
        step = max(1, (1 << 20) // max(len(ids), 1))
        for first in range(0, len(places), step):
            here = places[first : first + step]
            scores = block_products(anchors[first : first + step], matrix)
            yield here, scores, wave.ids[here][:, None] != ids, ids, labels


def _positives(rows: DataFrame, wave, plan: Mining) -> DataFrame:
    """Each task's best rows of every anchor's label."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = wave.value
        best = Best(len(anchors.ids), plan.positives)
        for here, scores, other, ids, labels in _scored(batches, anchors, plan):
            own = other & (anchors.labels[here][:, None] == labels) & (scores >= best.bar[here][:, None])
            i, j = _top(own, scores, plan.positives)
            best.add(here[i], scores[i, j], ids[j], labels[j])
        best.merge()
        yield _scored_rows(anchors.numbers[best.kept[:, 0]], best, True)

    return rows.mapInArrow(tasks, SCORED)


def _negatives(rows: DataFrame, wave, windows, plan: Mining) -> DataFrame:
    """Each task's best rows of other labels in every positive's window."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = wave.value
        place, lowest, highest = windows.value
        best = Best(len(place), plan.negatives)
        of_anchor = np.searchsorted(place, np.arange(len(anchors.ids) + 1))
        for here, scores, other, ids, labels in _scored(batches, anchors, plan):
            other = other & (anchors.labels[here][:, None] != labels)
            for nth in range(plan.positives):
                window = of_anchor[here] + nth
                has = np.flatnonzero(window < of_anchor[here + 1])
                window = window[has]
                floor = np.maximum(lowest[window], best.bar[window])[:, None]
                inside = other[has] & (scores[has] >= floor) & (scores[has] <= highest[window][:, None])
                i, j = _top(inside, scores[has], plan.negatives)
                best.add(window[i], scores[has[i], j], ids[j], labels[j])
        best.merge()
        yield _scored_rows(anchors.numbers[place[best.kept[:, 0]]], best, False)

    return rows.mapInArrow(tasks, SCORED)


def _scored_rows(numbers: np.ndarray, best: Best, positive: bool) -> pa.RecordBatch:
    columns = {
        "anchor": pa.array(numbers.astype(np.int32)),
        "score": pa.array(best.kept[:, 1]),
        "id": pa.array(best.kept[:, 2]),
        "label": pa.array(best.kept[:, 3]),
        "positive": pa.array(np.full(len(numbers), positive)),
    }
    return pa.RecordBatch.from_pydict(columns)


def streamed(pairs: Iterable[tuple[tuple, None]], plan: Mining) -> Iterator[tuple]:
    """Rows of ``MINED`` from keys ``(anchor, -score, is negative, id, label)`` in ascending order.

    Holds an anchor's open windows only: at most ``positives`` of them.
    """
    anchor, last, open_windows, met = None, None, [], 0
    for key, _ in pairs:
        if key == last:
            continue
        last = key
        number, falling, negative, row_id, _ = key
        score = -falling
        if number != anchor:
            anchor, open_windows, met = number, [], 0
        if not negative:
            if met < plan.positives:
                met += 1
                open_windows.append([row_id, score, 0])
            continue
        for window in open_windows:
            if plan.low * window[1] <= 100 * score <= plan.high * window[1]:
                window[2] += 1
                yield anchor, window[0], window[2], row_id, window[1], score
        # A window closes when it is full or the scores have fallen below it.
        open_windows = [w for w in open_windows if w[2] < plan.negatives and plan.low * w[1] <= 100 * score]


def hard_negatives(
    table: DataFrame,
    is_anchor: Column,
    label: Column,
    plan: Mining = Mining(),
    vector_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the inner product of ``floor(scale * x)``; higher scores come first, then
    smaller ids. An anchor's positives are its first rows of the same label; a positive's
    negatives are the first rows of other labels whose score lies in its window. Rows with a
    null id, label or vector, or a null or non-finite component, take no part; vectors of
    different lengths have no score. Repeated rows count once: candidates are the distinct
    (score, id, label) of an anchor, and equal anchor rows are mined once. Rows that share an
    anchor's id are never its candidates. An empty table, or one without anchors, gives no
    rows. Extra columns are not read.
    """
    spark = table.sparkSession
    context = spark.sparkContext
    rows = usable_rows(table, plan.scale, vector_id, vector, label)
    chosen = usable_rows(table.where(is_anchor), plan.scale, vector_id, vector, label).distinct()
    mined: list[DataFrame] = []
    for anchors in _waves(durable(chosen), plan):
        wave = context.broadcast(Wave.of(anchors))
        tops = durable(_positives(rows, wave, plan))
        positives = durable(_first(tops, plan.positives))
        windows = context.broadcast(_windows(positives.toArrow(), plan))
        pairs = positives.union(_negatives(rows, wave, windows, plan))
        # At equal scores a positive opens its window before negatives come.
        packed = pairs.select("anchor", (-F.col("score")).alias("falling"), (~F.col("positive")).alias("side"), "id", "label")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        sorted_pairs = packed.rdd.map(lambda r: (tuple(r), None)).repartitionAndSortWithinPartitions(
            tasks, lambda key: key[0]
        )
        found = spark.createDataFrame(sorted_pairs.mapPartitions(lambda part: streamed(part, plan)), MINED)
        names = spark.createDataFrame(anchors.select(["anchor", "id"])).withColumnRenamed("id", "anchor_id")
        mined.append(durable(found.join(F.broadcast(names), "anchor").drop("anchor")))
        wave.unpersist()
        windows.unpersist()
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not mined:
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], empty)
    result = mined[0]
    for more in mined[1:]:
        result = result.union(more)
    return result.select(columns)


def _waves(chosen: DataFrame, plan: Mining) -> Iterator[pa.Table]:
    """Anchors in portions of at most ``wave_bytes`` or one vector, numbered from 0 within each."""
    held: list[dict] = []
    size = 0
    for row in chosen.toLocalIterator():
        own = 8 * (len(row["v"]) + 2)
        if held and size + own > plan.wave_bytes:
            yield _wave_table(held)
            held, size = [], 0
        held.append({"anchor": len(held), "id": row["id"], "label": row["label"], "v": row["v"]})
        size += own
    if held:
        yield _wave_table(held)


def _wave_table(rows: list[dict]) -> pa.Table:
    kinds = {"anchor": pa.int32(), "id": pa.int64(), "label": pa.int64(), "v": pa.list_(pa.int64())}
    return pa.Table.from_pylist(rows, schema=pa.schema(list(kinds.items())))


def _first(scored: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` distinct candidates of every anchor."""
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "label")
    ranked = scored.distinct().withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= keep).drop("place")


def _windows(positives: pa.Table, plan: Mining) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, lowest and highest score of every window, by anchor."""
    place = positives["anchor"].to_numpy().astype(np.int64)
    score = positives["score"].to_numpy().astype(object)
    order = np.argsort(place, kind="stable")
    lowest = np.array([-(-plan.low * s // 100) for s in score[order]], np.int64)
    highest = np.array([plan.high * s // 100 for s in score[order]], np.int64)
    return place[order], lowest, highest
