"""Near copies by a chosen-path join on word shingles.

Each run samples a few shingles of every distinct shingle set, the same ones wherever sets
share them, and so splits the sets into buckets; buckets above a limit are split again by
the next sample of their own sets, and small ones are searched in full on sketches. Runs are
repeated until a pair at the threshold is met with the wanted recall. What the runs join is
a coarse group; inside it all pairs of whole sets are compared exactly, in blocks, so links
are counted without listing pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartergrid.llm.components import components
from quartergrid.llm.joins import free, gathered, keyed, look_up, sized
from quartergrid.llm.token_files import fresh_path
from quartergrid.llm.words import factorize, give_back, grouped, slices
from quartergrid.session import durable, tidy

MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SKETCH = 64
ROW_BATCH = 4096


@dataclass(frozen=True)
class JoinPlan:
    """``recall`` is that of one pair at the threshold over all runs, in buckets that need no second split.

    A set whose sketch agrees with a leader's in ``absorbed`` of its places is left to the
    leader: by the triangle inequality for Jaccard distances its partners come near the
    leader too, and ``coarse`` is low enough to see that.
    """

    words: int = 5
    similarity: float = 0.8
    recall: float = 0.99999
    first_sample: float = 2.0
    later_sample: float = 1.25
    levels: int = 4
    leaf: int = 64
    block: int = 256
    coarse: float = 0.45
    absorbed: float = 0.8
    absorbing_runs: int = 2

    def samples(self) -> list[float]:
        return [self.first_sample] + [self.later_sample] * (self.levels - 1)

    def runs(self) -> int:
        shared = 2 * self.similarity / (1 + self.similarity)
        return math.ceil(math.log(1 - self.recall) / (-shared * self.first_sample))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def _constants(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed((np.arange(n, dtype=np.uint64) + np.uint64(seed)) * np.uint64(MIX[0])) | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's runs of ``words`` words.

    Words lie between ASCII blanks and are compared as they stand. A text of fewer words
    has one shingle, all of them; a text without words has none.
    """
    codes, counts, distinct = factorize(texts)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()], np.uint64)
    empty = distinct.index("").as_py()
    stream = hashes[codes]
    kept = codes != empty
    at = 0
    factors = _constants(words, 1000)
    for n in counts.tolist():
        own = stream[at : at + n][kept[at : at + n]]
        at += n
        if not len(own):
            yield own
            continue
        width = min(words, len(own))
        total = np.zeros(len(own) - width + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                total += _mixed(own[k : k + len(total)] + factors[k])
        yield np.unique(_mixed(total + np.uint64(width)))


def set_name(items: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    return xxhash.xxh3_128_digest(items.tobytes())


SIGNATURE = "doc_id long, set_id binary, size int, sketch binary, picks array<array<int>>"


def signatures(docs: DataFrame, plan: JoinPlan, doc_id: str, text: str) -> DataFrame:
    """For each row: its set's name, a min-wise sketch, and the sampled shingles by run and level."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    runs, samples = plan.runs(), plan.samples()
    picks = np.tile(np.array(samples), runs)
    multipliers, orders = _constants(len(picks), 1), _constants(SKETCH, 2000)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part["text"], plan.words))
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array([set_name(x) for x in sets], pa.binary()),
                        pa.array([len(x) for x in sets], pa.int32()),
                        pa.array([_sketch(x, orders) for x in sets], pa.binary()),
                        pa.array([_picked(x, multipliers, picks) for x in sets], pa.list_(pa.list_(pa.int32()))),
                    ],
                    ["doc_id", "set_id", "size", "sketch", "picks"],
                )
        give_back()

    return rows.mapInArrow(tasks, SIGNATURE)


def _sketch(items: np.ndarray, orders: np.ndarray) -> bytes:
    if not len(items):
        return bytes(SKETCH)
    least = np.full(len(orders), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for first in range(0, len(items), ROW_BATCH):
            part = items[first : first + ROW_BATCH]
            least = np.minimum(least, (part[None, :] * orders[:, None]).min(axis=1))
    return (_mixed(least) & np.uint64(255)).astype("u1").tobytes()


def _picked(items: np.ndarray, multipliers: np.ndarray, samples: np.ndarray) -> list[np.ndarray]:
    """Shingles below each level's share of the hash range: ``sample`` of them on average."""
    if not len(items):
        return [[] for _ in samples]
    bars = np.minimum(samples / len(items), 1.0) * float(2**53)
    found: list[list[np.ndarray]] = [[] for _ in samples]
    with np.errstate(over="ignore"):
        for first in range(0, len(items), ROW_BATCH):
            part = items[first : first + ROW_BATCH]
            low = ((part[None, :] * multipliers[:, None]) >> np.uint64(11)) < bars[:, None]
            which, where = np.nonzero(low)
            ends = np.searchsorted(which, np.arange(len(samples) + 1))
            values = part[where].astype(np.uint32).view(np.int32)
            for k in range(len(samples)):
                found[k].append(values[ends[k] : ends[k + 1]])
    return [np.concatenate(f) for f in found]


def class_table(docs: DataFrame, plan: JoinPlan = JoinPlan(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: its class of near copies and its number of links.

    Two rows are linked when the Jaccard similarity of their shingle sets reaches the
    plan's; a class is what links connect, named by its smallest id. Rows with equal sets
    are linked. Null, empty and blank texts have no shingles: each is its own class with 0
    links. A row whose id repeats counts as one more row of that document. Rows with a
    null id are one document; other columns are not read; an empty table gives no rows.

    Columns: ``doc_id``, ``class_id``, ``n_links`` (linked rows), ``class_size`` (rows).
    """
    spark = docs.sparkSession
    place = fresh_path(spark, "signatures")
    signatures(docs, plan, doc_id, text).write.parquet(place)
    signed = spark.read.parquet(place)
    place = fresh_path(spark, "sets")
    distinct = signed.where("size > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"),
        F.count(F.lit(1)).alias("copies"),
        F.first("sketch").alias("sketch"),
        F.first("picks").alias("picks"),
    )
    distinct.write.parquet(place)
    sets = spark.read.parquet(place)
    n = sets.count()
    edges, gone = _absorbed(sets, n, plan)
    tidy(spark)
    active = sets.join(sized(gone), "set_id", "left_anti")
    leaves, more, n_leaves = _leaves(active, n, plan)
    coarse = components(_search(leaves, n_leaves, active, plan).unionByName(edges).unionByName(more))
    tidy(spark)
    links = _verified(docs, sets, coarse, plan, doc_id, text)
    tidy(spark)
    return _answer(signed, sets, n, links)


def _buckets(rows: DataFrame, level: int) -> DataFrame:
    """Rows of the buckets that the sets' ``picked`` of one level open below ``bucket``."""
    item = F.explode("picked")
    return rows.withColumn("item", item).withColumn("bucket", F.xxhash64("bucket", F.lit(level), "item")).drop("item", "picked")


def _picked_at(plan: JoinPlan, level: int) -> Column:
    """The picks of a set for one level of a run; null behind the last one."""
    return F.try_element_at("picks", F.col("run") * plan.levels + level + 1).alias("picked")


def _with_leaders(split: DataFrame, n: float, plan: JoinPlan) -> DataFrame:
    """``bucket, a, order, leader, alike``: every set's likeness to the leaders of its ``bucket``, from some ``n`` rows.

    The leader is a bucket's first set in the order of a hash, so this is linear in the rows
    of a bucket. Only likeness of ``coarse`` or more is returned.
    """
    first = F.struct(F.xxhash64("set_id").alias("order"), F.col("set_id").alias("leader"), F.col("sketch").alias("of"))
    leaders = split.groupBy("bucket").agg(F.min(first).alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = look_up(
        split.withColumnRenamed("bucket", "key").withColumnRenamed("set_id", "node"),
        durable(gathered(leaders.select(F.col("bucket").alias("node"), "component"), n)),
    ).select(F.col("key").alias("bucket"), F.col("node").alias("a"), "sketch", "found.*").where("a <> leader")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, of = (np.frombuffer(b"".join(batch[c].to_pylist()), "u1").reshape(-1, SKETCH) for c in ("sketch", "of"))
            alike = (own == of).mean(axis=1)
            found = batch.select(["bucket", "a", "order", "leader"]).append_column("alike", pa.array(alike))
            yield found.filter(pa.array(alike >= plan.coarse))

    return durable(gathered(pairs, n).mapInArrow(near, "bucket long, a binary, order long, leader binary, alike double"))


def _absorbed(sets: DataFrame, n: int, plan: JoinPlan) -> tuple[DataFrame, DataFrame]:
    """Edges ``a, b`` to leaders, and the sets ``a`` that are left to a leader which is left to none.

    This takes large groups of near copies apart before any bucket is searched in full.
    """
    runs = F.explode(F.sequence(F.lit(0), F.lit(plan.absorbing_runs - 1)))
    rows = sets.select("set_id", "sketch", "picks", runs.alias("run"))
    rows = rows.select("set_id", "sketch", "run", _picked_at(plan, 0), F.col("run").cast("long").alias("bucket"))
    n_rows = n * plan.absorbing_runs * plan.first_sample
    found = _with_leaders(_buckets(rows, 0), n_rows, plan)
    near = found.where(F.col("alike") >= plan.absorbed)
    best = durable(gathered(near.groupBy("a").agg(F.min(F.struct("order", "leader"))["leader"].alias("b")), n))
    gone = best.join(sized(best.select(F.col("a").alias("b"))), "b", "left_anti").select(F.col("a").alias("set_id"))
    return found.select("a", F.col("leader").alias("b")).distinct(), durable(gone)


def _leaves(sets: DataFrame, n: float, plan: JoinPlan) -> tuple[DataFrame, DataFrame, int]:
    """``bucket, set_id, members`` of all buckets that are not split further and hold two sets or more.

    And edges ``a, b``: before a large bucket is split its sets are compared with its leader,
    and those very near it are left to it there. So near copies do not go down together.
    And the number of rows that the search deals out to units; there are at most ``n`` sets.
    """
    runs = F.explode(F.sequence(F.lit(0), F.lit(plan.runs() - 1)))
    rows = sets.select("set_id", "picks", runs.alias("run"))
    rows = rows.select("set_id", "run", _picked_at(plan, 0), F.col("run").cast("long").alias("bucket"))
    leaves, edges, total = [], [sets.sparkSession.createDataFrame([], "a binary, b binary")], 0
    n *= plan.runs()
    for level, sample in enumerate(plan.samples()):
        n *= sample
        split = _buckets(rows, level).select("set_id", "run", "bucket")
        counts = durable(gathered(_members(split), n))
        small = F.col("members") <= plan.leaf
        in_small, n = counts.agg(*(F.coalesce(F.sum(F.when(c, F.col("members"))), F.lit(0)) for c in (small, ~small))).first()
        total += in_small
        leaf = split.select("set_id", "bucket").join(counts.where(small).hint("merge"), "bucket")
        leaves.append(durable(gathered(leaf, in_small)))
        if not n:
            return reduce(DataFrame.unionByName, leaves), reduce(DataFrame.unionByName, edges), total
        large = counts.where(~small).select("bucket")
        kept = durable(gathered(split.join(sized(large), "bucket", "left_semi"), n))
        left = kept.select("set_id").distinct().hint("merge")
        sets = durable(gathered(sets.select("set_id", "sketch", "picks").join(left, "set_id", "left_semi"), n))
        # Joined once for this level's leaders and the next one's buckets.
        joined = kept.join(sets.hint("merge"), "set_id").select("set_id", "run", "bucket", "sketch", _picked_at(plan, level + 1))
        joined = durable(gathered(joined, n))
        found = _with_leaders(joined.select("set_id", "bucket", "sketch"), n, plan)
        edges.append(found.select("a", F.col("leader").alias("b")).distinct())
        taken = found.where(F.col("alike") >= plan.absorbed).select("bucket", F.col("a").alias("set_id"))
        rows = joined.drop("sketch").join(taken.hint("merge"), ["bucket", "set_id"], "left_anti")
        rows = kept = durable(gathered(rows, n))
        tidy(sets.sparkSession)
    counts = durable(gathered(_members(kept), n))
    leaves.append(durable(gathered(kept.select("set_id", "bucket").join(sized(counts), "bucket"), n)))
    dealt = F.sum(F.col("members") * F.ceil(F.col("members") / plan.block))
    total += counts.agg(F.coalesce(dealt, F.lit(0))).first()[0]
    return reduce(DataFrame.unionByName, leaves), reduce(DataFrame.unionByName, edges), total


def _members(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")


def _blocks(rows: DataFrame, plan: JoinPlan) -> DataFrame:
    """Deal the members of large buckets to blocks, and pairs of blocks to units.

    A unit holds one block, or two of which only pairs across are compared; so every pair
    of a bucket is compared in one unit, whatever the bucket's size. Units are small, so a
    hash deals them out; ranges would work out the rows twice and send the driver a sample.
    """
    blocks = F.ceil(F.col("members") / plan.block).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    return (
        rows.withColumn("block", F.pmod(F.xxhash64("set_id"), blocks).cast("int"))
        .withColumn("other", other)
        .withColumn(
            "unit",
            F.concat_ws("-", F.col("bucket").cast("string"), F.least("block", "other"), F.greatest("block", "other")),
        )
        .drop("other", "members", "bucket")
    )


def _search(leaves: DataFrame, n: int, sets: DataFrame, plan: JoinPlan) -> DataFrame:
    """Edges ``a, b`` from sets to the leaders that their sketches come near, in every leaf; ``n`` rows are dealt out.

    Small buckets that hold the same sets, as near copies do in most runs, are searched once.
    """
    buckets = leaves.where(F.col("members") <= plan.leaf).groupBy("bucket").agg(F.sort_array(F.collect_set("set_id")).alias("all"))
    small = (
        gathered(gathered(buckets.select("all"), n).distinct(), n)
        .where(F.size("all") > 1)
        .select(F.xxhash64("all").alias("bucket"), F.size("all").cast("long").alias("members"), F.explode("all").alias("set_id"))
    )
    rows = small.unionByName(leaves.where(F.col("members") > plan.leaf).select(*small.columns))
    # Sketches are joined before the rows are dealt out, so a large bucket's are not looked up once a block.
    units = _blocks(gathered(rows.join(sets.select("set_id", "sketch").hint("merge"), "set_id"), n), plan)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in grouped(batches, "unit"):
            names = np.array(unit["set_id"].to_pylist(), object)
            near = _leaders(np.frombuffer(b"".join(unit["sketch"].to_pylist()), "u1").reshape(-1, SKETCH), plan)
            if near:
                a, b = zip(*near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[list(a)], pa.binary()), pa.array(names[list(b)], pa.binary())], ["a", "b"]
                )

    dealt = units.select("unit", "set_id", "sketch").repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(tasks, "a binary, b binary").distinct()


def _leaders(sketches: np.ndarray, plan: JoinPlan) -> list[tuple[int, int]]:
    """Pairs (set, root) that join what has sketches similar to a leader's.

    Sets very near a leader are left to it, as in :class:`JoinPlan`.
    """
    left, root = np.arange(len(sketches)), np.arange(len(sketches))
    while len(left) > 1:
        leader, left = left[0], left[1:]
        alike = (sketches[left] == sketches[leader]).mean(axis=1)
        joined = np.append(left[alike >= plan.coarse], leader)
        roots = np.unique(root[joined])
        root[np.isin(root, roots)] = roots[0]
        left = left[alike < plan.absorbed]
    apart = np.flatnonzero(root != np.arange(len(root)))
    return list(zip(apart.tolist(), root[apart].tolist()))


LINKED = "a binary, b binary, links long"


def _verified(docs: DataFrame, sets: DataFrame, coarse: DataFrame, plan: JoinPlan, doc_id: str, text: str) -> DataFrame:
    """Exact comparison of all pairs in a coarse group: ``a``, a set linked with it (or itself), rows linked with it."""
    n = coarse.count()
    counts = coarse.groupBy(F.col("component").alias("node")).agg(F.count(F.lit(1)).alias("component"))
    members = gathered(look_up(coarse.withColumnRenamed("component", "key"), gathered(counts, n)), n)
    dealt = _blocks(
        members.select(F.hex("key").alias("bucket"), F.col("node").alias("set_id"), F.col("found").alias("members")), plan
    )
    units = dealt.groupBy("set_id", "block").agg(F.collect_list("unit").alias("units"))
    wanted = sets.select("set_id", "rep", "copies").join(units, "set_id").withColumnRenamed("set_id", "wanted")
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                items = [x.tobytes() for x in shingle_sets(part["text"], plan.words)]
                names = [xxhash.xxh3_128_digest(x) for x in items]
                same = pa.array([a == b for a, b in zip(names, part["wanted"].to_pylist())])
                out = pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), part["copies"], part["block"], pa.array(items, pa.binary()), part["units"]],
                    ["set_id", "copies", "block", "items", "units"],
                )
                yield out.filter(same)
        give_back()

    whole = found.mapInArrow(read, "set_id binary, copies long, block int, items binary, units array<string>")
    rows = whole.select("set_id", "copies", "block", "items", F.explode("units").alias("unit"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in grouped(batches, "unit"):
            yield _compared(unit, plan.similarity)
        give_back()

    return durable(rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(compare, LINKED))


def _compared(unit: pa.Table, similarity: float) -> pa.RecordBatch:
    first = {name: k for k, name in reversed(list(enumerate(unit["set_id"].to_pylist())))}
    rows = sorted(first.values())
    names = [unit["set_id"][k].as_py() for k in rows]
    items = [np.frombuffer(unit["items"][k].as_buffer(), np.uint64) for k in rows]
    copies = np.array([unit["copies"][k].as_py() for k in rows])
    blocks = np.array([unit["block"][k].as_py() for k in rows])
    sizes = np.array([len(x) for x in items])
    common = intersections(items)
    linked = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    if blocks.min() != blocks.max():
        linked &= blocks[:, None] != blocks[None, :]
    labels = np.arange(len(rows))
    while True:
        near = np.where(linked, labels[None, :], len(rows)).min(axis=1)
        new = np.minimum(labels, near)
        if (new == labels).all():
            break
        labels = new
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.binary()), pa.array([names[k] for k in labels], pa.binary()), pa.array(linked @ copies, pa.int64())],
        ["a", "b", "links"],
    )


def intersections(items: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of dense slices of their shared items."""
    owner = np.repeat(np.arange(len(items)), [len(x) for x in items])
    values, codes, counts = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    keep = shared[codes]
    owner, codes = owner[keep], place[codes[keep]]
    order = np.argsort(codes, kind="stable")
    owner, codes = owner[order], codes[order]
    total = np.zeros((len(items), len(items)), np.float32)
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(codes, [start, start + width])
        dense = np.zeros((len(items), width), np.float32)
        dense[owner[a:b], codes[a:b] - start] = 1
        total += dense @ dense.T
    return np.rint(total).astype(np.int64)


def _answer(signed: DataFrame, sets: DataFrame, n: int, links: DataFrame) -> DataFrame:
    per_set = links.groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("links"))
    fine = components(links.where("a <> b").select("a", "b")).withColumnRenamed("node", "set_id")
    known = (
        sets.select("set_id", "rep", "copies")
        .join(per_set.hint("merge"), "set_id", "left")
        .join(fine.hint("merge"), "set_id", "left")
        .withColumn("class", F.coalesce("component", "set_id"))
        .drop("component")
    )
    known = durable(gathered(known, n))
    grouped_sets = known.where("class <> set_id OR links > 0").groupBy(F.col("class").alias("node")).agg(
        F.struct(F.min("rep").alias("id"), F.sum("copies").alias("rows")).alias("component")
    )
    joined = look_up(
        known.where("class <> set_id OR links > 0").select(F.col("class").alias("key"), F.col("set_id").alias("node"), "links", "copies"),
        grouped_sets,
    ).select(F.col("node").alias("set_id"), F.col("found.id").alias("class_id"), F.col("found.rows").alias("class_size"), "links", "copies")
    alone = known.where("class = set_id AND coalesce(links, 0) = 0").select(
        "set_id", F.col("rep").alias("class_id"), F.col("copies").alias("class_size"), F.lit(0).cast("long").alias("links"), "copies"
    )
    info = joined.unionByName(alone)
    salts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = signed.where("size > 0").select("doc_id", "set_id", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    parts = rows.select("set_id", "salt").distinct().join(info, "set_id")
    full = rows.join(parts, ["set_id", "salt"]).select(
        "doc_id", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "class_size"
    )
    blank = signed.where("size = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size")
    )
    return full.unionByName(blank)


def drop_near_copies(
    docs: DataFrame, plan: JoinPlan = JoinPlan(), doc_id: str = "doc_id", text: str = "text", row: str | None = None
) -> DataFrame:
    """One row of ``docs`` of each class, with all columns: that of the smallest id, a null id last.

    Classes are those of rows, which ``row`` tells apart; if no column does, a keyed copy of
    ``docs`` is written. Rows with the same or a null id are compared by their own texts,
    and rows without shingles all stay.
    """
    if row is None:
        row = free("_row", docs)
        return drop_near_copies(durable(keyed(docs, row)), plan, doc_id, text, row).drop(row)
    name = free("_gone", docs)
    classes = class_table(docs, plan, row, text).where("class_size > 1").select(F.col("doc_id").alias("_row"), "class_id")
    ids = docs.select(docs[row].alias("_row"), docs[doc_id].alias("_id"))
    among = durable(classes.join(ids.hint("merge"), "_row"))
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_row"))["_row"]
    stays = among.groupBy("class_id").agg(first.alias("_row")).select("_row")
    gone = durable(among.select("_row").join(stays.hint("merge"), "_row", "left_anti").withColumnRenamed("_row", name))
    return docs.join(sized(gone), docs[row] == F.col(name), "left_anti")
