"""Exact largest inner products by best-first search of M-trees.

With one more component that lifts every candidate to the same length, the largest inner
product is the smallest Euclidean distance, which is a metric. Candidates are dealt to
cells around a few pivots; each cell holds M-trees whose pages store covering radii and
distances to the parent's routing object. A query first visits the cell it lies in, then
only cells and pages that its bound cannot exclude.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartergrid.llm.token_files import fresh_path
from quartergrid.session import durable

EXACT = float(1 << 53)
NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Shape:
    """``pivots`` bounds the cells; a tree holds ``tree`` vectors, a page ``page``, a group ``queries`` queries."""

    pivots: int = 32
    tree: int = 4096
    page: int = 256
    fanout: int = 16
    queries: int = 8192


def scaled(embedding: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component, null if a component is null or not finite."""
    usable = embedding.isNotNull() & F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.when(usable, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def products(left: np.ndarray, right: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer inner products of rows with a vector, in floating point while that is exact.

    ``largest`` bounds the rows' components.
    """
    if largest * np.abs(right).max(initial=0) * max(left.shape[-1], 1) < EXACT:
        return (left @ right).astype(np.int64)
    exact = left.astype(object) @ right.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


@dataclass
class Page:
    """A node: its entries' vectors, distances to the node's routing object, and radii or ids."""

    leaf: bool
    vectors: np.ndarray
    parent_distances: np.ndarray
    radii: np.ndarray  # of children; empty in a leaf
    below: np.ndarray  # page numbers of children, or ids of each vector
    largest: float = field(init=False)

    def __post_init__(self) -> None:
        self.largest = float(np.abs(self.vectors).max(initial=0.0))


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that gives all of them the length ``sqrt(top)``."""
    rest = np.maximum(top - (vectors * vectors).sum(axis=1), 0.0)
    return np.hstack([vectors, np.sqrt(rest)[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` to the vector ``b``."""
    return np.sqrt(np.maximum(((a - b) ** 2).sum(axis=1), 0.0))


def build(vectors: np.ndarray, ids: np.ndarray, top: float, shape: Shape) -> list[Page]:
    """Bulk-load a tree from the top; page 0 is its root, whose routing object is its first vector."""
    high = lifted(vectors.astype(float), top)
    pages: list[Page | None] = []

    def load(rows: np.ndarray, centre: int) -> tuple[int, float]:
        number = len(pages)
        pages.append(None)
        away = distances(high[rows], high[centre])
        if len(rows) <= shape.page:
            pages[number] = Page(True, vectors[rows], away, np.zeros(0), ids[rows])
            return number, float(away.max(initial=0.0))
        centres = rows[np.linspace(0, len(rows) - 1, shape.fanout).astype(int)]
        gaps = np.stack([distances(high[rows], high[c]) for c in centres], axis=1)
        nearest = gaps.argmin(axis=1)
        if (nearest == nearest[0]).all():
            nearest = np.arange(len(rows)) * shape.fanout // len(rows)
        kept = [k for k in range(len(centres)) if (nearest == k).any()]
        children = [load(rows[nearest == k], int(centres[k])) for k in kept]
        routes = centres[kept]
        pages[number] = Page(
            False, high[routes], distances(high[routes], high[centre]),
            np.array([r for _, r in children]), np.array([c for c, _ in children]),
        )
        return number, float(away.max())

    load(np.arange(len(vectors)), 0)
    return pages


def needed(names: np.ndarray, keep: int) -> tuple[list[int], bool]:
    """Places of best-first ``names`` that leave ``keep - 1`` whichever one name is taken out, and whether they do.

    These are the first ``keep`` where no name repeats, and fewer than twice as many where
    names do; more than ``keep - 1`` of one name are never needed.
    """
    if len(names) >= keep and len(set(names[:keep].tolist())) == keep:
        return list(range(keep)), True
    seen: dict[int, int] = {}
    places: list[int] = []
    for place, name in enumerate(names.tolist()):
        if seen.get(name, 0) == keep - 1:
            continue
        seen[name] = seen.get(name, 0) + 1
        places.append(place)
        if len(places) - max(seen.values()) == keep - 1:
            return places, True
    return places, False


def search(pages: list[Page], root: np.ndarray, query: np.ndarray, keep: int, top: float, bound: float) -> list[tuple[int, int]]:
    """The best (score, id) of a tree that are :func:`needed`, best score first, smaller id first; none farther than ``bound``."""
    length = float((query * query).sum())
    lift = np.append(query, 0.0)
    slack = 1e-6 * (1 + np.sqrt(length + top))
    best_scores, best_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = False
    queue = [(0.0, 0, float(distances(root[None, :], lift)[0]))]
    while queue:
        least, number, to_route = heapq.heappop(queue)
        if least > bound + slack:
            break
        page = pages[number]
        room = page.radii if not page.leaf else 0.0
        open_ = np.flatnonzero(np.abs(to_route - page.parent_distances) - room <= bound + slack)
        if not len(open_):
            continue
        if not page.leaf:
            gaps = distances(page.vectors[open_], lift)
            near = np.maximum(gaps - page.radii[open_], 0.0)
            for entry, gap, low in zip(open_.tolist(), gaps.tolist(), near.tolist()):
                if low <= bound + slack:
                    heapq.heappush(queue, (max(low, least), int(page.below[entry]), gap))
            continue
        held = page.vectors if len(open_) == len(page.vectors) else page.vectors[open_]
        scores = products(held, query, page.largest)
        if full:
            better = np.flatnonzero(scores >= best_scores[-1])
            if not len(better):
                continue
            scores, open_ = scores[better], open_[better]
        owners = page.below[open_]
        named = owners != NONE
        scores = np.concatenate([best_scores, np.repeat(scores, named.sum(axis=1))])
        names = np.concatenate([best_ids, owners[named]])
        order = np.lexsort((names, -scores))
        places, full = needed(names[order], keep)
        order = order[places]
        best_scores, best_ids = scores[order], names[order]
        if full:
            bound = min(bound, float(np.sqrt(max(length + top - 2.0 * float(best_scores[-1]), 0.0))))
    return list(zip(best_scores.tolist(), best_ids.tolist()))


PAGES = (
    "cell int, sub int, page int, leaf boolean, root array<double>, vectors array<double>, "
    "parent_distances array<double>, radii array<double>, below array<long>, entries int"
)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([r.reshape(-1) for r in rows]) if rows else np.zeros(0)
    ends = np.cumsum([0] + [r.size for r in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def index(candidates: DataFrame, width: int, top: float, keep: int, shape: Shape) -> tuple[DataFrame, np.ndarray, dict[int, tuple[int, float]]]:
    """Pages of all trees in the shared folder, the pivots, and each cell's trees and radius.

    Pivots are the first ``shape.pivots`` distinct vectors in the order of a hash; every
    vector is indexed. Equal vectors share one entry with their ``keep`` smallest ids, each
    as often as its row is repeated, at most ``keep - 1`` times.
    """
    spark = candidates.sparkSession
    smallest = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    repeats = F.array_repeat("id", F.least(F.col("rows"), F.lit(keep - 1)).cast("int"))
    distinct = durable(
        candidates.groupBy("vector", "id").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("_n", smallest).where(F.col("_n") <= keep)
        .groupBy("vector").agg(F.sort_array(F.flatten(F.collect_list(repeats))).alias("ids"))
    )
    sample = distinct.orderBy(F.xxhash64("vector"), "vector").select("vector").limit(shape.pivots).collect()
    pivots = lifted(np.array([r["vector"] for r in sample], float).reshape(-1, width), top)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                high = lifted(_matrix(batch["vector"], width), top)
                gaps = np.stack([distances(high, p) for p in pivots], axis=1)
                cell = gaps.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch["vector"], batch["ids"], pa.array(cell.astype(np.int32)), pa.array(gaps.min(axis=1))],
                    ["vector", "ids", "cell", "gap"],
                )

    celled = durable(distinct.mapInArrow(assign, "vector array<long>, ids array<long>, cell int, gap double"))
    cells = {
        r["cell"]: (-(-r["n"] // shape.tree), r["radius"])
        for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()
    }
    trees = F.create_map(*(F.lit(x) for c, (n, _) in cells.items() for x in (c, n)))[F.col("cell")] if cells else F.lit(1)
    dealt = celled.withColumn("sub", F.pmod(F.xxhash64("vector"), trees).cast("int"))

    def load(table: pa.Table) -> pa.Table:
        vectors = _matrix(table["vector"], width)
        named = table["ids"].to_pylist()
        ids = np.full((len(vectors), max(map(len, named))), NONE)
        for k, own in enumerate(named):
            ids[k, : len(own)] = own
        pages = build(vectors, ids, top, shape)
        n = len(pages)
        root = lifted(vectors[:1], top)
        return pa.table(
            {
                "cell": pa.array([table["cell"][0].as_py()] * n, pa.int32()),
                "sub": pa.array([table["sub"][0].as_py()] * n, pa.int32()),
                "page": pa.array(range(n), pa.int32()),
                "leaf": pa.array([p.leaf for p in pages]),
                "root": _lists([root] * n),
                "vectors": _lists([p.vectors.astype(float) for p in pages]),
                "parent_distances": _lists([p.parent_distances for p in pages]),
                "radii": _lists([p.radii for p in pages]),
                "below": _lists([p.below.astype(np.int64) for p in pages]),
                "entries": pa.array([len(p.vectors) for p in pages], pa.int32()),
            }
        )

    place = fresh_path(spark, "metric-pages")
    dealt.groupBy("cell", "sub").applyInArrow(load, PAGES).write.parquet(place)
    return spark.read.parquet(place), pivots, cells


def _pages(table: pa.Table) -> list[Page]:
    rows = table.sort_by("page").to_pydict()
    out = []
    for k in range(table.num_rows):
        n, leaf = rows["entries"][k], rows["leaf"][k]
        below = np.array(rows["below"][k], np.int64)
        out.append(
            Page(
                leaf, np.array(rows["vectors"][k], float).reshape(n, -1), np.array(rows["parent_distances"][k]),
                np.array(rows["radii"][k]), below.reshape(n, -1) if leaf else below,
            )
        )
    return out


FOUND = "query long, score long, id long"


def top_products(
    vectors: DataFrame,
    queries: Column,
    k: int,
    scale: int = 256,
    shape: Shape = Shape(),
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The ``k`` largest integer inner products of each query row with all other rows.

    Components are scaled and floored. Rows that are null or hold a null or a non-finite
    component take no part; a shorter vector counts as padded with zeros. Ties go to the
    smaller id; a query with fewer than ``k`` other rows has them all; equal vectors are
    searched once. A query never finds its own id. Repeated rows count, as in SQL: a
    candidate takes a rank for each of its rows, and again for each row of the query. A
    null id takes no part. An empty table gives no rows.

    Columns: ``query_id``, ``rank``, ``vec_id``, ``score``.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        vectors[vec_id].cast("long").alias("id"), queries.alias("asked"), scaled(vectors[embedding], scale).alias("vector")
    ).where("id IS NOT NULL AND vector IS NOT NULL")
    rows = durable(rows)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.max(F.size("vector")).alias("width"), F.max(square).alias("top"), F.count_if("asked").alias("asked")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts["asked"]:
        return spark.createDataFrame([], schema)
    width, top, keep = facts["width"], facts["top"], k + 1
    padded = F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vector")))
    rows = rows.withColumn("vector", padded)
    asked = durable(rows.where("asked").select("vector").distinct().withColumn("query", F.monotonically_increasing_id()))
    pages, pivots, cells = index(rows.select("id", "vector"), width, top, keep, shape)
    blocks = -(-facts["asked"] // shape.queries)
    numbers = sorted(cells)
    radii = np.array([cells[c][1] for c in numbers])
    slack = 1e-6 * (1 + 2 * np.sqrt(top))

    def route(first: bool):
        def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = _matrix(batch["vector"], width)
                high = np.hstack([points, np.zeros((len(points), 1))])
                gaps = np.stack([distances(high, pivots[c]) for c in numbers], axis=1)
                home = np.zeros_like(gaps, bool)
                home[np.arange(len(gaps)), gaps.argmin(axis=1)] = True
                bound = batch["bound"].to_numpy(zero_copy_only=False)
                at, cell = np.nonzero(home if first else ~home & (gaps - radii <= bound[:, None] + slack))
                out = batch.select(["query", "vector", "bound"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(np.array(numbers, np.int32)[cell])], ["query", "vector", "bound", "cell"]
                )

        return tasks

    def visit(tree: pa.Table, group: pa.Table) -> pa.Table:
        if not tree.num_rows or not group.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        loaded, root = _pages(tree), np.array(tree["root"][0].as_py())
        points = _matrix(group["vector"], width)
        found = [
            (name, score, owner)
            for name, point, bound in zip(group["query"].to_pylist(), points, group["bound"].to_pylist())
            for score, owner in search(loaded, root, point, keep, top, bound)
        ]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query", "score", "id"), columns)})

    def visited(waiting: DataFrame, first: bool) -> DataFrame:
        trees = F.create_map(*(F.lit(x) for c, (n, _) in cells.items() for x in (c, n)))[F.col("cell")]
        sent = (
            waiting.mapInArrow(route(first), "query long, vector array<long>, bound double, cell int")
            .withColumn("sub", F.explode(F.sequence(F.lit(0), trees - 1)))
            .withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
        )
        copies = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        key = ["cell", "sub", "block"]
        found = copies.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(visit, FOUND)
        return _best(found, keep)

    near = durable(visited(asked.withColumn("bound", F.lit(float("inf"))), True))
    far = near.groupBy("query").agg((F.count(F.lit(1)) - F.max("nth")).alias("others"), F.min("score").alias("worst"))
    gap = F.sqrt(F.greatest(square + top - 2.0 * F.col("worst"), F.lit(0.0)))
    bounded = asked.join(far, "query", "left").select(
        "query", "vector", F.when(F.col("others") >= k, gap).otherwise(float("inf")).alias("bound")
    )
    best = _best(near.unionByName(visited(bounded, False)), keep)
    lists = best.groupBy("query").agg(F.collect_list(F.struct("score", "id")).alias("found")).join(asked, "query")
    pairs = (
        rows.where("asked").groupBy(F.col("id").alias("query_id"), "vector").agg(F.count(F.lit(1)).alias("asks"))
        .join(lists.select("vector", "found"), "vector")
        .select("query_id", "asks", F.explode("found").alias("f"))
        .where(F.col("query_id") != F.col("f.id"))
        .withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("asks"), F.lit(k)))))
        .select("query_id", F.col("f.id").alias("vec_id"), F.col("f.score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The best rows of each query that are :func:`needed`; ``nth`` counts the rows of one id."""
    own = Window.partitionBy("query", "id").orderBy(F.desc("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "nth")
    most = F.max("nth").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        found.select("query", "score", "id").repartition("query")
        .withColumn("nth", F.row_number().over(own)).where(F.col("nth") < keep)
        .withColumn("_others", F.row_number().over(order) - 1 - F.coalesce(most, F.lit(0)))
        .where(F.col("_others") < keep - 1).drop("_others")
    )
