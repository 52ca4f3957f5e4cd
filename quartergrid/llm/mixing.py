"""Mix sources to target weights by Pareto order sampling.

A source's target divided by its size gives whole copies that every document gets, and a
remainder. For the remainder documents are ranked by random odds over inclusion odds and
taken from the lowest rank until their words meet what is left of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartergrid.llm.joins import free, keyed
from quartergrid.session import durable

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (1, 2, 3)
MOST = 3
SEED = "mix"
BUCKETS = 1024
SALTS = 32


def targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """Target of each source from ``source, source_size``: one row per source, so one small window.

    Sources in code-point order, null last, weigh ``cycle`` in turn and share the sum of
    all sizes. A target stops at ``most`` times its source's size and the excess is shared
    by weight. Filling sources in the order of size per weight settles all stops at once:
    a source stops when its share of what the earlier ones leave reaches its limit. A
    source without words has target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), place))
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = full.rowsBetween(Window.unboundedPreceding, -1)
    later = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    filled = weighed.select(
        "*",
        (
            F.sum("source_size").over(everything)
            - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
        ).alias("left"),
        F.sum("weight").over(later).alias("weights"),
    ).withColumn(
        "stops", most * F.col("source_size") * F.col("weights") <= F.col("weight") * F.col("left")
    )
    settled = filled.select(
        "*",
        F.max(F.when(~F.col("stops"), F.col("weights"))).over(everything).alias("open_weights"),
        F.max(F.when(~F.col("stops"), F.col("left"))).over(everything).alias("open_left"),
    )
    return settled.select(
        "source",
        "source_size",
        "source_rows",
        F.when(F.col("stops"), (most * F.col("source_size")).cast("double"))
        .otherwise(F.col("weight") * F.col("open_left").cast("double") / F.col("open_weights"))
        .alias("target"),
    )


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|" + seed))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = SEED,
    cycle: tuple[int, ...] = CYCLE,
    most: int = MOST,
    row: str | None = None,
) -> DataFrame:
    """Copies of each document in the mix, one row per input row.

    Inclusion odds within a source are those of its remainder times the root of the
    document's size over the source's mean, so long documents are likelier. The document
    at which the words meet the target is taken if that comes nearer to it. Null and empty
    texts have size 0 and are never taken; null sources are one source; repeated rows are
    ranked alike and side by side; an empty table gives no rows. Results depend on ids,
    texts, sources and the seed only.

    Columns: ``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``copies``, ``taken``.
    """
    sized = durable(
        docs.select(
            docs[doc_id].alias("doc_id"),
            docs[source].alias("source"),
            F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.pmod(F.xxhash64(docs[doc_id] if row is None else docs[row]), F.lit(SALTS)).cast("int").alias("_salt"),
            *([] if row is None else [docs[row].alias("row"), F.coalesce(docs[doc_id].cast("string"), F.md5(docs[text])).alias("_draw")]),
        )
    )
    by_source = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = (
        targets(by_source, cycle, most)
        .withColumn("ratio", ratio)
        .withColumn("whole", F.floor("ratio"))
        .select(
            F.col("source").alias("_source"),
            *("source_size", "target", "whole"),
            (F.col("target") - F.col("whole") * F.col("source_size")).alias("wanted"),
            (F.col("ratio") - F.col("whole")).alias("remainder"),
            (F.col("source_size") / F.col("source_rows")).alias("mean_size"),
        )
    )
    draw = uniform(F.col("doc_id" if row is None else "_draw"), seed)
    odds = F.col("remainder") / (1 - F.col("remainder")) * F.sqrt(F.col("size") / F.col("mean_size"))
    rank = draw / (1 - draw) / odds
    ranked = durable(
        _with_source(sized, shares).select(
            *sized.columns,
            *("source_size", "target", "whole", "wanted"),
            F.when((F.col("size") > 0) & (F.col("remainder") > 0), rank / (1 + rank)).alias("rank"),
        )
    )
    place = ["rank", "doc_id"] if row is None else ["rank", "doc_id", "row"]
    cut = _cuts(ranked, place)
    first, second = _bucket(1), _bucket(2)
    below = (
        F.col("edge1").isNull()
        | (first < F.col("edge1"))
        | (first == F.col("edge1"))
        & (
            F.col("edge2").isNull()
            | (second < F.col("edge2"))
            | (second == F.col("edge2")) & (F.struct(*place) <= F.col("last"))
        )
    )
    extra = F.when(F.col("rank").isNotNull() & F.coalesce(below, F.lit(False)), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(0).cast("long")
    return _with_source(ranked, cut).select(
        "doc_id", "size", "source", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"), *([] if row is None else ["row"]),
    )


def _with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Add the columns of a row's source; salted, so a source that fills a third of the rows is cut up."""
    salted = per_source.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = rows["source"].eqNullSafe(salted["_source"]) & (rows["_salt"] == salted["_s"])
    return rows.join(salted, same, "left").drop("_source", "_s")


def _bucket(level: int) -> Column:
    return F.floor(F.col("rank") * float(BUCKETS**level))


def _edge(rows: DataFrame, level: int) -> DataFrame:
    """The bucket of each source in which the words pass what is wanted, and the words before it."""
    words = rows.groupBy("source", _bucket(level).alias("edge")).agg(
        F.sum("size").alias("words"), F.max("wanted").alias("wanted"), F.max("before").alias("before")
    )
    order = Window.partitionBy("source").orderBy("edge").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = words.withColumn("up_to", F.col("before") + F.sum("words").over(order)).where("up_to > wanted")
    return passed.groupBy(F.col("source").alias("_source")).agg(
        F.min(F.struct("edge", (F.col("up_to") - F.col("words")).alias("before"))).alias("at")
    )


def _cuts(ranked: DataFrame, place: list[str]) -> DataFrame:
    """Where each source's ranking is cut: a bucket, a bucket inside it, and the last row taken there.

    Two levels of 1,024 buckets leave a millionth of a source's rows to be sorted together.
    """
    rows = ranked.where("rank IS NOT NULL").withColumn("before", F.lit(0).cast("long"))
    cut = None
    for level in (1, 2):
        edge = durable(_edge(rows, level))
        inside = _with_source(rows.drop("before"), edge.select("_source", "at"))
        rows = inside.where(_bucket(level) == F.col("at.edge")).withColumn("before", F.col("at.before")).drop("at")
        here = edge.select("_source", F.col("at.edge").alias(f"edge{level}"))
        cut = here if cut is None else _join_source(cut, here)
    order = Window.partitionBy("source").orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        rows.withColumn("up_to", F.col("before") + F.sum("size").over(order))
        .where(F.col("up_to") - F.col("size") / 2 <= F.col("wanted"))
        .groupBy(F.col("source").alias("_source"))
        .agg(F.max(F.struct(*place)).alias("last"))
    )
    return _join_source(cut, last)


def _join_source(left: DataFrame, right: DataFrame) -> DataFrame:
    other = right.withColumnRenamed("_source", "_other")
    return left.join(other, left["_source"].eqNullSafe(other["_other"]), "left").drop("_other")


def mixed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None, **options
) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it.

    ``row`` tells rows apart; if no column does, a keyed copy of ``docs`` is written.
    """
    if row is None:
        row = free("_row", docs)
        return mixed(durable(keyed(docs, row)), doc_id, text, source, row, **options).drop(row)
    key, times, copy = (free(name, docs) for name in ("_mixed", "_copies", "_copy"))
    copies = mix(docs, doc_id, text, source, row=row, **options).select(F.col("row").alias(key), F.col("copies").alias(times))
    return (
        docs.join(copies.where(F.col(times) > 0), docs[row] == F.col(key))
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
        .drop(key, times, copy)
    )
