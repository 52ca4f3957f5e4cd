import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from quartergrid.llm.chosen_path import drop_near_copies
from quartergrid.llm.content_dedup import drop_copies, mark_copies
from quartergrid.llm.joins import keyed
from quartergrid.llm.mixing import mix, mixed
from quartergrid.session import durable

BLANK = re.compile(r"[\x20\x09-\x0D]")


def test_exact_copies_match_brute_force(edge_docs, no_docs):
    docs = [(r["doc_id"], r["text"] or "") for r in edge_docs.collect()]
    groups = {}
    for doc_id, text in docs:
        groups.setdefault(BLANK.sub("", text), []).append((-len(text), doc_id is None, doc_id or 0, doc_id))
    want = []
    for doc_id, text in docs:
        own = groups[BLANK.sub("", text)]
        keep = min(own, key=lambda g: g[:3])[3]
        want.append((doc_id, keep, len(own), doc_id == keep, hashlib.sha256(BLANK.sub("", text).encode()).hexdigest()))
    got = mark_copies(edge_docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert mark_copies(no_docs).count() == 0


def test_drop_copies_keeps_all_columns(edge_docs):
    kept = drop_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted(r["doc_id"] or 0 for r in kept.collect())
    assert ids == [0, 3, 6, 7, 8, 9, 9, 10]


def test_a_hot_text_is_cut_over_ranges(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.col("id").cast("string")).alias("text")
    )
    rows = mark_copies(docs).where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.max("group_size"))
    assert tuple(rows.first()) == (1000, 0, 0, 1000)


def test_mixture_meets_targets(spark, edge_docs, no_docs):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.expr("repeat('word ', cast(1 + id * 7 % 40 as int))").alias("text"),
        F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 100 == 1, "tiny").when(F.col("id") % 7 == 2, None).otherwise("mid").alias("source"),
    )
    rows = mix(docs).collect()
    assert len(rows) == 6000
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6 * total
    for source, (target, size) in targets.items():
        taken = sum(r["taken"] for r in rows if r["source"] == source)
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 20
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in rows)
    again = mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)
    assert mixed(docs).count() == sum(r["copies"] for r in rows)


def test_mixture_edges(edge_docs, no_docs):
    rows = mix(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r["taken"] == 0 for r in rows if not (r["size"]))
    assert mix(no_docs).count() == 0 and mixed(no_docs).count() == 0
    assert mixed(edge_docs).columns == edge_docs.columns


def test_long_documents_are_likelier(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(if(id % 2 = 0, 1, 16) as int))").alias("text"),
        F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"),
    )
    share = {r["size"]: r["p"] for r in mix(docs).where("source = 'a'").groupBy("size").agg(F.avg(F.least("copies", F.lit(1))).alias("p")).collect()}
    assert share[16] > share[1]


REPEATED = [
    (None, "A a a a a a", "s"), (None, "B b b b b b", "s"), (7, "A a a a a a", "s"),
    (8, "C c c c c c", "s"), (8, "D d d d d d", "s"), (5, "C c c c c c", "s"), (9, "E e e", "s"), (9, "E e e", "s"),
    (None, "F f f f", "s"), (None, "F f f f", "s"),
]


def test_rows_are_judged_apart_where_ids_repeat_or_are_null(spark):
    docs = durable(keyed(spark.createDataFrame(REPEATED, "doc_id long, text string, source string")))
    want = [(5, "C c c c c c"), (7, "A a a a a a"), (8, "D d d d d d"), (9, "E e e"), (None, "B b b b b b"), (None, "F f f f")]
    for dropped in (drop_copies(docs, row="row_key"), drop_near_copies(docs, row="row_key"), drop_near_copies(docs.drop("row_key"))):
        assert sorted([(r["doc_id"], r["text"]) for r in dropped.collect()], key=repr) == sorted(want, key=repr)
    got = {r["text"] for r in drop_copies(docs.drop("row_key")).collect()}
    assert got == {t for _, t in want}


def test_each_row_takes_its_own_copies(spark):
    rows = [(None, f"w{k} " * (1 + k % 9), "a" if k % 3 else "b") for k in range(60)] + [(1, "x y", "a"), (1, "z " * 9, "c")]
    docs = durable(keyed(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    counted = {r["row"]: r["copies"] for r in mix(docs, row="row_key").collect()}
    got = Counter(r["row_key"] for r in mixed(docs, row="row_key").collect())
    assert len(counted) == len(rows) and got == Counter({k: n for k, n in counted.items() if n})
    assert mixed(docs.drop("row_key")).count() == sum(counted.values())
