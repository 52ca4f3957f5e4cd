import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quartergrid.llm.chosen_path import JoinPlan, _leaves, class_table, drop_near_copies, intersections, signatures
from quartergrid.llm.components import components
from quartergrid.llm.joins import look_up
from quartergrid.llm.metric_topk import Shape, build, search, top_products
from quartergrid.llm.words import grouped, slices


def near_copies(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(20)]
    docs = []
    for base in range(12):
        words = (passage if base % 2 else []) + [word() for _ in range(60 + 10 * base)]
        for copy in range(1 + base * 3):
            own = list(words)
            for _ in range(copy % 4):
                own[rng.randrange(len(own))] = word()
            docs.append(" ".join(own))
    docs += [docs[-1]] * 5 + [passage_text for passage_text in [" ".join(passage)] * 3] + ["one two", "one two", "", None, "x"]
    return list(enumerate(docs))


def brute_classes(docs, similarity=0.8):
    sets = []
    for _, text in docs:
        w = (text or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    label, links = list(range(len(docs))), [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return [(docs[i][0], docs[label[i]][0], links[i]) for i in range(len(docs))]


def test_classes_match_brute_force(spark):
    docs = near_copies()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for plan in (JoinPlan(), JoinPlan(leaf=4, block=8)):
        got = class_table(frame, plan).select("doc_id", "class_id", "n_links").collect()
        assert sorted(map(tuple, got)) == brute_classes(docs)
    kept = drop_near_copies(frame)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in brute_classes(docs)})


def test_class_edges(edge_docs, no_docs):
    rows = {r["doc_id"]: r for r in class_table(edge_docs).collect()}
    assert class_table(edge_docs).count() == edge_docs.count()
    assert all(rows[k]["class_id"] == k and rows[k]["n_links"] == 0 for k in (4, 5, 6))
    assert rows[8]["class_id"] == 7 and rows[3]["class_id"] == 1 and rows[2]["n_links"] == 2
    assert rows[9]["n_links"] == 1 and rows[9]["class_size"] == 2
    assert class_table(no_docs).count() == 0
    assert drop_near_copies(edge_docs).columns == edge_docs.columns


def test_components_of_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 400)] + [(500, 500)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {**{k: 0 for k in range(51)}, **{k: 100 for k in range(100, 400)}}


def test_intersections_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (1, 10, 200, 250, 90)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = intersections(sets, width=16)
    off = ~np.eye(5, dtype=bool)
    assert (got[off] == np.array(want)[off]).all()


def test_groups_and_slices_cross_batches():
    batches = [pa.RecordBatch.from_pydict({"k": list(b), "n": list(range(len(b)))}) for b in ("aab", "bb", "", "bcd", "d")]
    got = [(t["k"][0].as_py(), t.num_rows) for t in grouped(iter(batches), "k")]
    assert got == [("a", 2), ("b", 4), ("c", 1), ("d", 2)]
    batch = pa.RecordBatch.from_pydict({"t": ["aaaa", None, "b" * 100, "", "cc"]})
    parts = [p["t"].to_pylist() for p in slices(batch, "t", 10)]
    assert sum(parts, []) == batch["t"].to_pylist() and len(parts) > 1


def test_tree_search_matches_brute_force_and_prunes():
    rng = np.random.default_rng(7)
    centres = rng.integers(-200, 200, (12, 6))
    vectors = (centres[rng.integers(0, 12, 900)] + rng.integers(-4, 5, (900, 6))).astype(float)
    ids = np.stack([np.arange(900), np.full(900, np.iinfo(np.int64).max)], axis=1)
    top = float((vectors**2).sum(axis=1).max())
    pages = build(vectors, ids, top, Shape(page=16, fanout=4))
    assert sum(len(p.vectors) for p in pages if p.leaf) == 900
    root = np.append(vectors[0], np.sqrt(max(top - (vectors[0] ** 2).sum(), 0)))
    for query in vectors[:40]:
        scores = (vectors @ query).astype(int)
        want = sorted(zip((-scores).tolist(), range(900)))[:6]
        got = search(pages, root, query, 6, top, float("inf"))
        assert [(-s, i) for s, i in got] == want


def brute_top(rows, k):
    usable = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in usable)
    usable = [(i, np.pad(v, (0, width - len(v))).astype(int)) for i, v in usable]
    out = []
    for i, q in usable:
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for j, v in usable if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_products_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(120)]
    rows += [(1000, None), (1050, [1.0, None, 0.0, 0.0]), (1100, [float("nan"), 0.0, 0.0, 0.0]), (1150, [float("inf"), 0.0, 0.0, 0.0]), (1200, [0.5]), (1250, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = F.col("vec_id") % 50 == 0
    for shape in (Shape(), Shape(pivots=4, tree=40, page=8, fanout=3, queries=5)):
        got = top_products(frame, asked, 5, shape=shape).select("query_id", "rank", "vec_id", "score").collect()
        assert sorted(map(tuple, got)) == brute_top(rows, 5)
    assert top_products(frame.where("vec_id = 50"), asked, 5).count() == 0
    assert top_products(frame.limit(0), asked, 5).count() == 0


def test_huge_components_stay_exact(spark):
    rows = [(0, [1e7, 1.0]), (50, [1e7, 2.0]), (1, [1.0, 7.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in top_products(frame, F.col("vec_id") % 50 == 0, 5).collect()}
    assert got[0, 1] == 50 and got[50, 1] == 0


def test_repeated_rows_count_as_in_sql(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3) / 4]) for i in range(160)]
    rows += [rows[0]] * 7 + [rows[50]] * 2 + [rows[k] for k in range(1, 160, 3) for _ in range(k % 4)]
    rows += [(100, [float(x) / 4, 1.0, -1.0]) for x in range(9)]  # one asked id with many vectors
    rows += [(0, [0.75, 0.75, 0.75])] * 6 + [(k, [0.75, 0.75, 0.75]) for k in (171, 172, 173)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    usable = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    want = []
    for query in (0, 50, 100, 150):
        scored = sorted((-int(q @ v), j) for i, q in usable if i == query for j, v in usable if j != query)
        want += [(query, n + 1, j, -s) for n, (s, j) in enumerate(scored[:5])]
    for shape in (Shape(), Shape(pivots=4, tree=40, page=8, fanout=3, queries=5)):
        got = top_products(frame, F.col("vec_id") % 50 == 0, 5, shape=shape).collect()
        assert sorted(map(tuple, got)) == want


def test_rounds_of_small_joins_hold_no_broadcast(spark):
    rows = spark.createDataFrame([("x", "y"), ("z", "y")], "key string, b string")
    labels = spark.createDataFrame([("x", 1), ("y", 2)], "node string, component int")
    found = look_up(rows, labels)
    assert [(r["key"], r["found"]) for r in found.collect()] == [("x", 1)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_rounds_on_small_tables_take_few_tasks_and_files(spark):
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long")
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        labels = components(edges)
        assert labels.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert {r["component"] for r in labels.collect()} == {0}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_both_ways_of_the_edges_come_from_one_pass(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long").mapInArrow(counted, "a long, b long")
    assert components(edges).count() == 51 and read.value == 50


def counting(frame, read):
    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(counted, frame.schema)


def test_texts_are_compared_in_one_pass_without_a_sample(spark):
    read, docs = spark.sparkContext.accumulator(0), near_copies()
    table = class_table(counting(spark.createDataFrame(docs, "doc_id long, text string"), read))
    assert read.value == 2 * len(docs)
    assert sorted(map(tuple, table.select("doc_id", "class_id", "n_links").collect())) == brute_classes(docs)


def test_later_levels_do_not_read_all_sets(spark):
    frame = spark.createDataFrame([(k, " ".join(f"{c}{k}" for c in "abcdefgh")) for k in range(400)], "doc_id long, text string")
    reads = {}
    for levels in (2, 4):
        plan = JoinPlan(leaf=0, levels=levels)
        sets = signatures(frame.union(frame.limit(9)), plan, "doc_id", "text").localCheckpoint()
        read = spark.sparkContext.accumulator(0)
        _leaves(counting(sets, read), sets.count(), plan)
        reads[levels] = read.value
    assert reads[2] == reads[4]
