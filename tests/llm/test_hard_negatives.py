import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quartergrid.llm.hard_negatives import Mining, block_products, hard_negatives, streamed
from quartergrid.llm.queries import SQL

SCHEMA = "vec_id long, embedding array<float>, label int, anchor int, score string"

def table(n=400, seed=0, width=6):
    """Ties, repeated rows, repeated ids, nulls, non-finite values, and one label with a third of all rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        vector = (rng.integers(-3, 5, width) / 8).tolist()
        label = 3 if i % 3 == 0 else int(rng.integers(0, 4))
        rows.append((i, vector, label, 1, "x"))
        if i % 50 == 0:
            rows += [rows[-1]] * 3
        if i % 100 == 0:
            rows.append((i, vector, (label + 1) % 4, 1, "x"))
            rows.append((i, vector[::-1], label, 1, "x"))
    rows += [(100, None, 1, 1, "x"), (200, [1.0] * width, None, 1, "x"), (None, [1.0] * width, 1, 1, "x")]
    rows += [(300, [float("nan")] + [1.0] * (width - 1), 1, 1, "x"), (7, [None] + [1.0] * (width - 1), 1, 1, "x")]
    rows.append((14, [float("inf")] * width, 1, 1, "x"))
    return rows


def by_sql(rows):
    con = duckdb.connect()
    kinds = [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())]
    columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)]
    con.register("embeddings", pa.table(columns, names=[name for name, _ in kinds]))
    return sorted(con.sql(SQL["op13_secondary_sort_negatives"]).fetchall())


def mined(frame, plan=Mining()):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hard_negatives(frame, F.col("vec_id") % 100 == 0, label, plan).collect()))


def test_matches_sql_with_ties_repeats_and_nulls(spark):
    rows = table()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    wanted = by_sql(rows)
    assert wanted and mined(frame) == wanted
    # Three anchors at a time, and blocks of seven rows.
    assert mined(frame, Mining(wave_bytes=200, block=7)) == wanted


def test_no_rows_and_no_anchors(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [0.5], 1, 1, "x"), (2, [0.5], 2, 1, "x")], SCHEMA)) == []
    assert mined(spark.createDataFrame([(0, [0.5], 1, 1, "x")], SCHEMA)) == []
    zeros = [(100 * i, [0.0, 0.0], i % 2 + 1, 1, "x") for i in range(5)]
    assert mined(spark.createDataFrame(zeros, SCHEMA)) == by_sql(zeros)


def test_iterator_opens_and_closes_windows():
    plan = Mining(positives=2, negatives=2)
    keys = [(0, -100, False, 1, 5), (0, -95, True, 2, 6), (0, -90, True, 3, 6), (0, -80, False, 4, 5), (0, -80, True, 9, 6)]
    keys += [(0, -72, True, 5, 6), (0, -70, True, 6, 6), (0, -70, True, 6, 6), (0, -69, True, 7, 7), (0, -60, False, 8, 5)]
    keys += [(1, -50, True, 1, 1)]
    got = list(streamed(((k, None) for k in keys), plan))
    assert got == [(0, 1, 1, 3, 100, 90), (0, 1, 2, 9, 100, 80), (0, 4, 1, 5, 80, 72), (0, 4, 2, 6, 80, 70)]


def test_products_are_exact_or_raise():
    big = np.array([[1 << 31, 3]], np.int64)
    assert block_products(big, big)[0, 0] == (1 << 62) + 9
    huge = np.array([[1 << 32, 3]], np.int64)
    try:
        block_products(huge, huge)
    except OverflowError:
        return
    raise AssertionError("a product beyond 64 bits must raise")
