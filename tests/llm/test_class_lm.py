import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quartergrid.llm.class_lm import (
    ALL,
    ClassModel,
    Clustering,
    Core,
    _contexts,
    _flat,
    _matrix,
    _rare_words,
    class_bigrams,
    exchange_gains,
    likelihood,
    score_documents,
    sequences,
)

# One word in a hundred is frequent; the others travel by shuffle.
PLAN = Clustering(classes=4, core_share=0.01, sweeps=1, parts=2)


def training():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]


def base(docs, trains):
    """Add-one unigram scores by definition."""
    counts = Counter(t for (_, text), train in zip(docs, trains) if train for t in [*words(text), None])
    total = sum(counts.values())
    out = []
    for (doc_id, text), train in zip(docs, trains):
        own = [*words(text), None]
        score = sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in own)
        out.append((doc_id, not train, len(own), sum(counts[t] > 0 for t in own), total, round(score, 4)))
    return sorted(out, key=repr)


def taken(frame):
    rows = frame.collect()
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-9 for r in rows)
    return sorted(
        ((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows),
        key=repr,
    )


def grammar(n=300, seed=3):
    rng = np.random.default_rng(seed)
    parts = [[f"{kind}{i}" for i in range(12)] for kind in ("det", "noun", "verb")]
    out = []
    for i in range(n):
        text = " ".join(str(rng.choice(parts[k % 3])) for k in range(3 * int(rng.integers(2, 9))))
        out.append((i, text + (f" once{i}" if i % 3 == 0 else "")))
    return out


def test_base_counts_and_edges(spark, edge_docs, no_docs):
    docs = [(r["doc_id"], r["text"], r["t"]) for r in edge_docs.withColumn("t", training()).collect()]
    wanted = base([d[:2] for d in docs], [d[2] for d in docs])
    for plan in (Clustering(classes=3, sweeps=1), PLAN):
        assert taken(score_documents(edge_docs, training(), plan)) == wanted
    assert score_documents(no_docs, training(), PLAN).collect() == []
    nothing = base([d[:2] for d in docs], [False] * len(docs))
    assert taken(score_documents(edge_docs, F.lit(None).cast("boolean"), PLAN)) == nothing


def test_exchange_gain_is_the_likelihood_difference():
    rng = np.random.default_rng(1)
    stream, classes = rng.integers(0, 9, 400), 3
    # Texts are circles here as well: their end stands before the first word and after the last.
    after = np.roll(stream, -1)
    own = np.append(np.arange(8) % classes, 3)  # the last id stands for the end

    def matrix(of):
        m = np.zeros((5, 5), np.int64)
        np.add.at(m, (of[stream], of[after]), 1)
        return m

    m = matrix(own)
    for word in range(8):
        left = np.bincount(own[stream][after == word], minlength=5)
        right = np.bincount(own[after][stream == word], minlength=5)
        twice = int(((stream == word) & (after == word)).sum())
        gains = exchange_gains(m, own[[word]], left[None], right[None], np.array([twice]), classes)[0]
        for to in range(classes):
            moved = own.copy()
            moved[word] = to
            assert gains[to] - gains[own[word]] == pytest.approx(likelihood(matrix(moved)) - likelihood(m), abs=1e-6)


def test_known_words_the_end_and_an_unknown_word_share_all_probability():
    plan = Clustering(classes=3)
    rng = np.random.default_rng(5)
    class_of, n = rng.integers(0, 3, 30), rng.integers(1, 9, 30)
    bigrams = np.zeros((5, 5), np.int64)
    sizes = np.append(np.bincount(class_of, n, 3).astype(int), 7)
    for after, size in enumerate(sizes):
        np.add.at(bigrams, (rng.integers(0, 4, size), after), 1)
    model = ClassModel.of(bigrams, np.bincount(class_of, minlength=3), 31, plan)
    word = model.emission(class_of, n)
    for before in range(5):
        chances = 10 ** (model.follows[before, class_of] + word)
        assert chances.sum() + (10 ** model.follows[before, 3:]).sum() == pytest.approx(1)


def test_held_out_texts_score_above_the_unigram_model(spark):
    docs = grammar()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in score_documents(frame, training(), PLAN).collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    for r in held:
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))


def test_classes_find_the_parts_of_a_grammar(spark):
    docs = grammar(400)
    frame = spark.createDataFrame([(i, re.sub(" once.*", "", t)) for i, t in docs], "doc_id long, text string")
    rows = score_documents(frame, training(), Clustering(classes=3, sweeps=3, parts=2)).where("held_out").collect()
    per_token = sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    # One of twelve words of a known part of speech, and the end after every third word.
    assert per_token > math.log10(1 / 12) - 0.25


def test_packed_ids_of_a_cut_batch():
    texts = [[4, 9], [9], [70_000, 1, 1, 9], [9], [2, 9]]
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([np.array(t, "<i4").tobytes() for t in texts], pa.binary())})
    for first, n in ((0, 5), (1, 3), (2, 1)):
        ids, before, counts = _flat(batch.slice(first, n), 9)
        cut = texts[first : first + n]
        assert ids.tolist() == sum(cut, []) and counts.tolist() == [len(t) for t in cut]
        assert before.tolist() == sum(([9, *t[:-1]] for t in cut), [])


def test_one_reading_counts_contexts_and_bigrams_and_rare_words_have_places(spark):
    plan = Clustering(classes=2)
    core = Core(pa.array([b"a", b"b"], pa.binary()), np.array([4, 3]), np.array([0, 1, 2, 3]), 4)
    shared = spark.sparkContext.broadcast(core)
    docs = [(1, "a b x y a", True), (2, "", True), (3, "z b a", True), (4, "a x b", True)]
    rows = sequences(spark.createDataFrame(docs, "doc_id long, text string, train boolean").coalesce(1), shared).cache()
    bigrams = class_bigrams(rows, shared, plan)
    assert bigrams.sum() == 6 + 1 + 4 + 4
    for part in range(plan.parts):
        counted = _contexts(rows, shared, plan, part).where(F.col("word") == ALL)
        assert np.array_equal(_matrix(counted, plan.classes + 2), bigrams)
    rare = _rare_words(rows, shared).orderBy("place").collect()
    assert [(bytes(r["word"]), r["place"]) for r in rare] == [(b"x", 2), (b"y", 3), (b"z", 7), (b"x", 12)]
