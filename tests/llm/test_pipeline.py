import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

CLASHING = ("row_key", "copies", "_gone", "_of", "_row", "_mixed", "_copy", "salt", "rank")
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def bare(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def sentence(seed, n=40):
    return " ".join(f"{chr(97 + (seed * 7 + i) % 26)}word{(seed * 31 + i * i) % 997}" for i in range(n))


def documents():
    rows = []
    for i in range(24):
        text = sentence(i)
        rows.append((i, text, "en" if i % 2 else "de", "ab"[i % 2], len(text)))
        if i % 4 == 0:
            rows.append((100 + i, " " + text.replace(" ", "  ") + "\n", "en", "a", 0))
        if i % 6 == 0:
            rows.append((200 + i, text + " tail", None, None, 0))
    rows += [(300, None, "en", "a", 0), (301, "", None, "b", 0), (302, "12 34 !!", "en", None, 0)]
    rows += [(1, sentence(90), "en", "a", 0), (None, sentence(91), "en", "b", 0), (None, sentence(92), "de", None, 0)]
    return rows + [rows[0], rows[-1]]


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows):
        frame = spark.createDataFrame(rows, FIELDS)
        for name in CLASHING:
            frame = frame.withColumn(name, F.concat(F.lit(name), F.coalesce("doc_id", F.lit(-1))))
        path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        frame.repartition(3).write.parquet(f"{path}/documents.parquet")
        return path

    return write


def staged(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        out.append(docs)
    return out


def test_every_stage_against_its_own_input(spark, folder):
    path = folder(documents())
    first = spark.read.parquet(f"{path}/documents.parquet")
    identified, exact, near, mixed, packed = staged(spark, path)
    kept = [(r["doc_id"], r["text"]) for r in identified.collect()]
    wanted = [(i, t) for i, t, *_ in documents() if re.search("[a-z]", t or "")]
    assert sorted(kept, key=repr) == sorted(wanted, key=repr)
    texts = [r["text"] for r in exact.collect()]
    assert sorted(map(bare, texts)) == sorted({bare(t) for _, t in wanted})
    # Of each text with a tail, which is a near copy, one of two stays.
    near_texts = [r["text"] for r in near.collect()]
    assert len(near_texts) == len(texts) - 4 and {" ".join(t.split(" tail")[0].split()) for t in near_texts} == {
        " ".join(t.split(" tail")[0].split()) for t in texts
    }
    assert {r["text"] for r in mixed.collect()} <= set(near_texts)
    assert mixed.columns == first.columns and mixed.where("copies <> concat('copies', coalesce(doc_id, -1))").count() == 0
    pieces = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert pieces <= 4096
    assert packed.where("start = 0").count() == mixed.count()


def test_empty_and_unlabelled_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).count() == 0
    unlabelled = [(i, t, None, s, n) for i, t, _, s, n in documents()]
    assert corpus_pipeline.run(spark, folder(unlabelled)).count() > 0


def test_the_mixture_weighs_the_identified_languages_of_a_source(spark, folder):
    rng = random.Random(4)
    kinds = {"de": ("sch", "ung", "ver", "lich"), "fr": ("eux", "qui", "ais", "oir")}
    rows = []
    for k, (lang, parts) in enumerate(kinds.items()):
        for i in range(60):
            text = " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(40)) + "."
            rows.append((100 * k + i, text, lang if i % 4 else None, "a", 0))
    identified, _, near, mixed, _ = staged(spark, folder(rows))
    assert identified.columns[-2] == "identified_lang"
    assert all(r["identified_lang"] == ("fr" if r["doc_id"] >= 100 else "de") for r in identified.collect())
    total, taken = 40 * near.count(), [40 * mixed.where(c).count() for c in ("doc_id < 100", "doc_id >= 100")]
    assert taken == pytest.approx([total / 3, 2 * total / 3], abs=40)
