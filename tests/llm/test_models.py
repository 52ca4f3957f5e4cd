import os
import random
import re
import subprocess
import sys
import zlib
from itertools import product
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quartergrid.llm import language, secret_forest, toxicity, weak_quality
from quartergrid.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def strings(seed, n, letters="abc"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(n)]


def brute_kernel(s, t, order, decay):
    def places(x):
        out = {}
        def walk(start, chosen):
            if len(chosen) == order:
                word = "".join(x[i] for i in chosen)
                out[word] = out.get(word, 0.0) + decay ** (chosen[-1] - chosen[0] + 1)
                return
            for i in range(start, len(x)):
                walk(i + 1, [*chosen, i])
        walk(0, [])
        return out
    a, b = places(s), places(t)
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def test_subsequence_kernel_matches_brute_force():
    marks = toxicity.Landmarks(strings(1, 5), 3, 0.7, 1)
    for s in strings(2, 20):
        own = brute_kernel(s, s, 3, 0.7)
        want = [brute_kernel(s, t, 3, 0.7) / np.sqrt(own * brute_kernel(t, t, 3, 0.7)) for t in marks.strings]
        assert np.allclose(marks.kernels([s])[0], want, atol=1e-5)
    assert (marks.kernels(["", "ab"]) == 0).all()


def toxic_texts():
    rng = random.Random(5)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts, labels = [], []
    for k in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        if k % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zyxwot", "quonker", "vlimpet"]))
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    return texts, labels


def test_toxicity_sees_gapped_insults():
    texts, labels = toxic_texts()
    model = toxicity.fit(texts, labels, toxicity.Training(landmarks=24))
    tests = ["abc z y x w o t def quo-nker", "gab vlimmpet zyx.wot quonkker abc", "abc def gab fed", "", None, "ab " * 4000]
    got = toxicity._scored(pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": pa.array(tests, pa.string())}), model)
    assert got["predicted"].to_pylist() == [1, 1, 0, 0, 0, 0]
    assert all(0 <= s <= 1 for s in got["score"].to_pylist())


def test_units_cover_long_words_and_spelled_words():
    found = toxicity.units(pa.array(["x" * 30 + "idiot" + "y" * 30, "an i d i o t", None], pa.string()))
    own = np.split(found.codes, np.cumsum(found.counts)[:-1])
    assert any("idiot" in found.strings[k] for k in own[0])
    assert "idiot" in [found.strings[k] for k in own[1]] and not len(own[2])


def brute_marginals(emissions, transitions):
    n, size = emissions.shape
    total, out, pairs = 0.0, np.zeros((n, size)), np.zeros((size, size))
    for path in product(range(size), repeat=n):
        w = np.exp(sum(emissions[i, p] for i, p in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        total += w
        for i, p in enumerate(path):
            out[i, p] += w
        for a, b in zip(path, path[1:]):
            pairs[a, b] += w
    return out / total, pairs / total


def test_forward_backward_matches_all_paths():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 4, 2, 6])
    starts = np.cumsum(lengths) - lengths
    emissions, transitions = rng.normal(size=(13, 3)), rng.normal(size=(3, 3))
    got, expected = language.forward_backward(emissions, transitions, starts, lengths, pairs=True)
    total = np.zeros((3, 3))
    for s, n in zip(starts, lengths):
        want, pairs = brute_marginals(emissions[s : s + n], transitions)
        assert np.allclose(got[s : s + n], want)
        total += pairs
    assert np.allclose(expected, total)


def switched_model():
    rng = random.Random(1)
    make = lambda parts: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    kinds = {"aa": ["ba", "bo", "li"], "bb": ["sch", "ung", "ver"], "cc": ["eux", "qui", "ée"]}
    texts = [(k, " ".join(make(p) for _ in range(30)) + ".") for k, p in kinds.items() for _ in range(60)]
    return language.fit([t for _, t in texts], [k for k, _ in texts]), kinds, make


def test_words_of_switched_text_are_labelled():
    model, kinds, make = switched_model()
    words = [make(kinds["aa"]) for _ in range(8)] + [make(kinds["bb"]) for _ in range(8)]
    sure, counts = language.distributions(pa.array([" ".join(words)]), model)
    assert sure.argmax(axis=1).tolist() == [0] * 8 + [1] * 8 and counts.tolist() == [16]


def test_documents_without_letters_are_unknown(spark, edge_docs, no_docs):
    model, _, _ = switched_model()
    rows = language.label_documents(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    unknown = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert unknown == {4, 5, 6} and all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert all(0 <= r["score"] <= 1 for r in rows)
    kept = language.keep_identified(edge_docs, model, least=0.0)
    assert kept.columns == edge_docs.columns and kept.count() == len(rows) - 3
    assert language.label_documents(no_docs, model).count() == 0
    unlabelled = edge_docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    for table in (no_docs, unlabelled):
        nothing = language.fit_table(table)
        assert {(r["lang_pred"], r["score"]) for r in language.label_documents(edge_docs, nothing).collect()} == {("und", 0.0)}
        assert language.keep_identified(edge_docs, nothing).count() == len(rows) - 3


def test_held_out_language(spark):
    rows = QUERIES["op10_language_crf"](spark, FOLDER).join(
        spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)


def test_held_out_toxicity(spark):
    rows = QUERIES["op2_subsequence_toxicity"](spark, FOLDER).join(
        spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic"), "doc_id"
    ).where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.9 * len(rows)


def test_quality_follows_true_labels(spark):
    rows = QUERIES["op3_weak_label_quality"](spark, FOLDER).join(
        spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality"), "doc_id"
    ).collect()
    for value in (0, 1):
        own = [r for r in rows if r["quality"] == value]
        assert sum(r["predicted"] == value for r in own) >= 0.85 * len(own)


def test_label_model_joins_labellers_that_see_different_faults():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.8
    fault = rng.integers(0, 4, len(truth))
    cast = np.ones((len(truth), 4), np.int8)
    for k in range(4):
        cast[~truth & ((fault == k) | (rng.random(len(truth)) < 0.2)), k] = 0
        cast[truth & (rng.random(len(truth)) < 0.002), k] = 0
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    model = weak_quality.estimate(patterns, counts.astype(float))
    assert ((model.posterior(cast) >= 0.5) == truth).mean() > 0.98
    assert abs(model.prior - 0.8) < 0.08


def test_quality_edges(edge_docs, no_docs):
    rows = weak_quality.score_quality(edge_docs, *weak_quality.fit_table(edge_docs)).collect()
    assert len(rows) == edge_docs.count()
    assert all(r["score"] == 0 and r["predicted"] == 0 for r in rows if r["doc_id"] in (4, 5, 6))
    assert weak_quality.score_quality(no_docs, *weak_quality.fit_table(no_docs)).count() == 0


def test_secret_forest_drops_false_findings(spark, no_docs, edge_docs):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("enschtalionverheit") for _ in range(n))
    code = lambda n, s: "".join(rng.choice(s) for _ in range(n))
    rows = []
    for k in range(300):
        parts = [word(5) for _ in range(20)]
        kind = k % 5
        found = [
            "AKIA" + code(16, "ABCDEFGHIJ234567"), f'token = "{code(40, "0123456789abcdef")}"', word(18), code(16, "0123456789"),
            f"password={code(14, 'abcdef0123456789')}",
        ][kind]
        parts.insert(10, found)
        rows.append((k, " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = secret_forest.scan(docs).collect()
    texts = dict(rows)
    assert all(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["candidate"] for r in got)
    wrong = [r for r in got if r["is_secret"] != (r["doc_id"] % 5 in (0, 1, 4))]
    assert len(wrong) <= 3 and {r["doc_id"] for r in got} == set(texts)
    assert secret_forest.scan(no_docs).count() == 0
    secret_forest.scan(edge_docs).collect()


def test_toxicity_edges(spark, edge_docs, no_docs):
    texts, labels = toxic_texts()
    model = toxicity.fit(texts, labels, toxicity.Training(landmarks=16))
    rows = toxicity.score_documents(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(r["score"] is not None for r in rows)
    assert toxicity.score_documents(no_docs, model).count() == 0
    none = toxicity.fit_table(no_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_documents(edge_docs.limit(3), none).where(F.col("score").isNull()).count() == 0


def test_prefixed_names_give_their_values():
    texts = {
        "db_password: hunter2!x9": "hunter2!x9", 'client_secret = "p4ss-W0rd.9"': "p4ss-W0rd.9", 'DB_PASSWORD="k9$Lm2!qz7"': "k9$Lm2!qz7",
        "AUTH_TOKEN: a8f.93kd.zz1": "a8f.93kd.zz1", "password: hunter2!x9": "hunter2!x9",
        "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG": "wJalrXUtnFEMI/K7MDENG", "src/config/app/my.db_password: hunter2!x9": "hunter2!x9",
    }
    names = secret_forest.Describer.names
    for text, value in texts.items():
        found = [(text[a:b], secret_forest.Describer().describe(text, a, b)) for a, b in secret_forest.spans(text)]
        assert found[-1][0] == value and len(found) == 1
        assert found[-1][1][names.index("assigned")] == found[-1][1][names.index("telling")] == 1
    text = "0123456789abcdef0123, token=abc.def1 and 0123456789abcdef4567"
    assert [text[a:b] for a, b in secret_forest.spans(text)] == ["0123456789abcdef0123", "abc.def1", "0123456789abcdef4567"]


def test_dictionary_reads_every_text_and_counts_copies_once(spark):
    rows = [(0, "Wasserfall einmal"), (1, "ein wasserfall, Kathedrale"), (2, "die Kathedrale steht"), (3, "abcd1 steht=")]
    rows += [(k, "hotcopy words") for k in range(10, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = secret_forest.dictionary(docs)
    assert {r["word"] for r in words.collect()} == {"wasserfall", "kathedrale"}
    runs = spark.createDataFrame([(1, "WasserfallKathedrale token=hotcopyhotcopyhot"), (None, "a/wasserfall/12345678")], "doc_id long, text string")
    found = secret_forest.candidates(runs, secret_forest.Describer())
    at = secret_forest.Describer.names.index("covered")
    got = {r["candidate"]: r["features"][at] for r in secret_forest.with_coverage(found, words).collect()}
    assert got == {"WasserfallKathedrale": 1.0, "hotcopyhotcopyhot": 0.0, "a/wasserfall/12345678": 10 / 21}


def test_evenly_switched_text_stays(spark):
    model, kinds, make = switched_model()
    text = " ".join(make(kinds[k]) for k in ("aa", "bb", "cc") for _ in range(8))
    docs = spark.createDataFrame([(1, text), (2, "123 !!")], "doc_id long, text string")
    label = language.label_documents(docs, model).where("doc_id = 1").first()
    assert label["lang_pred"] != "und" and label["score"] < 0.5
    assert [r["doc_id"] for r in language.keep_identified(docs, model).collect()] == [1]


FIT_AND_MEASURE = """
import random, re
from pathlib import Path
from pyspark.sql import SparkSession
from quartergrid.llm import language

def held():
    return sum(map(int, re.findall(r"Pss_Anon: +([0-9]+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

rng = random.Random(2)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
text = lambda extra: " ".join("".join(rng.choices("abcdefghijklmnop" + extra, k=rng.randint(2, 9))) for _ in range(500))
docs = spark.createDataFrame([(k, text(k)) for k in ("x", "y", "z") for _ in range(300)], "lang string, text string")
docs.groupBy("lang").count().collect()
before = held()
model = language.fit_table(docs)
print("HELD", held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_the_driver_keeps_no_memory_of_the_fit():
    env = os.environ | {"PYTHONPATH": str(Path(language.__file__).parents[2])}
    run = subprocess.run([sys.executable, "-c", FIT_AND_MEASURE], capture_output=True, text=True, timeout=300, env=env)
    assert run.returncode == 0, run.stderr[-2000:]
    assert float(re.search(r"HELD (.*)", run.stdout)[1]) < 60
