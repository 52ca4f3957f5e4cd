import os
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quartergrid.llm import packing
from quartergrid.llm.packing import Limits, Packer, Piece, pack
from quartergrid.llm.token_files import LANES, decode_segment, encode_segment, frequencies, round_trip
from quartergrid.llm.tokens import WordTokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def plain_ids(texts):
    encoded = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids for e in encoded]


def test_word_ids_are_those_of_whole_texts(edge_docs):
    texts = [r["text"] for r in edge_docs.select("text").collect()]
    texts += ["K İstanbul ﬁ x y   a\x1cb don't STRASSE ẞ 's 12,5%", "a  b\r\n\tc\x0bd\x0ce"]
    ids, counts = WordTokens(PATH).ids(pa.array(texts, pa.string()))
    want = plain_ids(texts)
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("n", [0, 1, LANES, LANES + 1, 70_000, 200_001])
def test_segment_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 49_408).astype(np.uint32)
    lengths = np.diff(np.concatenate([[0], np.sort(np.random.default_rng(1).integers(0, n + 1, 6)), [n]]))
    names = [None, -5, 1, 2, 3, 2**60, 9]
    data = encode_segment(ids, names, lengths)
    got, got_names, got_lengths = decode_segment(data)
    assert (got == ids).all() and got_names == names and got_lengths.tolist() == lengths.tolist()
    if n > LANES:
        blocks = np.frombuffer(data[8:12], "<u4")[0]
        parts = [decode_segment(data, [b])[0].reshape(-1) for b in reversed(range(blocks))]
        assert (np.concatenate(parts[::-1])[:n] == ids).all()
        assert len(data) < 4 * n + 300_000
        broken = bytearray(data)
        broken[-20] ^= 1
        with pytest.raises(ValueError):
            decode_segment(bytes(broken))


def test_frequencies_fill_the_scale():
    for counts in ([1], [5, 1], [10**6, 1, 1], list(range(1, 3000))):
        ids = np.repeat(np.arange(len(counts)), counts)
        present, shares = frequencies(ids)
        assert len(present) == len(counts) and shares.sum() == 1 << 20 and shares.min() >= 1


def test_token_files_give_all_documents_back(spark, edge_docs, no_docs):
    rows = round_trip(edge_docs, PATH).orderBy("start").collect()
    docs = sorted(((r["doc_id"], r["text"]) for r in edge_docs.collect()), key=lambda d: (d[0] is not None, d[0] or 0))
    want, at = [], 0
    for (doc_id, _), ids in zip(docs, plain_ids([t for _, t in docs])):
        want.append((doc_id, at, len(ids) + 1, crc([*ids, 1])))
        at += len(ids) + 1
    assert [tuple(r) for r in rows] == want
    assert round_trip(no_docs, PATH).count() == 0


def check_packing(rows, texts, limits, end_id=2):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for doc_id, own in pieces.items():
        want = texts[doc_id]
        copies = len(own and [r for r in own if r["start"] == 0])
        assert sum(r["length"] for r in own) == copies * len(want)
        for r in own:
            ids = np.frombuffer(r["ids"], "<u4").tolist()
            assert ids == want[r["start"] : r["start"] + r["length"]]
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own])
        assert [r["offset"] for r in own] == [0, *ends[:-1].tolist()]
        assert ends[-1] <= limits.tokens and len(own) <= limits.segments
        assert sum(r["length"] - r["prompt_tokens"] for r in own) <= limits.loss_tokens
    return sequences


def test_packing_holds_every_id_once(edge_docs, no_docs):
    docs = edge_docs.where("doc_id IS NOT NULL")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {k: [*ids, 2] for k, ids in zip(texts, plain_ids(list(texts.values())))}
    rows = pack(docs, PATH).collect()
    assert {r["doc_id"] for r in rows} == set(want)
    lengths = [sum(r["length"] for r in s) for s in check_packing(rows, want, Limits()).values()]
    assert all(n == 4096 or n & (n - 1) == 0 for n in lengths)
    assert pack(no_docs, PATH).count() == 0


def test_packing_under_all_limits(spark):
    rows = [(i, "ask " * (i % 7), "word " * (i * i % 90 + 1)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, prompt string, text string").repartition(2)
    limits = Limits(tokens=64, segments=3, loss_tokens=40)
    want = {k: a + b + [2] for (k, _, _), a, b in zip(rows, plain_ids([p for _, p, _ in rows]), plain_ids([t for _, _, t in rows]))}
    check_packing(pack(docs, PATH, limits, prompt="prompt").collect(), want, limits)


def test_conversations_pack_with_prompts(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    said = turns.groupBy("conv_id").agg(
        F.concat_ws(" ", F.collect_list(F.when(F.col("role") != "assistant", F.col("text")))).alias("asked"),
        F.concat_ws(" ", F.collect_list(F.when(F.col("role") == "assistant", F.col("text")))).alias("answer"),
    )
    limits = Limits(1024, 8, 512)
    ids = said.collect()
    want = {
        r["conv_id"]: a + b + [2]
        for r, a, b in zip(ids, plain_ids([r["asked"] for r in ids]), plain_ids([r["answer"] for r in ids]))
    }
    check_packing(pack(said, PATH, limits, doc_id="conv_id", text="answer", prompt="asked").collect(), want, limits)


def test_best_dot_product_is_placed_first():
    packer = Packer(Limits(10, 3, 10))
    for k, n in enumerate([2, 9, 5]):
        packer.waiting.append(Piece(k, 0, np.zeros(n, np.uint32), 0, n))
    first = next(packer._pack())
    assert first[0].doc_id == 1 and sum(len(p.ids) for p in first) == 10


PACK_AND_MEASURE = """
import random, re
from pathlib import Path
import pyarrow as pa
import public_tokenizers
from quartergrid.llm import packing

def status(field):
    return int(re.search(field + r":\\s+([0-9]+)", Path("/proc/self/status").read_text())[1]) / 1024

rng = random.Random(5)
words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) + rng.choice(["", "$$$"]) for _ in range(200_000)]
texts = [" ".join(rng.choices(words, k=500)) for _ in range(3000)]
batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([""] * 3000), pa.array(texts)], ["doc_id", "prompt", "text"])
del texts, words
path = public_tokenizers.path("word_bpe_49k.json")
packing.worker_tokens(path)
Path("/proc/self/clear_refs").write_text("5")  # the peak starts anew
before = status("VmRSS")
assert sum(b.num_rows for b in packing.packed(iter([batch]), 0, path, packing.Limits(), 2)) >= 3000
print("GREW", status("VmHWM") - before)
"""


@pytest.mark.skipif(not Path("/proc/self/clear_refs").exists(), reason="memory can't be read here")
def test_packing_keeps_no_memory_of_earlier_slices():
    env = os.environ | {"PYTHONPATH": str(Path(packing.__file__).parents[2])}
    run = subprocess.run([sys.executable, "-c", PACK_AND_MEASURE], capture_output=True, text=True, timeout=300, env=env)
    assert run.returncode == 0, run.stderr[-2000:]
    assert float(re.search(r"GREW (.*)", run.stdout)[1]) < 130
