"""Secret scan whose false positives a random forest removes.

Candidates are long runs of key characters and values assigned to telling names. Each is
described by its length, its characters' kinds and transitions, how much of it known words
cover, whether it looks like a path, and the words around it; the forest is trained on
labelled findings.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartergrid.llm.joins import look_up
from quartergrid.llm.words import slices
from quartergrid.session import durable

# What a candidate and the name of an assigned secret look like.
ASSIGNED = re.compile(
    r"""(?i:(?:api[_-]?key|access[_-]?key|key|token|secret|password|passwd|pwd)["']?\s*[:=]\s*["']?)([^\s"']{6,})"""
)
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
TELLING = ("key", "token", "secret", "password", "passwd", "pwd", "auth", "credential")
AROUND = 24
WORD_SLOTS = 16
SHORTEST, LONGEST = 4, 32
# Words that stand alone: letters beside digits or signs of encodings are mostly parts of keys.
WORD = rf"(?<![\p{{L}}\p{{N}}+=])(\p{{L}}{{{SHORTEST},{LONGEST}}}+)(?![\p{{L}}\p{{N}}+=])"
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Training:
    """Bounds of a fit: labelled findings of each label."""

    findings: int = 20_000
    trees: int = 40
    depth: int = 8
    seed: int = 11


@dataclass
class Describer:
    """Features of candidates; ``words`` are known ones in lower case, and may be given later by :func:`with_coverage`."""

    words: frozenset[str] = field(default_factory=frozenset)

    names = (
        "length", "lower", "upper", "digits", "marks", "kinds", "transitions", "longest_run", "entropy",
        "distinct", "covered", "slashes", "dots", "extension", "hex", "assigned", "quoted", "telling",
        *(f"near_{k}" for k in range(WORD_SLOTS)),
    )

    def describe(self, text: str, start: int, end: int) -> list[float]:
        found = text[start:end]
        size = len(found)
        kinds = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s" for c in found]
        changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
        run = longest = 1
        for a, b in zip(kinds, kinds[1:]):
            run = run + 1 if a == b else 1
            longest = max(longest, run)
        counts = Counter(found)
        entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
        before = text[max(0, start - AROUND) : start]
        near = re.findall(r"\w+", (before + " " + text[end : end + AROUND]).lower())
        slots = [0.0] * WORD_SLOTS
        for word in near:
            slots[xxhash.xxh32_intdigest(word) % WORD_SLOTS] = 1.0
        tail = before.rstrip(" \"'")
        return [
            float(size), kinds.count("l") / size, kinds.count("u") / size, kinds.count("d") / size,
            kinds.count("s") / size, float(len(set(kinds))), changes / size, longest / size, entropy,
            len(counts) / size, self.covered(found.lower()), found.count("/") / size, found.count(".") / size,
            float(bool(re.search(r"\.[a-z]{1,4}$", found))), float(bool(re.fullmatch(r"[0-9a-fA-F]+", found))),
            float(tail.endswith(("=", ":"))), float(before.endswith(("\"", "'"))),
            float(any(t in before.lower() for t in TELLING)), *slots,
        ]

    def covered(self, found: str) -> float:
        """Largest share of the characters that disjoint known words of ``SHORTEST`` letters or more cover."""
        best = [0] * (len(found) + 1)
        for end in range(1, len(found) + 1):
            best[end] = best[end - 1]
            for size in range(SHORTEST, min(end, LONGEST) + 1):
                if found[end - size : end] in self.words:
                    best[end] = max(best[end], best[end - size] + size)
        return best[-1] / max(len(found), 1)


def spans(text: str) -> list[tuple[int, int]]:
    """Where candidates lie: values assigned to a name that ends in a key word, and runs outside those and their names."""
    out, last = [], 0
    for match in ASSIGNED.finditer(text):
        name = match.start()
        while name > last and text[name - 1] in NAME:
            name -= 1
        out += [m.span() for m in RUN.finditer(text, last, name)]
        out.append(match.span(1))
        last = match.end()
    return out + [m.span() for m in RUN.finditer(text, last)]


CUT_ROWS = 256
FOUND = "doc_id long, start long, length long, candidate string, features array<double>"


def candidates(docs: DataFrame, describer: Describer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All candidates of whole texts with their features; ``start`` counts code points."""
    shared = docs.sparkSession.sparkContext.broadcast(describer)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _found(part, shared.value)

    return rows.mapInArrow(tasks, FOUND)


def _found(part: pa.RecordBatch, describer: Describer) -> pa.RecordBatch:
    out: list[tuple] = []
    for key, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
        for start, end in spans(text or ""):
            out.append((key, start, end - start, text[start:end], describer.describe(text, start, end)))
    columns = list(zip(*out)) or [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "length", "candidate", "features"]
    )


def rule_label(found: DataFrame) -> Column:
    """Labels of findings whose form settles them; null for the others.

    Access-key ids, and values of mixed letters and digits assigned to a telling name, are
    secrets. Runs of letters that read like words, digits alone, and hyphenated hexadecimal
    ids with no telling name near are not.
    """
    at = {name: F.col("features")[k] for k, name in enumerate(Describer.names)}
    text = F.col("candidate")
    mixed = text.rlike("[0-9]") & text.rlike("[A-Za-z]")
    secret = text.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$") | mixed & (at["assigned"] == 1) & (at["telling"] == 1) & (at["entropy"] > 3)
    harmless = (
        text.rlike("^[A-Z]?[a-z_-]+$|^[A-Z_-]+$|^[0-9_=/+-]+$")
        | text.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$") & (at["telling"] == 0)
    )
    return F.when(secret, 1.0).when(harmless, 0.0)


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word``: all words of four letters or more that stand in two different texts or more.

    The smallest and largest hash of the texts that hold a word settle that, so copies of a
    text count once and every task reduces its words before they are shuffled.
    """
    texts = docs.select(docs[text].cast("string").alias("text")).where("text IS NOT NULL")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(1)))
    return (
        texts.select(F.xxhash64("text").alias("of"), F.explode(words).alias("word"))
        .groupBy("word").agg(F.min("of").alias("first"), F.max("of").alias("last"))
        .where("first <> last").select("word")
    )


def with_coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the share that known words cover in its features.

    The dictionary has no bound, so it is joined to the distinct candidates' letter runs.
    """
    place = Describer.names.index("covered")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CUT_ROWS):
                own = batch.slice(at, CUT_ROWS)
                parts = [(n, p) for n, c in zip(own["node"].to_pylist(), own["low"].to_pylist()) for p in pieces(c)]
                nodes, keys = zip(*parts) if parts else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.string())], ["node", "key"])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = batch["features"].to_pylist()
            for row, low, known in zip(features, batch["candidate"].to_pylist(), batch["found"].to_pylist()):
                row[place] = Describer(frozenset(known)).covered(low.lower()) if known else 0.0
            columns = [batch[c] for c in ("doc_id", "start", "length", "candidate")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(features, pa.list_(pa.float64()))], ["doc_id", "start", "length", "candidate", "features"]
            )

    node = F.xxhash64("candidate")
    distinct = durable(found.select(node.alias("node"), F.col("candidate").alias("low")).dropDuplicates(["node"]))
    parts = distinct.mapInArrow(cut, "node long, key string")
    # Only words that stand in a candidate are copied to spread hot keys.
    met = durable(words.join(parts.select(F.col("key").alias("word")).distinct(), "word", "left_semi"))
    labels = met.select(F.col("word").alias("node"), F.lit(True).alias("component"))
    held = look_up(parts, labels).groupBy("node").agg(F.collect_set("key").alias("words"))
    known = distinct.select("node").join(held, "node", "left").select(
        "node", F.coalesce("words", F.array().cast("array<string>")).alias("component")
    )
    rows = found.withColumns({"key": node, "node": F.xxhash64("doc_id", "start")})
    return look_up(rows, known).select(*found.columns, "found").mapInArrow(cover, FOUND)


def pieces(candidate: str) -> set[str]:
    """All parts of the candidate's letter runs, in lower case, that could be words."""
    runs = LETTERS.findall(candidate.lower())
    return {
        run[a : a + n] for run in runs for a in range(len(run)) for n in range(SHORTEST, min(LONGEST, len(run) - a) + 1)
    }


def fit(labelled: DataFrame, training: Training = Training()) -> RandomForestClassificationModel:
    """A forest on ``features`` and ``label`` (0 or 1); at most ``training.findings`` rows of each label."""
    order = F.xxhash64("candidate", "features")
    rows = None
    for label in (0.0, 1.0):
        some = labelled.where(F.col("label") == label).orderBy(order, "candidate").limit(training.findings)
        rows = some if rows is None else rows.unionByName(some)
    rows = durable(rows.select(array_to_vector("features").alias("vector"), "label"))
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=training.trees, maxDepth=training.depth, seed=training.seed
    )
    return forest.fit(rows)


def scan(docs: DataFrame, training: Training = Training(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every candidate in every whole text with the forest's probability of a secret.

    ``is_secret`` is 1 from 0.5 on. Null and empty texts have no candidates; repeated rows
    are scanned each; only id and text are read; an empty table gives no rows. Where the
    rules settle findings of one label only, or none, that label (or 0) is given to all.
    """
    found = durable(candidates(docs, Describer(), doc_id, text))
    found = durable(with_coverage(found, dictionary(docs, text)))
    labelled = found.withColumn("label", rule_label(found)).where("label IS NOT NULL")
    present = sorted(r["label"] for r in labelled.select("label").distinct().collect())
    if len(present) < 2:
        scored = found.withColumn("score", F.lit(present[0] if present else 0.0))
    else:
        model = fit(labelled, training)
        given = model.transform(found.withColumn("vector", array_to_vector("features")))
        scored = given.withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        "doc_id", "start", "length", "candidate", "score", (F.col("score") >= 0.5).cast("int").alias("is_secret")
    )
