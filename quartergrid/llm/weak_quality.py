"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation,
and a hashed linear scorer trained on the posterior labels.

Each labeller votes high, low or abstains. How often it votes what in either class is
estimated from the counts of vote patterns over all documents, without any true label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartergrid.llm.words import factorize, slices, sums
from quartergrid.session import durable

LOW, HIGH, ABSTAIN = 0, 1, 2
TABLE = 1 << 16
SHAPES = 1 << 11  # the upper half is for words that repeat the one before

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for on was as with be by this are from or an at not "
    "le la les de des du et un une est que qui dans pour pas sur par au "
    "der die das und ist von zu den mit ein eine nicht im auf für als es "
    "el los las y en del se un una por con no para su".split()
)

# Name, and the bounds beyond which the labeller votes low and within which it votes high.
# A measure between the two abstains.
LABELLERS = {
    "upper_case": ((-1.0, 0.40), (0.0, 0.12)),
    "symbols": ((-1.0, 0.15), (0.0, 0.06)),
    "bars": ((-1.0, 0.10), (0.0, 0.02)),
    "repeated_lines": ((-1.0, 0.30), (-1.0, 0.10)),
    "word_length": ((2.0, 12.0), (3.0, 9.0)),
    "function_words": ((0.01, 2.0), (0.06, 2.0)),
    "marked_words": ((-1.0, 0.50), (0.0, 0.25)),
    "distinct_words": ((0.20, 2.0), (0.35, 2.0)),
    "letters": ((0.60, 2.0), (0.90, 2.0)),
    "echoed_words": ((-1.0, 0.15), (0.0, 0.03)),
}


def measures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One row of measures per text, then words per text, and rows of the scorer's table for each word."""
    codes, counts, raw = factorize(texts)
    words = raw.to_pylist()
    length = np.array([len(w) for w in words], float)
    upper = np.array([sum(map(str.isupper, w)) for w in words], float)
    letters = np.array([sum(map(str.isalpha, w)) for w in words], float)
    digits = np.array([sum(map(str.isdigit, w)) for w in words], float)
    symbols = length - letters - digits
    stop = np.array([w.lower().strip(".,;:!?") in FUNCTION_WORDS for w in words], float)
    bar = np.array([w == "|" for w in words], float)
    marked = (symbols >= 2).astype(float)
    kept = length[codes] > 0
    text_of = np.repeat(np.arange(len(counts)), counts)[kept]
    own = codes[kept]
    n = np.bincount(text_of, minlength=len(counts))
    echo = np.zeros(len(own), bool)
    echo[1:] = (own[1:] == own[:-1]) & (text_of[1:] == text_of[:-1])
    total = {k: sums(v[own], n) for k, v in dict(length=length, upper=upper, letters=letters, symbols=symbols, stop=stop, bar=bar, marked=marked).items()}
    distinct = np.bincount(np.unique(text_of * np.int64(len(words) + 1) + own) // (len(words) + 1), minlength=len(counts))
    some, characters = np.maximum(n, 1), np.maximum(total["length"], 1)
    measured = np.stack(
        [
            total["upper"] / np.maximum(total["letters"], 1),
            total["symbols"] / characters,
            total["bar"] / some,
            _repeated_lines(texts),
            characters / some,
            total["stop"] / some,
            total["marked"] / some,
            distinct / np.sqrt(some * np.minimum(some, 500.0)),
            total["letters"] / characters,
            np.bincount(text_of[echo], minlength=len(counts)) / some,
        ],
        axis=1,
    )
    hashed = np.array([xxhash.xxh32_intdigest(w.lower()) % TABLE for w in words], np.int64)
    shape = np.stack([np.minimum(length, 15), np.minimum(upper, 3), np.minimum(symbols, 3), np.minimum(digits, 3)], axis=1)
    shapes = (shape @ np.array([64, 16, 4, 1])).astype(np.int64) % (SHAPES // 2)
    return measured, n, hashed[own], shapes[own] + echo * (SHAPES // 2)


def _repeated_lines(texts: pa.Array) -> np.ndarray:
    """Share of each text's lines that repeat an earlier one."""
    lines = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
    count = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lines).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    size = np.int64(coded.max(initial=0) + 1)
    pairs = np.unique(np.repeat(np.arange(len(count)), count) * size + coded)
    return 1 - np.bincount(pairs // size, minlength=len(count)) / np.maximum(count, 1)


def votes(measured: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Votes of all labellers; all abstain on a text without words."""
    out = np.full(measured.shape, ABSTAIN, np.int8)
    for k, ((least, most), (low, high)) in enumerate(LABELLERS.values()):
        x = measured[:, k]
        out[(x >= low) & (x <= high), k] = HIGH
        out[(x < least) | (x > most), k] = LOW
    out[n == 0] = ABSTAIN
    return out


@dataclass
class VoteModel:
    """Share of high texts, and each labeller's vote probabilities in either class."""

    prior: float
    tables: np.ndarray  # labeller, class, vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is high."""
        logs = np.log(self.tables)
        each = np.arange(patterns.shape[1])
        low = logs[each, LOW, patterns].sum(axis=1) + np.log(1 - self.prior)
        high = logs[each, HIGH, patterns].sum(axis=1) + np.log(self.prior)
        return 1 / (1 + np.exp(np.clip(low - high, -50, 50)))

    def accuracies(self) -> dict[str, float]:
        """How often a labeller is right when it votes."""
        weight = np.array([1 - self.prior, self.prior])
        right = (self.tables[:, [LOW, HIGH], [LOW, HIGH]] * weight).sum(axis=1)
        cast = (self.tables[:, :, :2].sum(axis=2) * weight).sum(axis=1)
        return dict(zip(LABELLERS, (right / cast).tolist()))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> VoteModel:
    """Expectation-maximisation from "one low vote is enough" until no probability moves by 1e-7.

    Labellers look for different faults, so a low text has few low votes. A prior as heavy
    as the data says that a labeller seldom votes low on a high text; without it the
    faults that only one labeller sees would count as that labeller's mistakes.
    """
    cast = np.stack([((patterns == v) * counts[:, None]).sum(axis=0) for v in (HIGH, ABSTAIN)], axis=1) + 1e-9
    trust = counts.sum() * np.hstack([np.full((len(cast), 1), 0.002), 0.998 * cast / cast.sum(axis=1, keepdims=True)])
    high = np.where((patterns == LOW).any(axis=1), 0.1, 0.95)
    model = VoteModel(0.5, np.full((patterns.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds):
        tables = np.empty_like(model.tables)
        for vote in (LOW, HIGH, ABSTAIN):
            cast = (patterns == vote) * counts[:, None]
            tables[:, HIGH, vote] = (cast * high[:, None]).sum(axis=0) + 0.1
            tables[:, LOW, vote] = (cast * (1 - high)[:, None]).sum(axis=0) + 0.1
        tables[:, HIGH] += trust
        tables /= tables.sum(axis=2, keepdims=True)
        prior = float(np.clip((high * counts).sum() / counts.sum(), 1e-3, 1 - 1e-3))
        moved = max(np.abs(tables - model.tables).max(), abs(prior - model.prior))
        model = VoteModel(prior, tables)
        high = model.posterior(patterns)
        if moved < 1e-7:
            break
    return model


@dataclass
class Scorer:
    words: np.ndarray
    shapes: np.ndarray
    offset: float

    def score(self, n: np.ndarray, hashed: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        mean = sums(self.words[hashed] + self.shapes[shapes], n) / np.sqrt(np.maximum(n, 1))
        return 1 / (1 + np.exp(-np.clip(mean + self.offset, -30, 30)))


def train_scorer(n: np.ndarray, hashed: np.ndarray, shapes: np.ndarray, target: np.ndarray, epochs: int = 60, rate: float = 0.1) -> Scorer:
    """Logistic scorer on soft labels, both classes of equal weight, by adaptive gradient steps."""
    scorer = Scorer(np.zeros(TABLE), np.zeros(SHAPES), 0.0)
    squares = [np.full(TABLE, 1e-6), np.full(SHAPES, 1e-6)]
    text_of = np.repeat(np.arange(len(n)), n)
    root = np.sqrt(np.maximum(n, 1))
    balance = target / max(target.sum(), 1e-9) + (1 - target) / max((1 - target).sum(), 1e-9)
    for _ in range(epochs):
        error = (scorer.score(n, hashed, shapes) - target) * balance
        spread = (error / root)[text_of]
        for table, rows, square in ((scorer.words, hashed, squares[0]), (scorer.shapes, shapes, squares[1])):
            gradient = np.bincount(rows, spread, len(table)) + 1e-6 * table
            square += gradient * gradient
            table -= rate * gradient / np.sqrt(square)
        scorer.offset -= rate * float(error.sum())
    return scorer


QUALITY = "doc_id long, votes string, posterior double, score double, predicted int"


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def fit_table(docs: DataFrame, sample: int = 4000, doc_id: str = "doc_id", text: str = "text") -> tuple[VoteModel, Scorer]:
    """Count the vote patterns of all documents, then train the scorer on about ``sample`` of them.

    The counts have at most ``3 ** len(LABELLERS)`` rows. The sample follows a hash of the text.
    """

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                measured, n, _, _ = measures(part["text"])
                cast = ["".join(map(str, row)) for row in votes(measured, n).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(cast, pa.string())], ["votes"])

    rows = _rows(docs, doc_id, text)
    counted = durable(rows.select("text").mapInArrow(patterns, "votes string").groupBy("votes").count()).collect()
    if not counted:
        return VoteModel(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)), Scorer(np.zeros(TABLE), np.zeros(SHAPES), 0.0)
    seen = np.array([list(map(int, r["votes"])) for r in counted], np.int8)
    counts = np.array([r["count"] for r in counted], float)
    model = estimate(seen, counts)
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = min(1.0, sample / counts.sum())
    texts = sorted(r["text"] or "" for r in rows.where(draw < share).limit(2 * sample).collect()) or [""]
    measured, n, hashed, shapes = measures(pa.array(texts, pa.string()))
    return model, train_scorer(n, hashed, shapes, model.posterior(votes(measured, n)))


def score_quality(docs: DataFrame, model: VoteModel, scorer: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Votes, posterior and score of every whole text; ``predicted`` is 1 from a score of 0.5 on.

    Null, empty and blank texts get no vote, the prior as posterior, score 0 and predicted 0.
    Repeated rows are scored each; only id and text are read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, scorer))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                measured, n, hashed, shapes = measures(part["text"])
                cast = votes(measured, n)
                score = np.where(n > 0, scorer.score(n, hashed, shapes), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array(["".join(map(str, row)) for row in cast.tolist()], pa.string()),
                        pa.array(model.posterior(cast)),
                        pa.array(score),
                        pa.array((score >= 0.5).astype(np.int32)),
                    ],
                    ["doc_id", "votes", "posterior", "score", "predicted"],
                )

    return _rows(docs, doc_id, text).mapInArrow(tasks, QUALITY)
