"""Languages of words and documents by a linear-chain conditional random field.

Words are the positions of a chain, sentences its length, languages the labels. A word's
emission adds learned weights of its character n-grams, of its prefixes and suffixes
(n-grams that touch a word's end) and of the learned lexicons that hold it; transitions
between languages are learned too. Forward-backward gives each word's distribution, so
code-switched text is labelled word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quartergrid.llm.tokens import release_words
from quartergrid.llm.words import SLICE_BYTES, factorize, gather, give_back, slices, sums

UNKNOWN = "und"
TABLE_BITS = 17
NGRAMS = (1, 2, 3, 4, 5)
OUTER = "[^\\p{L}]+"


@dataclass(frozen=True)
class Training:
    """``documents`` bounds the labelled rows of each language that the model is fitted on."""

    documents: int = 300
    epochs: int = 3
    batch_words: int = 40_000
    rate: float = 0.5
    lexicon_count: int = 5
    lexicon_share: float = 0.9
    seed: int = 7


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # n-gram, language
    lexicon_words: np.ndarray  # sorted hashes
    lexicon_of: np.ndarray  # language of each
    lexicon_weights: np.ndarray  # lexicon, language
    transitions: np.ndarray  # from, to

    def emissions(self, words: Words) -> np.ndarray:
        n = len(words.hashes)
        out = np.zeros((n, len(self.languages)))
        for owner, rows in words.ngrams():
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(owner, self.weights[rows, k], n)
        out *= words.scale()[:, None]
        found, of = self.lexicon(words)
        out[found] += self.lexicon_weights[of]
        return out

    def lexicon(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that a lexicon holds, and which lexicon that is."""
        if not len(self.lexicon_words):
            return np.zeros(0, int), np.zeros(0, int)
        at = np.minimum(np.searchsorted(self.lexicon_words, words.hashes), len(self.lexicon_words) - 1)
        found = np.flatnonzero(self.lexicon_words[at] == words.hashes)
        return found, self.lexicon_of[at[found]]


class Words:
    """Distinct lower-case words with their hashed n-grams."""

    def __init__(self, words: pa.Array) -> None:
        framed = pc.binary_join_element_wise("\x02", words, "\x03", "")
        lengths = pc.binary_length(framed).to_numpy(zero_copy_only=False).astype(np.int64)
        self.bytes = np.frombuffer("".join(framed.to_pylist()).encode(), "u1").astype(np.uint64)
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        self.ends = np.cumsum(lengths)
        self.lengths = lengths
        self.hashes = self._whole()

    def _whole(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            place = np.arange(len(self.bytes)) - (self.ends - self.lengths)[self.owner]
            each = _spread((self.bytes + np.uint64(1)) * _spread(place.astype(np.uint64) + np.uint64(1)))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
            return total[self.ends] - total[self.ends - self.lengths]

    def ngrams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length: the word and the table row of every n-gram."""
        rolled = np.zeros(len(self.bytes), np.uint64)
        left = self.ends[self.owner] - np.arange(len(self.bytes))
        with np.errstate(over="ignore"):
            for n in range(1, max(NGRAMS) + 1):
                rolled = rolled[: len(self.bytes) - n + 1] * np.uint64(0x100000001B3) + self.bytes[n - 1 :]
                inside = left[: len(rolled)] >= n
                rows = _spread(rolled[inside] + np.uint64(n << 56)) >> np.uint64(64 - TABLE_BITS)
                yield self.owner[: len(rolled)][inside], rows.astype(np.int64)
                if n == len(self.bytes):
                    return

    def scale(self) -> np.ndarray:
        """One over the root of the number of n-grams."""
        count = sum(np.maximum(self.lengths - n + 1, 0) for n in NGRAMS)
        return 1 / np.sqrt(np.maximum(count, 1))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Chains:
    """Words with letters of some texts: a code each, where chains begin, and words per text."""

    codes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    text_words: np.ndarray
    words: Words


def chains(texts: pa.Array) -> Chains:
    """Cut texts into words and sentences; a sentence ends behind a word that ends in ``.``, ``!`` or ``?``."""
    codes, counts, raw = factorize(texts)
    raw = raw.cast(pa.string())
    core = pc.replace_substring_regex(pc.utf8_lower(raw), f"^{OUTER}|{OUTER}$", "")
    coded = core.dictionary_encode()
    core_of = coded.indices.to_numpy(zero_copy_only=False)
    closes = pc.match_substring_regex(raw, "[.!?]$").to_numpy(zero_copy_only=False)
    lettered = pc.greater(pc.binary_length(core), 0).to_numpy(zero_copy_only=False)[codes]
    text_of = np.repeat(np.arange(len(counts)), counts)
    ends = np.concatenate([[0], np.cumsum(closes[codes])])[:-1]
    own, text, sentence = core_of[codes][lettered], text_of[lettered], ends[lettered]
    new = np.ones(len(own), bool)
    new[1:] = (text[1:] != text[:-1]) | (sentence[1:] != sentence[:-1])
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(own)))
    return Chains(own, starts, lengths, np.bincount(text, minlength=len(counts)), Words(coded.dictionary))


def forward_backward(
    emissions: np.ndarray, transitions: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Each position's label distribution, and with ``pairs`` the expected transition counts.

    All chains advance together, longest first, so a step touches only chains that reach it.
    """
    order = np.argsort(-lengths, kind="stable")
    first, length = starts[order], lengths[order]
    steps = int(length[0]) if len(length) else 0
    reach = np.searchsorted(-length, -np.arange(steps), side="left")
    psi = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    move = np.exp(transitions)
    ahead, behind = np.empty_like(psi), np.ones_like(psi)
    for t in range(steps):
        at = first[: reach[t]] + t
        a = psi[at] if t == 0 else (ahead[at - 1] @ move) * psi[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros_like(move)
    for t in range(steps - 1, 0, -1):
        at = first[: reach[t]] + t
        onward = psi[at] * behind[at]
        b = onward @ move.T
        behind[at - 1] = b / b.sum(axis=1, keepdims=True)
        if pairs:
            total = ((ahead[at - 1] @ move) * onward).sum(axis=1, keepdims=True)
            expected += move * (ahead[at - 1].T @ (onward / total))
    both = ahead * behind
    return both / both.sum(axis=1, keepdims=True), expected


def fit(texts: list[str], labels: list[str], training: Training = Training()) -> Model:
    """Fit by adaptive gradient steps on mixed chains of one to three sentences.

    Sentences of different texts are joined in a fixed random order, so languages switch
    inside chains and transitions are learned. After the first pass, sentences that the
    model gives to another language with nine parts in ten are taken for foreign
    passages of their document and left out.
    """
    languages = sorted(set(labels))
    data = chains(pa.array(texts, pa.string()))
    of = {x: k for k, x in enumerate(languages)}
    gold = np.repeat(np.array([of[x] for x in labels]), data.text_words)
    n, size = len(data.words.hashes), len(languages)
    counts = np.stack([np.bincount(data.codes[gold == k], minlength=n) for k in range(size)], axis=1)
    total = counts.sum(axis=1)
    held = (total >= training.lexicon_count) & (counts.max(axis=1) >= training.lexicon_share * total)
    order = np.argsort(data.words.hashes[held], kind="stable")
    model = Model(
        languages,
        np.zeros((1 << TABLE_BITS, size)),
        data.words.hashes[held][order],
        counts[held].argmax(axis=1)[order],
        np.zeros((size, size)),
        np.zeros((size, size)),
    )
    # Table rows of all n-grams by length, and where each word's begin.
    grams = [
        (rows.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]))
        for owner, rows in data.words.ngrams()
    ]
    scale = data.words.scale()
    steps = [np.full(p.shape, 1e-3) for p in (model.weights, model.lexicon_weights, model.transitions)]
    random = np.random.default_rng(training.seed)
    usable = np.ones(len(data.starts), bool)
    for epoch in range(training.epochs):
        emissions = model.emissions(data.words)
        if epoch:
            sure, _ = forward_backward(
                emissions.astype(np.float32)[data.codes], model.transitions.astype(np.float32), data.starts, data.lengths
            )
            right = sums(sure[np.arange(len(gold)), gold], data.lengths) / data.lengths
            usable = right >= 0.1
        mixed = random.permutation(np.flatnonzero(usable))
        ends = np.cumsum(data.lengths[mixed])
        bounds = np.searchsorted(ends, np.arange(training.batch_words, ends[-1] + training.batch_words, training.batch_words)) if len(mixed) else []
        last = 0
        for bound in bounds:
            chosen = mixed[last : int(bound) + 1]
            last = int(bound) + 1
            if not len(chosen):
                continue
            lengths = data.lengths[chosen]
            at = np.repeat(data.starts[chosen] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            group = np.cumsum(random.integers(1, 4, len(chosen)))
            group = np.searchsorted(group, np.arange(len(chosen)), side="right")
            joined = np.bincount(group, lengths).astype(int)
            joined = joined[joined > 0]
            starts = np.cumsum(joined) - joined
            used, code = np.unique(data.codes[at], return_inverse=True)
            spans = [ends[used + 1] - ends[used] for _, ends in grams]
            part_rows = np.concatenate([gather(g, ends[used], k) for (g, ends), k in zip(grams, spans)])
            part_owner = np.concatenate([np.repeat(np.arange(len(used)), k) for k in spans])
            e = np.stack([np.bincount(part_owner, model.weights[part_rows, k], len(used)) for k in range(size)], axis=1)
            e *= scale[used][:, None]
            where = np.minimum(np.searchsorted(model.lexicon_words, data.words.hashes[used]), max(len(model.lexicon_words) - 1, 0))
            known = np.flatnonzero(model.lexicon_words[where] == data.words.hashes[used]) if len(model.lexicon_words) else np.zeros(0, int)
            lexicon = model.lexicon_of[where[known]] if len(known) else np.zeros(0, int)
            e[known] += model.lexicon_weights[lexicon]
            sure, expected = forward_backward(e[code], model.transitions, starts, joined, pairs=True)
            labels_here = gold[at]
            sure[np.arange(len(at)), labels_here] -= 1
            by_word = np.stack([np.bincount(code, sure[:, k], len(used)) for k in range(size)], axis=1) / len(at)
            inside = np.ones(len(at), bool)
            inside[starts] = False
            seen = np.bincount(
                labels_here[:-1][inside[1:]] * size + labels_here[1:][inside[1:]], minlength=size * size
            ).reshape(size, size)
            scaled = by_word * scale[used][:, None]
            gradient = np.stack(
                [np.bincount(part_rows, scaled[part_owner, k], 1 << TABLE_BITS) for k in range(size)], axis=1
            )
            lexical = np.zeros((size, size))
            np.add.at(lexical, lexicon, by_word[known])
            changes = (gradient, lexical, (expected - seen) / len(at))
            for parameter, change, seen_squares in zip(
                (model.weights, model.lexicon_weights, model.transitions), changes, steps
            ):
                change = change + 1e-7 * parameter
                seen_squares += change * change
                parameter -= training.rate * change / np.sqrt(seen_squares)
    return model


def fit_table(docs: DataFrame, training: Training = Training(), text: str = "text", lang: str = "lang") -> Model:
    """Fit on at most ``training.documents`` different texts of each language, the first by a hash of the text.

    Without labelled rows the model has no languages, and every text is ``und``.
    """
    usable = docs.select(docs[text].alias("text"), docs[lang].alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        none = np.zeros((0, 0))
        return Model([], np.zeros((1 << TABLE_BITS, 0)), np.zeros(0, np.uint64), np.zeros(0, int), none, none)
    # The group limit keeps a bounded number per language in every task before anything is shuffled.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    drawn = usable.withColumn("draw", F.xxhash64("text")).distinct()
    rows = drawn.withColumn("place", place).where(F.col("place") <= training.documents).collect()
    rows = sorted((r["lang"], r["text"]) for r in rows)
    model = fit([t for _, t in rows], [k for k, _ in rows], training)
    give_back()
    return model


PREDICTED = "doc_id long, lang_pred string, score double, words long, switches long, shares map<string,double>"


def label_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Language of every document, from the distributions of all its words.

    ``lang_pred`` has the largest mean share of the words and ``score`` is that share;
    ``shares`` gives all of them and ``switches`` counts changes of the likeliest language
    between neighbouring words. Null texts and texts without a letter are ``und`` with
    score 0; of equal shares the first language by name is taken; repeated rows are
    labelled each; only id and text are read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_words()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 2):
                yield _labelled(part, shared.value)
        give_back()

    return rows.mapInArrow(tasks, PREDICTED)


def distributions(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each word's distribution over the languages, and words per text."""
    found = chains(texts)
    sure, _ = forward_backward(
        model.emissions(found.words)[found.codes].astype(np.float32), model.transitions.astype(np.float32), found.starts, found.lengths
    )
    return sure, found.text_words


def share_of(sure: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Each text's mean distribution; zeros for a text without words."""
    share = np.stack([sums(sure[:, k].astype(float), words) for k in range(sure.shape[1])], axis=1)
    return share / np.maximum(words, 1)[:, None]


def _labelled(part: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    if not model.languages:
        return _unlabelled(part)
    sure, words = distributions(part["text"], model)
    share = share_of(sure, words)
    best = share.argmax(axis=1)
    likely = sure.argmax(axis=1)
    text_of = np.repeat(np.arange(len(words)), words)
    changed = (likely[1:] != likely[:-1]) & (text_of[1:] == text_of[:-1])
    switches = np.bincount(text_of[1:][changed], minlength=len(words))
    names = np.array([*model.languages, UNKNOWN], object)
    none = words == 0
    size = len(model.languages)
    shares = pa.MapArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(np.where(none, 0, size))]).astype(np.int32)),
        pa.array(np.tile(names[:-1], int((~none).sum())), pa.string()),
        pa.array(share[~none].reshape(-1)),
    )
    return pa.RecordBatch.from_arrays(
        [
            part["doc_id"],
            pa.array(names[np.where(none, size, best)], pa.string()),
            pa.array(np.clip(np.where(none, 0.0, share.max(axis=1)), 0, 1)),
            pa.array(words.astype(np.int64)),
            pa.array(switches.astype(np.int64)),
            shares,
        ],
        ["doc_id", "lang_pred", "score", "words", "switches", "shares"],
    )


def _unlabelled(part: pa.RecordBatch) -> pa.RecordBatch:
    n = part.num_rows
    words = chains(part["text"]).text_words
    shares = pa.MapArray.from_arrays(pa.array([0] * (n + 1), pa.int32()), pa.array([], pa.string()), pa.array([], pa.float64()))
    return pa.RecordBatch.from_arrays(
        [
            part["doc_id"], pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)),
            pa.array(words.astype(np.int64)), pa.array(np.zeros(n, np.int64)), shares,
        ],
        ["doc_id", "lang_pred", "score", "words", "switches", "shares"],
    )


def keep_identified(
    docs: DataFrame, model: Model, least: float = 0.0, text: str = "text", into: str | None = None
) -> DataFrame:
    """Rows of ``docs`` that are not ``und``, with all columns; code-switched text stays.

    ``least`` is the mean share that the first language must hold besides. ``into`` names a
    last column for the language, which must be a new one. A model without languages
    rejects only texts without a letter; the language of the others is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema if into is None else StructType([*docs.schema.fields, StructField(into, StringType())])

    def kept(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        if not shared.value.languages:
            return chains(part[text]).text_words > 0, np.zeros(part.num_rows, int)
        sure, words = distributions(part[text], shared.value)
        share = share_of(sure, words)
        return (words > 0) & (share.max(axis=1, initial=0.0) >= least), share.argmax(axis=1)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_words()
        names = np.array(shared.value.languages or [UNKNOWN], object)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES // 2):
                stays, best = kept(part)
                columns = part.columns if into is None else [*part.columns, pa.array(names[best], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(stays))
        give_back()

    return docs.mapInArrow(tasks, schema)
