"""Toxic text by a support vector machine on a gap-weighted subsequence kernel.

The kernel of two strings sums over their common subsequences of ``order`` characters and
weighs each by ``decay`` to the power of the stretch it covers, so ``i-d-i-o-t`` stays near
``idiot``. A few landmark strings stand for the kernel (Nyström): a unit's features are its
kernels with the landmarks. Units are words, windows of very long words, and runs of single
characters read as one word. Labels belong to whole texts, so the machine picks the units
that make a labelled text toxic itself, in turns with its own training.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartergrid.llm.words import factorize, slices, sums

MARKS = r"[^\p{L}\p{N}]+"
WINDOW, STRIDE = 24, 12
SPELLED = 3
CHUNK = 2048
CACHED_UNITS = 500_000


@dataclass(frozen=True)
class Training:
    """``toxic`` and ``clean`` bound the labelled texts, ``units`` the distinct units, of a fit."""

    toxic: int = 2000
    clean: int = 3000
    units: int = 24_000
    landmarks: int = 64
    order: int = 3
    decay: float = 0.7
    power: int = 3
    rounds: int = 3
    witnesses: int = 3
    penalty: float = 3e-4


def subsequence_kernel(left: np.ndarray, right: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Kernels of strings of one length with strings padded by -1.

    ``left`` is (n, length) and ``right`` (1 or n, m, length); the result is (n, m).
    """
    n, m, width = len(left), right.shape[1], right.shape[2]
    squared = np.float32(decay * decay)
    prefix = [np.zeros((width + 1, n, m), np.float32) for _ in range(order)]
    prefix[0] += 1
    total = np.zeros((n, m), np.float32)
    columns = np.ascontiguousarray(np.moveaxis(right, 2, 0))
    for at in range(left.shape[1]):
        equal = (left[None, :, at, None] == columns) * squared
        for j in range(width):
            total += equal[j] * prefix[order - 1][j]
        for i in range(order - 1, 0, -1):
            run = np.zeros((n, m), np.float32)
            for j in range(width):
                run *= np.float32(decay)
                run += equal[j] * prefix[i - 1][j]
                prefix[i][j + 1] *= np.float32(decay)
                prefix[i][j + 1] += run
    return total


def _codes(strings: list[str], width: int) -> np.ndarray:
    out = np.full((len(strings), width), -1, np.int32)
    for k, s in enumerate(strings):
        out[k, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<i4")
    return out


@dataclass
class Landmarks:
    strings: list[str]
    order: int
    decay: float
    power: int
    codes: np.ndarray = field(init=False)
    lengths: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.codes = _codes(self.strings, max(map(len, self.strings), default=1))[None]
        self.lengths = np.array([self.norm([s])[0] for s in self.strings])

    def norm(self, strings: list[str]) -> np.ndarray:
        """Roots of the kernels of equally long strings with themselves."""
        own = _codes(strings, len(strings[0]))
        return np.sqrt(subsequence_kernel(own, own[:, None, :], self.order, self.decay)[:, 0])

    def kernels(self, strings: list[str]) -> np.ndarray:
        """Powers of normalised kernels with every landmark; 0 for strings below ``order`` characters.

        A power of a kernel is a kernel; it tells a shared stem from a few shared letters.
        """
        out = np.zeros((len(strings), len(self.strings)), np.float32)
        sizes = np.array([len(s) for s in strings])
        for size in np.unique(sizes[sizes >= self.order]):
            rows = np.flatnonzero(sizes == size)
            for first in range(0, len(rows), CHUNK):
                part = rows[first : first + CHUNK]
                own = [strings[k] for k in part]
                raw = subsequence_kernel(_codes(own, int(size)), self.codes, self.order, self.decay)
                out[part] = (raw / np.maximum(self.norm(own)[:, None] * self.lengths[None, :], 1e-12)) ** self.power
        return out


@dataclass
class Model:
    landmarks: Landmarks
    weights: np.ndarray
    offset: float
    document: np.ndarray
    name: str

    def margins(self, units: list[str]) -> np.ndarray:
        return self.landmarks.kernels(units) @ self.weights + self.offset


@dataclass
class Units:
    """Distinct units of some texts, a code for each occurrence, and occurrences per text."""

    strings: list[str]
    codes: np.ndarray
    counts: np.ndarray


def units(texts: pa.Array) -> Units:
    """Cut whole texts into units: lower-case words without marks; see the module's text."""
    codes, counts, raw = factorize(texts)
    core = pc.replace_substring_regex(pc.utf8_lower(raw.cast(pa.string())), MARKS, "").dictionary_encode()
    strings = core.dictionary.to_pylist()
    own = core.indices.to_numpy(zero_copy_only=False)[codes]
    sizes = np.array([len(s) for s in strings], np.int64)
    text_of = np.repeat(np.arange(len(counts)), counts)
    worded = sizes[own] > 0
    own, text_of = own[worded], text_of[worded]
    extra_text, extra = [], []
    for code in np.flatnonzero(sizes > WINDOW):
        s = strings[code]
        parts = [s[a : a + WINDOW] for a in range(0, len(s) - WINDOW + STRIDE, STRIDE)]
        for text in text_of[own == code].tolist():
            extra_text += [text] * len(parts)
            extra += parts
    single = np.flatnonzero(sizes[own] == 1)
    if len(single) >= SPELLED:
        breaks = np.flatnonzero((np.diff(single) != 1) | (np.diff(text_of[single]) != 0)) + 1
        for run in np.split(single, breaks):
            if len(run) >= SPELLED:
                word = "".join(strings[k] for k in own[run])
                parts = [word[a : a + WINDOW] for a in range(0, max(len(word) - WINDOW + STRIDE, 1), STRIDE)]
                extra_text += [int(text_of[run[0]])] * len(parts)
                extra += parts
    if extra:
        known = {s: k for k, s in enumerate(strings)}
        added = np.array([known.setdefault(s, len(known)) for s in extra])
        strings = list(known)
        own, text_of = np.concatenate([own, added]), np.concatenate([text_of, extra_text])
        order = np.argsort(text_of, kind="stable")
        own, text_of = own[order], text_of[order]
    return Units(strings, own, np.bincount(text_of, minlength=len(counts)))


def document_features(margins: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: the two largest margins of distinct units, the sums of margins from 0.25 and from 0 on, and the number of units."""
    text_of = np.repeat(np.arange(len(counts)), counts)
    top = margins[codes] if len(codes) else np.zeros(0)
    first = np.full(len(counts), -1.0)
    np.maximum.at(first, text_of, top)
    leading = np.full(len(counts), -1)
    leading[text_of[top == first[text_of]]] = codes[top == first[text_of]]
    second = np.full(len(counts), -1.0)
    other = codes != leading[text_of]
    np.maximum.at(second, text_of[other], top[other])
    above = np.bincount(text_of, np.clip(top, 0, 1), len(counts))
    strong = np.bincount(text_of, np.clip(2 * top - 0.5, 0, 1), len(counts))
    columns = [np.clip(first, -1, 1) + np.clip(second, -1, 1), np.log1p(strong), np.log1p(above), np.log1p(counts), np.ones(len(counts))]
    return np.stack(columns, axis=1)


def fit(texts: list[str], toxic: list[int], training: Training = Training()) -> Model:
    """Choose landmarks, train the machine with its own choice of toxic units, then fit the texts' score."""
    order = sorted(range(len(texts)), key=lambda k: (texts[k] or "", toxic[k]))
    texts, label = [texts[k] for k in order], np.array([toxic[k] for k in order], bool)
    data = units(pa.array(texts, pa.string()))
    n = len(data.strings)
    text_of = np.repeat(np.arange(len(texts)), data.counts)
    seen = np.unique(text_of * np.int64(max(n, 1)) + data.codes)
    seen_text, seen_unit = seen // max(n, 1), seen % max(n, 1)
    in_toxic = np.bincount(seen_unit[label[seen_text]], minlength=n)
    in_clean = np.bincount(seen_unit[~label[seen_text]], minlength=n)
    weight = in_toxic * np.log(((in_toxic + 0.5) / (label.sum() + 1)) / ((in_clean + 0.5) / ((~label).sum() + 1)))
    usable = np.array([training.order <= len(s) <= WINDOW for s in data.strings], bool)
    weight = np.where(in_toxic >= min(2, in_toxic.max(initial=0)), weight, np.minimum(weight, 0.0))
    landmarks = _landmarks(data.strings, np.where(usable, weight, -np.inf), in_clean, training)
    often = in_toxic >= min(2, in_toxic.max(initial=0))
    telling = usable & often & (in_toxic / max(label.sum(), 1) > 10 * in_clean / max((~label).sum(), 1))
    ranked = np.argsort(-np.where(telling, weight, -np.inf), kind="stable")[: min(int(telling.sum()), training.units // 2)]
    ordinary = usable & ~telling & (in_clean > 0)
    clean = np.argsort(-np.where(ordinary, in_clean, -1), kind="stable")[: int(ordinary.sum())]
    common, rare = np.split(clean, [min(len(clean), training.units // 4)])
    clean = np.concatenate([common, rare[:: max(1, len(rare) // max(training.units // 4, 1))]])
    chosen = np.concatenate([ranked, clean]).astype(int)
    names = [data.strings[k] for k in chosen]
    against = np.where(np.arange(len(chosen)) >= len(ranked), np.sqrt(in_clean[chosen]), 0.0)
    positive = np.zeros(len(chosen), bool)
    positive[: len(ranked)] = (weight[ranked] > 5) & (in_toxic[ranked] > 2)
    root, features = _features(landmarks, landmarks.kernels(names))
    machine, offset = _machine(features, positive, against, training)
    near = np.argsort(-np.where(against > 0, (features @ machine + offset), -np.inf), kind="stable")
    near = [k for k in near[: training.landmarks // 4] if against[k] > 0]
    hard = [names[k] for k in near]
    against[near] *= 10
    landmarks = Landmarks(list(dict.fromkeys([*landmarks.strings, *hard])), training.order, training.decay, training.power)
    root, features = _features(landmarks, landmarks.kernels(names))
    machine, offset = _machine(features, positive, against, training)
    place = np.full(n, -1)
    place[chosen] = np.arange(len(chosen))
    here = place[seen_unit]
    candidates = (here >= 0) & (here < len(ranked)) & label[seen_text]
    for _ in range(training.rounds):
        margin = features @ machine + offset
        rows, bags = here[candidates], seen_text[candidates]
        by_bag = np.lexsort((-margin[rows], bags))
        rows, bags = rows[by_bag], bags[by_bag]
        starts = np.flatnonzero(np.append(True, bags[1:] != bags[:-1])) if len(bags) else np.zeros(0, int)
        rank = np.arange(len(bags)) - np.repeat(starts, np.diff(np.append(starts, len(bags))))
        witness = np.zeros(len(chosen), bool)
        witness[rows[(rank < training.witnesses) & (margin[rows] > 0)]] = True
        machine, offset = _machine(features, witness | positive, against, training)
    weights = (root @ machine).astype(np.float32)
    model = Model(landmarks, weights, float(offset), np.zeros(5), uuid.uuid4().hex)
    found = document_features(model.margins(data.strings), data.codes, data.counts)
    model.document = _logistic(found, label)
    return model


def _features(landmarks: Landmarks, kernels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nyström features of kernels with the landmarks, and the matrix that makes them."""
    gram = landmarks.kernels(landmarks.strings).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 1e-2 * np.eye(len(gram)))
    root = vectors @ np.diag(1 / np.sqrt(values)) @ vectors.T
    return root, kernels @ root


def _landmarks(strings: list[str], weight: np.ndarray, in_clean: np.ndarray, training: Training) -> Landmarks:
    """The most telling units that differ from one another, and a few of the commonest clean ones.

    A quarter of the landmarks is left for clean units that the first machine takes for toxic.
    """
    order = np.argsort(-weight, kind="stable")[: 12 * training.landmarks]
    pool = [strings[k] for k in order if np.isfinite(weight[k]) and weight[k] > 0]
    common = [strings[k] for k in np.argsort(-np.where(np.isfinite(weight), in_clean, -1), kind="stable")[: training.landmarks // 8]]
    common = [s for s in common if training.order <= len(s) <= WINDOW]
    chosen: list[str] = []
    if pool:
        near = Landmarks(pool, training.order, training.decay, training.power).kernels(pool)
        covered = np.zeros(len(pool))
        for k in range(len(pool)):
            if covered[k] < 0.6 and len(chosen) < training.landmarks * 3 // 4 - len(common):
                chosen.append(pool[k])
                covered = np.maximum(covered, near[:, k])
    return Landmarks(list(dict.fromkeys([*chosen, *common])) or ["und"], training.order, training.decay, training.power)


def _machine(features: np.ndarray, positive: np.ndarray, against: np.ndarray, training: Training) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes of equal weight, by Newton steps.

    ``against`` weighs the negative examples; common clean units weigh more.
    """
    x = np.hstack([features, np.ones((len(features), 1))]).astype(float)
    y = np.where(positive, 1.0, -1.0)
    part = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 * against / max(against.sum(), 1))
    ridge = np.full(x.shape[1], training.penalty)

    def loss(w: np.ndarray) -> float:
        short = np.maximum(1 - y * (x @ w), 0)
        return float((part * short * short).sum() + (ridge * w * w).sum())

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(60):
        active = (y * (x @ w) < 1) & (part > 0)
        xa = x[active] * part[active, None]
        step = np.linalg.solve(xa.T @ x[active] + np.diag(ridge), xa.T @ y[active]) - w
        size = 1.0
        while size > 1e-4 and loss(w + size * step) >= now:
            size /= 2
        after = loss(w + size * step)
        if after >= now - 1e-9:
            break
        w, now = w + size * step, after
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w = w - np.linalg.solve(hessian, x.T @ (p - label) + 0.1 * w)
    return w


def fit_table(docs: DataFrame, labels: DataFrame, training: Training = Training(), doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Fit on at most ``training.toxic`` and ``training.clean`` labelled rows, taken in the order of a hash."""
    rows = labels.select(labels[doc_id].alias("_id"), labels[toxic].cast("int").alias("_toxic")).where("_id IS NOT NULL AND _toxic IN (0, 1)")
    once = rows.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    order = F.xxhash64("_id")
    some = once.where("_toxic = 1").orderBy(order, "_id").limit(training.toxic).unionByName(
        once.where("_toxic = 0").orderBy(order, "_id").limit(training.clean)
    )
    found = docs.join(F.broadcast(some), docs[doc_id] == some["_id"]).select(docs[text].alias("_text"), "_toxic").collect()
    return fit([r["_text"] for r in found], [r["_toxic"] for r in found], training)


_known: dict[str, dict[str, float]] = {}


def _margins(model: Model, strings: list[str]) -> np.ndarray:
    """Margins of units; a worker remembers those of its latest model."""
    if model.name not in _known:
        _known.clear()
        _known[model.name] = {}
    known = _known[model.name]
    late = [s for s in strings if s not in known]
    fresh = dict(zip(late, model.margins(late).tolist())) if late else {}
    out = np.array([known[s] if s in known else fresh[s] for s in strings])
    if len(known) + len(fresh) <= CACHED_UNITS:
        known.update(fresh)
    return out


SCORED = "doc_id long, score double, predicted int, hits array<struct<unit:string,margin:double>>"


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Toxicity of every whole text.

    ``score`` is the probability of label 1, ``predicted`` is 1 from 0.5 on, and ``hits``
    lists the distinct units with positive margin. Null, empty and blank texts are scored
    as texts without units; repeated rows are scored each; only id and text are read; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _scored(part, shared.value)

    return rows.mapInArrow(tasks, SCORED)


def _scored(part: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    found = units(part["text"])
    margin = _margins(model, found.strings)
    each = margin[found.codes] if len(found.codes) else np.zeros(0)
    z = document_features(margin, found.codes, found.counts) @ model.document
    score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    text_of = np.repeat(np.arange(len(found.counts)), found.counts)
    passed = each > 0
    pairs = np.unique(np.stack([text_of[passed], found.codes[passed]], axis=1), axis=0)
    ends = np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0], minlength=len(score)))]).astype(np.int32)
    hits = pa.StructArray.from_arrays(
        [pa.array([found.strings[k] for k in pairs[:, 1]], pa.string()), pa.array(margin[pairs[:, 1]].astype(float))], ["unit", "margin"]
    )
    return pa.RecordBatch.from_arrays(
        [
            part["doc_id"],
            pa.array(score),
            pa.array((score >= 0.5).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(ends), hits),
        ],
        ["doc_id", "score", "predicted", "hits"],
    )
