"""Score texts with a class-based bigram model whose word classes come from exchange clustering.

A word's probability is that of its class after the class before it, times that of the word
in its class. Frequent words are exchanged between classes, a part of them at a time, each
to the class that raises the likelihood of all class bigrams most; every other word then
joins the class that explains its neighbours best. Counts are those of all training texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartergrid.llm.tally import Tally, as_batch
from quartergrid.llm.token_files import stored
from quartergrid.llm.words import factorize, run_places, slices, sums, whole_runs

LONG_WORD = 24


@dataclass(frozen=True)
class Clustering:
    """``classes`` of words; ``core_share`` of all tokens makes a word frequent, so at most its inverse are.

    Every frequent word is looked at once in each of ``sweeps``, in ``parts`` that move together.
    """

    classes: int = 40
    core_share: float = 1e-6
    sweeps: int = 2
    parts: int = 3
    discount: float = 0.5
    prior: float = 20.0


# Behind the word classes: the end of a text, then words of unknown class.
def end_class(plan: Clustering) -> int:
    return plan.classes


def open_class(plan: Clustering) -> int:
    return plan.classes + 1


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A code per word, words per text, and the distinct lower-cased words as bytes.

    A word beyond ``LONG_WORD`` bytes goes by a digest behind a byte that no text holds.
    """
    codes, counts, cased = factorize(texts)
    # Lower-cased by distinct word: they lie in a buffer of their own.
    lowered = pc.ascii_lower(cased).dictionary_encode()
    codes = lowered.indices.to_numpy(zero_copy_only=False)[codes].astype(np.int64)
    counts, words = counts.astype(np.int64), lowered.dictionary
    blank = pc.index(words, "").as_py()
    if blank >= 0:
        real = codes != blank
        counts = sums(real.astype(np.int64), counts)
        codes = codes[real]
    named = words.cast(pa.large_binary())
    lengths = pc.binary_length(named).to_numpy(zero_copy_only=False)
    if (lengths > LONG_WORD).any():
        named = pa.array(
            [w if len(w) <= LONG_WORD else b"\xff" + hashlib.blake2b(w, digest_size=16).digest() for w in named.to_pylist()],
            pa.large_binary(),
        )
    return codes, counts, named.cast(pa.binary())


def _merged(tables: list[pa.Table]) -> pa.Table:
    added = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum"), ("train", "sum")])
    return added.rename_columns(["word", "n", "train"])


def word_counts(texts: DataFrame, most: int = 400_000) -> DataFrame:
    """``word, n, train``: occurrences in all texts and in those marked ``train``."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part in slices(batch, "text"):
                codes, counts, words = words_of(part["text"])
                train = np.repeat(part["train"].to_numpy(zero_copy_only=False), counts)
                each = [np.bincount(c, minlength=len(words)) for c in (codes, codes[train])]
                columns = {"word": words, "n": pa.array(each[0]), "train": pa.array(each[1])}
                held.append(pa.table(columns).filter(pc.field("n") > 0))
                if sum(t.num_rows for t in held) > 2 * most:
                    held = [_merged(held)]
                    if held[0].num_rows > most:
                        yield from held.pop().to_batches()
        if held:
            yield from _merged(held).to_batches()

    partial = texts.select("text", "train").mapInArrow(tasks, "word binary, n long, train long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"), F.sum("train").alias("train"))


@dataclass
class Core:
    """Frequent words by id; ``counts`` are training counts, 0 for those that training lacks.

    Ids behind the words: ``end`` of a text, and ``rare`` for any other word.
    """

    words: pa.Array
    counts: np.ndarray
    classes: np.ndarray  # of every id; the open class for words that training lacks
    texts: int  # of the training part, each with one end

    @property
    def end(self) -> int:
        return len(self.words)

    @property
    def rare(self) -> int:
        return len(self.words) + 1


# The ids of a text are one value, four bytes each: the clustering reads them again and again, and an
# array would be copied number by number each time.
SEQUENCES = "row long, doc_id long, train boolean, ids binary, rare array<binary>"


def sequences(texts: DataFrame, core) -> DataFrame:
    """Word ids of every text with its end, and its other words in order.

    A text's ``row`` is the number of its task and of the task's ids before it, so ``row`` and a
    place in the text add up to a number of their own for every id.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = core.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                codes, counts, words = words_of(part["text"])
                ids = pc.fill_null(pc.index_in(words, known.words), known.rare).to_numpy(zero_copy_only=False)[codes]
                is_rare = ids == known.rare
                ends = np.cumsum(counts)
                offsets = 4 * np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32)
                rare_ends = np.concatenate([[0], np.cumsum(sums(is_rare.astype(np.int64), counts))]).astype(np.int32)
                with_ends = np.insert(ids, ends, known.end).astype("<i4")
                columns = {
                    "row": pa.array(row + offsets[:-1].astype(np.int64) // 4),
                    "doc_id": part["doc_id"],
                    "train": part["train"],
                    "ids": pa.Array.from_buffers(
                        pa.binary(), part.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(with_ends)]
                    ),
                    "rare": pa.ListArray.from_arrays(pa.array(rare_ends), words.take(pa.array(codes[is_rare]))),
                }
                row += len(with_ends)
                yield pa.RecordBatch.from_pydict(columns)

    return texts.mapInArrow(tasks, SEQUENCES)


def _flat(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, the id before each (the end before a text's first), and ids per text."""
    packed = batch["ids"].cast(pa.binary())
    _, offsets, values = packed.buffers()
    places = np.frombuffer(offsets, np.int32)[packed.offset : packed.offset + len(packed) + 1] // 4
    counts = np.diff(places).astype(np.int64)
    ids = np.frombuffer(values, "<i4")[places[0] : places[-1]]
    before = np.concatenate([[end], ids[:-1]])
    before[np.cumsum(counts) - counts] = end
    return ids, before, counts


def class_bigrams(training: DataFrame, core, plan: Clustering) -> np.ndarray:
    """How often each class follows each other one: ``[before, after]``."""
    size = plan.classes + 2

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = core.value, np.zeros(size * size, np.int64)
        for batch in batches:
            if batch.num_rows:
                ids, before, _ = _flat(batch, known.end)
                cells = known.classes[before].astype(np.int64) * size + known.classes[ids]
                total += np.bincount(cells, minlength=size * size)
        cells = np.flatnonzero(total)
        yield as_batch({"cell": cells, "n": total[cells]})

    return _matrix(training.select("ids").mapInArrow(tasks, "cell long, n long"), size)


def _matrix(counted: DataFrame, size: int) -> np.ndarray:
    matrix = np.zeros(size * size, np.int64)
    # At most one row per pair of classes.
    for row in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        matrix[row["cell"]] = row["n"]
    return matrix.reshape(size, size)


def likelihood(bigrams: np.ndarray) -> float:
    """Log-likelihood of class bigrams but for the words' own counts, which no exchange changes."""
    m = bigrams.astype(float)
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=0)).sum() - _xlogx(m.sum(axis=1)).sum())


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange_gains(
    bigrams: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, twice: np.ndarray, classes: int
) -> np.ndarray:
    """``[word, class]``: likelihood with the word in that class, less that without the word.

    ``left`` and ``right`` count the classes next to each word, ``twice`` how often the word
    follows itself (counted in both), ``own`` is its class now.
    """
    rows = np.arange(len(own))
    left, right = left.astype(float), right.astype(float)
    left[rows, own] -= twice
    right[rows, own] -= twice
    without = np.repeat(bigrams[None].astype(float), len(own), axis=0)
    without[rows, :, own] -= left
    without[rows, own, :] -= right
    without[rows, own, own] -= twice
    before, after = without[:, :, :classes], without[:, :classes, :]
    columns = _xlogx(before + left[:, :, None]) - _xlogx(before)
    lines = _xlogx(after + right[:, None, :]) - _xlogx(after)
    each = np.arange(classes)
    corner = without[:, each, each]
    both = _xlogx(corner + left[:, :classes] + right[:, :classes] + twice[:, None]) - _xlogx(corner)
    n = left.sum(axis=1) + twice
    # Neighbours keep their own number of bigrams wherever the word goes.
    sizes = [(without.sum(axis=axis) + beside)[:, :classes] for axis, beside in ((1, right), (2, left))]
    sized = sum(_xlogx(s + n[:, None]) - _xlogx(s) for s in sizes)
    return columns.sum(axis=1) - columns[:, each, each] + lines.sum(axis=2) - lines[:, each, each] + both - sized


# Stands for a word where a row counts class bigrams.
ALL = -1


def _contexts(training: DataFrame, core, plan: Clustering, part: int) -> DataFrame:
    """``word, cell, n``: classes left and right of the words of one part, and words that follow themselves.

    Rows of the word ``ALL`` count class bigrams by cell, as in :func:`class_bigrams`, so the
    texts are read once for both.
    """
    size = plan.classes + 2
    width = 2 * size + 1

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tally, total = core.value, Tally(most=1_000_000), np.zeros(size * size, np.int64)
        mine = np.append((np.arange(len(known.words)) % plan.parts == part) & (known.counts > 0), [False, False])
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, before, _ = _flat(batch, known.end)
            left, right = known.classes[before], known.classes[ids]
            total += np.bincount(left * size + right, minlength=size * size)
            here, onward, again = mine[ids], mine[before], ids == before
            again &= here
            keys = np.concatenate([
                ids[here].astype(np.int64) * width + left[here],
                before[onward].astype(np.int64) * width + size + right[onward],
                ids[again].astype(np.int64) * width + 2 * size,
            ])
            keys, n = np.unique(keys, return_counts=True)
            for found, summed in tally.add(keys, n):
                yield as_batch({"word": found // width, "cell": found % width, "n": summed[:, 0]})
        for found, summed in tally.finish():
            yield as_batch({"word": found // width, "cell": found % width, "n": summed[:, 0]})
        cells = np.flatnonzero(total)
        yield as_batch({"word": np.full(len(cells), ALL), "cell": cells, "n": total[cells]})

    return training.select("ids").mapInArrow(tasks, "word long, cell long, n long")


def _moves(contexts: DataFrame, core, bigrams: np.ndarray, plan: Clustering, tasks_wanted: int) -> pa.Table:
    """The class that suits each word of a part best; at most one row per frequent word."""
    size = plan.classes + 2

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = core.value
        for rows in whole_runs(batches, "word"):
            starts, at = run_places(rows["word"])
            cells = np.zeros((len(starts), 2 * size + 1), np.int64)
            np.add.at(cells, (at, rows["cell"].to_numpy()), rows["n"].to_numpy())
            ids = rows["word"].to_numpy()[starts]
            for first in range(0, len(ids), 256):
                here = slice(first, first + 256)
                own, counted = known.classes[ids[here]], cells[here]
                gains = exchange_gains(
                    bigrams, own, counted[:, :size], counted[:, size : 2 * size], counted[:, -1], plan.classes
                )
                wanted, each = gains.argmax(axis=1), np.arange(len(own))
                stay = gains[each, wanted] - gains[each, own] <= 1e-6
                yield as_batch({"word": ids[here].astype(np.int32), "class": np.where(stay, own, wanted).astype(np.int32)})

    dealt = contexts.repartition(tasks_wanted, "word").sortWithinPartitions("word")
    return dealt.mapInArrow(tasks, "word int, class int").toArrow()


def cluster(spark: SparkSession, training: DataFrame, core: Core, plan: Clustering) -> np.ndarray:
    """Classes of all ids after the sweeps; the likeliest that was met."""
    tasks_wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    classes, best, best_classes = core.classes, -np.inf, core.classes
    for step in range(plan.sweeps * plan.parts + 1):
        shared = spark.sparkContext.broadcast(Core(core.words, core.counts, classes, core.texts))
        last = step == plan.sweeps * plan.parts or not len(core.words)
        if last:
            bigrams = class_bigrams(training, shared, plan)
        else:
            contexts = stored(_contexts(training, shared, plan, step % plan.parts), "contexts")
            bigrams = _matrix(contexts.where(F.col("word") == ALL), plan.classes + 2)
        reached = likelihood(bigrams)
        if reached > best:
            best, best_classes = reached, classes
        if last:
            shared.unpersist()
            break
        found = _moves(contexts.where(F.col("word") != ALL), shared, bigrams, plan, tasks_wanted)
        classes = classes.copy()
        classes[found["word"].to_numpy()] = found["class"].to_numpy()
        shared.unpersist()
    return best_classes


# Stands for the class of a rare word until that is chosen.
UNDECIDED = -1


def _beside(core: Core, ids: np.ndarray) -> np.ndarray:
    return np.where(ids == core.rare, UNDECIDED, core.classes[ids]).astype(np.int32)


# ``place`` orders all occurrences; one number, which Spark sorts without comparing rows.
RARE = "word binary, row long, place long, before int, after int, train boolean"


def _rare_words(rows: DataFrame, core) -> DataFrame:
    """Every occurrence of a word that is not frequent, with the classes next to it."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = core.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, before, counts = _flat(batch, known.end)
            at = np.flatnonzero(ids == known.rare)
            owner = np.repeat(np.arange(batch.num_rows), counts)[at]
            starts = (np.cumsum(counts) - counts)[owner]
            rows = batch["row"].to_numpy()[owner]
            columns = {
                "word": batch["rare"].flatten(),
                "row": pa.array(rows),
                "place": pa.array(rows + at - starts),
                "before": pa.array(_beside(known, before[at])),
                # The end follows every word, so there is always a next id.
                "after": pa.array(_beside(known, ids[at + 1])),
                "train": batch["train"].take(pa.array(owner)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(tasks, RARE)


CLASSED = "row long, place long, before int, after int, train boolean, class int, n long, first boolean"


def _classed(rare: DataFrame, bigrams: np.ndarray, plan: Clustering, tasks_wanted: int) -> DataFrame:
    """Add the class of each rare word, its training count, and whether a row is its first in training.

    A word of no training text has the open class and the count 0.
    """
    classes = plan.classes
    smooth = bigrams[: classes + 1, : classes + 1] + 0.1
    follows = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    size = np.log(bigrams[:, :classes].sum(axis=0) + 1.0)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "word"):
            starts, at = run_places(rows["word"])
            train = rows["train"].to_numpy(zero_copy_only=False)
            n = np.bincount(at[train], minlength=len(starts))
            beside = []
            for side in ("before", "after"):
                of = rows[side].to_numpy()
                taken = train & (of != UNDECIDED)
                cells = np.bincount(at[taken] * (classes + 2) + of[taken], minlength=len(starts) * (classes + 2))
                beside.append(cells.reshape(-1, classes + 2)[:, : classes + 1])
            fit = beside[0] @ follows[:, :classes] + beside[1] @ follows[:classes].T - n[:, None] * size
            chosen = np.where(n > 0, fit.argmax(axis=1), open_class(plan)).astype(np.int32)
            first = np.zeros(len(at), bool)
            first[np.flatnonzero(train)[np.unique(at[train], return_index=True)[1]]] = True
            columns = {c: rows[c] for c in ("row", "place", "before", "after", "train")}
            added = {"class": pa.array(chosen[at]), "n": pa.array(n[at]), "first": pa.array(first)}
            yield from pa.table(columns | added).combine_chunks().to_batches()

    return rare.repartition(tasks_wanted, "word").sortWithinPartitions("word").mapInArrow(tasks, CLASSED)


def _in_order(classed: DataFrame, plan: Clustering, tasks_wanted: int) -> DataFrame:
    """Put the class of a rare word behind another one into ``before``: rows of a text meet in order."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = open_class(plan)
        for batch in batches:
            if not batch.num_rows:
                continue
            # A text's first word has the end before it, so a chain never leaves its text.
            own, before = batch["class"].to_numpy(), batch["before"].to_numpy().copy()
            chained = batch["chained"].to_numpy(zero_copy_only=False)
            before[chained] = np.concatenate([[last], own[:-1]])[chained]
            last = own[-1]
            columns = {c: batch[c] for c in ("row", "after", "train", "class", "n", "first")}
            yield pa.RecordBatch.from_pydict(columns | {"before": pa.array(before), "leads": batch["leads"]})

    marked = classed.withColumn("chained", F.col("before") == UNDECIDED).withColumn("leads", F.col("after") == UNDECIDED)
    return (
        marked.repartition(tasks_wanted, "row")
        .sortWithinPartitions("place")
        .mapInArrow(tasks, "row long, after int, train boolean, class int, n long, first boolean, before int, leads boolean")
    )


@dataclass
class ClassModel:
    """Log10 probabilities: classes after classes (the open class stands for unknown words), and words in their class."""

    tokens: int
    types: int
    follows: np.ndarray
    sizes: np.ndarray  # training words of each class
    discount: float

    @classmethod
    def of(cls, bigrams: np.ndarray, class_types: np.ndarray, types: int, plan: Clustering) -> ClassModel:
        """Class transitions with a Dirichlet prior; each word gives ``discount`` of its count to unknown words."""
        known = plan.classes + 1
        counts = bigrams[:known, :known].astype(float)
        sizes, tokens = counts.sum(axis=0), int(counts.sum())
        alone = (sizes + 1) / (tokens + known)
        follows = (counts + plan.prior * alone) / (counts.sum(axis=1, keepdims=True) + plan.prior)
        words = sizes[: plan.classes]
        spared = np.divide(plan.discount * class_types, words, out=np.zeros(plan.classes), where=words > 0)
        # An unknown word is as likely as what the classes spare; it goes on as they do.
        share = plan.discount * class_types + 1e-9
        after_unknown = share / share.sum() @ follows[: plan.classes]
        rows = np.vstack([follows, after_unknown])
        unknown = np.maximum(rows[:, : plan.classes] @ spared, 1 / (tokens + types + 1))
        with np.errstate(divide="ignore"):
            return cls(tokens, types, np.log10(np.column_stack([rows, unknown])), words, plan.discount)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """Log10 of the add-one unigram model."""
        return np.log10((counts + 1) / (self.tokens + self.types + 1))

    def emission(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log10 of words in their word class; the end and unknown words stand alone in theirs."""
        inside = (classes < len(self.sizes)) & (counts > 0)
        sizes = np.append(self.sizes, [1.0, 1.0])[classes]
        return np.where(inside, np.log10(np.where(inside, counts - self.discount, 1) / np.where(inside, sizes, 1)), 0.0)


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _frequent_scores(rows: DataFrame, core, model) -> DataFrame:
    """Every text's sums over its tokens that are frequent words or its end."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scorer = core.value, model.value
        counts = np.append(known.counts, [known.texts, 0])
        words = known.classes[: known.end]
        emission = np.append(scorer.emission(words, known.counts), [0.0, 0.0])
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, before, each = _flat(batch, known.end)
            here, settled = ids != known.rare, (ids != known.rare) & (before != known.rare)
            base = np.where(here, scorer.base(counts)[ids], 0.0)
            score = np.where(here, emission[ids], 0.0)
            score += np.where(settled, scorer.follows[known.classes[before], known.classes[ids]], 0.0)
            starts = np.cumsum(each) - each
            columns = {
                "row": batch["row"],
                "doc_id": batch["doc_id"],
                "held_out": pc.invert(batch["train"]),
                "n_tokens": pa.array(each),
                "n_known": pa.array(sums((here & (counts[ids] > 0)).astype(np.int64), each)),
                "base_score": pa.array(np.add.reduceat(base, starts)),
                "score": pa.array(np.add.reduceat(score, starts)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(tasks, SCORED)


def _rare_scores(ordered: DataFrame, model) -> DataFrame:
    """Every text's sums over its rare words and over what follows them."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own, before, after, n = (batch[c].to_numpy() for c in ("class", "before", "after", "n"))
            leads = batch["leads"].to_numpy(zero_copy_only=False)
            score = scorer.emission(own, n) + scorer.follows[before, own]
            score += np.where(leads, 0.0, scorer.follows[own, np.where(leads, 0, after)])
            columns = {"known": (n > 0).astype(np.int64), "base": scorer.base(n), "more": score}
            # Rows of a text lie together, so few are left to add up.
            starts, _ = run_places(batch["row"])
            summed = {k: pa.array(np.add.reduceat(v, starts)) for k, v in columns.items()}
            yield pa.RecordBatch.from_pydict({"row": batch["row"].take(pa.array(starts))} | summed)

    each = ordered.select("row", "class", "before", "after", "n", "leads")
    added = [F.sum(c).alias(c) for c in ("known", "base", "more")]
    return each.mapInArrow(tasks, "row long, known long, base double, more double").groupBy("row").agg(*added)


def _core(counts: DataFrame, tokens: int, texts: int, plan: Clustering) -> Core:
    """Words of at least ``core_share`` of all tokens, most frequent first: at most its inverse."""
    least = max(int(np.ceil(plan.core_share * tokens)), 1)
    found = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").toArrow()
    words = found["word"].combine_chunks().cast(pa.binary())
    train = found["train"].to_numpy()
    # Words are dealt to classes in the order of frequency.
    classes = np.where(train > 0, np.arange(len(train)) % plan.classes, open_class(plan))
    classes = np.append(classes, [end_class(plan), open_class(plan)]).astype(np.int64)
    return Core(words, train, classes, texts)


def score_documents(
    docs: DataFrame,
    training: Column,
    plan: Clustering = Clustering(),
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every text.

    The model learns from all rows where ``training`` holds. Tokens are words between ASCII
    white space in lower case (A to Z), and one end per text. ``score`` is the class model's
    log10 probability, in which all unknown words are one event, as in ``base_score``, the
    add-one unigram model. Null and empty texts are an end alone; repeated rows are learned
    and scored each; a null id stays null; other columns are not read. Without training rows
    every token is unknown, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    tasks_wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    texts = docs.select(
        docs[doc_id].cast("long").alias("doc_id"),
        docs[text].cast("string").alias("text"),
        F.coalesce(training, F.lit(False)).alias("train"),
    )
    counts = stored(word_counts(texts), "word-counts")
    totals = counts.agg(F.sum("n").alias("n"), F.count_if(F.col("train") > 0).alias("types")).first()
    trained = texts.where("train").count()
    core = _core(counts, totals["n"] or 0, trained, plan)
    shared = spark.sparkContext.broadcast(core)
    rows = stored(sequences(texts, shared), "sequences")
    core = Core(core.words, core.counts, cluster(spark, rows.where("train"), core, plan), trained)
    shared.unpersist()
    shared = spark.sparkContext.broadcast(core)
    bigrams = class_bigrams(rows.where("train"), shared, plan)
    classed = _classed(_rare_words(rows, shared), bigrams, plan, tasks_wanted)
    ordered = stored(_in_order(classed, plan, tasks_wanted), "rare-words")
    bigrams[open_class(plan)], bigrams[:, open_class(plan)] = 0, 0
    types = np.bincount(core.classes[: core.end][core.counts > 0], minlength=plan.classes)
    learned = ordered.where("train")
    pairs = learned.select(F.col("before").alias("a"), F.col("class").alias("b"), F.col("first").cast("int").alias("new"))
    pairs = pairs.union(learned.where("NOT leads").select("class", "after", F.lit(0)))
    for row in pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("new")).collect():
        bigrams[row["a"], row["b"]] += row["n"]
        if row["new"]:
            types[row["b"]] += row["new"]
    model = ClassModel.of(bigrams, types, totals["types"] + (trained > 0), plan)
    scorer = spark.sparkContext.broadcast(model)
    scored = _frequent_scores(rows, shared, scorer).join(_rare_scores(ordered, scorer), "row", "left")
    score = F.col("score") + F.coalesce("more", F.lit(0.0))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
