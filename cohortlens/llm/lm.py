"""A log-bilinear language model, trained by noise-contrastive estimation.

Words from a count on are classes of their own, so the vocabulary grows with the corpus; any
other word belongs to a class by its form (its length, first two bytes and last one). Two
words of context: the word before and the one before that each give a distribution over all
classes, the product of two vectors plus a bias, normalised exactly; the score is a mixture of
the two. Within a class of many words, a word has its add-one share, one count standing for
all unseen words; so probabilities over known words and one unknown word per form sum to 1.

All training text is learned from, ``PASSES`` times whatever its size. Trainers start alike and take a
share of the text each, in ``ROUNDS`` rounds after each of which their vectors are averaged by how often each
class was seen; each has at least ``SPAN`` tokens for every class, so their number grows with the text, not
with its files. Normalisers are sums over all classes
for each context word; as the vocabulary grows with the root of the corpus, their cost grows
with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.llm.common import raw, scramble, word_hashes
from cohortlens.session import materialize

FORMS = 128
#: A word is a class of its own from this count on, and from the root of all tokens by ``RISE``.
LEAST, RISE = 8, 64
#: Words whose counts every task holds, besides those with a class; counts of the others are joined.
HEAD = 1 << 17
VECTOR = 32
#: Sampled training: tokens of a step and of a group that shares its noise words, those words, and the pace of a step.
BATCH, GROUP, DRAWN, PACE = 2048, 64, 16, 0.5
MANY = np.float32(math.log(DRAWN))
BUFFER = 1 << 16
#: How often all text is gone over, in how many averaged rounds, and the tokens a trainer has for each class, at least.
PASSES, ROUNDS, SPAN = 1, 2, 256
#: Classes whose vectors travel as one row; contexts and classes that are multiplied at a time, within a cache.
SLICE, TILE = 2048, 256
#: Stands for the end of a text, as does a word with a space; class 0 belongs to it.
END, END_WORD = np.uint64(0x5EED_0E4D_5EED_0E4D), b" "
#: Tokens in a row, distinct words that a task remembers, and counts that it adds up before it sends them.
CHUNK, KNOWN_WORDS, COUNT_ROWS = 1 << 16, 1 << 17, 1 << 21


def form_of(words: list[bytes]) -> np.ndarray:
    """Class of each word's form, by arithmetic on all words at once."""
    if not words:
        return np.empty(0, np.int64)
    data = np.frombuffer(b" ".join(words) + b"  ", np.uint8).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size + 1) - size - 1
    second = data[first + np.minimum(1, size - 1)]
    mixed = data[first] * 263 + second * 1031 + data[first + size - 1] * 67 + np.minimum(size, 12) // 4 * 17
    return (scramble(mixed.astype(np.uint64)) % np.uint64(FORMS)).astype(np.int64)


class Counts(NamedTuple):
    """Sums over all training tokens; ``head`` and ``head_count`` are the most frequent words, by hash."""

    total: int
    distinct: int
    head: np.ndarray
    head_count: np.ndarray
    head_class: np.ndarray
    own: int
    own_count: np.ndarray
    form_total: np.ndarray
    form_distinct: np.ndarray

    @property
    def size(self) -> int:
        return self.own + FORMS

    def noise(self) -> np.ndarray:
        """Smoothed share of each class in the training tokens."""
        n = np.concatenate([self.own_count, self.form_total]) + 1.0
        return n / n.sum()

    def classes(self, hashes: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each token; its count where it is in the head, else 0; and whether it is."""
        if not len(self.head):
            return np.where(hashes == END, 0, self.own + forms), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
        known = self.head[at] == hashes
        own = np.where(known, self.head_class[at], -1)
        classes = np.where(hashes == END, 0, np.where(own >= 0, own, self.own + forms))
        return classes, np.where(known, self.head_count[at], 0), known


class Lexicon:
    """Words of a task by number, with their hashes and forms; a word is hashed when it first comes up."""

    def __init__(self) -> None:
        self.numbers = {END_WORD: 0}
        self.hashes, self.forms = np.array([END]), np.zeros(1, np.int64)

    def ids(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int32, len(words))
        at = np.flatnonzero(found < 0)
        if len(at):
            missing = [words[i] for i in at.tolist()]
            fresh = list(dict.fromkeys(missing))
            self.numbers.update(zip(fresh, range(len(self.numbers), len(self.numbers) + len(fresh))))
            found[at] = np.fromiter(map(self.numbers.__getitem__, missing), np.int32, len(missing))
            self.hashes, self.forms = np.append(self.hashes, word_hashes(fresh)), np.append(self.forms, form_of(fresh))
        return found


#: A row of tokens: whole texts of about ``CHUNK`` tokens, as numbers of the words in the row's own list.
TOKENS = {"turn": "int", "docs": "array<long>", "sizes": "binary", "ids": "binary", "hashes": "binary", "forms": "binary", "counts": "binary"}
#: The turn of texts that are held out; the others have the number of the round that learns from them.
HELD = -1
#: Rows of tokens that a task is given at a time, as each holds many texts.
ROWS_AT_ONCE = 16


class Chunk(NamedTuple):
    """Texts of one row of tokens."""

    sizes: np.ndarray
    ids: np.ndarray
    hashes: np.ndarray
    forms: np.ndarray

    @staticmethod
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Chunk]]:
        """Row after row, so that one at a time is unpacked."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                hashes = np.frombuffer(row["hashes"], np.uint64)
                yield row, Chunk(np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["ids"], number_type(len(hashes))), hashes,
                                 np.frombuffer(row["forms"], np.uint8).astype(np.int64))


@contextmanager
def few_rows_at_once(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of few rows for the queries that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ROWS_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def number_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def tokenised(docs: DataFrame, key: str, text: str, training: Column, rounds: int = ROUNDS) -> DataFrame:
    """The texts as rows of ``TOKENS``, written once: nothing later splits or hashes a word. A row holds texts of one turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        waiting: dict[int, tuple[list, list, list]] = {}

        def out(turn: int) -> pa.RecordBatch:
            words, docs, sizes = waiting.pop(turn)
            own, local, counts = np.unique(lexicon.ids(words), return_inverse=True, return_counts=True)
            cells = [np.array(sizes, np.int32), local.astype(number_type(len(own))), lexicon.hashes[own],
                     lexicon.forms[own].astype(np.uint8), counts.astype(np.int64) * (turn != HELD)]
            return pa.RecordBatch.from_arrays(
                [pa.array([turn], pa.int32()), pa.array([docs], pa.list_(pa.int64())), *[pa.array([c.tobytes()], pa.binary()) for c in cells]],
                names=list(TOKENS))

        for batch in batches:
            for doc, apart, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = raw(value.as_py())
                # The round that learns from a text does not depend on the file it lies in.
                turn = HELD if apart else xxhash.xxh3_64_intdigest(data) % rounds
                words, docs, sizes = waiting.setdefault(turn, ([], [], []))
                own = data.lower().split()
                words += own
                words.append(END_WORD)
                docs.append(doc)
                sizes.append(len(own) + 1)
                if len(words) >= CHUNK:
                    yield out(turn)
                    if len(lexicon.numbers) > KNOWN_WORDS:
                        lexicon = Lexicon()
        for turn in list(waiting):
            yield out(turn)

    rows = docs.select(F.col(key).cast("long").alias("k"), (~training).alias("h"), F.col(text).alias("t"))
    return materialize(rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in TOKENS.items())), "tokens")


def count_words(rows: DataFrame) -> DataFrame:
    """(word, form, n) over all training tokens; each task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            n = np.bincount(place, np.concatenate(counts)).astype(np.int64)
            seen = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(words[seen].view(np.int64)), pa.array(
                np.concatenate(forms)[first[seen]].astype(np.int32)), pa.array(n[seen])], ["word", "form", "n"])

        hashes, forms, counts, waiting = [], [], [], 0
        for batch in batches:
            for one, two, three in (tuple(batch.column(c)[i].as_py() for c in range(3)) for i in range(batch.num_rows)):
                hashes.append(np.frombuffer(one, np.uint64))
                forms.append(np.frombuffer(two, np.uint8))
                counts.append(np.frombuffer(three, np.int64))
                waiting += len(hashes[-1])
                if waiting >= COUNT_ROWS:
                    yield out()
                    hashes, forms, counts, waiting = [], [], [], 0
        if waiting:
            yield out()

    learned = rows.filter(F.col("turn") != HELD).select("hashes", "forms", "counts")
    return learned.mapInArrow(run, "word long, form int, n long").groupBy("word").agg(
        F.first("form").alias("form"), F.sum("n").alias("n"))


def least_count(total: int) -> int:
    """Count from which a word has a class of its own."""
    return max(LEAST, math.ceil(math.sqrt(total) / RISE))


def gather(counts: DataFrame) -> Counts:
    """What every task needs of the counts: sums, the words with classes of their own, and others, up to ``HEAD``.

    Words are taken by classes of equal magnitude of their count, as many classes as fit, so
    no task sends more than its share; a class that does not fit is joined like all below it.
    """
    size = F.floor(F.log2("n") * 8).cast("int")
    sizes = counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect()  # some hundred rows
    own_least = least_count(sum(r["n"] for r in sizes))
    room, least = HEAD, None
    for row in sorted(sizes, key=lambda r: -r["size"]):
        room -= row["v"]
        if room < 0:
            break
        least = row["size"]
    end = int(np.array([END]).view(np.int64)[0])
    chosen = (F.col("n") >= own_least) | (F.col("word") == end)
    top = counts.filter(chosen | (size >= least) if least is not None else chosen).toPandas().sort_values(
        ["n", "word"], ascending=[False, True])
    hashes, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    rank = np.full(len(top), -1, np.int64)
    words = np.flatnonzero((hashes != END) & (n >= own_least))
    rank[words] = np.arange(1, len(words) + 1)
    sums = counts.groupBy(F.when(chosen, F.lit(-1)).otherwise(F.col("form")).alias("form")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    form_total, form_distinct = np.zeros(FORMS, np.int64), np.zeros(FORMS, np.int64)
    for row in sums:
        if row["form"] >= 0:
            form_total[row["form"]], form_distinct[row["form"]] = row["n"], row["v"]
    order = np.argsort(hashes)
    return Counts(sum(r["n"] for r in sums), sum(r["v"] for r in sums), hashes[order], n[order], rank[order],
                  len(words) + 1, np.append(n[hashes == END].sum(), n[words]), form_total, form_distinct)


def contexts(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token and the one before that; a text starts after ends, and so do texts in a row."""
    first = np.concatenate([[0], classes[:-1]])
    return first, np.where(first == 0, 0, np.concatenate([[0], first[:-1]]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.negative(x)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


class Trainer:
    """Noise-contrastive estimation on tokens, by steps scaled for each vector (AdaGrad).

    Each class has a vector as the word before, one as the word before that and one as the word
    itself, and a bias against the noise. All trainers start with the same vectors, or where the round before ended.
    """

    def __init__(self, noise: np.ndarray, start: State | None = None):
        self.random = np.random.default_rng(7)
        size = len(noise)
        if start is None:
            vectors = self.random.normal(0, 0.3, (size, 2 * VECTOR)).astype(np.float32)
            # Vectors of the word before, then those of the word before that; the bias is the last column.
            start = State(np.concatenate([vectors[:, :VECTOR], vectors[:, VECTOR:]]), np.zeros((size, VECTOR + 1), np.float32),
                          np.full(2 * size, 1e-2, np.float32), np.full(size, 1e-2, np.float32), 0.3)
        self.context, self.target = start.context.copy(), start.target.copy()
        self.context_square, self.target_square, self.share = start.context_square.copy(), start.target_square.copy(), start.share
        self.below, self.seen = np.cumsum(noise), np.zeros(size, np.int64)
        self.held, self.waiting = [], 0

    def add(self, classes: np.ndarray) -> None:
        self.held.append(np.stack([classes, *contexts(classes)]))
        self.waiting += len(classes)
        if self.waiting >= BUFFER:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        rows = np.concatenate(self.held, axis=1)
        self.seen += np.bincount(rows[0], minlength=len(self.seen))
        self.held, self.waiting = [], 0
        rows = rows[:, self.random.permutation(rows.shape[1])]
        for at in range(0, rows.shape[1], BATCH):
            part = rows[:, at : at + BATCH]
            live = part.shape[1]
            self.step(*np.pad(part, ((0, 0), (0, -live % GROUP))), live)

    def step(self, word: np.ndarray, before: np.ndarray, earlier: np.ndarray, live: int) -> None:
        """One step over a batch; rows from ``live`` on only fill the last group."""
        size, groups = len(self.target), len(word) // GROUP
        drawn = np.minimum(np.searchsorted(self.below, self.random.random(groups * DRAWN)), size - 1)
        real = (np.arange(len(word)) < live).astype(np.float32).reshape(groups, 1, GROUP)
        # Both contexts of a group side by side, against the same words and noise.
        at = np.stack([before.reshape(groups, GROUP), earlier.reshape(groups, GROUP) + size], axis=1).ravel()
        x = np.take(self.context, at, axis=0).reshape(groups, 2 * GROUP, VECTOR)
        pairs = x.reshape(groups, 2, GROUP, VECTOR)
        y = np.take(self.target, word, axis=0).reshape(groups, GROUP, VECTOR + 1)
        noise = np.take(self.target, drawn, axis=0).reshape(groups, DRAWN, VECTOR + 1)
        words, others = np.ascontiguousarray(y[..., :VECTOR]), np.ascontiguousarray(noise[..., :VECTOR])
        fit = np.einsum("gcnd,gnd->gcn", pairs, words)
        fit += y[:, None, :, VECTOR]
        pull = (sigmoid(fit - MANY) - 1) * real
        push = np.matmul(x, others.transpose(0, 2, 1))
        push += noise[:, None, :, VECTOR] - MANY
        push = sigmoid(push)
        if live < len(word):
            push *= np.broadcast_to(real, (groups, 2, GROUP)).reshape(groups, 2 * GROUP, 1)
        grad = np.empty((len(word) + len(drawn), VECTOR + 1), np.float32)
        grad[: len(word), :VECTOR] = np.einsum("gcn,gcnd->gnd", pull, pairs).reshape(-1, VECTOR)
        grad[: len(word), VECTOR] = pull.sum(axis=1).ravel()
        grad[len(word) :, :VECTOR] = np.matmul(push.transpose(0, 2, 1), x).reshape(-1, VECTOR)
        grad[len(word) :, VECTOR] = push.sum(axis=1).ravel()
        own = np.matmul(push, others).reshape(groups, 2, GROUP, VECTOR)
        own += pull[..., None] * words[:, None]
        move(self.context, self.context_square, at, own.reshape(-1, VECTOR))
        move(self.target, self.target_square, np.concatenate([word, drawn]), grad)
        odds = math.log(self.share / (1 - self.share))
        closer = sigmoid(fit[:, 1] - fit[:, 0] + odds).ravel()[:live]
        self.share += 0.02 * live / 8192 * (float(closer.mean()) - self.share)

    def rows(self) -> np.ndarray:
        """All of a class in one row: three vectors, bias, and the squares of its steps."""
        size = len(self.target)
        return np.column_stack([self.context[:size], self.context[size:], self.target, np.log(self.context_square[:size]),
                                np.log(self.context_square[size:]), np.log(self.target_square)])


class State(NamedTuple):
    """Where a round ends and the next one starts."""

    context: np.ndarray
    target: np.ndarray
    context_square: np.ndarray
    target_square: np.ndarray
    share: float

    @staticmethod
    def of(rows: np.ndarray, share: float) -> State:
        first, second, target, squares = np.split(rows.astype(np.float32), [VECTOR, 2 * VECTOR, 3 * VECTOR + 1], axis=1)
        squares = np.exp(squares)
        return State(np.concatenate([first, second]), np.ascontiguousarray(target), np.concatenate([squares[:, 0], squares[:, 1]]),
                     np.ascontiguousarray(squares[:, 2]), share)


def move(table: np.ndarray, square: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
    """Add up the gradients of each row, and step."""
    order = np.argsort(rows.astype(np.int32))
    rows, grad = np.take(rows, order), np.take(grad, order, axis=0)
    edge = np.concatenate([[True], rows[1:] != rows[:-1], [True]])
    start = np.flatnonzero(edge[:-1])
    # Most rows come once and need no sum.
    many = np.flatnonzero(~edge[start + 1])
    at, total = np.take(rows, start), np.take(grad, start, axis=0)
    if len(many):
        inside = np.flatnonzero(~(edge[:-1] & edge[1:]))
        total[many] = np.add.reduceat(np.take(grad, inside, axis=0), np.searchsorted(inside, start[many]), axis=0)
    square[at] += np.einsum("ij,ij->i", total, total)
    total *= (PACE / np.sqrt(np.take(square, at)))[:, None]
    table[at] = np.take(table, at, axis=0) - total


class Model(NamedTuple):
    """``first`` and ``second`` are vectors of contexts; ``norm`` has the log of each one's sum over all classes."""

    first: np.ndarray
    second: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    norm: np.ndarray
    share: float

    def logs(self, classes: np.ndarray) -> np.ndarray:
        """Natural log of each token's probability after the two before it."""
        before, earlier = contexts(classes)
        y, bias = np.take(self.target, classes, axis=0), np.take(self.bias, classes)
        one = np.einsum("ij,ij->i", np.take(self.first, before, axis=0), y) + bias - np.take(self.norm[0], before)
        two = np.einsum("ij,ij->i", np.take(self.second, earlier, axis=0), y) + bias - np.take(self.norm[1], earlier)
        return np.logaddexp(one + math.log(1 - self.share), two + math.log(self.share))

    def norms(self, start: int) -> np.ndarray:
        """``norm`` of the ``SLICE`` contexts from ``start`` on."""
        vectors = np.concatenate([self.first[start : start + SLICE], self.second[start : start + SLICE]])
        total = np.zeros(len(vectors))
        for row in range(0, len(vectors), TILE):
            part = vectors[row : row + TILE]
            for at in range(0, len(self.target), SLICE):
                scores = part @ self.target[at : at + SLICE].T
                scores += self.bias[at : at + SLICE]
                np.minimum(scores, 80, out=scores)
                total[row : row + TILE] += np.exp(scores, out=scores).sum(axis=1)
        return np.log(total).reshape(2, -1)


def trainers(own: Counts) -> int:
    """How many share the text, each with ``SPAN`` tokens for every class."""
    return max(1, own.total // (SPAN * own.size))


def learn(rows: DataFrame, shared: Broadcast, passes: int = PASSES, rounds: int = ROUNDS) -> Model:
    """Train on all tokens of the training rows; ``norm`` is still empty."""
    own, spark = shared.value, rows.sparkSession
    width = 3 * VECTOR + 4
    schema = "start int, tokens long, share double, seen binary, tables binary"
    names = ["start", "tokens", "share", "seen", "tables"]
    state = Trainer(own.noise()).rows().astype("<f2")
    share = 0.3

    for turn in range(passes * rounds):
        here = spark.sparkContext.broadcast((state, share))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(shared.value.noise(), State.of(*here.value))
            for _, chunk in Chunk.rows(batches):
                trainer.add(np.take(shared.value.classes(chunk.hashes, chunk.forms)[0], chunk.ids))
            trainer.flush()
            n = int(trainer.seen.sum())
            if not n:
                return
            tables = trainer.rows().astype("<f2")
            for at in range(0, len(tables), SLICE):
                row = [[at], [n], [trainer.share], [trainer.seen[at : at + SLICE].astype("<i8").tobytes()], [tables[at : at + SLICE].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *map(pa.array, row[1:])], names)

        def joined(parts: pa.Table) -> pa.Table:
            """Each class by how often a trainer saw it."""
            start = parts["start"][0].as_py()
            weights = [np.frombuffer(x.as_py(), "<i8") + 1e-3 for x in parts["seen"]]
            tables = sum(w[:, None] * np.frombuffer(x.as_py(), "<f2").reshape(-1, width).astype(np.float32)
                         for w, x in zip(weights, parts["tables"])) / sum(weights)[:, None]
            n = parts["tokens"].to_numpy()
            return pa.table([pa.array([start], pa.int32()), pa.array([int(n.sum())]),
                             pa.array([float((n * parts["share"].to_numpy()).sum() / n.sum())]), pa.array([b""]),
                             pa.array([tables.astype("<f2").tobytes()])], names=names)

        texts = rows.filter(F.col("turn") == turn % rounds).select("sizes", "ids", "hashes", "forms")
        parts = texts.coalesce(trainers(own)).mapInArrow(run, schema).groupBy("start").applyInArrow(
            joined, schema).collect()  # vectors of all classes, which grow with the root of the corpus
        if parts:
            parts.sort(key=lambda r: r["start"])
            state, share = np.frombuffer(b"".join(bytes(r["tables"]) for r in parts), "<f2").reshape(-1, width), parts[0]["share"]
    return model_of(State.of(state, share), own.noise())


def model_of(state: State, noise: np.ndarray) -> Model:
    """The model of a state; ``norm`` is still empty."""
    size = len(noise)
    return Model(np.ascontiguousarray(state.context[:size]), np.ascontiguousarray(state.context[size:]), np.ascontiguousarray(
        state.target[:, :VECTOR]), (state.target[:, VECTOR] + np.log(noise)).astype(np.float32), np.zeros((2, size)), state.share)


def normalised(spark: SparkSession, model: Model) -> Model:
    """Sums over all classes for each context, shared out among tasks."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([shared.value.norms(start).tobytes()])], ["start", "norm"])

    size = len(model.target)
    rows = spark.range(0, size, SLICE, math.ceil(size / SLICE)).mapInArrow(run, "start long, norm binary").collect()
    rows.sort(key=lambda r: r["start"])
    return model._replace(norm=np.concatenate([np.frombuffer(r["norm"]).reshape(2, -1) for r in rows], axis=1))


def score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", passes: int = PASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Learns from all rows where ``training`` holds and scores every row, in log10. A null or
    empty text is one end. Without training rows every token is unknown. Rows that repeat an
    id are scored each. Texts never shuffle: counts do, by word, and for each document its
    words outside the head with their number; those are rare, so none is a hot key.
    """
    training = F.coalesce(training, F.lit(True))
    spark = docs.sparkSession
    rows = tokenised(docs, key, text, training)
    with few_rows_at_once(spark):
        counts = materialize(count_words(rows), "word-counts")
        own = gather(counts)
        shared = spark.sparkContext.broadcast(own)  # HEAD words, those with classes, and sums of forms
        model = spark.sparkContext.broadcast(normalised(spark, learn(rows, shared, passes)))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_head", pa.int64()),
                        ("head_base", pa.float64()), ("head_score", pa.float64()), ("words", pa.list_(pa.int64())),
                        ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, net = shared.value, model.value
        shares = np.log10(own.form_total + own.form_distinct + 1.0)
        for row, chunk in Chunk.rows(batches):
            sizes = chunk.sizes.astype(np.int64)
            first = np.cumsum(sizes) - sizes
            # Of each word of the row, then of each token.
            class_of, count, in_head = own.classes(chunk.hashes, chunk.forms)
            base_of, many = np.log10(count + 1.0), class_of >= own.own
            inside = np.where(many, base_of - shares[np.where(many, class_of - own.own, 0)], 0.0)
            known = np.take(in_head, chunk.ids)
            logs = net.logs(np.take(class_of, chunk.ids)) / math.log(10) + np.take(inside, chunk.ids)
            # Words outside the head, and how often each text has them.
            text_of = np.repeat(np.arange(len(sizes)), sizes)[~known]
            pair, times = np.unique(text_of * len(chunk.hashes) + chunk.ids[~known], return_counts=True)
            ends = pa.array(np.searchsorted(pair // len(chunk.hashes), np.arange(len(sizes) + 1)).astype(np.int32))
            words = chunk.hashes[pair % len(chunk.hashes)].view(np.int64)
            add = lambda values: pa.array(np.add.reduceat(values, first))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["docs"], pa.int64()), pa.array(np.full(len(sizes), row["turn"] == HELD)), pa.array(sizes), add(known.astype(np.int64)),
                 add(np.take(base_of, chunk.ids)), add(logs), pa.ListArray.from_arrays(ends, pa.array(words)),
                 pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))], schema=schema)

    parts = rows.select(*[c for c in TOKENS if c != "counts"]).mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_head long, head_base double, head_score double, words array<long>, times array<int>")
    with few_rows_at_once(spark):
        parts = materialize(parts.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    found = rare.join(counts.select("word", "n"), "word").groupBy("row").agg(
        F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare"))
    added = F.coalesce("rare", F.lit(0.0))
    per_token = float(np.log10(own.total + own.distinct + 1.0))
    return parts.drop("words", "times").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(own.total).cast("long").alias("train_tokens"),
        (F.col("head_base") + added - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("head_score") + added).alias("score"))
