"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with the logistic of a bias plus the
weights of its distinct words, a document unless all its sentences are clean (noisy-or).
Weights are learned from document labels alone, with an L1 penalty that leaves few words.
The sentences that carry a document's score are its offending ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.llm.common import fields, raw, with_result
from cohortlens.llm.quality import label_sample
from cohortlens.session import materialize

#: The classifier reads at most this many labelled rows, those with the smallest hash of their id.
SAMPLE_ROWS = 10_000
#: And of these as many as have so many distinct words of sentences together.
SAMPLE_WORDS = 1 << 23
SLOTS = 1 << 20
MIN_DOCUMENTS = 4
STEPS, RATE, PENALTY, START = 200, 1.0, 1e-4, -6.0
THRESHOLD = 0.7
MAX_MEMO = 300_000
SENTENCE = re.compile(rb"[^.!?\n]+")
WORD = re.compile(rb"[a-z0-9'\x80-\xff]+")


def sentences(text: str | None) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) in bytes of each sentence with a word; A-Z are lower-cased."""
    data = raw(text).lower()
    out = []
    for match in SENTENCE.finditer(data):
        words = WORD.findall(match[0])
        if words:
            out.append((match.start(), match.end(), words))
    return out


def slot(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & (SLOTS - 1)


class Bags(NamedTuple):
    """Word places of all sentences in a row, where each sentence starts, and where each document's first does."""

    words: np.ndarray
    sentence: np.ndarray
    document: np.ndarray


class Model(NamedTuple):
    bias: float
    slots: np.ndarray
    weights: np.ndarray

    def lookup(self) -> dict[int, float]:
        return dict(zip(self.slots.tolist(), self.weights.tolist()))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(bags: Bags, labels: np.ndarray, steps: int = STEPS) -> Model:
    """Adagrad with soft thresholds on the likelihood of the document labels."""
    if not len(labels) or labels.min() == labels.max():
        # One class or none: the smoothed share, spread over one sentence.
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(float(np.log(share / (1 - share))) if len(labels) else START, np.empty(0, np.int64), np.empty(0))
    count = len(bags.document)
    doc_of = np.repeat(np.arange(count), np.diff(np.append(bags.document, len(bags.sentence))))
    sent_of = np.repeat(np.arange(len(bags.sentence)), np.diff(np.append(bags.sentence, len(bags.words))))
    places, word = np.unique(bags.words, return_inverse=True)
    documents = np.bincount(np.unique(word.astype(np.int64) * count + doc_of[sent_of]) // count, minlength=len(places))
    often = documents >= MIN_DOCUMENTS
    number = np.cumsum(often) - 1
    use = often[word]
    word, sent_of, places = number[word[use]], sent_of[use], places[often]
    weight, bias = np.zeros(len(places)), START
    square, bias_square = np.full(len(places), 1e-8), 1e-8
    positive = labels > 0
    for _ in range(steps):
        z = bias + np.bincount(sent_of, weight[word], minlength=len(doc_of))
        clean = np.bincount(doc_of, softplus(z), minlength=count)  # -log P(no sentence is toxic)
        pull = np.where(positive, -1 / np.expm1(np.maximum(clean, 1e-9)), 1.0)
        grad_z = pull[doc_of] / (1 + np.exp(-z)) / count
        grad = np.bincount(word, grad_z[sent_of], minlength=len(places))
        square += grad**2
        step = RATE / np.sqrt(square)
        weight -= step * grad
        weight = np.sign(weight) * np.maximum(np.abs(weight) - step * PENALTY, 0)
        bias_grad = grad_z.sum()
        bias_square += bias_grad**2
        bias -= RATE * bias_grad / np.sqrt(bias_square)
    chosen = weight != 0
    return Model(float(bias), places[chosen].astype(np.int64), weight[chosen])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS) -> Model:
    """Fit on at most ``sample_rows`` labelled documents of at most ``sample_words`` words; the driver gets hashed words, not texts.

    Of rows that repeat a labelled id, the one with the least text is learned from. Words found in fewer than
    ``MIN_DOCUMENTS`` documents have no weight and stay where they are. Null texts have no sentence and teach nothing.
    """
    spark = docs.sparkSession

    @F.pandas_udf("words binary, sizes binary")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        words, sizes = [], []
        for value in texts:
            found = [sorted({slot(w) for w in s[2]}) for s in sentences(value)]
            words.append(np.array([p for s in found for p in s], "<u4").tobytes())
            sizes.append(np.array([len(s) for s in found], "<u4").tobytes())
        return pd.DataFrame({"words": words, "sizes": sizes})

    sample = label_sample(labels, key, label, sample_rows)
    rows = docs.select(F.col(key).alias("doc_key"), F.col(text).alias("doc_text")).join(
        F.broadcast(sample), F.col("doc_key") == F.col("label_key"))  # at most sample_rows small rows
    once = rows.groupBy("doc_key", "label_value").agg(F.min("doc_text").alias("doc_text"))
    found = materialize(fields(with_result(once, hashed, "m", "doc_text"), ["doc_key", "label_value"], ["words", "sizes"]).filter(
        F.octet_length("sizes") > 0), "toxic-words")
    # At most sample_rows rows.
    upto = F.sum(F.octet_length("words") / 4).over(Window.orderBy(F.xxhash64("doc_key"), "doc_key"))
    learned = found.withColumn("upto", upto).filter(F.col("upto") <= sample_words).drop("upto")
    often = spark.sparkContext.broadcast(frequent_slots(learned))

    @F.pandas_udf("words binary, sizes binary")
    def kept(words: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        out = []
        for w, n in zip(words, sizes):
            places, counts = np.frombuffer(w, "<u4"), np.frombuffer(n, "<u4")
            stay = often.value[places >> 3] >> (places & 7).astype(np.uint8) & 1 > 0
            of = np.repeat(np.arange(len(counts)), counts)
            out.append((places[stay].tobytes(), np.bincount(of[stay], minlength=len(counts)).astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["words", "sizes"])

    data = fields(with_result(learned, kept, "m", "words", "sizes"), ["doc_key", "label_value"], ["words", "sizes"]).toPandas()
    data = data.sort_values("doc_key")
    sizes = [np.frombuffer(s, "<u4") for s in data["sizes"]]
    words = np.frombuffer(b"".join(data["words"]), "<u4")
    flat = np.concatenate(sizes).astype(np.int64) if sizes else np.empty(0, np.int64)
    many = np.array([len(s) for s in sizes], np.int64)
    return fit(Bags(words, np.cumsum(flat) - flat, np.cumsum(many) - many), data["label_value"].to_numpy(float))


def frequent_slots(rows: DataFrame) -> np.ndarray:
    """Bitmap of the word places found in ``MIN_DOCUMENTS`` documents or more, of whatever size the sample is."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(np.frombuffer(w.as_py(), "<u4")) for w in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).astype(np.int64) if own else np.empty(0, np.int64))], names=["place"])

    counts = rows.select("words").mapInArrow(distinct, "place long").groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    often = counts.filter(F.col("n") >= MIN_DOCUMENTS).select((F.col("place") + 1).alias("p"))
    bits = np.zeros(SLOTS // 8, np.uint8)
    for row in often.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect():  # at most SLOTS / 32768 rows of 4 KB
        at = (row["bucket"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return bits


class Scorer:
    def __init__(self, model: Model):
        self.bias, self.weights, self.memo = model.bias, model.lookup(), {}

    def weight(self, word: bytes) -> float:
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) > MAX_MEMO:
                self.memo.clear()
            known = self.memo[word] = self.weights.get(slot(word), 0.0)
        return known

    def margins(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, margin) of each sentence."""
        weight = self.weight
        return [(a, b, self.bias + sum(map(weight, set(words)))) for a, b, words in sentences(text)]

    @staticmethod
    def probability(margins: list[float]) -> float:
        """Noisy-or; a text without a sentence has 0."""
        return float(-np.expm1(-softplus(np.array(margins)).sum())) if margins else 0.0


def score(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5):
    """``docs`` with a struct of ``score`` and ``offending``: byte spans and scores of sentences at ``least`` or more.

    One pass without a shuffle. Null, empty and wordless texts score 0. Extra columns and repeated rows stay.
    """

    @F.pandas_udf("score double, offending array<struct<start:int,end:int,score:double>>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        own = Scorer(model)
        scores, spans = [], []
        for value in texts:
            found = own.margins(value)
            scores.append(own.probability([m for _, _, m in found]))
            each = [(a, b, 1 / (1 + float(np.exp(-m)))) for a, b, m in found if m > -20]
            spans.append([{"start": a, "end": b, "score": p} for a, b, p in each if p >= least])
        return pd.DataFrame({"score": scores, "offending": spans})

    return with_result(docs, scored, "toxicity_result", text)
