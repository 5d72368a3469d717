"""Language identification with hyperdimensional profiles.

Each symbol has a fixed random +-1 vector. An n-gram binds its letters: the vector of the
letter k places before the last is rotated k times and all are multiplied. A document is the
sum of its n-grams and a language the sum of its documents, scaled to unit length each.
The answer is the language with the largest cosine. Bundling is linear, so a document is its
n-gram counts times the n-gram vectors: one matrix product for many documents.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import with_result

DIMENSIONS, N = 1024, 2
#: Symbol 0 is everything that is no letter, 1 to 26 the letters a to z; other letters share the rest.
SYMBOLS = 64
GRAMS = SYMBOLS**N
BATCH = 256
UNKNOWN = "und"
#: The pipeline drops documents without a letter, and those less alike to every language than this.
LEAST_COSINE = 0.1


@functools.lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of every character of the basic plane; letter case is folded for single characters."""
    out = np.zeros(0x10000, np.uint8)
    for code in range(0x10000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            at = ord(low) if len(low) == 1 else code
            out[code] = at - 96 if 97 <= at <= 122 else 27 + at % (SYMBOLS - 27)
    return out


@functools.lru_cache(maxsize=1)
def gram_vectors() -> np.ndarray:
    letters = np.random.default_rng(20240501).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
    grams = np.ones((1, DIMENSIONS), np.int8)
    for place in range(N):
        grams = (grams[:, None, :] * np.roll(letters, N - 1 - place, axis=1)[None, :, :]).reshape(-1, DIMENSIONS)
    return grams.astype(np.float32)


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of n-grams within words, borders included, one row per text; and the letters of each text."""
    counts, letters = np.zeros((len(texts), GRAMS), np.float32), np.zeros(len(texts), np.int64)
    known = symbol_table()
    for row, text in enumerate(texts):
        if not text:
            continue
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = known[np.minimum(codes, 0xFFFF)]
        high = codes > 0xFFFF
        if high.any():
            symbols[high] = [27 + ord(c) % (SYMBOLS - 27) if c.isalpha() else 0 for c in text if ord(c) > 0xFFFF]
        letters[row] = np.count_nonzero(symbols)
        edged = np.concatenate([[0], symbols, [0]]).astype(np.int32)
        grams = edged[: len(edged) - N + 1]
        for place in range(1, N):
            grams = grams * SYMBOLS + edged[place : len(edged) - N + 1 + place]
        count = np.bincount(grams, minlength=GRAMS)
        count[0] = 0
        counts[row] = count
    return counts, letters


def bundle(counts: np.ndarray) -> np.ndarray:
    """Document vectors of unit length."""
    vectors = counts @ gram_vectors()
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


class Profiles:
    def __init__(self, names: list[str], vectors: np.ndarray, center: np.ndarray):
        self.names, self.center = names, center
        self.vectors = self._apart(vectors)

    def _apart(self, vectors: np.ndarray) -> np.ndarray:
        """What all languages share is taken off, so that cosines tell languages rather than text apart."""
        own = vectors - self.center
        return own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Best language and its cosine, cut at 0; ``und`` and 0 without a letter or without any profile."""
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        names, scores = [], []
        for at in range(0, len(texts), BATCH):
            counts, letters = gram_counts(texts[at : at + BATCH])
            vectors = bundle(counts)
            cosine = (self._apart(vectors) if len(self.names) > 1 else vectors) @ self.vectors.T
            best = cosine.argmax(axis=1)  # the first name in order wins a tie
            names += [self.names[b] if n else UNKNOWN for b, n in zip(best, letters)]
            scores.append(np.where(letters > 0, np.clip(cosine.max(axis=1), 0, 1), 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> Profiles:
    """Bundle all documents of each language.

    Each task sums the n-gram shares of its documents by language, and the sums of one
    language and n-gram are added up by a shuffle of small rows; the driver gets one row per
    language and n-gram seen (at most ``GRAMS`` a language). A document adds its counts over
    their length, so a long one weighs no more. Rows without a language or a letter add nothing.
    """

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                counts, letters = gram_counts(part["text"].tolist())
                counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
                for name, rows in part.reset_index(drop=True).groupby("lang").indices.items():
                    rows = rows[letters[rows] > 0]
                    if len(rows):
                        total[name] = total.get(name, 0) + counts[rows].sum(axis=0, dtype=np.float64)
        for name, values in sorted(total.items()):
            seen = np.flatnonzero(values)
            yield pd.DataFrame({"lang": name, "gram": seen, "total": values[seen]})

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL")
    # Decimals add up alike in any order, so a lost task cannot change a profile.
    added = (rows.mapInPandas(sums, "lang string, gram int, total double")
             .groupBy("lang", "gram").agg(F.sum(F.col("total").cast("decimal(30,9)")).cast("double").alias("total"))
             .toPandas())
    names = sorted(added["lang"].unique())
    counts = np.zeros((len(names), GRAMS))
    counts[[names.index(n) for n in added["lang"]], added["gram"].to_numpy(int)] = added["total"]
    vectors = bundle(counts.astype(np.float32))
    center = vectors.mean(axis=0) if len(names) > 1 else np.zeros(DIMENSIONS, np.float32)
    return Profiles(names, vectors, center)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text"):
    """``docs`` with a struct of ``lang_pred`` and ``score``, in one pass without a shuffle.

    A null, empty or letterless text is ``und`` with score 0. Ties go to the first language
    in alphabetical order. Extra columns and repeated rows stay.
    """

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        names, scores = profiles.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": np.asarray(scores, float)})

    return with_result(docs, guess, "language_result", text)


def keep_identified(docs: DataFrame, lang: str = "lang", text: str = "text", least: float = LEAST_COSINE) -> DataFrame:
    """Documents whose language is plain, with their own columns, whatever these are called.

    The profiles come from the same documents. Null, empty and letterless texts are ``und`` and go; so does a text less alike
    to every language than ``least``. Repeated rows are judged alike; rows without a language are judged, not learned from.
    Without any language all go, and an empty table gives no rows. Ties go to the first language by name, which keeps the row either way.
    """
    result = identify(docs, train(docs, lang, text), text)
    at = F.col(f"`{result.column}`")
    good = (at["lang_pred"] != UNKNOWN) & (at["score"] >= least)
    return result.frame.filter(good).select(*[F.col(f"`{c}`") for c in docs.columns])
