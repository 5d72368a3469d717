"""Quality rules: boosted trees over document statistics, as flat numpy arrays.

Statistics of a whole text come from one pass over its words and lines. Trees are grown in
numpy on histograms. A monotonic constraint on a feature bars splits whose children are in
the wrong order and passes the middle of the two child values down as a bound, so the whole
ensemble is monotonic in that feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.common import fields, frame_of, raw, windows, with_result, word_hashes

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The classifier reads at most this many labelled rows, those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
ROUNDS, DEPTH, RATE, BINS, LEAF_ROWS, PENALTY = 60, 4, 0.15, 64, 20, 1.0
THRESHOLD = 0.5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct"]
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "distinct_share"]
#: More of these never makes a text better.
DECREASING = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}


def statistics(text: str | None) -> tuple[int, ...]:
    """The ``BASE`` counts of a whole text; all 0 for a null or blank one."""
    data = raw(text)
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * len(BASE)
    hashes = word_hashes(words)
    runs = windows(hashes, 3)
    covered = np.zeros(n, bool)
    if len(runs):
        _, place, times = np.unique(runs, return_inverse=True, return_counts=True)
        again = times[place] > 1
        for i in range(3):
            covered[i : i + len(runs)] |= again
    lines = [line for line in data.split(b"\n") if line.split()]
    blank = len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (n, len(text) - blank, symbols, len(lines) - len(set(lines)), int(covered.sum()), len(lines), upper,
            len(np.unique(hashes)))


def features(base: np.ndarray) -> np.ndarray:
    words, chars, symbols, dup, repeat, lines, upper, distinct = base.astype(float).T
    per_word, per_char = np.maximum(words, 1), np.maximum(chars, 1)
    return np.column_stack([np.log1p(words), chars / per_word, symbols / per_char, dup / np.maximum(lines, 1),
                            repeat / per_word, upper / per_char, distinct / per_word])


@dataclass
class Trees:
    """An ensemble as flat arrays: one row of nodes per tree; a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int32)
        for _ in range(self.depth):
            f = self.feature[trees, node]
            right = x[rows, np.maximum(f, 0)] > self.cut[trees, node]
            node = np.where(f < 0, node, self.left[trees, node] + right)
        return self.start + self.value[trees, node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """Boost logistic loss. With one class or no rows, the ensemble is a constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    size = 2 ** (depth + 1) - 1
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.full((1, 1), -1), np.zeros((1, 1)), np.zeros((1, 1), np.int32), np.zeros((1, 1)), start, 0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
    trees, margin = [], np.full(len(y), start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _one_tree(binned, cuts, p - y, np.maximum(p * (1 - p), 1e-6), signs, depth, size)
        trees.append(tree[:4])
        margin += tree[4]
    return Trees(*(np.stack(part) for part in zip(*trees)), start, depth)


def _one_tree(binned, cuts, grad, hess, signs, depth, size):
    feature, cut, left, value = np.full(size, -1), np.zeros(size), np.zeros(size, np.int32), np.zeros(size)
    added, free = np.zeros(len(grad)), 1
    todo = [(0, np.arange(len(grad)), -np.inf, np.inf, 0)]
    while todo:
        node, rows, low, high, level = todo.pop()
        g, h = grad[rows], hess[rows]
        best = None
        if level < depth and len(rows) >= 2 * LEAF_ROWS:
            best = _best_split(binned[rows], cuts, g, h, signs, low, high)
        if best is None:
            value[node] = RATE * np.clip(-g.sum() / (h.sum() + PENALTY), low, high)
            added[rows] = value[node]
            continue
        f, at, lv, rv = best
        feature[node], cut[node], left[node] = f, cuts[f][at], free
        bounds = [(low, high), (low, high)]
        if signs[f]:
            middle = (lv + rv) / 2
            bounds = [(low, middle), (middle, high)] if signs[f] > 0 else [(middle, high), (low, middle)]
        right = binned[rows, f] > at
        todo += [(free, rows[~right], *bounds[0], level + 1), (free + 1, rows[right], *bounds[1], level + 1)]
        free += 2
    return feature, cut, left, value, added


def _best_split(binned, cuts, g, h, signs, low, high):
    best, gain = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + PENALTY)
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        sums = [np.bincount(binned[:, f], w, len(edges) + 1).cumsum() for w in (g, h, None)]
        (gl, hl, nl), (gt, ht, nt) = (s[:-1] for s in sums), (s[-1] for s in sums)
        lv = np.clip(-gl / (hl + PENALTY), low, high)
        rv = np.clip(-(gt - gl) / (ht - hl + PENALTY), low, high)
        gains = gl**2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - whole
        allowed = (nl >= LEAF_ROWS) & (nt - nl >= LEAF_ROWS)
        if signs[f]:
            allowed &= signs[f] * (rv - lv) >= 0
        gains = np.where(allowed, gains, -np.inf)
        at = int(gains.argmax())
        if gains[at] > gain:
            best, gain = (f, at, lv[at], rv[at]), gains[at]
    return best


def label_sample(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """Labelled ids with the smallest hashes; of an id with several labels, the lowest counts."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("label_key")).agg(
        F.min(label).cast("double").alias("label_value"))
    return chosen.orderBy(F.xxhash64("label_key"), "label_key").limit(rows)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on at most ``sample_rows`` labelled documents; only their counts reach the driver, once for each id.

    Of rows that repeat a labelled id, the one with the least counts is learned from. Null texts count as empty; without
    labelled documents the trees are a constant.
    """

    @F.pandas_udf(", ".join(f"{c} long" for c in BASE))
    def measured(texts: pd.Series) -> pd.DataFrame:
        return frame_of([statistics(t) for t in texts], BASE)

    sample = label_sample(labels, key, label, sample_rows)
    rows = docs.select(F.col(key).alias("doc_key"), F.col(text).alias("doc_text")).join(
        F.broadcast(sample), F.col("doc_key") == F.col("label_key"))  # at most sample_rows small rows
    counts = fields(with_result(rows, measured, "m", "doc_text"), ["doc_key", "label_value"], BASE)
    least = counts.groupBy("doc_key", "label_value").agg(F.min(F.struct(*BASE)).alias("least"))
    data = least.select("doc_key", "label_value", "least.*").toPandas().sort_values("doc_key")
    signs = [DECREASING.get(f, 0) for f in FEATURES]
    return grow(features(data[BASE].to_numpy()), data["label_value"].to_numpy(float), signs)


def base_failed(words: Column, repeats: Column) -> Column:
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def judge(docs: DataFrame, trees: Trees, text: str = "text", threshold: float = THRESHOLD):
    """``docs`` with a struct of the counts, ``score``, ``base_failed`` and ``kept``, in one pass without a shuffle.

    A null, empty or blank text has no words, so it fails the base rules. Repeated rows and
    extra columns stay; the struct takes a name that is free.
    """
    names = [*BASE, "score"]

    @F.pandas_udf(", ".join(f"{c} long" for c in BASE) + ", score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        base = np.array([statistics(t) for t in texts], np.int64).reshape(-1, len(BASE))
        out = pd.DataFrame(base, columns=BASE)
        out["score"] = trees.probability(features(base)) if len(base) else []
        return out[names]

    result = with_result(docs, scored, "quality_result", text)
    at = F.col(f"`{result.column}`")
    failed = base_failed(at["n_words"], at["n_repeat_words"])
    struct = F.struct(*[at[n].alias(n) for n in names], failed.alias("base_failed"),
                      (~failed & (at["score"] >= threshold)).alias("kept"))
    return result._replace(frame=result.frame.withColumn(result.column, struct))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns, whatever these are called.

    Null, empty and blank texts fail the base rules and go; repeated rows are judged alike and all stay or
    go. An empty table gives no rows, and without labels every document has the score of a constant, at the threshold.
    """
    result = judge(docs, train(docs, labels, key, text), text)
    return result.frame.filter(F.col(f"`{result.column}`.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
