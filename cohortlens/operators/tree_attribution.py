"""Contributions of features to a booster's margin, path by path, for whole batches of rows.

A leaf's value reaches a row through the features on its path. Each of them either lets the row pass, or,
where the feature is taken as unknown, passes the share of training rows that went that way. The
contribution of a feature is its Shapley value in this game, averaged over the orders in which features
become known; sums over subsets come from the coefficients of one polynomial for each leaf, so a path of m
features costs m squared steps, not 2 to the m. Contributions of a row and the base add up to its margin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cohortlens.operators.boosting import BoosterModel, Ensemble
from cohortlens.session import share_package


#: Paths whose values are found together, features up to which the values of all patterns are, and rows that go over the paths together.
PATHS, PATTERN_BITS, ROWS = 256, 7, 1 << 15


class Path(NamedTuple):
    """One leaf: its value, and for each feature on the way the bins that pass (low < bin <= high) and the share of rows that do."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def paths(ensemble: Ensemble) -> Iterator[Path]:
    """All leaves of all trees."""
    feature, cut, left, value, cover = (ensemble.parts[n] for n in ("feature", "cut", "left", "value", "cover"))
    for root in ensemble.parts["first"][:-1].tolist():
        todo: list[tuple[int, dict]] = [(root, {})]
        while todo:
            node, known = todo.pop()
            if left[node] == node:
                names = sorted(known)
                rows = [known[f] for f in names]
                yield Path(float(value[node]), np.array(names, int), *(np.array([r[i] for r in rows], float) for i in range(3)))
                continue
            f, c = int(feature[node]), int(cut[node])
            low, high, share = known.get(f, (-1, 256, 1.0))
            for child, bounds in ((left[node], (low, min(high, c))), (left[node] + 1, (max(low, c), high))):
                ratio = float(cover[child]) / float(cover[node]) if cover[node] > 0 else 0.0
                todo.append((int(child), {**known, f: (*bounds, share * ratio)}))


def path_values(passes: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley value of each feature in the game whose worth is the product of passes (known) and shares (unknown).

    ``passes`` (patterns, m) holds 0 or 1; ``share`` is (m) or, for many paths, (paths, m), and the values then (paths, patterns, m).
    """
    count, m = passes.shape
    share = share[..., None, :]
    # Coefficient k: the sum over all sets of k known features.
    whole = np.zeros((*share.shape[:-2], count, m + 1))
    whole[..., 0] = 1
    for j in range(m):
        whole[..., 1:] = whole[..., 1:] * share[..., j : j + 1] + whole[..., :-1] * passes[:, j : j + 1]
        whole[..., 0] *= share[..., j]
    weight = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
    out = np.empty(whole[..., :m].shape)
    for j in range(m):
        o, z = passes[:, j], share[..., j]
        known = o > 0
        rest = np.zeros(out.shape)
        # Take the factor (share + pass t) out again: from the top where the row passes, else by the share.
        carry = whole[..., m].copy()
        for k in range(m - 1, -1, -1):
            rest[..., k] = np.where(known, carry, np.divide(whole[..., k], z, out=np.zeros_like(carry), where=z > 0))
            carry = whole[..., k] - carry * z
        out[..., j] = (rest @ weight) * (o - z)
    return out


def patterns(m: int) -> np.ndarray:
    """(2 ** m, m): which features pass, by code."""
    return (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)


def code_of(path: Path, bins: np.ndarray) -> np.ndarray:
    """Which features of a path let each row pass, as bits. Bins are best stored by feature."""
    code = np.zeros(len(bins), np.uint8 if len(path.features) <= 8 else np.int64)
    for j, (f, low, high) in enumerate(zip(path.features, path.low, path.high)):
        own = bins[:, f]
        code |= ((own > low) & (own <= high)).astype(code.dtype) << code.dtype.type(j)
    return code


def contributions(ensemble: Ensemble, x: np.ndarray) -> np.ndarray:
    """(rows, features + 1): each feature's part of the margin, and the base last."""
    bins = np.asfortranarray(ensemble.bins(x))
    out = np.zeros((x.shape[1] + 1, len(x)))
    out[-1] = ensemble.prior
    for some in all_paths(ensemble):
        m = len(some[0].features)
        few = m <= PATTERN_BITS
        # Values of all patterns, for many paths at once; of long paths only those that occur.
        tables = path_values(patterns(m), np.stack([path.share for path in some])) if m and few else None
        for i, path in enumerate(some):
            out[-1] += path.value * path.share.prod()
            if not m:
                continue
            if few:
                which, table = code_of(path, bins), tables[i]
            else:
                code, which = np.unique(code_of(path, bins), return_inverse=True)
                table = path_values((code[:, None] >> np.arange(m) & 1).astype(float), path.share)
            for f, values in zip(path.features, path.value * table.T):
                out[f] += np.take(values, which)
    return out.T


@lru_cache(maxsize=2)
def all_paths(ensemble: Ensemble) -> list[list[Path]]:
    """All leaves, in lists of as many features each."""
    by_size: dict[int, list[Path]] = {}
    for path in paths(ensemble):
        by_size.setdefault(len(path.features), []).append(path)
    return [own[at : at + PATHS] for _, own in sorted(by_size.items()) for at in range(0, len(own), PATHS)]


def gathered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Batches put together, as paths are gone over for each."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += len(batch)
        if size >= ROWS:
            yield pd.concat(waiting, ignore_index=True)
            waiting, size = [], 0
    if size:
        yield pd.concat(waiting, ignore_index=True)


def tree_contributions(model: BoosterModel, df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., one column for each feature, base): one pass over rows with a feature vector, and no shuffle."""
    packed = model.getOrDefault("packed")
    share_package(df.sparkSession)

    @F.pandas_udf("array<double>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for features in gathered(batches):
            yield pd.Series(list(contributions(Ensemble.unpack(packed), np.stack(features.to_numpy()))), dtype=object)

    split = df.select(*keep, parts(vector_to_array(F.col(model.getFeaturesCol()))).alias("parts"))
    return split.select(*keep, *[F.get("parts", F.lit(i)).alias(n) for i, n in enumerate([*names, "base"])])
