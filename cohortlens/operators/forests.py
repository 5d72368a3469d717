"""Random forests grown in tasks and stored as a table of trees.

Features are cut into at most ``MAX_BINS`` bins once. Rows alike in bins, label and weight are one row with a number
of copies; a tree draws how often it sees each row from the Poisson law with that mean, by a hash of the row. A table of at
most ``LOCAL_ROWS`` rows goes to one task for every few trees, which grows them whole. In a larger one the nodes of more rows
than that are split by one aggregate over the rows for many nodes of all trees, then the rows of each node below go to a
task that grows the rest of its tree. Only splits of such large nodes reach the driver: tasks write the trees, and
rows to score meet them in tasks, a few trees and a block of rows at a time. Weights are whole numbers of 1/``UNIT``, so their sums do
not depend on their order, and both ways give the same trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.operators.boosting import LEAF, UNIT, Tree, binned, mixed, settled
from cohortlens.session import materialize, share_package

MAX_BINS = 32
LOCAL_ROWS = 1 << 18
#: Trees that one task grows if nothing else is asked, and scores if they are no larger than so many bytes together.
TASK_TREES, TASK_BYTES = 8, 1 << 25
#: Sums that one task holds at a time.
HERE_CELLS, MAX_CELLS = 1 << 20, 1 << 22
#: Votes are whole numbers of 1/``VOTE``, so their sums do not depend on their order.
VOTE = float(1 << 40)
GROWN = np.dtype([("feature", "<u2"), ("cut", "u1"), ("left", "<i4"), ("one", "<f8"), ("both", "<f8")])
STORED = np.dtype([("feature", "<u2"), ("cut", "u1"), ("left", "<i4"), ("vote", "<i8")])
BLOBS = ("bins", "label", "weight", "copies", "hash")


def salt(seed: int, tree: int) -> np.uint64:
    return mixed(np.array([(seed * 1_000_003 + tree) % 2**64], np.uint64))[0]


@lru_cache(maxsize=4096)
def poisson(mean: int) -> tuple[int, np.ndarray]:
    """The least likely-at-all count and the distribution function from there."""
    spread = 12 * math.sqrt(mean) + 20
    k = np.arange(max(0, math.floor(mean - spread)), math.ceil(mean + spread) + 1)
    logs = k * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in k])
    return int(k[0]), np.cumsum(np.exp(logs))


def drawn(hashes: np.ndarray, copies: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree sees each row."""
    chance = mixed(hashes ^ salt(seed, tree)) / 2.0**64
    out = np.empty(len(hashes), np.int64)
    for n in np.unique(copies):
        own = copies == n
        low, law = poisson(int(n))
        out[own] = low + np.searchsorted(law, chance[own], side="right")
    return out


def tried_features(paths: np.ndarray, width: int, seed: int, tree: int) -> np.ndarray:
    """(nodes, features): the square root of all features, drawn for each node by its path, lowest first."""
    count = math.ceil(math.sqrt(width))
    keys = mixed(mixed(paths.astype(np.uint64) ^ salt(seed, tree))[:, None] + np.arange(1, width + 1, dtype=np.uint64))
    return np.sort(np.argsort(keys, axis=1, kind="stable")[:, :count], axis=1)


def best_cuts(one: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gain, place of the feature, cut, weights of class 1 and of both on the left) from sums (nodes, features, bins).

    The largest drop of the Gini impurity counts; the first feature and the lowest cut win ties. No split has gain -inf.
    """
    below, all_below = one.cumsum(axis=2), both.cumsum(axis=2)
    total, whole = below[:, :1, -1:], all_below[:, :1, -1:]
    left, all_left = below[..., :-1], all_below[..., :-1]

    def impure(part: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.divide(2 * part * (of - part), of, out=np.zeros_like(of), where=of > 0)

    drop = (impure(total, whole) - impure(left, all_left) - impure(total - left, whole - all_left)) / whole
    gain = np.where((all_left > 0) & (all_left < whole) & (drop > 1e-12), drop, -np.inf)
    nodes, _, cuts = gain.shape
    flat, rows = gain.reshape(nodes, -1), np.arange(nodes)
    at = flat.argmax(axis=1)
    place, cut = at // cuts, at % cuts
    return flat[rows, at], place, cut, left[rows, place, cut], all_left[rows, place, cut]


def sums_by_cell(bins: np.ndarray, rows: np.ndarray, at: np.ndarray, tried: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """(nodes, features, bins) of each value: sums over ``rows``, whose nodes are ``at``, by the features their node tries."""
    cells, size = cells_of(bins, rows, at, tried), (*tried.shape, MAX_BINS)
    return [np.bincount(cells.ravel(), np.repeat(v[rows], size[1]), math.prod(size)).reshape(size) for v in values]


def cells_of(bins: np.ndarray, rows: np.ndarray, at: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """(rows, features): places in sums (nodes, features, bins)."""
    count = tried.shape[1]
    own = np.take(bins.ravel(), rows[:, None] * bins.shape[1] + tried[at])
    return (at[:, None] * count + np.arange(count)) * MAX_BINS + own


def sides_by_cell(bins: np.ndarray, rows: np.ndarray, at: np.ndarray, tried: np.ndarray, label: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, features, bins) of the weights of class 1 and of both, added up in one pass."""
    size = (*tried.shape, MAX_BINS, 2)
    cells = 2 * cells_of(bins, rows, at, tried) + label[rows][:, None]
    sums = np.bincount(cells.ravel(), np.repeat(both[rows], size[1]), math.prod(size)).reshape(size)
    return np.ascontiguousarray(sums[..., 1]), sums[..., 0] + sums[..., 1]


def grow(bins: np.ndarray, one: np.ndarray, both: np.ndarray, path: int, level: int, depth: int, seed: int, tree: int) -> np.ndarray:
    """The nodes from the one at ``path`` down, level by level, over rows that are all here; a leaf's ``left`` is itself.

    ``one`` and ``both`` are the weights of class 1 (all or nothing of a row) and of either.
    """
    out, base, label = [], 0, one > 0
    rows, at = np.arange(len(bins)), np.zeros(len(bins), np.int64)
    paths, ones, boths = np.array([path], np.uint64), np.array([one.sum()]), np.array([both.sum()])
    while len(paths):
        nodes = np.empty(len(paths), GROWN)
        nodes["feature"], nodes["cut"], nodes["left"] = 0, LEAF, np.arange(base, base + len(paths))
        nodes["one"], nodes["both"] = ones, boths
        out.append(nodes)
        mixed_up = np.flatnonzero((ones > 0) & (ones < boths)) if level < depth else np.empty(0, np.int64)
        if not len(mixed_up):
            break
        slot = np.full(len(paths), -1)
        slot[mixed_up] = np.arange(len(mixed_up))
        at = slot[at]
        order = np.argsort(at, kind="stable")[np.count_nonzero(at < 0):]
        rows, at = rows[order], at[order]
        tried = tried_features(paths[mixed_up], bins.shape[1], seed, tree)
        many, found = max(1, HERE_CELLS // (tried.shape[1] * MAX_BINS)), []
        for first in range(0, len(mixed_up), many):
            low, high = np.searchsorted(at, [first, first + many])
            found.append(best_cuts(*sides_by_cell(bins, rows[low:high], at[low:high] - first, tried[first : first + many], label, both)))
        gain, place, cut, left, all_left = map(np.concatenate, zip(*found))
        feature, splits = tried[np.arange(len(place)), place], np.isfinite(gain)
        parents = mixed_up[splits]
        nodes["feature"][parents], nodes["cut"][parents] = feature[splits], cut[splits]
        base += len(paths)
        nodes["left"][parents] = base + 2 * np.arange(len(parents))
        stay = splits[at]
        rows, at = rows[stay], at[stay]
        at = 2 * (np.cumsum(splits) - 1)[at] + (bins[rows, feature[at]] > cut[at])
        sides = lambda a, b: np.column_stack([a, b]).ravel()
        paths, ones, boths = (sides(2 * paths[parents], 2 * paths[parents] + np.uint64(1)),
                              sides(left[splits], ones[parents] - left[splits]), sides(all_left[splits], boths[parents] - all_left[splits]))
        level += 1
    return np.concatenate(out)


def pruned(nodes: np.ndarray) -> np.ndarray:
    """The tree as it is stored: sister leaves that say the same class are one leaf with their parent's share."""
    own, left, says = np.arange(len(nodes)), nodes["left"].astype(np.int64), 2 * nodes["one"] > nodes["both"]
    while True:
        leaf = left == own
        inner = np.flatnonzero(~leaf)
        a, b = left[inner], left[inner] + 1
        same = inner[leaf[a] & leaf[b] & (says[a] == says[b])]
        if not len(same):
            break
        left[same] = same
    # Level by level, as in ``grow``, wherever the nodes stood.
    levels, place = [np.zeros(1, np.int64)], np.zeros(len(nodes), np.int64)
    while len(levels[-1]):
        inner = left[levels[-1]][left[levels[-1]] != levels[-1]]
        levels.append(np.column_stack([inner, inner + 1]).ravel())
    order = np.concatenate(levels)
    place[order] = np.arange(len(order))
    out, leaf, kept = np.empty(len(order), STORED), (left == own)[order], nodes[order]
    out["feature"], out["cut"] = np.where(leaf, 0, kept["feature"]), np.where(leaf, LEAF, kept["cut"])
    out["left"] = place[left[order]]
    out["vote"] = np.rint(kept["one"] / kept["both"] * VOTE)
    return out


def votes(nodes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return nodes["vote"][settled(bins, (nodes["feature"], nodes["cut"], nodes["left"].astype(np.int64), None))]


def cell_of(features: str, limits: list[list[float]]) -> Column:
    """Bins of a feature vector, a byte a feature."""
    edges = [np.array(own, float) for own in limits]

    @F.pandas_udf("binary")
    def cell(values: pd.Series) -> pd.Series:
        out, have = np.full(len(values), None, object), values.notna().to_numpy()
        if have.any():
            out[have] = [row.tobytes() for row in binned(np.stack(values[have].to_numpy()), edges)]
        return pd.Series(out)

    return cell(vector_to_array(F.col(features)))


def cut_points(rows: DataFrame, width: int) -> list[list[float]]:
    """Limits between the bins of each feature: between all values where they are few, else quantiles."""
    probs = [i / MAX_BINS for i in range(1, MAX_BINS)]
    values = rows.select(F.posexplode("x").alias("i", "value")).filter("value IS NOT NULL")
    facts = {r["i"]: r for r in values.groupBy("i").agg(
        F.percentile_approx("value", probs, 10_000).alias("q"), F.max("value").alias("top"),
        F.approx_count_distinct("value").alias("kinds")).collect()}
    few = [i for i, r in facts.items() if r["kinds"] <= 2 * MAX_BINS]
    kinds: dict[int, list[float]] = {}
    for r in values.filter(F.col("i").isin(few)).distinct().collect():  # some tens a feature
        kinds.setdefault(r["i"], []).append(r["value"])
    out = []
    for i in range(width):
        known = sorted(kinds.get(i, []))
        if len(known) <= MAX_BINS and (known or i not in facts):
            out.append([(a + b) / 2 for a, b in zip(known, known[1:])])
        else:
            out.append(sorted({q for q in facts[i]["q"] if q < facts[i]["top"]}))
    return out


class Forest(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, HasSeed):
    """Random forest of a 0/1 label; rows without label, weight or features are left out."""

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)

    def __init__(self, numTrees: int, maxDepth: int, labelCol: str, weightCol: str, seed: int = 42, featuresCol: str = "features") -> None:
        super().__init__()
        if not 0 <= maxDepth <= 30:
            raise ValueError(f"a tree has 0 to 30 levels, not {maxDepth}")
        self._set(numTrees=numTrees, maxDepth=maxDepth, labelCol=labelCol, weightCol=weightCol, seed=seed, featuresCol=featuresCol)
        #: Most tasks that grow whole trees; None for one for every few trees.
        self.tasks: int | None = None

    def getNumTrees(self) -> int:
        return self.getOrDefault(self.numTrees)

    def getMaxDepth(self) -> int:
        return self.getOrDefault(self.maxDepth)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        share_package(dataset.sparkSession)
        known = dataset.select(F.col(self.getLabelCol()).cast("double").alias("y"), F.col(self.getWeightCol()).cast("double").alias("weight"),
                               self.getFeaturesCol(), vector_to_array(F.col(self.getFeaturesCol())).alias("x")
                               ).filter("y IS NOT NULL AND weight > 0 AND x IS NOT NULL")
        facts = known.agg(F.max(F.size("x")).alias("width"), F.count_if(~F.col("y").isin(0.0, 1.0)).alias("other")).first()
        if facts["width"] is None:
            raise ValueError("no labelled rows to fit")
        if facts["other"]:
            raise ValueError(f"{self.getLabelCol()} holds other values than 0 and 1")
        limits = cut_points(known, facts["width"])
        alike = known.select(cell_of(self.getFeaturesCol(), limits).alias("bins"), (F.col("y") == 1).alias("label"),
                             F.greatest(F.rint(F.col("weight") * UNIT), F.lit(1.0)).alias("weight")).groupBy("bins", "label", "weight").agg(
            F.count(F.lit(1)).alias("copies"))
        rows = materialize(alike.withColumn("hash", F.xxhash64("bins", "label", "weight")), "forest_rows")
        grown = self.small(rows) if rows.count() <= LOCAL_ROWS else self.large(rows, facts["width"])
        trees = materialize(grown, "forest")
        largest = trees.agg(F.max(F.octet_length("nodes")).alias("n")).first()["n"]
        if largest is None:
            raise ValueError("no tree drew a row")
        model = ForestModel(numTrees=self.getNumTrees(), limits=limits, treeBytes=largest, featuresCol=self.getFeaturesCol())
        model.trees = trees
        return model

    def small(self, rows: DataFrame) -> DataFrame:
        """(tree, nodes) from tasks that have all rows."""
        count, depth, seed = self.getNumTrees(), self.getMaxDepth(), self.getSeed()
        units = min(math.ceil(count / TASK_TREES), self.tasks or count)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = arrays_of(batch)
                for unit in range(units):
                    yield blob(unit, own)

        def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for unit, own in gathered(batches):
                for tree in range(unit, count, units):
                    bins, one, both = seen(own, seed, tree)
                    # A tree that drew no row has no vote.
                    if len(bins):
                        nodes = pruned(grow(bins, one, both, 1, 0, depth, seed, tree))
                        yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([nodes.tobytes()], pa.binary())], names=["tree", "nodes"])

        return rows.mapInArrow(deal, BLOB_SCHEMA).repartitionById(units, "unit").mapInArrow(plant, "tree int, nodes binary")

    def large(self, rows: DataFrame, width: int) -> DataFrame:
        """(tree, nodes): nodes of many rows are split over the whole table, the others in a task each."""
        count, depth, seed = self.getNumTrees(), self.getMaxDepth(), self.getSeed()
        tops, paths = [Tree() for _ in range(count)], [[1] for _ in range(count)]
        waiting, units = [(tree, 0) for tree in range(count)], []
        at_once = max(1, MAX_CELLS // (math.ceil(math.sqrt(width)) * MAX_BINS))
        while waiting:
            now, waiting = waiting[:at_once], waiting[at_once:]
            found = split_over_all(rows, tops, paths, now, width, seed)
            for tree, node in now:
                best = found.get((tree, node))
                if best is None or not math.isfinite(best["gain"]):
                    units.append((tree, node))
                    continue
                first = tops[tree].split(node, best["feature"], best["cut"])
                for child, (n, one, both) in ((first, best["left"]), (first + 1, best["right"])):
                    paths[tree].append(2 * paths[tree][node] + child - first)
                    level = paths[tree][child].bit_length() - 1
                    big = n > LOCAL_ROWS and 0 < one < both and level < depth
                    (waiting if big else units).append((tree, child))
        shapes, numbers = [t.arrays() for t in tops], {unit: i for i, unit in enumerate(units)}
        shared = rows.sparkSession.sparkContext.broadcast((shapes, numbers))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shapes, numbers = shared.value
            for batch in batches:
                own = arrays_of(batch)
                for tree, shape in enumerate(shapes):
                    node = np.where(drawn(own["hash"], own["copies"], seed, tree) > 0, settled(own["bins"], shape), -1)
                    for leaf in np.unique(node[node >= 0]):
                        yield blob(numbers[tree, int(leaf)], {c: v[node == leaf] for c, v in own.items()})

        def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for unit, own in gathered(batches):
                tree, node = units[unit]
                bins, one, both = seen(own, seed, tree)
                path = paths[tree][node]
                nodes = grow(bins, one, both, path, path.bit_length() - 1, depth, seed, tree)
                yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([node], pa.int32()), pa.array([nodes.tobytes()], pa.binary())],
                                                 names=["tree", "node", "nodes"])

        def join(group: pd.DataFrame) -> pd.DataFrame:
            tree = int(group["tree"].iloc[0])
            return pd.DataFrame({"tree": [tree], "nodes": [pruned(joined(shapes[tree], dict(zip(group["node"], group["nodes"])))).tobytes()]})

        parts = rows.mapInArrow(deal, BLOB_SCHEMA).repartitionById(len(units), "unit").mapInArrow(plant, "tree int, node int, nodes binary")
        return parts.groupBy("tree").applyInPandas(join, "tree int, nodes binary")


BLOB_SCHEMA = "unit int, " + ", ".join(f"{c} binary" for c in BLOBS)
KINDS = {"bins": np.uint8, "label": np.bool_, "weight": np.float64, "copies": np.int64, "hash": np.uint64}


def arrays_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns of stored rows; bins as a matrix."""
    out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in BLOBS[1:]}
    out["hash"] = out["hash"].view(np.uint64)
    out["bins"] = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return out


def blob(unit: int, own: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows as one row: the bytes of each column."""
    return pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), *[pa.array([own[c].astype(KINDS[c]).tobytes()], pa.binary()) for c in BLOBS]],
                                      names=["unit", *BLOBS])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The rows of each unit of a partition, which holds one."""
    parts: dict[int, dict[str, list[bytes]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            own = parts.setdefault(row["unit"], {c: [] for c in BLOBS})
            for c in BLOBS:
                own[c].append(row[c])
    for unit, own in parts.items():
        out = {c: np.frombuffer(b"".join(own[c]), KINDS[c]) for c in BLOBS}
        out["bins"] = out["bins"].reshape(len(out["hash"]), -1)
        yield unit, out


def seen(own: dict[str, np.ndarray], seed: int, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the rows that a tree drew, and their weights in class 1 and in both."""
    times = drawn(own["hash"], own["copies"], seed, tree)
    use = times > 0
    both = (times * own["weight"])[use]
    return own["bins"][use], np.where(own["label"][use], both, 0.0), both


def joined(top: tuple[np.ndarray, ...], parts: dict[int, bytes]) -> np.ndarray:
    """One tree from its top and the parts below the leaves of the top; sums of the top follow from theirs."""
    feature, cut, left, _ = top
    own = {node: np.frombuffer(data, GROWN) for node, data in parts.items()}
    out = np.zeros(len(left), GROWN)
    out["feature"], out["cut"], out["left"] = feature, cut, left
    pieces, size = [out], len(left)
    for node, part in own.items():
        # The part's root takes the leaf's place; the others follow.
        moved = part[1:].copy()
        moved["left"] += size - 1
        out[node] = part[0]
        out["left"][node] = node if part["left"][0] == 0 else part["left"][0] + size - 1
        pieces.append(moved)
        size += len(moved)
    for node in range(len(left) - 1, -1, -1):
        if left[node] != node:
            for name in ("one", "both"):
                out[name][node] = out[name][left[node]] + out[name][left[node] + 1]
    return np.concatenate(pieces)


def split_over_all(rows: DataFrame, tops: list[Tree], paths: list[list[int]], plan: list[tuple[int, int]], width: int, seed: int) -> dict:
    """(tree, node) -> best split of the nodes in ``plan`` and (rows, weights) of its sides, from one aggregate over the rows."""
    nodes: dict[int, list[int]] = {}
    for tree, node in plan:
        nodes.setdefault(tree, []).append(node)
    tries = {t: tried_features(np.array([paths[t][n] for n in own], np.uint64), width, seed, t) for t, own in nodes.items()}
    shared = rows.sparkSession.sparkContext.broadcast((nodes, tries, {t: tops[t].arrays() for t in nodes}))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, tries, shapes = shared.value
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            own = arrays_of(batch)
            for tree, asked in nodes.items():
                times = drawn(own["hash"], own["copies"], seed, tree)
                slot = np.full(len(shapes[tree][2]), -1)
                slot[asked] = np.arange(len(asked))
                at = np.where(times > 0, slot[settled(own["bins"], shapes[tree])], -1)
                use = np.flatnonzero(at >= 0)
                both = times * own["weight"]
                part = sums_by_cell(own["bins"], use, at[use], tries[tree], np.where(own["label"], both, 0.0), both, np.ones(len(at)))
                sums[tree] = part if tree not in sums else [a + b for a, b in zip(sums[tree], part)]
        for tree, part in sums.items():
            place = np.nonzero(part[2])
            columns = [np.full(len(place[0]), tree), np.array(nodes[tree])[place[0]], *place[1:], *[p[place] for p in part]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["tree", "node", "place", "bin", "one", "whole", "n"])

    cells = rows.mapInArrow(add_up, "tree long, node long, place long, bin long, one long, whole long, n long")
    total = cells.groupBy("tree", "node", "place", "bin").agg(*[F.sum(c).alias(c) for c in ("one", "whole", "n")])

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(group["tree"].iloc[0]), int(group["node"].iloc[0])
        tried = shared.value[1][tree][shared.value[0][tree].index(node)]
        sums = np.zeros((3, 1, len(tried), MAX_BINS))
        for k, name in enumerate(("one", "whole", "n")):
            sums[k, 0, group["place"], group["bin"]] = group[name]
        gain, place, cut, one, whole = (v[0] for v in best_cuts(sums[0], sums[1]))
        n = sums[2, 0, place, : cut + 1].sum()
        ends = sums[:, 0, 0].sum(axis=1)
        return pd.DataFrame({"tree": [tree], "node": [node], "gain": [gain], "feature": [int(tried[place])], "cut": [int(cut)],
                             "left": [[n, one, whole]], "right": [[ends[2] - n, ends[0] - one, ends[1] - whole]]})

    best = total.groupBy("tree", "node").applyInPandas(
        choose, "tree long, node long, gain double, feature long, cut long, left array<double>, right array<double>")
    return {(r["tree"], r["node"]): r for r in best.collect()}


class ForestModel(Model, HasFeaturesCol, MLReadable, MLWritable):
    """Adds ``rawPrediction``, ``probability`` (both of both classes) and ``prediction`` to rows with a feature vector.

    ``trees`` is a stored table (tree, nodes). Scoring stores the distinct bins of the rows first.
    """

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    limits = Param(Params._dummy(), "limits", "limits between the bins of each feature", TypeConverters.toList)
    treeBytes = Param(Params._dummy(), "treeBytes", "bytes of the largest tree", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, numTrees: int | None = None, limits: list | None = None, treeBytes: int | None = None, featuresCol: str = "features") -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.trees: DataFrame | None = None

    def getNumTrees(self) -> int:
        return self.getOrDefault(self.numTrees)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        share_package(dataset.sparkSession)
        keyed = dataset.withColumn("__cell", cell_of(self.getFeaturesCol(), self.getOrDefault(self.limits)))
        cells = materialize(keyed.select("__cell").filter("__cell IS NOT NULL").distinct(), "forest_cells")
        blocks = max(1, math.ceil(cells.count() / LOCAL_ROWS))
        own = max(1, min(TASK_TREES, TASK_BYTES // max(1, self.getOrDefault(self.treeBytes))))
        groups = math.ceil(self.getNumTrees() / own)
        schema = "unit int, bins binary, nodes binary"

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block = batch.column("block").to_numpy()
                for b in np.unique(block):
                    data = pa.array([b"".join(batch.column("__cell").filter(pa.array(block == b)).to_pylist())], pa.binary())
                    for group in range(groups):
                        yield pa.RecordBatch.from_arrays([pa.array([group * blocks + b], pa.int32()), data, pa.nulls(1, pa.binary())],
                                                         names=["unit", "bins", "nodes"])

        width = len(self.getOrDefault(self.limits))

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, trees = [], []
            for batch in batches:
                rows += [v for v in batch.column("bins").to_pylist() if v is not None]
                trees += [v for v in batch.column("nodes").to_pylist() if v is not None]
            bins, total = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width), 0
            for nodes in trees:
                total = total + votes(np.frombuffer(nodes, STORED), bins)
            for at in range(0, len(bins) if trees else 0, 1 << 14):
                part = bins[at : at + (1 << 14)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in part], pa.binary()), pa.array(total[at : at + (1 << 14)], pa.int64()),
                     pa.array(np.full(len(part), len(trees)), pa.int64())], names=["__cell", "votes", "trees"])

        dealt = cells.select("__cell", F.pmod(F.xxhash64("__cell"), F.lit(blocks)).alias("block")).mapInArrow(deal, schema)
        first = (F.floor(F.col("tree") / own) * blocks).cast("int")
        sent = self.trees.select(F.explode(F.sequence(first, first + F.lit(blocks - 1))).alias("unit"), F.lit(None).cast("binary").alias("bins"), "nodes")
        met = dealt.unionByName(sent).repartitionById(groups * blocks, "unit").mapInArrow(vote, "__cell binary, votes long, trees long")
        total = met.groupBy("__cell").agg((F.sum("votes") / VOTE).alias("__votes"), F.sum("trees").alias("__trees"))
        scored = keyed.join(total, "__cell", "left")
        p, known = F.col("__votes") / F.col("__trees"), F.col("__cell").isNotNull()
        pair = lambda a, b: F.when(known, array_to_vector(F.array(a.cast("double"), b.cast("double"))))
        return scored.select(*dataset.columns, pair(F.col("__trees") - F.col("__votes"), F.col("__votes")).alias("rawPrediction"),
                             pair(1 - p, p).alias("probability"), (p > 0.5).cast("double").alias("prediction"))

    def write(self) -> ForestWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> ForestReader:
        return ForestReader(cls)


class ForestWriter(MLWriter):
    """Parameters as other stages have them, and the trees beside them."""

    def __init__(self, model: ForestModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.trees.write.parquet(f"{path}/trees")


class ForestReader(MLReader):
    def __init__(self, cls: type[ForestModel]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.trees = self.sparkSession.read.parquet(f"{path}/trees")
        return model
