"""Boosted trees of many fits at once, grown on histograms of binned features.

Folds, trials and models are *jobs*. Features are cut into at most ``MAX_BINS`` bins once for each table; a
level of all trees under way then needs the sums of gradient, hessian and rows per (job, node, feature,
bin), which is one aggregate over the rows, and the best split of a node is found where its sums meet.
Only splits reach the driver. Scores of earlier trees are stored with the rows every ``STORE_ROUNDS``
rounds, so a task repeats few trees and a lost executor costs one level.

A table of at most ``LOCAL_ROWS`` rows (its count is checked) needs no exchange at all: its rows (a byte a feature)
go to one task for each job, which grows all rounds there; of two sister nodes only the one with fewer rows is added up, and features
whose bins together have few codes are added up in one pass. Gradients are whole numbers of 1/``UNIT``, so their sums do
not depend on their order, and both ways give the same trees.
"""

from __future__ import annotations

import base64
import io
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params as MLParams, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from cohortlens.session import materialize, share_package

MAX_BINS = 64
UNIT = float(1 << 26)
LOCAL_ROWS = 1 << 20
STORE_ROUNDS = 20
#: Sums that one task holds at a time; nodes beyond them wait for the next pass.
MAX_CELLS = 1 << 22
#: Codes of features that are added up together: for nodes of at least ``CODE_ROWS`` rows, and for smaller ones.
MANY_CODES, FEW_CODES, CODE_ROWS = 1 << 12, 1 << 6, 1 << 14
BLOCK_ROWS = 1 << 15
#: Rows scored together with all trees.
SCORE_ROWS = 8192
LEAF = 255


@dataclass(frozen=True)
class Settings:
    """How one booster grows.

    Splits maximise the drop of the loss: with ``newton`` from gradients and hessians, less the penalties, and only
    where half that drop exceeds ``gamma``; else the squared error of the gradients. Leaves are Newton steps either way.
    """

    rounds: int
    depth: int
    rate: float
    subsample: float = 1.0
    colsample: float = 1.0
    min_child_weight: float = 0.0
    gamma: float = 0.0
    reg_lambda: float = 0.0
    reg_alpha: float = 0.0
    newton: bool = False
    seed: int = 42


@dataclass(frozen=True)
class Job:
    """One fit: the place of its table in the list of tables, and its settings."""

    table: int
    settings: Settings


def mixed(value: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        value = (value ^ (value >> np.uint64(33))) * np.uint64(factor)
    return value ^ (value >> np.uint64(33))


def sampled(hashes: np.ndarray, settings: Settings, turn: int) -> np.ndarray:
    """Rows that a round looks at, chosen by hash."""
    if settings.subsample >= 1:
        return np.ones(len(hashes), bool)
    salt = mixed(np.array([settings.seed * 1_000_003 + turn], np.uint64))[0]
    return mixed(hashes ^ salt) / 2.0**64 < settings.subsample


def chosen_features(settings: Settings, turn: int, width: int) -> np.ndarray:
    count = max(1, math.ceil(settings.colsample * width - 1e-9))
    if count >= width:
        return np.arange(width)
    return np.sort(np.random.default_rng([settings.seed, turn]).choice(width, count, replace=False))


def shrunk(gradient: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(gradient) * np.maximum(np.abs(gradient) - alpha, 0.0)


def leaf_value(gradient: float, hessian: float, settings: Settings) -> float:
    """The penalised Newton step, before the learning rate; sums are in units of 1/``UNIT``."""
    weight = hessian / UNIT + settings.reg_lambda
    return float(-shrunk(gradient / UNIT, settings.reg_alpha) / weight) if weight > 0 else 0.0


def best_splits(sums: np.ndarray, settings: Settings) -> tuple[np.ndarray, ...]:
    """(gain, feature, cut, sums of the left side, sums of all) per node from ``sums`` (3, nodes, features, bins).

    Rows whose bin is at most ``cut`` go left. The first feature and the lowest cut win ties; no allowed split has gain -inf.
    """
    below = sums.cumsum(axis=3)
    total = below[:, :, :1, -1:]
    left, right = below[..., :-1], total - below[..., :-1]

    def worth(side: np.ndarray) -> np.ndarray:
        weight = (side[1] / UNIT if settings.newton else side[2]) + settings.reg_lambda
        power = shrunk(side[0] / UNIT, settings.reg_alpha) ** 2
        return np.divide(power, weight, out=np.zeros_like(power), where=weight > 0)

    gain = worth(left) + worth(right) - worth(total)
    if settings.newton:
        gain = gain / 2 - settings.gamma
    least = settings.min_child_weight * UNIT
    allowed = (left[2] > 0) & (right[2] > 0) & (left[1] >= least) & (right[1] >= least)
    gain = np.where(allowed & (gain > 1e-12), gain, -np.inf)
    nodes, features, cuts = gain.shape
    flat = gain.reshape(nodes, -1)
    at = flat.argmax(axis=1) if flat.shape[1] else np.zeros(nodes, int)
    rows = np.arange(nodes)
    best = flat[rows, at] if flat.shape[1] else np.full(nodes, -np.inf)
    feature, cut = at // max(cuts, 1), at % max(cuts, 1)
    return best, feature, cut, (left[:, rows, feature, cut] if flat.shape[1] else total[:, :, 0, 0]), total[:, :, 0, 0]


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf's ``left`` is itself."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [LEAF])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> int:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.left)
        for _ in range(2):
            self.feature.append(0)
            self.cut.append(LEAF)
            self.left.append(len(self.left))
            self.value.append(0.0)
            self.cover.append(0.0)
        return self.left[node]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.value)


def step(bins: np.ndarray, node: np.ndarray, arrays: tuple[np.ndarray, ...]) -> np.ndarray:
    """One level down."""
    feature, cut, left, _ = arrays
    return left[node] + (bins[np.arange(len(node)), feature[node]] > cut[node])


class Growth:
    """A booster under way. ``frontier`` holds the nodes whose sums are needed next."""

    def __init__(self, settings: Settings, width: int, prior: float):
        self.settings, self.width, self.prior = settings, width, prior
        self.trees: list[Tree] = []
        self.still = False
        self.start()

    def start(self) -> None:
        self.tree, self.level = Tree(), 0
        self.parents, self.rows = [-1], [math.inf]
        self.features = chosen_features(self.settings, len(self.trees), self.width)
        self.frontier = [] if self.done else [0]

    @property
    def done(self) -> bool:
        return self.still or len(self.trees) >= self.settings.rounds

    def take(self, splits: tuple[np.ndarray, ...]) -> bool:
        """Split the frontier; True when that ended the tree, which then waits in ``trees``."""
        gain, feature, cut, left, total = splits
        settings, following = self.settings, []
        self.parents, self.rows = [], []
        if self.level == 0:
            self.fill(0, total[:, 0])
        for i, node in enumerate(self.frontier):
            if np.isfinite(gain[i]):
                first = self.tree.split(node, int(self.features[feature[i]]), int(cut[i]))
                for child, sums in ((first, left[:, i]), (first + 1, total[:, i] - left[:, i])):
                    self.fill(child, sums)
                    if sums[2] > 1:
                        following.append(child)
                        self.parents.append(i)
                        self.rows.append(sums[2])
        self.level += 1
        self.frontier = following if self.level < settings.depth else []
        if self.frontier:
            return False
        self.trees.append(self.tree)
        # A tree that changes no score would come again in every later round that sees the same rows and features.
        whole = settings.subsample >= 1 and len(self.features) == self.width
        self.still = whole and len(self.tree.left) == 1 and abs(self.tree.value[0]) < 1 / UNIT
        return True

    def sisters(self) -> tuple[list[int], list[tuple[int, int, int]]]:
        """Places in the frontier to add up, and (place, place of its sister, place of its parent) of those that follow from them.

        Of two sisters the one with fewer rows is added up; the other is what its parent has left.
        """
        ask, follow, at = [], [], 0
        while at < len(self.frontier):
            if at + 1 < len(self.frontier) and self.parents[at] == self.parents[at + 1]:
                few, many = (at, at + 1) if self.rows[at] <= self.rows[at + 1] else (at + 1, at)
                ask.append(few)
                follow.append((many, few, self.parents[at]))
                at += 2
            else:
                ask.append(at)
                at += 1
        return ask, follow

    def fill(self, node: int, sums: np.ndarray) -> None:
        self.tree.value[node] = self.settings.rate * leaf_value(sums[0], sums[1], self.settings)
        self.tree.cover[node] = float(sums[2])


def gradients(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the logistic loss, as whole numbers of 1/``UNIT``."""
    g, h = np.empty(len(y)), np.empty(len(y))
    # Blocks that stay in the processor's cache.
    for at in range(0, len(y), BLOCK_ROWS):
        own = slice(at, at + BLOCK_ROWS)
        p = np.clip(margin[own], -700, 700)
        np.negative(p, out=p)
        np.exp(p, out=p)
        p += 1
        np.divide(1, p, out=p)
        unit = weight[own] * UNIT
        np.rint((p - y[own]) * unit, out=g[own])
        np.rint(np.maximum(p * (1 - p), 1e-16) * unit, out=h[own])
    return g, h


@dataclass
class Pack:
    """Features whose bins a row has together are one code, so one pass adds up all of them. ``bins`` has the bin of each feature by code."""

    codes: np.ndarray
    features: list[int]
    bins: list[np.ndarray]

    def __post_init__(self) -> None:
        self.size = len(self.bins[0])


def alone(bins: np.ndarray, width: int) -> list[Pack]:
    """Every feature by itself. Bins are best stored by feature."""
    return [Pack(bins[:, f], [f], [np.arange(width)]) for f in range(bins.shape[1])]


def together(bins: np.ndarray, width: int, most: int) -> list[Pack]:
    """Features in packs of at most ``most`` codes that occur; each joins the first pack that has room."""
    kinds = [np.flatnonzero(np.bincount(bins[:, f], minlength=width)) for f in range(bins.shape[1])]
    packs: list[Pack] = []
    for f in sorted(range(bins.shape[1]), key=lambda f: -len(kinds[f])):
        for i, pack in enumerate(packs):
            joint = pack.codes.astype(np.int64) * width + bins[:, f]
            occur = np.flatnonzero(np.bincount(joint, minlength=pack.size * width))
            if len(occur) <= most:
                number = np.zeros(pack.size * width, np.uint16)
                number[occur] = np.arange(len(occur))
                packs[i] = Pack(number[joint], [*pack.features, f], [*(own[occur // width] for own in pack.bins), occur % width])
                break
        else:
            packs.append(Pack(bins[:, f], [f], [np.arange(width)]))
    return packs


def sums_by_bin(packs: list[Pack], slot: np.ndarray, slots: int, width: int, values: Sequence[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """(values + 1, slots, features, bins): sums of each value and counts over ``rows``, which have a slot each, best in order."""
    codes = [np.zeros((len(values) + 1, slots, pack.size)) for pack in packs]
    for at in range(0, len(rows), BLOCK_ROWS):
        part, own = rows[at : at + BLOCK_ROWS], slot[at : at + BLOCK_ROWS]
        low, high = own.min(), own.max() + 1
        weights = [*(v[part] for v in values), None]
        own = own - low
        for pack, sums in zip(packs, codes):
            place = np.take(pack.codes, part).astype(np.int64)
            if high - low > 1:
                place += own * pack.size
            for total, weight in zip(sums, weights):
                total[low:high] += np.bincount(place, weight, (high - low) * pack.size).reshape(-1, pack.size)
    out, at, first = np.empty((len(values) + 1, slots, sum(len(p.features) for p in packs), width)), 0, np.arange(slots)[:, None] * width
    for pack, sums in zip(packs, codes):
        for bins in pack.bins:
            for total, part in zip(out, sums):
                # Whole numbers, so any order of adding up is exact.
                total[:, at] = part if pack.size == width and len(pack.bins) == 1 else np.bincount(
                    (first + bins).ravel(), part.ravel(), slots * width).reshape(slots, width)
            at += 1
    return out


def grow_here(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, hashes: np.ndarray, settings: Settings, prior: float) -> Growth:
    """All rounds of one job over rows that are all here. The rows of each node are a list, and split with it."""
    growth = Growth(settings, bins.shape[1], prior)
    width = int(bins.max(initial=0)) + 1
    bins = np.asfortranarray(bins)
    few, many = together(bins, width, max(width, FEW_CODES)), together(bins, width, MANY_CODES) if len(y) >= CODE_ROWS else []
    margin, every = np.full(len(y), prior), np.arange(len(y))
    while not growth.done:
        turn, tree = len(growth.trees), growth.tree
        use = every if settings.subsample >= 1 else np.flatnonzero(sampled(hashes, settings, turn))
        g, h = gradients(margin, y, weight)
        members, above = {0: use}, None
        chosen = set(growth.features.tolist())
        packs = [[p for p in some if chosen.intersection(p.features)] for some in (few, many)]
        places = [[order.index(f) for f in growth.features.tolist()] for order in ([f for p in some for f in p.features] for some in packs if some)]
        while True:
            frontier, (ask, follow) = growth.frontier, growth.sisters()
            sizes = [len(members[frontier[i]]) for i in ask]
            wide = int(bool(many) and sum(sizes) >= CODE_ROWS * len(ask))
            rows = np.concatenate([members[frontier[i]] for i in ask])
            own = sums_by_bin(packs[wide], np.repeat(np.arange(len(ask)), sizes), len(ask), width, (g, h), rows)[:, :, places[wide]]
            if follow:
                sums = np.empty((3, len(frontier), len(growth.features), width))
                sums[:, ask] = own
                larger, smaller, parent = map(list, zip(*follow))
                # Whole numbers, so nothing is lost in a difference.
                sums[:, larger] = above[:, parent] - sums[:, smaller]
            else:
                sums = own
            above, ended = sums, growth.take(best_splits(sums, settings))
            for node in frontier:
                deal_rows(bins, tree, node, members)
            if ended:
                break
        parts = [members]
        if len(use) < len(y):
            # Rows that were not drawn follow the splits.
            rest = np.ones(len(y), bool)
            rest[use] = False
            parts.append({0: np.flatnonzero(rest)})
            for node in range(len(tree.left)):
                deal_rows(bins, tree, node, parts[1])
        for part in parts:
            for node, rows in part.items():
                margin[rows] += tree.value[node]
        growth.start()
    return growth


def deal_rows(bins: np.ndarray, tree: Tree, node: int, members: dict[int, np.ndarray]) -> None:
    """The rows of a split node go to its children."""
    if tree.left[node] != node:
        rows = members.pop(node)
        right = bins[:, tree.feature[node]][rows] > tree.cut[node]
        members[tree.left[node]], members[tree.left[node] + 1] = rows[np.flatnonzero(~right)], rows[np.flatnonzero(right)]


class Ensemble:
    """Flat trees and the limits of the bins: scores whole batches."""

    def __init__(self, prior: float, edges: list[np.ndarray], parts: dict[str, np.ndarray]):
        self.prior, self.edges, self.parts = prior, edges, parts

    @classmethod
    def of(cls, growth: Growth, edges: list[np.ndarray]) -> Ensemble:
        trees = growth.trees
        first = np.cumsum([0, *[len(t.left) for t in trees]])
        join = lambda name, kind: np.concatenate([np.array(getattr(t, name), kind) for t in trees]) if trees else np.empty(0, kind)
        left = join("left", np.int32) + np.repeat(first[:-1], np.diff(first)).astype(np.int32)
        return cls(growth.prior, edges, {
            "first": first.astype(np.int32), "feature": join("feature", np.int16), "cut": join("cut", np.uint8), "left": left,
            "value": join("value", np.float64), "cover": join("cover", np.float32)})

    def bins(self, x: np.ndarray) -> np.ndarray:
        return binned(x, self.edges)

    def margins(self, x: np.ndarray) -> np.ndarray:
        first = self.parts["first"].tolist()
        out = np.full(len(x), self.prior)
        feature, cut, left, value = (self.parts[n] for n in ("feature", "cut", "left", "value"))
        for at in range(0, len(x), SCORE_ROWS):
            bins = self.bins(x[at : at + SCORE_ROWS])
            flat, start, total = bins.ravel(), np.arange(len(bins)) * bins.shape[1], out[at : at + SCORE_ROWS]
            # Tree by tree, as while fitting, so that both sum in one order.
            for low, high in zip(first, first[1:]):
                own, limit, child = feature[low:high].astype(np.int64), cut[low:high], left[low:high].astype(np.int64) - low
                node = np.zeros(len(bins), np.int64)
                while True:
                    lower = np.take(child, node)
                    lower += np.take(flat, np.take(own, node) + start) > np.take(limit, node)
                    if np.array_equal(lower, node):
                        break
                    node = lower
                total += np.take(value[low:high], node)
        return out

    def pack(self) -> str:
        out = io.BytesIO()
        limits = np.concatenate([*self.edges, np.empty(0)])
        np.savez_compressed(out, prior=self.prior, limits=limits, sizes=np.array([len(e) for e in self.edges]), **self.parts)
        return base64.b64encode(out.getvalue()).decode()

    @staticmethod
    @lru_cache(maxsize=4)
    def unpack(packed: str) -> Ensemble:
        with np.load(io.BytesIO(base64.b64decode(packed))) as data:
            edges = np.split(data["limits"], np.cumsum(data["sizes"])[:-1]) if len(data["sizes"]) else []
            return Ensemble(float(data["prior"]), edges, {n: data[n] for n in ("first", "feature", "cut", "left", "value", "cover")})


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of values; a value on a limit belongs below it, NaN to the last bin."""
    out = np.zeros(x.shape, np.uint8)
    for i, limits in enumerate(edges):
        out[:, i] = np.searchsorted(limits, x[:, i], side="left")
    return out


class BoosterModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` (of both classes) to rows with a feature vector."""

    packed = Param(MLParams._dummy(), "packed", "the ensemble, packed as text", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, packed: str | None = None, featuresCol: str = "features") -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def ensemble(self) -> Ensemble:
        return Ensemble.unpack(self.getOrDefault(self.packed))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        packed = self.getOrDefault(self.packed)
        share_package(dataset.sparkSession)

        @F.pandas_udf("double")
        def chance(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series(np.empty(0))
            margins = Ensemble.unpack(packed).margins(np.stack(features.to_numpy()))
            return pd.Series(1 / (1 + np.exp(-np.clip(margins, -700, 700))))

        p = chance(vector_to_array(F.col(self.getFeaturesCol())))
        return dataset.withColumn("probability", array_to_vector(F.array(1 - p, p)))


class Booster(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter):
    """One booster as a pipeline stage; ``fit_all`` fits many together."""

    def __init__(self, settings: Settings | None = None, labelCol: str = "label", featuresCol: str = "features") -> None:
        super().__init__()
        self.settings = settings or Settings(100, 3, 0.1)
        self._set(maxIter=self.settings.rounds, labelCol=labelCol, featuresCol=featuresCol)

    def _fit(self, dataset: DataFrame) -> BoosterModel:
        return fit_all([dataset], [Job(0, self.settings)], self.getLabelCol(), self.getFeaturesCol())[0]


def fit_all(tables: Sequence[DataFrame], jobs: Sequence[Job], label: str = "label", features: str = "features") -> list[BoosterModel]:
    """Fit each job on its table (a 0/1 label and a feature vector), all of them together.

    Rows without a label or features are left out; a table without rows is an error, one with a single class gives
    a constant. Equal rows are sampled together, as samples go by a hash of the row.
    """
    share_package(tables[0].sparkSession)
    both = None
    for tag, table in enumerate(tables):
        rows = table.select(F.lit(tag).alias("tag"), F.col(label).cast("double").alias("y"),
                            vector_to_array(F.col(features)).alias("x")).filter("y IS NOT NULL AND x IS NOT NULL")
        both = rows if both is None else both.unionByName(rows)
    facts = {r["tag"]: r for r in both.groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("share"), F.max(F.size("x")).alias("width")).collect()}
    if len(facts) < len(tables):
        raise ValueError("no labelled rows to fit")
    edges = bin_limits(both, facts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, lists = batch.column("tag").to_numpy(), batch.column("x")
            cells = [None] * batch.num_rows
            values, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for tag in np.unique(tags):
                at = np.flatnonzero(tags == tag)
                x = np.stack([values[offsets[i] : offsets[i + 1]] for i in at])
                for i, row in zip(at, binned(x, edges[tag])):
                    cells[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("tag"), batch.column("y"), batch.column("hash"), pa.array(cells, pa.binary())],
                                             names=["tag", "y", "hash", "bins"])

    rows = materialize(both.withColumn("hash", F.xxhash64("x", "y")).mapInArrow(place, "tag int, y double, hash long, bins binary"), "bins")
    priors = {t: math.log(max(r["share"], 1e-12) / max(1 - r["share"], 1e-12)) for t, r in facts.items()}
    # A class of its own has no gradient to follow.
    flat = {t for t, r in facts.items() if r["share"] in (0.0, 1.0)}
    small = {t for t, r in facts.items() if r["n"] <= LOCAL_ROWS and t not in flat}
    done: dict[int, Ensemble] = {}
    for i, job in enumerate(jobs):
        if job.table in flat:
            done[i] = Ensemble.of(Growth(Settings(0, 1, 0.0), len(edges[job.table]), priors[job.table]), edges[job.table])
    done |= fit_in_tasks(rows, {i: j for i, j in enumerate(jobs) if j.table in small}, priors, edges)
    done |= fit_by_levels(rows, {i: j for i, j in enumerate(jobs) if j.table not in small and j.table not in flat}, priors, edges)
    return [BoosterModel(packed=done[i].pack(), featuresCol=features) for i in range(len(jobs))]


def bin_limits(rows: DataFrame, facts: dict) -> dict[int, list[np.ndarray]]:
    """Limits between the bins of each table and feature, from quantiles; at most ``MAX_BINS - 1``."""
    probs = [i / (MAX_BINS - 1) for i in range(MAX_BINS - 1)]
    cells = rows.select("tag", F.posexplode("x").alias("i", "value"))
    limits = {(r["tag"], r["i"]): r for r in cells.groupBy("tag", "i").agg(
        F.percentile_approx("value", probs, 10_000).alias("q"), F.max("value").alias("top")).collect()}
    out = {}
    for tag, fact in facts.items():
        own = [limits[tag, i] for i in range(fact["width"])]
        # Nothing lies beyond the largest value.
        out[tag] = [np.unique(np.array([q for q in r["q"] if q < r["top"]], float)) for r in own]
    return out


def fit_in_tasks(rows: DataFrame, jobs: dict[int, Job], priors: dict, edges: dict) -> dict[int, Ensemble]:
    """Jobs on small tables, each in a task of its own."""
    if not jobs:
        return {}
    # Tasks start in their order, and the longest must not start last.
    order = sorted(jobs, key=lambda i: -jobs[i].settings.rounds * jobs[i].settings.depth)
    by_table: dict[int, list[int]] = {}
    for unit, i in enumerate(order):
        by_table.setdefault(jobs[i].table, []).append(unit)
    who = F.create_map(*[F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for tv in by_table.items() for v in tv])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tag, own, bins in by_tag(batch):
                blobs = [own.column(c).to_numpy().tobytes() for c in ("y", "hash")]
                yield pa.RecordBatch.from_arrays([pa.array([tag], pa.int32()), *[pa.array([b], pa.binary()) for b in (*blobs, bins.tobytes())]],
                                                 names=["tag", "y", "hash", "bins"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                parts.setdefault(row["unit"], []).append((row["y"], row["hash"], row["bins"]))
        for unit, blobs in parts.items():
            job = jobs[order[unit]]
            y, hashes, bins = (np.frombuffer(b"".join(part), kind) for part, kind in zip(zip(*blobs), (np.float64, np.uint64, np.uint8)))
            blobs.clear()
            growth = grow_here(bins.reshape(len(y), -1), y, np.ones(len(y)), hashes, job.settings, priors[job.table])
            yield pa.RecordBatch.from_arrays([pa.array([order[unit]], pa.int32()), pa.array([Ensemble.of(growth, edges[job.table]).pack()])],
                                             names=["job", "packed"])

    blocks = rows.filter(F.col("tag").isin(list(by_table))).mapInArrow(block, "tag int, y binary, hash binary, bins binary")
    copies = blocks.select(F.explode(F.element_at(who, F.col("tag"))).alias("unit"), "y", "hash", "bins")
    fitted = copies.repartitionById(len(jobs), "unit").mapInArrow(fit, "job int, packed string")
    return {r["job"]: Ensemble.unpack(r["packed"]) for r in fitted.collect()}


def fit_by_levels(rows: DataFrame, jobs: dict[int, Job], priors: dict, edges: dict) -> dict[int, Ensemble]:
    """Jobs on large tables, level by level over all their rows."""
    growing = {i: Growth(j.settings, len(edges[j.table]), priors[j.table]) for i, j in jobs.items()}
    rows = rows.filter(F.col("tag").isin(sorted({j.table for j in jobs.values()}))).withColumn("margins", F.lit(None).cast("binary"))
    stored = dict.fromkeys(jobs, 0)
    found: dict[int, list] = {i: [] for i in jobs}
    while any(not g.done for g in growing.values()):
        plan, cells = [], 0
        for i, growth in growing.items():
            size = len(growth.features) * MAX_BINS
            waiting = [] if growth.done else growth.frontier[len(found[i]) :]
            count = min(len(waiting), (MAX_CELLS - cells) // size if plan else max(1, (MAX_CELLS - cells) // size))
            if count > 0:
                plan.append((i, waiting[:count]))
                cells += count * size
        splits = level_splits(rows, jobs, growing, stored, plan)
        for i, nodes in plan:
            found[i] += [splits[i, n] for n in nodes]
            growth = growing[i]
            if len(found[i]) == len(growth.frontier):
                parts = [np.array(c) for c in zip(*found[i])]
                parts[3], parts[4] = parts[3].T, parts[4].T
                found[i] = []
                if growth.take(tuple(parts)):
                    growth.start()
        if any(len(g.trees) - stored[i] >= STORE_ROUNDS and not g.done for i, g in growing.items()):
            rows = store_margins(rows, jobs, growing, stored)
            stored = {i: len(g.trees) for i, g in growing.items()}
    return {i: Ensemble.of(g, edges[jobs[i].table]) for i, g in growing.items()}


def margins_of(i: int, order: dict, bins: np.ndarray, kept: pa.Array, trees: list[tuple], prior: float) -> np.ndarray:
    """Scores of a job after its stored trees and those given."""
    if kept[0].as_py() is None:
        margin = np.full(len(bins), prior)
    else:
        margin = np.frombuffer(b"".join(kept.to_pylist())).reshape(len(bins), -1)[:, order[i]].copy()
    for arrays in trees:
        margin += arrays[3][settled(bins, arrays)]
    return margin


def settled(bins: np.ndarray, arrays: tuple[np.ndarray, ...]) -> np.ndarray:
    node = np.zeros(len(bins), np.int64)
    while True:
        lower = step(bins, node, arrays)
        if (lower == node).all():
            return node
        node = lower


def places(jobs: dict[int, Job]) -> dict[int, int]:
    """Where each job's score stands among those of its table."""
    seen: dict[int, int] = {}
    out = {}
    for i, job in jobs.items():
        out[i] = seen.get(job.table, 0)
        seen[job.table] = out[i] + 1
    return out


def by_tag(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Rows of each table in a batch, with their bins as a matrix."""
    tags = batch.column("tag").to_numpy()
    for tag in np.unique(tags):
        own = batch.filter(pa.array(tags == tag))
        yield int(tag), own, np.frombuffer(b"".join(own.column("bins").to_pylist()), np.uint8).reshape(own.num_rows, -1)


def store_margins(rows: DataFrame, jobs: dict, growing: dict, stored: dict) -> DataFrame:
    """The rows with the scores of all trees so far."""
    fresh = {i: [t.arrays() for t in g.trees[stored[i] :]] for i, g in growing.items()}
    priors, order = {i: g.prior for i, g in growing.items()}, places(jobs)
    shared = rows.sparkSession.sparkContext.broadcast(fresh)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tag, own, bins in by_tag(batch):
                mine = [i for i, j in jobs.items() if j.table == tag]
                scores = np.column_stack([margins_of(i, order, bins, own.column("margins"), shared.value[i], priors[i]) for i in mine])
                yield pa.RecordBatch.from_arrays(
                    [*[own.column(c) for c in ("tag", "y", "hash", "bins")], pa.array([r.tobytes() for r in scores], pa.binary())],
                    names=["tag", "y", "hash", "bins", "margins"])

    return materialize(rows.mapInArrow(add, rows.schema), "margins")


def level_splits(rows: DataFrame, jobs: dict, growing: dict, stored: dict, plan: list[tuple[int, list[int]]]) -> dict:
    """(job, node) -> best split of the nodes in ``plan``, from one aggregate over the rows."""
    work = {}
    for i, nodes in plan:
        g = growing[i]
        work[i] = {"trees": [t.arrays() for t in g.trees[stored[i] :]], "tree": g.tree.arrays(), "nodes": nodes, "turn": len(g.trees),
                   "features": g.features, "prior": g.prior}
    order = places(jobs)
    shared = rows.sparkSession.sparkContext.broadcast(work)
    settings = {i: j.settings for i, j in jobs.items()}

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for tag, own, bins in by_tag(batch):
                y, hashes = own.column("y").to_numpy(), own.column("hash").to_numpy().view(np.uint64)
                for i, w in shared.value.items():
                    if jobs[i].table != tag:
                        continue
                    margin = margins_of(i, order, bins, own.column("margins"), w["trees"], w["prior"])
                    g, h = gradients(margin, y, np.ones(len(y)))
                    slot = np.full(len(w["tree"][2]), -1)
                    slot[w["nodes"]] = np.arange(len(w["nodes"]))
                    at = np.where(sampled(hashes, settings[i], w["turn"]), slot[settled(bins, w["tree"])], -1)
                    use = np.flatnonzero(at >= 0)
                    part = sums_by_bin(alone(bins[:, w["features"]], MAX_BINS), at[use], len(w["nodes"]), MAX_BINS, (g, h), use)
                    sums[i] = part if i not in sums else sums[i] + part
        for i, part in sums.items():
            slot, feature, cell = np.nonzero(part[2])
            nodes = np.array(shared.value[i]["nodes"])
            columns = [np.full(len(slot), i), nodes[slot], feature, cell, *part[:, slot, feature, cell]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["job", "node", "feature", "bin", "g", "h", "n"])

    cells = rows.mapInArrow(add_up, "job long, node long, feature long, bin long, g long, h long, n long")
    total = cells.groupBy("job", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        i, node = int(group["job"].iloc[0]), int(group["node"].iloc[0])
        sums = np.zeros((3, 1, int(group["feature"].max()) + 1, MAX_BINS))
        for k, name in enumerate(("g", "h", "n")):
            sums[k, 0, group["feature"], group["bin"]] = group[name]
        gain, feature, cut, left, whole = best_splits(sums, settings[i])
        return pd.DataFrame({"job": [i], "node": [node], "gain": gain, "feature": feature, "cut": cut,
                             "left": [left[:, 0].tolist()], "whole": [whole[:, 0].tolist()]})

    best = total.groupBy("job", "node").applyInPandas(
        choose, "job long, node long, gain double, feature long, cut long, left array<double>, whole array<double>")
    out = {(r["job"], r["node"]): (r["gain"], r["feature"], r["cut"], np.array(r["left"]), np.array(r["whole"])) for r in best.collect()}
    # A root none of whose rows was sampled has no sums.
    empty = (-math.inf, 0, 0, np.zeros(3), np.zeros(3))
    return {(i, n): out.get((i, n), empty) for i, nodes in plan for n in nodes}

