"""Hard negatives from an STR-packed R-tree of integer vectors.

Rows are packed sort-tile-recursively: slabs along the coordinate of the largest variance, each cut
along the next one, into tiles of about ``TILE`` rows; a tile's task goes on inside it, down to leaves.
Every node has the bounds of its rows coordinate by coordinate, and so for an anchor an interval
that holds all inner products below it. A queue takes the node with the highest bound first, and
drops nodes outside the windows of scores asked for or strictly below a kth score already found.

An anchor first searches the tile it lies in; the kth score found there prunes all other tiles. Then its
positives give windows of scores, and its negatives are searched in them. Scores are integers, so
equal scores are equal in every task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm.common import block_by, cut_points, joined_rows, matrix_of, usable_vectors
from cohortlens.session import materialize

POSITIVES, NEGATIVES = 5, 5
#: Window of a negative's score, in percent of the positive's.
LOW, HIGH = 80, 100
SCALE = 256
TILE, LEAF, FAN = 1 << 14, 128, 16
#: Anchors that meet a tile in one task, about.
ANCHORS = 1 << 13
#: Coordinates that order the rows inside a tile.
INNER_AXES = 3
FOUND = "anchor_id long, slot long, other_id long, score long"


class Wanted(NamedTuple):
    """Scores from ``low`` to ``high``, of which those of a ``slot`` are kept apart."""

    slot: int
    low: float
    high: float


class RTree:
    """Packed boxes over the rows of one tile; ``kind`` is a type in which all products are exact."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        order = packed_order(x)
        self.x, self.ids, self.labels = np.ascontiguousarray(x[order]), ids[order], labels[order]
        starts = np.arange(0, len(x), LEAF)
        low, high = np.minimum.reduceat(self.x, starts), np.maximum.reduceat(self.x, starts)
        self.leaves = len(starts)
        lows, highs, self.below = [low], [high], [range(0)] * len(starts)
        first = 0
        while len(low) > 1:
            starts = np.arange(0, len(low), FAN)
            self.below += [range(first + s, first + min(s + FAN, len(low))) for s in starts.tolist()]
            first += len(low)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            lows.append(low)
            highs.append(high)
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each anchor with each node's box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def search(self, anchor: np.ndarray, own: int, label: int, same: bool, k: int, wanted: list[Wanted],
               least: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(slot, scores, ids) of the k best rows of each window: of the anchor's label or of others, never itself."""
        best = {w: (np.empty(0, self.x.dtype), np.empty(0, np.int64)) for w in wanted}
        floor = {w: w.low for w in wanted}
        need, ceiling = min(floor.values()), max(w.high for w in wanted)
        root = len(self.below) - 1
        queue = [(-most[root], root)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < need:
                break
            if least[node] > ceiling:
                continue
            if node >= self.leaves:
                for child in self.below[node]:
                    if most[child] >= need and least[child] <= ceiling:
                        heapq.heappush(queue, (-most[child], child))
                continue
            rows = slice(node * LEAF, node * LEAF + LEAF)
            score = self.x[rows] @ anchor
            near = np.flatnonzero((score >= need) & (score <= ceiling) & ((self.labels[rows] == label) == same) & (self.ids[rows] != own))
            if not len(near):
                continue
            score, ids = score[near], self.ids[rows][near]
            for w in wanted:
                fits = (score >= floor[w]) & (score <= w.high)
                if fits.any():
                    scores, found = np.concatenate([best[w][0], score[fits]]), np.concatenate([best[w][1], ids[fits]])
                    order = np.lexsort((found, -scores))[:k]
                    best[w] = scores[order], found[order]
                    if len(order) == k:
                        floor[w] = max(w.low, scores[order[-1]])
            need = min(floor.values())
        for w, (scores, found) in best.items():
            yield w.slot, scores, found


def packed_order(x: np.ndarray) -> np.ndarray:
    """Rows sorted tile by tile along the coordinates of the largest variance."""
    axes = np.argsort(-x.astype(float).var(axis=0), kind="stable")[:INNER_AXES]

    def cut(rows: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
        rows = rows[np.argsort(x[rows, left[0]], kind="stable")]
        leaves = math.ceil(len(rows) / LEAF)
        if len(left) == 1 or leaves <= 1:
            return [rows]
        slabs = math.ceil(leaves ** (1 / len(left)))
        size = math.ceil(leaves / slabs) * LEAF
        return [part for at in range(0, len(rows), size) for part in cut(rows[at : at + size], left[1:])]

    return np.concatenate(cut(np.arange(len(x)), axes)) if len(axes) else np.arange(len(x))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Each component times ``scale``, rounded down."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def moments(rows: DataFrame, width: int) -> list[int]:
    """Coordinates by descending variance."""
    schema = "axis int, n double, s double, ss double"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            x = matrix_of(batch.column(0), width, "f8")
            n, s, ss = n + len(x), s + x.sum(axis=0), ss + (x**2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, float(n))), pa.array(s),
                                          pa.array(ss)], names=["axis", "n", "s", "ss"])

    total = rows.select("v").mapInArrow(sums, schema).groupBy("axis").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    spread = F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    return [r["axis"] for r in total.orderBy(F.desc(spread), "axis").collect()]


def tiled(rows: DataFrame, n: int, width: int) -> tuple[DataFrame, int]:
    """Rows with the tile they lie in, and how many tiles there are."""
    tiles = math.ceil(n / TILE)
    if tiles <= 1 or not width:
        return rows.withColumn("tile", F.lit(0)), 1
    axes = moments(rows.filter("searched"), width)[:2]
    slabs = math.ceil(math.sqrt(tiles)) if len(axes) > 1 else tiles
    rest = math.ceil(tiles / slabs)
    # A fraction by id parts rows of equal value, so that a crowded value takes several tiles.
    along = lambda axis: F.coalesce(F.get("v", F.lit(axis)), F.lit(0)) + F.pmod(F.xxhash64("id", F.lit(axis)), F.lit(1 << 20)) / (1 << 20)
    rows = rows.withColumn("y", along(axes[0]))
    first = rows.filter("searched").agg(F.percentile_approx("y", cut_points(slabs), 100 * slabs)).first()[0] if slabs > 1 else []
    rows = rows.withColumn("slab", block_by(first or [])("y"))
    if rest == 1:
        return rows.withColumn("tile", F.col("slab")).drop("slab", "y"), slabs
    rows = rows.withColumn("y", along(axes[1]))
    limits = {r["slab"]: np.array(r["e"]) for r in rows.filter("searched").groupBy("slab").agg(
        F.percentile_approx("y", cut_points(rest), 100 * rest).alias("e")).collect()}

    @F.pandas_udf("int")
    def tile(slab: pd.Series, y: pd.Series) -> pd.Series:
        out = slab.to_numpy() * rest
        for s in np.unique(slab):
            own = slab.to_numpy() == s
            out[own] += np.searchsorted(limits[s], y.to_numpy()[own], side="right")
        return pd.Series(out.astype(np.int32))

    return rows.withColumn("tile", tile("slab", "y")).drop("slab", "y"), slabs * rest


def meet(rows: DataFrame, anchors: DataFrame, tiles: int, parts: int, width: int, kind: str, same: bool, k: int,
         wanted: Callable[[dict], list[Wanted]]) -> DataFrame:
    """(anchor_id, slot, other_id, score) of the k best rows in each window of each anchor, tile by tile."""

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(one) and len(two):
            tree = RTree(joined_rows(one["x"], width, "<i8").astype(kind), one["id"].to_numpy(), one["label"].to_numpy())
            points = joined_rows(two["x"], width, "<i8").astype(kind)
            least, most = tree.intervals(points)
            for i, row in enumerate(two.drop(columns="x").to_dict("records")):
                windows = wanted(row)
                if windows:
                    for slot, scores, found in tree.search(points[i], row["id"], row["label"], same, k, windows, least[i], most[i]):
                        out.append((np.full(len(found), row["id"]), np.full(len(found), slot), found, scores.astype(np.int64)))
        names = ["anchor_id", "slot", "other_id", "score"]
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*out))} if out else {n: np.empty(0, np.int64) for n in names})

    keys = ["tile", "part"]
    left = rows.select(*[F.col(c).alias(c) for c in ("id", "label", "x", "tile")]).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = anchors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    tasks = tiles * parts
    return left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(run, FOUND)


def mine(rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchors`` names.

    A row's score is its inner product with the anchor, of components times ``scale`` rounded down. An anchor's positives
    are its first ``positives`` other rows of its label; each has the first ``negatives`` rows of other labels
    with a score from ``low`` to ``high`` percent of its own. Higher scores come first, ties by the smaller id; with
    fewer rows all are returned, and a positive without any gives none, as does an empty table.

    Rows without an id, label or vector, or with a null, NaN or infinite component, take no part; of rows that repeat an
    id, the one with the least label and then vector counts. Shorter vectors count as filled with zeros. Equal vectors of one
    label beyond the first that could be returned are not searched. Products past 64 bits raise an error. Other columns
    are not read.
    """
    spark = rows.sparkSession
    alive = usable_vectors(rows.filter(F.col(f"`{label}`").isNotNull()), key, vector, label=F.col(f"`{label}`").cast("long"),
                           anchor=F.coalesce(anchors, F.lit(False)))
    whole = alive.withColumn("v", quantised(F.col("v"), scale))
    equal = Window.partitionBy("v", "label").orderBy("id")
    searched = whole.withColumn("nth", F.row_number().over(equal)).filter(F.col("nth") <= max(positives, negatives) + 1).drop("nth")
    both = materialize(searched.withColumn("searched", F.lit(True)).unionByName(
        whole.filter("anchor").withColumn("searched", F.lit(False))), "vectors")
    reach = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    facts = both.agg(F.max(F.size("v")).alias("width"), F.max(reach).alias("reach"), F.count_if("searched").alias("n"),
                     F.count_if(~F.col("searched")).alias("anchors")).first()
    if not facts["n"] or not facts["anchors"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(1, facts["width"])
    largest = width * (facts["reach"] or 0.0) ** 2 * max(100, low, high)
    if largest >= 2**63:
        raise ValueError("inner products of these components do not fit 64 bits; scale them down")
    kind = "f8" if largest < 2**53 else "i8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column("v"), width, "<i8")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "label", "searched", "tile")],
                                              pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "label", "searched", "tile", "x"])

    cut, tiles = tiled(both, facts["n"], width)
    packed = materialize(cut.select("id", "label", "searched", "tile", "v").mapInArrow(
        pack, "id long, label long, searched boolean, tile int, x binary"), "tiles")
    own, asked = packed.filter("searched"), packed.filter("NOT searched").select("id", "label", "x", "tile")
    parts = max(1, math.ceil(facts["anchors"] / ANCHORS))
    every = F.sequence(F.lit(0), F.lit(tiles - 1))
    by_anchor = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    search = lambda who, same, k, wanted: meet(own, who, tiles, parts, width, kind, same, k, wanted)

    open_ended = lambda row: [Wanted(0, row["floor"], math.inf)]
    none_yet = F.lit(-math.inf).alias("floor")
    found = search(asked.select("*", none_yet), True, positives, open_ended)
    if tiles > 1:
        home = materialize(found, "home")
        floors = home.groupBy("anchor_id").agg(F.when(F.count(F.lit(1)) >= positives, F.min("score").cast("double")).alias("floor"))
        others = asked.join(floors.withColumnRenamed("anchor_id", "id"), "id", "left").withColumn("floor", F.coalesce("floor", none_yet))
        others = others.withColumn("tile", F.explode(F.array_remove(every, F.col("tile"))))
        found = home.unionByName(search(others.select("id", "label", "x", "tile", "floor"), True, positives, open_ended))
    good = materialize(found.withColumn("nth", F.row_number().over(by_anchor)).filter(F.col("nth") <= positives), "positives")

    per_anchor = good.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("other_id", "score")).alias("good"))
    seekers = asked.drop("tile").join(per_anchor, "id").withColumn("tile", F.explode(every))

    def between(row: dict) -> list[Wanted]:
        spans = [Wanted(int(g["other_id"]), -(-low * int(g["score"]) // 100), high * int(g["score"]) // 100) for g in row["good"]]
        return [w for w in spans if w.low <= w.high]

    hard = search(seekers, False, negatives, between)
    by_positive = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "other_id")
    ranked = hard.withColumn("rank", F.row_number().over(by_positive)).filter(F.col("rank") <= negatives)
    scores = good.select("anchor_id", F.col("other_id").alias("slot"), F.col("score").alias("positive_score"))
    return ranked.join(scores, ["anchor_id", "slot"]).select(
        "anchor_id", F.col("slot").alias("positive_id"), "rank", F.col("other_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
