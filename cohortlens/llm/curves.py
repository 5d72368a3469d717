"""Nearest neighbours by inner product along shifted space-filling curves.

Vectors get one more number, so that the largest inner product is the least distance, and are
projected at random onto ``AXES`` axes, once for each curve, each time with another shift of the
grid. The Hilbert curve of a grid gives every row a key; keys are range-partitioned into blocks of
about ``BLOCK`` rows. A query looks at the rows of its own key's block and of ``reach`` blocks on both
sides on each curve; these windows are ranked by exact inner products and merged.

How many curves and how wide is measured rather than guessed: for at most ``SAMPLE`` queries the
true neighbours are found by comparing all rows, and the cheapest choice that holds ``TARGET`` of
them is taken. Where a curve of any number of axes cannot keep neighbours together, as with
vectors without any structure, that choice is a window as wide as the table, and the search is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.llm.common import block_by, cut_points, joined_rows, matrix_of, scramble, usable_vectors
from cohortlens.session import materialize

K = 20
CURVES, AXES, AXIS_BITS = 4, 8, 6
#: Low bits of a key that part rows of one cell, so that a crowded cell takes several blocks.
APART_BITS = 15
BLOCK = 1 << 14
#: Queries that meet one block in one task, about; more are dealt over several.
QUERY_BLOCK = 1 << 14
#: Rows that fit centre and scale, queries that fit the windows, and the share of their neighbours to be found.
FIT_ROWS, SAMPLE, TARGET = 4096, 256, 0.98
#: Queries multiplied with a block at a time, and the relative error allowed to such a product before it is made exact.
STEP, SLACK = 256, 1e-12


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of grid cells (n, axes), by the transposed form of its bits."""
    x = [c.astype(np.uint64) for c in cells.T]
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(len(x)):
            upper = (x[i] & np.uint64(q)) != 0
            swap = np.where(upper, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(upper, low, swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    key = np.zeros(len(cells), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << np.uint64(1) | (axis ^ flip) >> np.uint64(bit) & np.uint64(1)
    return key


class Curves:
    """Random projections and shifts, fitted to where the vectors lie."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 20240611):
        random = np.random.default_rng(seed)
        self.longest = longest
        points = self.lifted(sample)
        width = points.shape[1]
        axes = min(AXES, width)
        self.centre = points.mean(axis=0)
        self.maps, self.spans, self.shifts = [], [], []
        for _ in range(CURVES):
            turn = np.linalg.qr(random.normal(size=(width, axes)))[0]
            spread = ((points - self.centre) @ turn).std(axis=0)
            self.maps.append(turn)
            self.spans.append(np.where(spread > 0, 8 * spread, 1.0))
            self.shifts.append(random.random(axes) / 4)

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        """With a last number that makes all rows as long as the longest."""
        rest = np.maximum(self.longest**2 - (rows**2).sum(axis=1), 0)
        return np.column_stack([rows, np.sqrt(rest)])

    def asked(self, rows: np.ndarray) -> np.ndarray:
        """Queries at the length of the longest row, which leaves their order of neighbours as it is."""
        size = np.sqrt((rows**2).sum(axis=1))
        return np.column_stack([rows * (self.longest / np.where(size > 0, size, 1))[:, None], np.zeros(len(rows))])

    def keys(self, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """(n, CURVES) signed keys."""
        top = (1 << AXIS_BITS) - 1
        apart = scramble(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - APART_BITS)
        out = []
        for turn, span, shift in zip(self.maps, self.spans, self.shifts):
            grid = (((points - self.centre) @ turn) / span + 0.375 + shift) * (top + 1)
            out.append(hilbert(np.clip(grid, 0, top).astype(np.uint64), AXIS_BITS) << np.uint64(APART_BITS) | apart)
        return np.column_stack(out).view(np.int64)


class Reach(NamedTuple):
    """Curves that are searched, and blocks to either side."""

    curves: int
    blocks: int

    @staticmethod
    def least(apart: np.ndarray, total: int) -> Reach:
        """The cheapest that finds ``TARGET`` of the pairs; ``apart`` (pairs, curves) says how many blocks lie between."""
        best = (total, Reach(1, total - 1))
        for curves in range(1, apart.shape[1] + 1):
            need = np.sort(apart[:, :curves].min(axis=1))
            wide = int(need[min(len(need) - 1, math.ceil(TARGET * len(need)) - 1)]) if len(need) else 0
            cost = curves * min(2 * wide + 1, total)
            if cost < best[0]:
                best = (cost, Reach(curves, wide))
        return best[1]


def inner(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products pair by pair, summed from the first component to the last."""
    total = np.zeros(len(queries))
    for i in range(queries.shape[1]):
        total += queries[:, i] * rows[:, i]
    return total


def best_rows(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(place of query, place of row, score) of each query's k best rows other than its own, by score and id."""
    order = np.argsort(ids, kind="stable")
    sizes = np.sqrt((rows**2).sum(axis=1).max(initial=0)) * np.sqrt((queries**2).sum(axis=1))
    out = []
    for at in range(0, len(queries), STEP):
        part = queries[at : at + STEP]
        score = part @ rows.T
        own = np.searchsorted(ids, query_ids[at : at + STEP], sorter=order)
        hit = np.flatnonzero((own < len(ids)) & (ids[order[np.minimum(own, len(ids) - 1)]] == query_ids[at : at + STEP]))
        score[hit, order[own[hit]]] = -np.inf
        if score.shape[1] > k:
            kth = np.partition(score, -k, axis=1)[:, -k] - SLACK * part.shape[1] * sizes[at : at + STEP]
            which, place = np.nonzero(score >= kth[:, None])
        else:
            which, place = np.nonzero(np.isfinite(score))
        chosen = np.isfinite(score[which, place])
        which, place = which[chosen], place[chosen]
        exact = inner(part[which], rows[place])
        rank = np.lexsort((ids[place], -exact, which))
        which, place, exact = which[rank], place[rank], exact[rank]
        nth = np.arange(len(which)) - np.searchsorted(which, which)
        out.append((which[nth < k] + at, place[nth < k], exact[nth < k]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def search(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found with the largest inner product with each query, its own id left out.

    Rows and queries without an id or a vector, or with a null, infinite, NaN or only zero components, take
    no part; of rows that repeat an id, the one with the least vector counts. Of equal vectors, only the
    k + 1 smallest ids can be among the nearest, so only they are searched. Equal scores go to the smaller id; with fewer
    than k other rows all are returned; empty tables give no rows. Shorter vectors count as filled
    with zeros. Other columns are not read.
    """
    spark = rows.sparkSession
    alive = F.exists("v", lambda x: x != 0)
    found = usable_vectors(rows, key, vector).filter(alive)
    asked = usable_vectors(queries, key, vector).filter(alive).withColumn("asks", F.lit(True))
    equal = Window.partitionBy("v").orderBy("id")
    found = found.withColumn("nth", F.row_number().over(equal)).filter(F.col("nth") <= k + 1).drop("nth").withColumn("asks", F.lit(False))
    both = materialize(found.unionByName(asked), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = both.agg(F.max(F.size("v")).alias("width"), F.max(F.when(~F.col("asks"), square)).alias("square"),
                     F.count_if(~F.col("asks")).alias("n"), F.count_if("asks").alias("asked")).first()
    result = "query_id long, vec_id long, score double"
    if not facts["n"] or not facts["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, kind = facts["width"], "<f4" if "array<float>" in dict(both.dtypes)["v"] else "<f8"
    sample = both.filter("NOT asks").orderBy(F.xxhash64("id")).limit(FIT_ROWS).select("v").toArrow().column(0).combine_chunks()
    curves = Curves(matrix_of(sample, width, "f8"), math.sqrt(facts["square"]))

    def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column("v"), width, "f8")
                ids, asks = batch.column("id").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
                keys = curves.keys(np.where(asks[:, None], curves.asked(x), curves.lifted(x)), ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("asks"), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()),
                     *[pa.array(c) for c in keys.T]], names=["id", "asks", "x", *[f"key{c}" for c in range(CURVES)]])

    names = ", ".join(f"key{c} long" for c in range(CURVES))
    keyed = both.mapInArrow(with_keys, f"id long, asks boolean, x binary, {names}")
    blocks = math.ceil(facts["n"] / BLOCK)
    if blocks > 1:
        keyed = materialize(keyed, "keys")
        edges = keyed.filter("NOT asks").agg(*[
            F.percentile_approx(f"key{c}", cut_points(blocks), 100 * blocks).alias(f"e{c}") for c in range(CURVES)]).first()
        for c in range(CURVES):
            keyed = keyed.withColumn(f"key{c}", block_by(edges[f"e{c}"])(f"key{c}"))
        reach = measure(keyed, width, kind, k, blocks)
    else:
        keyed = keyed.withColumns({f"key{c}": F.lit(0) for c in range(CURVES)})
        reach = Reach(1, 0)

    parts = max(1, math.ceil(facts["asked"] * min(2 * reach.blocks + 1, blocks) / blocks / QUERY_BLOCK))
    where = F.explode(F.array(*[F.struct(F.lit(c).alias("curve"), F.col(f"key{c}").alias("block")) for c in range(reach.curves)]))
    placed = keyed.withColumn("at", where).select("id", "asks", "x", "at.curve", "at.block")
    # Windows count for a query's own place too; at the ends of a curve they are shorter.
    left = placed.filter("NOT asks").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    window = F.sequence(F.greatest(F.col("block") - reach.blocks, F.lit(0)), F.least(F.col("block") + reach.blocks, F.lit(blocks - 1)))
    right = placed.filter("asks").withColumn("block", F.explode(window)).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))

    def nearest(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        x, q = joined_rows(one["x"], width, kind).astype("f8"), joined_rows(two["x"], width, kind).astype("f8")
        ids, query_ids = one["id"].to_numpy(), two["id"].to_numpy()
        which, place, score = best_rows(q, query_ids, x, ids, k) if len(x) and len(q) else ([], [], [])
        return pd.DataFrame({"query_id": query_ids[which] if len(which) else [], "vec_id": ids[place] if len(place) else [], "score": score})

    meet = ["curve", "block", "part"]
    tasks = max(1, reach.curves * blocks * parts)
    near = left.repartition(tasks, *meet).groupBy(*meet).cogroup(right.repartition(tasks, *meet).groupBy(*meet)).applyInPandas(
        nearest, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if reach.curves > 1:
        near = near.distinct()
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def measure(keyed: DataFrame, width: int, kind: str, k: int, blocks: int) -> Reach:
    """The reach that finds ``TARGET`` of the true neighbours of at most ``SAMPLE`` queries, chosen by hash."""
    chosen = keyed.filter("asks").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    q, query_ids = joined_rows(chosen["x"], width, kind).astype("f8"), chosen["id"].to_numpy()
    sides = [f"key{c}" for c in range(CURVES)]
    own = chosen[sides].to_numpy()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            x = joined_rows(batch.column("x").to_pylist(), width, kind).astype("f8")
            ids = batch.column("id").to_numpy()
            at = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in sides])
            if held is not None:
                x, ids, at = np.concatenate([held[0], x]), np.concatenate([held[1], ids]), np.concatenate([held[2], at])
            which, place, score = best_rows(q, query_ids, x, ids, k)
            keep = np.unique(place)
            held = x[keep], ids[keep], at[keep]
            last = which, ids[place], score, np.abs(at[place] - own[which]).astype(np.int64)
        if held is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(last[0].astype(np.int64)), pa.array(last[1]), pa.array(last[2]), *[pa.array(c) for c in last[3].T]],
                names=["query", "id", "score", *sides])

    schema = "query long, id long, score double, " + ", ".join(f"{c} long" for c in sides)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = keyed.filter("NOT asks").mapInArrow(compare, schema).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)
    pairs = best.select(*sides).toPandas()  # at most SAMPLE * k rows
    return Reach.least(pairs.to_numpy(), blocks)
