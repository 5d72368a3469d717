"""Exact top-k by Hamming distance on binary codes: incremental multi-index hashing.

Codes are cut into segments, and each segment has a table from its value to the codes that
have it. A search looks up all values within radius 0, 1, 2, ... of the query's segments and
verifies what it finds. With m segments searched to radius r, every code within distance
m * (r + 1) - 1 was found: so the search ends when the kth verified distance is that near.
Codes are dealt into blocks, each with tables of its own, and blocks of queries meet blocks
of codes; the best of each block are merged.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

BITS = 64
K = 10
BLOCK = 1 << 14
QUERY_BLOCK = 1 << 14
#: Partitions that the meetings of blocks are dealt over, at most; further meetings share them.
MAX_TASKS = 20_000


def sign_code(vector: Column) -> Column:
    """One bit for each number, at most 64: 1 where it is above 0. Null numbers and NaN give 0. A longer vector raises."""
    bit = lambda x, i: F.when((x > 0) & ~F.isnan(x.cast("double")), F.call_function(
        "shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    code = F.aggregate(F.transform(vector, bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    said = F.concat(F.lit(f"a vector is longer than the {BITS} numbers of a code: "), F.size(vector).cast("string"))
    return F.when(F.size(vector) > BITS, F.raise_error(said).cast("long")).otherwise(code)


def sign_words(vector: Column, bits: int) -> Column:
    """``sign_code`` of vectors of up to ``bits`` numbers: the codes of 64 numbers after another, as bytes. A longer vector raises."""
    parts = [F.lpad(F.hex(F.coalesce(sign_code(F.slice(vector, at + 1, BITS)), F.lit(0).cast("long"))), BITS // 4, "0")
             for at in range(0, bits, BITS)]
    said = F.concat(F.lit(f"a vector is longer than the {bits} numbers of a code: "), F.size(vector).cast("string"))
    return F.when(F.size(vector) > bits, F.raise_error(said).cast("binary")).otherwise(F.unhex(F.concat(*parts)))


def unpacked(codes: pd.Series) -> np.ndarray:
    """Codes as rows of 64-bit words, the first numbers of a vector in the lowest bits of the first word."""
    if codes.dtype == object:
        return np.frombuffer(b"".join(codes), ">u8").reshape(len(codes), -1).astype(np.uint64)
    return codes.to_numpy().view(np.uint64)[:, None]


class MultiIndex:
    """Segment tables over distinct codes, which are rows of 64-bit words."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, k: int):
        self.k = k
        order = np.lexsort((ids, *codes.T))
        codes, ids = codes[order], ids[order]
        new = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]).any(axis=1)]))
        self.codes, self.ids = codes[new], ids
        self.first, self.many = new, np.diff(np.append(new, len(codes)))
        bits = BITS * codes.shape[1]
        # About one code for each value of a segment.
        self.parts = max(1, min(bits // 4, round(bits / max(1.0, math.log2(len(new) + 1)))))
        edges = np.linspace(0, bits, self.parts + 1).astype(int)
        self.segments = [(int(lo), int(hi - lo)) for lo, hi in zip(edges, edges[1:])]
        self.tables = []
        for lo, width in self.segments:
            values = self.values(self.codes, lo, width)
            at = np.argsort(values, kind="stable")
            self.tables.append((values[at], at))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def values(codes: np.ndarray, lo: int, width: int) -> np.ndarray:
        """``width`` bits of each code from bit ``lo`` on; a segment may cross from one word into the next."""
        word, at = divmod(lo, BITS)
        out = codes[:, word] >> np.uint64(at)
        if at + width > BITS:
            out = out | codes[:, word + 1] << np.uint64(BITS - at)
        return out & np.uint64((1 << width) - 1) if width < BITS else out

    def near_values(self, value: np.uint64, width: int, radius: int) -> np.ndarray:
        """All values that differ in exactly ``radius`` bits."""
        key = width, radius
        if key not in self.masks:
            self.masks[key] = np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.uint64)
        return self.masks[key] ^ value

    def search(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest rows, by distance and id."""
        seen, far = np.empty(0, np.int64), np.empty(0, np.int64)
        for radius in range(max(w for _, w in self.segments) + 1):
            found = []
            for (lo, width), (values, at) in zip(self.segments, self.tables):
                if radius <= width:
                    probes = self.near_values(self.values(code[None, :], lo, width)[0], width, radius)
                    start, stop = np.searchsorted(values, probes), np.searchsorted(values, probes, side="right")
                    hit = np.flatnonzero(stop > start)
                    found += [at[a:b] for a, b in zip(start[hit], stop[hit])]
            fresh = np.setdiff1d(np.concatenate(found), seen) if found else np.empty(0, np.int64)
            seen = np.concatenate([seen, fresh])
            far = np.concatenate([far, np.bitwise_count(self.codes[fresh] ^ code).sum(axis=1).astype(np.int64)])
            covered = self.parts * (radius + 1) - 1
            if self.many[seen[far <= covered]].sum() >= self.k or len(seen) == len(self.codes):
                break
        rows = np.minimum(self.many[seen], self.k)
        each = np.repeat(np.arange(len(seen)), rows)
        ids = self.ids[self.first[seen][each] + np.arange(len(each)) - np.repeat(np.cumsum(rows) - rows, rows)]
        order = np.lexsort((ids, far[each]))[: self.k]
        return far[each][order], ids[order]


def top_k(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, bits: int = BITS) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k rows nearest to each query, itself included.

    Ties go to the smaller id. Rows and queries without an id or a vector are left out; with
    fewer than k rows all are returned. Codes have ``bits`` places, a multiple of 64; shorter vectors
    have zeros at the end and longer ones raise an error. Empty tables give no rows, and other columns are not read. Rows that repeat an id are separate neighbours; of
    queries that repeat an id, one is searched, the one with the smallest code.
    """
    if bits % BITS:
        raise ValueError(f"codes have whole words of {BITS} bits, not {bits}")
    has = F.col(f"`{vector}`").isNotNull() & F.col(f"`{key}`").isNotNull()
    code = sign_code(F.col(f"`{vector}`")) if bits == BITS else sign_words(F.col(f"`{vector}`"), bits)
    pick = lambda df: df.filter(has).select(F.col(f"`{key}`").cast("long").alias("id"), code.alias("code"))
    codes, asked = pick(rows), pick(queries)
    asked = asked.groupBy("id").agg(F.min("code").alias("code"))
    blocks = max(1, math.ceil(codes.count() / BLOCK))
    query_blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    by = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "id", "code"), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    left = codes.withColumn("block", by("row", blocks)).withColumn("query_block", every(query_blocks))
    right = asked.withColumn("query_block", by("query", query_blocks)).withColumn("block", every(blocks))

    def nearest(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "neighbour_id": [], "distance": []}
        if len(one) and len(two):
            index = MultiIndex(unpacked(one["code"]), one["id"].to_numpy(), k)
            for _, group in two.groupby("code"):
                far, ids = index.search(unpacked(group["code"].iloc[:1])[0])
                for query in group["id"]:
                    out["query_id"].append(np.full(len(ids), query))
                    out["neighbour_id"].append(ids)
                    out["distance"].append(far)
        return pd.DataFrame({n: np.concatenate(v) if v else np.empty(0, np.int64) for n, v in out.items()})

    keys = ["block", "query_block"]
    # A meeting of blocks takes long for its few bytes, so its partitions are not to be put together by size.
    tasks = min(blocks * query_blocks * 2, MAX_TASKS)
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        nearest, "query_id long, neighbour_id long, distance long")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "neighbour_id", "distance")
