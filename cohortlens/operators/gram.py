"""Correlations of many columns from blocks of a Gram matrix.

One expression for each pair of columns stops working at some hundred columns. Here a task multiplies whole
batches: for each pair of blocks of ``TILE`` columns, the sums and counts of the rows where both values are present. Blocks
of all tasks are added up pair by pair, in two steps, so no task gathers the blocks of all others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.operators.ordered import number
from cohortlens.session import share_package

TILE = 256
#: First step of adding up: tasks that share one sum.
SALT = 32
BLOCK = "a int, b int, part int, sums binary"


def correlations(df: DataFrame, columns: Sequence[str], tile: int = TILE) -> DataFrame:
    """(feature_a, feature_b, corr) of all pairs in order, over the rows where both hold a number; NaN counts as missing.

    Null where a column is constant or fewer than two rows have both. Values are taken from their column's mean, so that
    large values of little spread lose no digits.
    """
    share_package(df.sparkSession)
    names, cut = list(columns), range(0, len(columns), tile)
    # Plain names, as columns may have any.
    plain = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(names)])
    means = plain.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(len(names))]).first()
    shift = np.array([0.0 if m is None or not np.isfinite(m) else m for m in means])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(batch.num_columns)])
            have = np.isfinite(x)
            x = np.where(have, x - shift, 0.0)
            have, square = have.astype(float), x * x
            for i, at in enumerate(cut):
                for j, to in enumerate(cut):
                    if i <= j:
                        left, right = slice(at, at + tile), slice(to, to + tile)
                        part = np.stack([have[:, left].T @ have[:, right], x[:, left].T @ have[:, right], have[:, left].T @ x[:, right],
                                         square[:, left].T @ have[:, right], have[:, left].T @ square[:, right], x[:, left].T @ x[:, right]])
                        sums[i, j] = sums.get((i, j), 0) + part
        part = TaskContext.get().partitionId() % SALT
        for (i, j), total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (i, j, part)] + [pa.array([total.tobytes()], pa.binary())],
                                             names=["a", "b", "part", "sums"])

    def total_of(rows: pa.Table) -> np.ndarray:
        return sum(np.frombuffer(rows["sums"][i].as_py()) for i in range(rows.num_rows))

    def add(rows: pa.Table) -> pa.Table:
        return rows.slice(0, 1).set_column(3, "sums", pa.array([total_of(rows).tobytes()], pa.binary()))

    def correlate(rows: pa.Table) -> pa.Table:
        i, j = rows["a"][0].as_py() * tile, rows["b"][0].as_py() * tile
        wide, high = min(tile, len(names) - i), min(tile, len(names) - j)
        n, sx, sy, sxx, syy, sxy = total_of(rows).reshape(6, wide, high)
        spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
        a, b = np.nonzero((np.arange(wide)[:, None] + i) < (np.arange(high)[None, :] + j))
        fine = (n[a, b] > 1) & (spread[a, b] > 0)
        corr = np.where(fine, (n * sxy - sx * sy)[a, b] / np.sqrt(np.where(fine, spread[a, b], 1.0)), 0.0)
        return pa.table({"feature_a": pa.array([names[k + i] for k in a], pa.string()), "feature_b": pa.array([names[k + j] for k in b], pa.string()),
                         "corr": pa.array(corr, mask=~fine)})

    blocks = plain.mapInArrow(multiply, BLOCK).groupBy("a", "b", "part").applyInArrow(add, BLOCK)
    return blocks.groupBy("a", "b").applyInArrow(correlate, "feature_a string, feature_b string, corr double")
