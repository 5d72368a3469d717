"""Stratified holdout and folds, and fixed-size samples.

Assignments follow a hash of the key, so they are repeatable and need no sort: the
cut points are selected by histogram, and labelling rows is a projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.columns import key_hash
from cohortlens.operators.ordered import rank_cutoffs


def with_holdout(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42,
                 name: str = "is_test") -> DataFrame:
    """Mark round(test_share * n) rows of each class as test rows."""
    wanted = F.floor(F.col("size") * F.lit(test_share) + 0.5)
    cuts = rank_cutoffs(df, label, key, seed, [wanted])
    cut = F.element_at(cuts, F.col(label))
    place = F.struct(key_hash(df, key, seed).alias("hash"), F.col(key).alias("key"))
    return df.withColumn(name, F.coalesce(place <= F.get(cut, F.lit(0)), F.lit(False)))


def with_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Fold 0..folds-1 per row; the fold sizes of a class differ by at most one."""
    wanted = [F.ceil(F.col("size") * i / folds).cast("bigint") for i in range(1, folds)]
    cuts = F.element_at(rank_cutoffs(df, label, key, seed, wanted), F.col(label))
    place = F.struct(key_hash(df, key, seed).alias("hash"), F.col(key).alias("key"))
    # A class smaller than the number of folds repeats a cut point, which counts each time.
    passed = [F.coalesce(place > F.get(cuts, F.lit(i)), F.lit(False)).cast("int") for i in range(folds - 1)]
    total = passed[0]
    for step in passed[1:]:
        total = total + step
    return df.withColumn(name, total)


def sample_n(df: DataFrame, key: str, n: int = 100, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order (the whole table if it is smaller), as a top-k."""
    hashed = df.withColumn("__order", key_hash(df, key, seed))
    return hashed.orderBy("__order", key).limit(n).drop("__order")
