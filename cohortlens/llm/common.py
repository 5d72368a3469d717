"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space between words. ``bytes.split`` and ``bytes.lower`` follow the same ASCII rules.
WORD = r"[^\x20\x09-\x0D]+"
MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(text: str | None) -> bytes:
    """UTF-8 of a text; a null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def id_fold(key: str, parts: int) -> Column:
    """CRC-32 of an id written as text, modulo ``parts``; splits rows for training and holding out."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


class Scored(NamedTuple):
    frame: DataFrame
    column: str


def with_result(df: DataFrame, udf: Callable[..., Column], name: str, *inputs: str) -> Scored:
    """``df`` with one struct column, under a name that does not clash with its own."""
    column = unused(df, name)
    return Scored(df.withColumn(column, udf(*[F.col(f"`{c}`") for c in inputs])), column)


def fields(scored: Scored, keep: list[str], names: Iterable[str]) -> DataFrame:
    """Chosen columns and chosen fields of the result, side by side."""
    return scored.frame.select(
        *[F.col(f"`{c}`") for c in keep], *[F.col(f"`{scored.column}`.{n}").alias(n) for n in names])


def frame_of(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame.from_records(rows, columns=names)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, alike in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` words."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    value = hashes[:count].copy()
    for i in range(1, width):
        value *= MIX
        value ^= value >> np.uint64(29)
        value += hashes[i : i + count]
    return scramble(value)


def scramble(value: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    value = value ^ (value >> np.uint64(30))
    value = value * np.uint64(0xBF58476D1CE4E5B9)
    value = value ^ (value >> np.uint64(27))
    value = value * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def arrow_rows(build: Callable[[dict], dict], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function from one that takes and returns columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = build({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip((out[f.name] for f in schema), schema)],
                    schema=schema)

    return run


def usable_vectors(df: DataFrame, key: str, vector: str, **others: Column) -> DataFrame:
    """(id, v, ...) of rows with an id and a vector of finite numbers; of rows that repeat an id, the one with the least values."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"),
                     *[c.alias(n) for n, c in others.items()])
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(False)))
    names = [*others, "v"]
    return rows.groupBy("id").agg(F.min(F.struct(*names)).alias("w")).select("id", *[F.col(f"w.{n}").alias(n) for n in names])


def joined_rows(column: pa.Array | pd.Series, width: int, kind: str) -> np.ndarray:
    """A matrix from a column of packed rows."""
    return np.frombuffer(b"".join(column), kind).reshape(-1, width)


def matrix_of(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """A matrix from a column of lists; shorter ones are filled with zeros."""
    out = np.zeros((len(column), width), kind)
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) == out.size:
        return values.astype(kind).reshape(out.shape)
    at = np.repeat(np.arange(len(column)), sizes)
    out[at, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def block_by(edges: list) -> Callable[[str], Column]:
    """The number of edges at or below a value; edges ascend."""
    limits = np.array(edges)

    @F.pandas_udf("int")
    def find(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, values.to_numpy(), side="right").astype(np.int32))

    return find


def cut_points(blocks: int) -> list[float]:
    return [i / blocks for i in range(1, blocks)]
