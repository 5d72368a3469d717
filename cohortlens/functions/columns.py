"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Modulus 2**31 - 1 and multiplier of the portable hash. Products of two residues
# stay below 2**62, so the arithmetic never overflows a BIGINT.
HASH_MODULUS = 2147483647
HASH_MULTIPLIER = 48271


def clip(col: Column, low: float | None, high: float | None) -> Column:
    """Bound a value; null stays null (``greatest``/``least`` alone skip nulls)."""
    bounded = col
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(col.isNotNull(), bounded)


def add_all(terms: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def row_std(cols: Sequence[Column]) -> Column:
    """Sample standard deviation across columns of one row, skipping nulls."""
    n = add_all(F.when(c.isNotNull(), 1.0).otherwise(0.0) for c in cols)
    mean = F.try_divide(add_all(F.coalesce(c, F.lit(0.0)) for c in cols), n)
    squares = add_all(F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cols)
    return F.when(n >= 2, F.sqrt(F.try_divide(squares, n - 1)))


def band(col: Column, steps: Sequence[tuple[float, str]], floor: str) -> Column:
    """First step whose lower bound is reached, else the floor. Null gives the floor."""
    out = F.when(col >= steps[0][0], steps[0][1])
    for low, name in steps[1:]:
        out = out.when(col >= low, name)
    return out.otherwise(floor)


def lookup(col: Column, table: dict[str, float], default: float = 0.0) -> Column:
    """Small fixed lookup as a CASE expression."""
    (first, value), *rest = table.items()
    out = F.when(col == first, F.lit(value))
    for key, val in rest:
        out = out.when(col == key, F.lit(val))
    return out.otherwise(F.lit(default))


def portable_hash(key: Column, seed: int) -> Column:
    """Pseudo-random residue of an integer key, the same in any SQL engine.

    x -> (a*x + seed)**5 is a bijection modulo 2**31 - 1, because 5 does not
    divide 2**31 - 2.
    """
    m = F.lit(HASH_MODULUS).cast("bigint")
    x = F.pmod(F.pmod(key.cast("bigint"), m) * F.lit(HASH_MULTIPLIER) + F.lit(seed), m)
    fourth = F.pmod(F.pmod(x * x, m) * F.pmod(x * x, m), m)
    return F.pmod(fourth * x, m)


def key_hash(df: DataFrame, key: str, seed: int) -> Column:
    """``portable_hash`` for integer keys; other keys are hashed to an integer first."""
    col = F.col(key)
    if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        col = F.xxhash64(col)
    return portable_hash(col, seed)


def fixed_text(col: Column, digits: int) -> Column:
    """Decimal text with ``digits`` places, rounded half-even on the exact binary value.

    ``format_string`` rounds the shortest decimal form half-up (1.15 -> "1.2"), which
    is not what the wording needs. The product col * 10**digits is split into a
    rounded part and its exact error, so that only true ties count as ties.
    """
    scale = F.lit(10.0**digits)
    product = col * scale
    high = col * F.lit(134217729.0) - (col * F.lit(134217729.0) - col)
    error = (high * scale - product) + (col - high) * scale
    tie = (product - F.floor(product)) == 0.5
    units = (
        F.when(tie & (error > 0), F.ceil(product).cast("double"))
        .when(tie & (error < 0), F.floor(product).cast("double"))
        .otherwise(F.rint(product))
    )
    return F.format_string(f"%.{digits}f", units / scale)


def count_below(value: Column, limits: Column, most: int) -> Column:
    """How many of fewer than ``most`` ascending limits are below the value (binary search)."""
    widths = F.array(*[F.lit(1 << i) for i in range((most - 1).bit_length() - 1, -1, -1)])

    def step(found: Column, width: Column) -> Column:
        reach = found + width
        return F.when(F.get(limits, reach - 1) < value, reach).otherwise(found)

    return F.aggregate(widths, F.lit(0), step)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def to_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str], kind: str, name: str = "feature",
            value: str = "value") -> DataFrame:
    """(keep..., name, value) with nulls dropped; one row per cell.

    Written as a generator: plans that read the same long table twice, once in a
    subquery, then share one shuffle, which they do not with ``unpivot``.
    """
    cells = [F.struct(F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for c in columns]
    return df.select(*keep, F.inline(F.array(*cells))).filter(F.col(value).isNotNull())


def one_row_to_long(row: DataFrame, records: Sequence[dict[str, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """Turn each row of an aggregate (mostly one) into one output row per record."""
    structs = [F.struct(*[c.alias(n) for n, c in rec.items()]) for rec in records]
    return row.select(*keep, F.inline(F.array(*structs)))
