"""Ranks, running totals and exact quantiles without a single-task sort.

A global ``Window.orderBy`` sends every row to one task. For running totals, rows are first
reduced to one row per distinct value, cut into value ranges of about equal
size, and only then ordered inside each range. Totals per range are few, so the
running total over them fits in one small window. The range limits come from a scalar
subquery over the same reduced rows, so the whole computation stays one lazy plan and the
reduced shuffle is reused.

Quantiles need the order around a few ranks only. A sketch made on the scan brackets them; further
scans count what lies below a bracket and keep what lies inside, so no exchange carries the cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.columns import count_below, key_hash

#: Ranges that are cut at least, of values and of hashes.
MIN_BUCKETS, STRATA_BUCKETS = 64, 1 << 16
#: Ranks of a sketch are right to one part in so many; groups of no more rows are kept whole.
SKETCH = 10_000


def distinct_counts(df: DataFrame, by: Sequence[str], value: str, **measures: Column) -> DataFrame:
    """One row per (by, value) with summed measures; hot values shrink before the shuffle."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(*[m.alias(name) for name, m in measures.items()])
    )


def with_buckets(counts: DataFrame, value: str, measures: Sequence[str], feature: str | None = None,
                 buckets: int | None = None) -> DataFrame:
    """Add ``bucket``, an ascending value range per feature, and ``total_<m>`` per measure.

    ``feature`` must be a column of driver-known names (a bounded set), because the
    limits of all features travel together as one map. Any further grouping columns
    share the limits of their feature: equal values never straddle two buckets.
    All measures take part in the subquery, so that it reads the very shuffle that the
    outer query reads.
    """
    buckets = buckets or bucket_count(counts)
    facts = [_limits(value, buckets).alias("limits")]
    facts += [F.sum(m).alias(f"total_{m}") for m in measures]
    if feature is None:
        fact = counts.agg(F.struct(*facts)).scalar()
    else:
        per_feature = counts.groupBy(feature).agg(F.struct(*facts).alias("fact"))
        table = per_feature.agg(F.map_from_entries(F.collect_list(F.struct(feature, "fact")))).scalar()
        fact = F.element_at(table, F.col(feature))
    # Steps of their own, because a subquery may not be written inside a fold; the
    # optimizer merges the projections again, so the array is not copied into the rows.
    out = counts.withColumn("fact", fact).select(
        "*", F.col("fact.limits").alias("limits"), *[F.col(f"fact.total_{m}").alias(f"total_{m}") for m in measures])
    # Never null, so that joins on it push no null test (and with it the search) to the raw rows.
    bucket = F.coalesce(count_below(F.col(value), F.col("limits"), buckets), F.lit(0))
    return out.withColumn("bucket", bucket).drop("fact", "limits")


def bucket_count(df: DataFrame) -> int:
    """Value ranges to cut: four per shuffle partition, so that it grows with the cluster."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_BUCKETS, 4 * partitions)


def _limits(value: str, buckets: int) -> Column:
    """Distinct approximate quantiles; the probabilities are written as one constant."""
    probs = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    return F.array_distinct(F.expr(f"percentile_approx(`{value}`, array({probs}), {max(10000, 10 * buckets)})"))


def bucket_offsets(bucketed: DataFrame, by: Sequence[str], measures: Sequence[str],
                   descending: bool = False) -> DataFrame:
    """Per (by, bucket): each measure's sum over the buckets that come before."""
    order = F.desc("bucket") if descending else F.asc("bucket")
    window = Window.partitionBy(*by).orderBy(order)
    per_bucket = bucketed.groupBy(*by, "bucket").agg(*[F.sum(m).alias(m) for m in measures])
    before = [(F.sum(m).over(window) - F.col(m)).alias(f"before_{m}") for m in measures]
    return per_bucket.select(*by, "bucket", *before)


def running_totals(counts: DataFrame, value: str, measures: Sequence[str],
                   descending: bool = False, buckets: int | None = None) -> DataFrame:
    """Running totals ``cum_<m>`` of each measure over all distinct values in order."""
    bucketed = with_buckets(counts, value, measures, buckets=buckets)
    # At most ``buckets`` rows, whatever the input size.
    offsets = F.broadcast(bucket_offsets(bucketed, [], measures, descending))
    order = F.desc(value) if descending else F.asc(value)
    window = Window.partitionBy("bucket").orderBy(order)
    inner = bucketed.select("*", *[F.sum(m).over(window).alias(f"in_{m}") for m in measures])
    out = inner.join(offsets, "bucket")
    cums = [(F.col(f"in_{m}") + F.col(f"before_{m}")).alias(f"cum_{m}") for m in measures]
    return out.select(value, *measures, *cums, *[f"total_{m}" for m in measures])


def number(column: str) -> Column:
    """A column as numbers; NaN counts as missing."""
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def by_group(row: DataFrame, by: Sequence[str], facts: Sequence[str]) -> Column:
    """The facts of each row's group, as a scalar that needs no join; ``row`` has one row per group."""
    if not by:
        return row.select(F.struct(*facts)).scalar()
    table = row.agg(F.map_from_entries(F.collect_list(F.struct(F.struct(*by).alias("key"), F.struct(*facts).alias("value"))))).scalar()
    return F.element_at(table, F.struct(*by))


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles: (by..., feature, q0, q1, ...), one row per group and column with a value.

    Three scans. A sketch gives each wanted rank a bracket of values that surely holds it, two parts in
    ``SKETCH`` to either side; counts below the brackets place them exactly; and only cells inside, four parts in
    ``SKETCH``, folded by value, are exchanged and ordered. Groups are the caller's and few: their brackets travel
    as one scalar. Nulls and NaN are left out.
    """
    by, names = list(by), [f"c{i}" for i in range(len(columns))]
    wide = df.select(*by, *[number(c).alias(n) for c, n in zip(columns, names)])
    reach = 2 / SKETCH
    ends = [x for p in probs for x in (max(p - reach, 0.0), min(p + reach, 1.0))]
    sketch = wide.groupBy(*by).agg(*[F.count(n).alias(f"n_{n}") for n in names],
                                   *[F.percentile_approx(n, ends, SKETCH).alias(f"e_{n}") for n in names])
    bracketed = wide.withColumn("facts", by_group(sketch, by, sketch.columns[len(by):]))
    infinite = F.lit(float("inf"))
    # A small group is kept whole, as an error of a part of its rows is less than the one rank that rounding may take.
    end = lambda name, i: F.when(F.col(f"facts.n_{name}") <= SKETCH, -infinite if i % 2 == 0 else infinite).otherwise(
        F.get(f"facts.e_{name}", F.lit(i)))
    wanted = range(len(probs))
    low = bracketed.select(*by, *names, *[end(n, 2 * i).alias(f"lo_{n}_{i}") for n in names for i in wanted],
                           *[end(n, 2 * i + 1).alias(f"hi_{n}_{i}") for n in names for i in wanted])
    counts = low.groupBy(*by).agg(*[F.count(n).alias(f"n_{n}") for n in names],
                                  *[F.count_if(F.col(n) < F.col(f"lo_{n}_{i}")).alias(f"b_{n}_{i}") for n in names for i in wanted])
    cells = [F.when(F.col(n).between(F.col(f"lo_{n}_{i}"), F.col(f"hi_{n}_{i}")),
                    F.struct(F.lit(k).alias("c"), F.lit(i).alias("q"), F.col(n).alias("value")))
             for k, n in enumerate(names) for i in wanted]
    inside = low.select(*by, F.inline(F.array_compact(F.array(*cells))))
    order = Window.partitionBy(*by, "c", "q").orderBy("value")
    ranked = inside.groupBy(*by, "c", "q", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(order))
    ranked = ranked.withColumn("facts", by_group(counts, by, counts.columns[len(by):]))
    size = F.get(F.array(*[F.col(f"facts.n_{n}") for n in names]), F.col("c"))
    before = F.get(F.array(*[F.col(f"facts.b_{n}_{i}") for n in names for i in wanted]), F.col("c") * len(probs) + F.col("q"))
    position = (size - 1) * F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("q"))
    ranked = ranked.select(*by, "c", "q", "value", position.alias("position"), (before + F.col("upto") - F.col("n")).alias("first"),
                           (before + F.col("upto")).alias("end"))
    holds = lambda rank: (rank >= F.col("first")) & (rank < F.col("end"))
    lower, upper = F.floor("position"), F.ceil("position")
    found = ranked.filter(holds(lower) | holds(upper)).groupBy(*by, "c", "q").agg(
        F.max(F.when(holds(lower), F.col("value"))).alias("low"), F.max(F.when(holds(upper), F.col("value"))).alias("top"),
        F.max(F.col("position") - lower).alias("part"))
    value = F.coalesce(F.col("low") + (F.col("top") - F.col("low")) * F.col("part"),
                       F.raise_error("a wanted rank lies outside its bracket").cast("double"))
    out = found.groupBy(*by, "c").agg(*[F.max(F.when(F.col("q") == i, value)).alias(f"q{i}") for i in wanted])
    # A long table names its features itself.
    name = [] if "feature" in by else [F.get(F.array(*[F.lit(c) for c in columns]), F.col("c")).alias("feature")]
    return out.select(*by, *name, *[f"q{i}" for i in wanted])


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str,
                    probs: Sequence[float], buckets: int | None = None) -> DataFrame:
    """``quantiles`` of a long table: one row per ``by`` with columns q0, q1, ...; ``by[0]`` is the feature name."""
    return quantiles(df, [value], probs, by).select(*by, *[f"q{i}" for i in range(len(probs))])


def rank_cutoffs(df: DataFrame, stratum: str, key: str, seed: int, wanted: Sequence[Column]) -> Column:
    """Map of stratum -> ascending cut points (hash, key) at the wanted ranks.

    Each wanted rank is an expression over the stratum size ``size``. Selecting ranks
    by histogram needs no full ordering: counts per hash range show which range holds a
    wanted rank, and only those ranges are looked into. The result is a scalar, so that
    assigning rows is a plain projection. Rows that share a key share a side.
    """
    width = max(1, (1 << 31) // max(STRATA_BUCKETS, 16 * bucket_count(df)))
    hashed = df.select(F.col(stratum).alias("stratum"), F.col(key).alias("key"),
                       key_hash(df, key, seed).alias("hash"))
    hashed = hashed.withColumn("bucket", F.expr(f"hash div {width}"))
    per_bucket = hashed.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    spans = per_bucket.select(
        "stratum", "bucket", "n",
        (F.sum("n").over(Window.partitionBy("stratum").orderBy("bucket")) - F.col("n")).alias("start"),
        F.sum("n").over(Window.partitionBy("stratum")).alias("size"),
    )
    targets = (
        spans.select("stratum", "bucket", "start", "n", F.explode(F.array(*wanted)).alias("rank"))
        .filter((F.col("rank") > F.col("start")) & (F.col("rank") <= F.col("start") + F.col("n")))
        .groupBy("stratum", "bucket", "start")
        .agg(F.collect_list("rank").alias("ranks"))
    )
    window = Window.partitionBy("stratum", "bucket").orderBy("hash", "key")
    cuts = (
        hashed.join(targets, ["stratum", "bucket"])
        .groupBy("stratum", "bucket", "start", "ranks", "hash", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("end", F.col("start") + F.sum("n").over(window))
        .select("stratum", "hash", "key", "n", "end", F.explode("ranks").alias("rank"))
        .filter((F.col("rank") > F.col("end") - F.col("n")) & (F.col("rank") <= F.col("end")))
        .groupBy("stratum")
        .agg(F.sort_array(F.collect_list(F.struct("hash", "key"))).alias("cuts"))
    )
    return cuts.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "cuts")))).scalar()
