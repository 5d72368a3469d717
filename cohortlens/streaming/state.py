"""State that streams keep in the shared folder: a drift reference by value range, and the newest predictions.

Each micro-batch leaves its own folder, named after the batch, and a repeated batch overwrites it. So a
restart goes on from the last complete batch and gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortlens.functions.columns import count_below, count_where
from cohortlens.functions.distributions import chi_square_p, ks_p
from cohortlens.operators import drift, risk
from cohortlens.operators.ordered import number
from cohortlens.operators.profile import long_numbers, long_texts
from cohortlens.schema import DRIFT_ALPHA, RECENT_PREDICTIONS, RETAINED_PREDICTIONS

#: Value ranges of a numeric feature.
RANGES = 512


@dataclass
class Reference:
    """A stored reference population.

    ``numbers`` holds (feature, range, value, n_ref) in this order, so a reader of one range skips the others; ``ranges`` the
    counts of each range; ``texts`` (feature, value, n_ref). ``edges`` are the limits of each feature's ranges.
    """

    numbers: str
    ranges: str
    texts: str
    edges: dict[str, list[float]]

    @staticmethod
    def store(reference: DataFrame, numeric: Sequence[str], categorical: Sequence[str], path: str) -> Reference:
        spark = reference.sparkSession
        own = Reference(f"{path}/numbers", f"{path}/ranges", f"{path}/texts", {})
        if numeric:
            probs = [i / RANGES for i in range(1, RANGES)]
            row = reference.agg(*[F.percentile_approx(number(c), probs, 10 * RANGES).alias(f"e{i}") for i, c in enumerate(numeric)]).first()
            own.edges = {c: sorted(set(row[f"e{i}"] or [])) for i, c in enumerate(numeric)}
        placed = own.placed(long_numbers(reference, numeric)) if numeric else None
        if placed is not None:
            counts = placed.groupBy("feature", "range", "value").agg(F.count(F.lit(1)).alias("n_ref"))
            # In order, so that files and their parts state which ranges they hold.
            counts.repartitionByRange("feature", "range").sortWithinPartitions("feature", "range", "value").write.mode("overwrite").parquet(own.numbers)
            stored = own.read_numbers(spark)
            stored.groupBy("feature", "range").agg(
                F.sum("n_ref").alias("n_ref"), F.min("value").alias("low"), F.max("value").alias("high")).coalesce(1).write.mode(
                "overwrite").parquet(own.ranges)
        if categorical:
            long_texts(reference, categorical).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n_ref")).write.mode(
                "overwrite").parquet(own.texts)
        spark.createDataFrame([(json.dumps(own.edges),)], "edges string").coalesce(1).write.mode("overwrite").json(f"{path}/edges")
        return own

    @staticmethod
    def load(spark: SparkSession, path: str) -> Reference:
        edges = json.loads(spark.read.json(f"{path}/edges").first()["edges"])
        return Reference(f"{path}/numbers", f"{path}/ranges", f"{path}/texts", edges)

    def read_numbers(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("feature string, range int, value double, n_ref long").parquet(self.numbers)

    def placed(self, long: DataFrame) -> DataFrame:
        """(feature, value) with the range of the value."""
        limits = F.create_map(*[part for c, e in self.edges.items() for part in (F.lit(c), F.array(*map(F.lit, e)).cast("array<double>"))])
        return long.withColumn("range", count_below(F.col("value"), F.element_at(limits, F.col("feature")), RANGES))


def batch_drift(batch: DataFrame, reference: Reference, numeric: Sequence[str], categorical: Sequence[str],
                alpha: float = DRIFT_ALPHA) -> DataFrame:
    """Drift of one micro-batch against a stored reference: feature, type, statistic, p-value, size and flag.

    The batch is counted by range, and only these counts meet the reference's. They make the gap between the two
    distributions exact at the ends of the ranges and bound it inside; of the ranges whose bound exceeds the
    widest gap found, and of no others, the stored values are read and ordered.
    """
    spark = batch.sparkSession
    parts = []
    if numeric:
        parts.append(batch_ks(batch, reference, numeric).select(
            "feature", F.lit("numerical").alias("feature_type"), F.col("ks_statistic").alias("statistic"),
            ks_p(F.col("ks_statistic"), F.col("size_ref"), F.col("size_cur")).alias("p_value"), "size_cur"))
    if categorical:
        current = long_texts(batch, categorical).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n_cur"))
        both = spark.read.parquet(reference.texts).join(current, ["feature", "value"], "full_outer").na.fill(0, ["n_ref", "n_cur"])
        chi = drift.chi_square_from_counts(both)
        parts.append(chi.select("feature", F.lit("categorical").alias("feature_type"), F.col("chi2_statistic").alias("statistic"),
                                chi_square_p("chi2_statistic", "dof").alias("p_value"), "size_cur"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("drift_detected", F.col("p_value") < alpha)


def batch_ks(batch: DataFrame, reference: Reference, numeric: Sequence[str]) -> DataFrame:
    """(feature, size_ref, size_cur, ks_statistic) of the features that both sides have."""
    spark = batch.sparkSession
    cells = reference.placed(long_numbers(batch, numeric))
    current = cells.groupBy("feature", "range").agg(F.count(F.lit(1)).alias("n_cur"), F.min("value").alias("low_cur"), F.max("value").alias("high_cur"))
    # At most RANGES rows for each feature, on either side.
    both = spark.read.parquet(reference.ranges).join(current, ["feature", "range"], "full_outer").na.fill(0, ["n_ref", "n_cur"])
    every = Window.partitionBy("feature")
    order = every.orderBy("range")
    share = lambda tag: F.try_divide(F.col(f"n_{tag}"), F.col(f"size_{tag}"))
    upto = lambda tag: F.try_divide(F.sum(f"n_{tag}").over(order), F.col(f"size_{tag}"))
    sized = both.withColumns({"size_ref": F.sum("n_ref").over(every), "size_cur": F.sum("n_cur").over(every)}).filter(
        "size_ref > 0 AND size_cur > 0")
    placed = sized.withColumn("after", upto("ref") - upto("cur")).withColumn("before", F.col("after") - share("ref") + share("cur"))
    placed = placed.withColumn("widest", F.max(F.abs("after")).over(every))
    bound = F.greatest(F.col("before") + share("ref"), share("cur") - F.col("before"))
    many = F.least("low", "low_cur") < F.greatest("high", "high_cur")
    rows = placed.withColumn("open", many & (bound > F.col("widest"))).select(
        "feature", "range", "before", "size_ref", "size_cur", "widest", "open").collect()  # RANGES rows a feature
    sizes = {r["feature"]: r for r in rows}
    opened = [r for r in rows if r["open"]]
    result = spark.createDataFrame([(f, r["size_ref"], r["size_cur"], r["widest"]) for f, r in sizes.items()],
                                   "feature string, size_ref long, size_cur long, widest double")
    if not opened:
        return result.withColumnRenamed("widest", "ks_statistic")
    # Pushed to the scan, which skips what holds other ranges.
    chosen = None
    for f in dict.fromkeys(r["feature"] for r in opened):
        test = (F.col("feature") == f) & F.col("range").isin([r["range"] for r in opened if r["feature"] == f])
        chosen = test if chosen is None else chosen | test
    values = reference.read_numbers(spark).filter(chosen).select("feature", "range", "value", "n_ref", F.lit(0).cast("long").alias("n_cur"))
    mine = cells.filter(chosen).select("feature", "range", "value", F.lit(0).cast("long").alias("n_ref"), F.lit(1).cast("long").alias("n_cur"))
    starts = spark.createDataFrame([(r["feature"], r["range"], r["before"], r["size_ref"], r["size_cur"]) for r in opened],
                                   "feature string, range int, before double, size_ref long, size_cur long")
    counts = values.unionByName(mine).groupBy("feature", "range", "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    inside = Window.partitionBy("feature", "range").orderBy("value")
    # ``starts`` has a row for each open range.
    met = counts.join(F.broadcast(starts), ["feature", "range"])
    gap = F.col("before") + F.sum("n_ref").over(inside) / F.col("size_ref") - F.sum("n_cur").over(inside) / F.col("size_cur")
    inner = met.select("feature", F.abs(gap).alias("gap")).groupBy("feature").agg(F.max("gap").alias("gap"))
    return result.join(inner, "feature", "left").select(
        "feature", "size_ref", "size_cur", F.greatest("widest", F.coalesce("gap", F.lit(0.0))).alias("ks_statistic"))


@dataclass
class NewestLog:
    """The newest predictions of a stream, kept batch by batch.

    A batch's state holds the total so far and the newest ``keep`` records by time, then key. A
    record that comes again, by its key, counts once as long as it is among those kept or in the same batch; a late record
    takes its place by its own time, and is only counted where ``keep`` newer ones are known.
    """

    path: str
    time: str
    key: str
    keep: int = RETAINED_PREDICTIONS

    def state(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """The state after the batch before ``batch_id``, or None at the start."""
        return None if batch_id == 0 else spark.read.parquet(f"{self.path}/state/{batch_id - 1}")

    def order(self) -> list[Column]:
        return [F.desc(self.time), F.desc(self.key)]

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Fold a batch in: one aggregate by key, and a top-k of what is kept and what came."""
        spark, before = batch.sparkSession, self.state(batch.sparkSession, batch_id)
        names = batch.columns
        first = F.min(F.struct(self.time, *[c for c in names if c not in (self.time, self.key)])).alias("w")
        fresh = batch.filter(F.col(self.key).isNotNull() & F.col(self.time).isNotNull()).groupBy(self.key).agg(first).select(
            self.key, "w.*").select(*names)
        kept, total = fresh, F.lit(0).cast("long")
        if before is not None:
            records = before.filter(F.col("record").isNotNull()).select("record.*")
            fresh = fresh.join(records.select(self.key), self.key, "left_anti")
            kept = records.select(*names).unionByName(fresh)
            total = before.agg(F.max("total")).scalar()
        newest = kept.orderBy(*self.order()).limit(self.keep)
        # One row without a record carries the total of an empty log as well.
        seen = (total + fresh.agg(F.count(F.lit(1))).scalar()).alias("total")
        none = F.lit(None).cast(newest.select(F.struct(*names).alias("r")).schema["r"].dataType)
        state = newest.select(F.struct(*names).alias("record"), F.lit(None).cast("long").alias("total")).unionByName(
            spark.range(1).select(none.alias("record"), seen))
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/{batch_id}")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """All input that is there, batch by batch."""
        query = (stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()

    def last(self, spark: SparkSession) -> DataFrame | None:
        """The state of the last batch whose folder is complete."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/state")
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return None
        done = [int(s.getPath().getName()) for s in files.listStatus(folder) if files.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]
        return spark.read.parquet(f"{self.path}/state/{max(done)}") if done else None

    def retained(self, spark: SparkSession) -> DataFrame | None:
        """The newest ``keep`` records."""
        state = self.last(spark)
        return None if state is None else state.filter(F.col("record").isNotNull()).select("record.*")

    def recent_stats(self, spark: SparkSession, probability: str = "probability", n: int = RECENT_PREDICTIONS) -> DataFrame:
        """Log size and statistics of the newest ``n`` predictions, from the state alone."""
        state = self.last(spark)
        if state is None:
            raise ValueError("no batch has been added")
        kept = state.filter(F.col("record").isNotNull()).select("record.*")
        out = risk.recent_stats(kept, self.time, self.key, probability, n)
        return out.withColumn("total_predictions", state.agg(F.max("total")).scalar())
