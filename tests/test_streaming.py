"""Streams cut into several batches give the batch answer."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import drift, risk
from cohortlens.session import materialize
from cohortlens.sources import bindings
from cohortlens.streaming import jobs, state
from cohortlens.streaming.state import NewestLog, Reference

NUMBERS, CATEGORIES = ["l_quantity", "l_tax"], ["l_returnflag"]


def test_hourly_stats_over_many_batches(spark, sf, tmp_path):
    events = bindings.scored_events(spark, sf)
    events.repartitionByRange(5, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", events.schema, files_per_batch=1)
    out = jobs.run_hourly_stats(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(str(r.hour_start), r.n, r.high_risk) for r in out.collect()}
    # Files arrive in no stated order, so late hours may be left out, but none is counted twice.
    want = {(str(r.hour_start), r.n, r.high_risk) for r in risk.hourly_counts(events).collect()}
    assert {h for h, _, _ in got} <= {h for h, _, _ in want}
    assert sum(n for _, n, _ in got) <= events.count()


def test_hours_in_order_equal_the_batch_answer(spark, sf, tmp_path):
    """Files in the order of time lose nothing; one that comes far too late is counted as such."""
    events = bindings.scored_events(spark, sf).orderBy("ts").limit(600)
    rows = materialize(events, "ordered")
    cuts = [r.ts for r in rows.orderBy("ts").select("ts").collect()][::150]
    parts = [rows.filter((F.col("ts") >= a) & (F.col("ts") < b) if b else F.col("ts") >= a) for a, b in zip(cuts, [*cuts[1:], None])]
    path = f"{tmp_path}/in"
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(path)
        stream = jobs.file_stream(spark, path, rows.schema, files_per_batch=1)
        out, late = jobs.run_hourly_counted(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
        assert late == 0
    key = lambda df: sorted((str(r.hour_start), r.n, round(r.avg_probability, 9), r.high_risk) for r in df.collect())
    assert key(out) == key(risk.hourly_counts(rows))
    rows.orderBy("ts").limit(7).coalesce(1).write.mode("append").parquet(path)
    for _ in range(2):  # the watermark moves on between runs
        out, late = jobs.run_hourly_counted(jobs.file_stream(spark, path, rows.schema, files_per_batch=1), f"{tmp_path}/out", f"{tmp_path}/cp")
        assert key(out) == key(risk.hourly_counts(rows))


def test_newest_log_equals_the_batch_queries(spark, sf, tmp_path):
    events = bindings.scored_events(spark, sf).select("event_id", "ts", "probability")
    twice = materialize(events.unionByName(events.filter("event_id % 10 = 0")), "twice")
    for name, files in (("one", 1), ("many", 5)):
        twice.repartition(files, "event_id").write.parquet(f"{tmp_path}/{name}")
        log = NewestLog(f"{tmp_path}/{name}-log", "ts", "event_id", keep=50)
        assert log.retained(spark) is None
        stream = jobs.file_stream(spark, f"{tmp_path}/{name}", twice.schema, files_per_batch=1)
        log.run(stream, f"{tmp_path}/{name}-cp")
        want = [tuple(r) for r in risk.retain_latest(events, "ts", "event_id", 50).collect()]
        assert [tuple(r) for r in log.retained(spark).orderBy(F.desc("ts"), F.desc("event_id")).collect()] == want
        # Copies of a record lie in one file here, so all are found.
        got, plain = log.recent_stats(spark, n=20).first(), risk.recent_stats(events, "ts", "event_id", n=20).first()
        assert tuple(got)[:2] == tuple(plain)[:2] and got.avg_probability == pytest.approx(plain.avg_probability)
        # A restart finds nothing new, and a repeated batch gives the same state.
        log.run(stream, f"{tmp_path}/{name}-cp")
        log.add(spark.read.schema(twice.schema).parquet(f"{tmp_path}/{name}").limit(0), files)
        assert log.recent_stats(spark, n=20).first() == got
    empty = NewestLog(f"{tmp_path}/empty", "ts", "event_id")
    empty.add(twice.limit(0), 0)
    assert tuple(empty.recent_stats(spark).first())[:2] == (0, 0)


def test_batch_drift_reads_few_ranges(spark, sf, tmp_path):
    """The statistic equals that of the whole tables for a batch alike, apart, constant and empty."""
    sides = materialize(bindings.drift_sides(spark, sf).select("side", *NUMBERS, *CATEGORIES), "sides")
    reference = sides.filter("side = 'reference'")
    stored = Reference.store(reference, NUMBERS, CATEGORIES, f"{tmp_path}/ref")
    assert Reference.load(spark, f"{tmp_path}/ref") == stored
    current = sides.filter("side = 'current'")
    for batch in (current, current.withColumn("l_quantity", F.col("l_quantity") + 9.5), current.withColumn("l_quantity", F.lit(1e9)),
                  reference.limit(40), current.withColumn("l_tax", F.lit(None).cast("double"))):
        want = {r.feature: round(r.statistic, 9) for r in drift.drift_table(
            drift.tag_sides(reference.drop("side"), batch.drop("side")), NUMBERS, CATEGORIES).collect()}
        got = {r.feature: round(r.statistic, 9) for r in state.batch_drift(batch.drop("side"), stored, NUMBERS, CATEGORIES).collect()}
        assert got == want
    assert state.batch_drift(current.drop("side").limit(0), stored, NUMBERS, CATEGORIES).count() == 0


def test_validation_splits_rows(spark, students, tmp_path):
    students.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", students.schema, files_per_batch=1)
    out = jobs.run_validation(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert out.count() == students.count()
    assert out.filter("accepted AND size(errors) > 0").count() == 0
    assert out.select("batch_id").distinct().count() == 4
    # A restart finds nothing new and repeats nothing.
    again = jobs.run_validation(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert again.count() == students.count()


def test_drift_per_batch(spark, sf, tmp_path):
    sides = bindings.drift_sides(spark, sf)
    folders = jobs.reference_counts(sides.filter("side = 'reference'"), NUMBERS, CATEGORIES, f"{tmp_path}/ref")
    current = sides.filter("side = 'current'").select(*NUMBERS, *CATEGORIES)
    current.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", current.schema, files_per_batch=1)
    out = jobs.run_drift(stream, folders, NUMBERS, CATEGORIES, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert out.count() == 2 * 3
    assert sum(r.size_cur for r in out.filter("feature = 'l_tax'").collect()) == current.count()
    whole = jobs.batch_drift(current, spark.read.parquet(folders[0]), spark.read.parquet(folders[1]), NUMBERS, CATEGORIES)
    table = {r.feature: r.statistic for r in drift.drift_table(sides, NUMBERS, CATEGORIES).collect()}
    assert {r.feature: round(r.statistic, 9) for r in whole.collect()} == {f: round(v, 9) for f, v in table.items()}


def test_log_keeps_each_event_once(spark, sf, tmp_path):
    events = bindings.scored_events(spark, sf)
    events.unionByName(events).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", events.schema)
    out = jobs.run_scored_log(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert out.count() == events.count() == out.select("event_id").distinct().count()
    assert out.filter(F.col("risk_level").isNull()).count() == 0


def test_hours_are_counted_by_many_tasks(spark, tmp_path):
    """The folder of a batch has several files: one task would hold the state of all partitions at once."""
    rows = spark.range(400).selectExpr("timestamp_seconds(1700000000 + id * 1800) AS ts", "id / 400D AS probability")
    rows.write.parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", rows.schema)
    out = jobs.run_hourly_stats(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    for folder in (tmp_path / "out").iterdir():
        assert len(list(folder.glob("part-*.parquet"))) > 1
    key = lambda df: sorted((str(r.hour_start), r.n, round(r.avg_probability, 9), r.high_risk) for r in df.collect())
    assert key(out) == key(risk.hourly_counts(rows))
