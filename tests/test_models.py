import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from cohortlens.operators import attribution, calibrate, drift, features, metrics, models, split
from cohortlens.plans import flows
from cohortlens.schema import KEY, LABEL, NUMERIC_FEATURES
from cohortlens.session import materialize
from cohortlens.sources import artifacts, bindings, files

LIGHT = dict(trees=8, rounds=3, forest_depth=6)


@pytest.fixture(scope="module")
def rows(spark):
    """Enough learners to learn from, with an easy label."""
    return materialize(bindings.students(spark, "/root/testdata/sf0.01"), "rows")


def test_preprocessing_has_no_gaps(rows):
    model = features.Preprocessor().fit(rows)
    out = model.transform(rows)
    from pyspark.ml.functions import vector_to_array

    sizes = out.select(F.size(vector_to_array("features")).alias("n")).distinct().collect()
    assert [r.n for r in sizes] == [len(model.feature_names())] == [20]
    flat = model.flat(rows)
    stats = flat.agg(*[F.avg(c).alias(c) for c in NUMERIC_FEATURES]).first()
    assert all(abs(stats[c]) < 1e-9 for c in NUMERIC_FEATURES)


def test_unknown_level_gives_zeros(rows):
    model = features.Preprocessor(numeric=[]).fit(rows)
    row = model.flat(rows.limit(1).withColumn("school_type", F.lit("Other"))).first().asDict()
    assert sum(v for c, v in row.items() if c.startswith("school_type_")) == 0.0


def test_constant_column_is_only_centred(rows):
    flat = features.Preprocessor(categorical=[]).fit(rows.withColumn("midterm", F.lit(50.0))).flat(rows.withColumn("midterm", F.lit(50.0)))
    assert flat.select("midterm").distinct().collect()[0][0] == 0.0


def test_wrong_columns_and_empty_tables_are_errors(spark, rows):
    with pytest.raises(ValueError, match="Missing feature"):
        features.Preprocessor().fit(rows.select("gender"))
    with pytest.raises(ValueError, match="No values"):
        features.Preprocessor().fit(rows.filter("1 = 0"))


def test_stages_survive_saving(rows, tmp_path):
    from pyspark.ml import Pipeline

    stages = [features.OutlierClipper(), features.FeatureEngineer(), features.Preprocessor(numeric=[*NUMERIC_FEATURES, *features.ENGINEERED])]
    model = Pipeline(stages=stages).fit(rows)
    artifacts.save_model(model, f"{tmp_path}/prep")
    again = artifacts.load_model(f"{tmp_path}/prep")
    pick = lambda m: [r.features for r in m.transform(rows).orderBy(KEY).limit(20).collect()]
    assert pick(model) == pick(again)
    assert artifacts.try_load_model(f"{tmp_path}/none") is None


def test_five_models_beat_chance(rows):
    scores = models.cross_validate(rows, KEY, models.baselines(**LIGHT), folds=2)
    table = {(r.model, r.metric): r["mean"] for r in metrics.fold_summary(scores).collect()}
    assert len({m for m, _ in table}) == 5
    assert all(0.0 <= v <= 1.0 for v in table.values())
    assert all(table[m, "roc_auc"] > 0.8 for m, _ in table)


def test_a_failing_model_scores_zero(rows):
    def broken(n):
        raise RuntimeError("no")

    scores = models.cross_validate(rows, KEY, {"broken": broken}, folds=2)
    assert {(r.metric, r.score) for r in scores.collect()} == {(m, 0.0) for m in models.SCORES}


def test_train_flow_saves_the_best(rows, tmp_path):
    build = {"Naive Bayes": lambda n: models.naive_bayes(), "Random Forest": lambda n: models.forest(8, 6)}
    summary, name, model = flows.train_baselines(rows, str(tmp_path), builders=build, folds=2)
    assert summary.count() == 10
    assert isinstance(artifacts.load_model(f"{tmp_path}/{artifacts.artifact_name(name)}"), PipelineModel)
    records, batch = flows.score(rows, model, at=F.lit("2024-01-01").cast("timestamp"))
    assert records.columns == [KEY, "probability", "risk_probability", "risk_level", "prediction", "confidence", "timestamp"]
    assert batch.first().total_students == rows.count()
    assert flows.explain(rows, model).count() == rows.count()


def test_tune_flow(rows, tmp_path):
    space = {**models.SEARCH_SPACE, "n_estimators": (2, 3, "int"), "max_depth": (2, 3, "int")}
    trials = models.draw_params(2, space=space)
    assert trials == models.draw_params(2, space=space)
    results, best, model = flows.tune(rows, str(tmp_path), trials=trials)
    assert results.count() == 2 and best in trials
    assert files.read_params(rows.sparkSession, f"{tmp_path}/best_params") == pytest.approx(best)
    again = calibrate.CalibratedModel.load(f"{tmp_path}/booster_calibrated")
    scored = again.transform(rows)
    low, high = scored.agg(F.min("probability"), F.max("probability")).first()
    assert 0.0 <= low and high <= 1.0
    assert metrics.roc_auc(scored, label=LABEL).first().roc_auc > 0.8


def test_evaluation_tables(rows):
    table = split.with_holdout(rows, LABEL, KEY)
    model = models.fit(table.filter("NOT is_test"), models.logistic)
    scored = materialize(models.score(model, table.filter("is_test"), [LABEL, "gender", "school_type", "parent_edu"]), "scored")
    out = flows.evaluate(scored)
    assert out["roc_auc"].first().roc_auc > 0.8
    assert {r.dimension for r in out["fairness"].collect()} == {"gender", "school_type", "parent_edu"}
    assert out["threshold_sweep"].count() == 16
    assert sum(r.n for r in out["calibration_curve"].collect()) == scored.count()


def test_permutation_finds_the_feature_that_matters(spark):
    df = spark.range(3000).select(
        "id", (F.rand(1)).alias("a"), F.rand(2).alias("b")).withColumn("y", (F.col("a") > 0.5).cast("bigint"))
    df = materialize(df, "perm")
    scorer = lambda d: d.withColumn("probability", F.col("a"))
    rank = attribution.permutation_importance(df, ["a", "b"], scorer, "y", "id").collect()
    assert rank == attribution.permutation_importance(df.repartition(5, "a"), ["a", "b"], scorer, "y", "id").collect()
    assert rank[0].feature == "a" and rank[0].importance == pytest.approx(0.5, abs=0.05)
    assert rank[1].importance == pytest.approx(0.0, abs=1e-9)


def test_shuffling_is_a_permutation(spark):
    df = materialize(spark.range(500).select(F.col("id").alias("a")), "shuffle")
    out = attribution.shuffled(df, ["a"], "a")
    assert sorted(r.a__shuffled for r in out.collect()) == list(range(500))
    assert out.filter("a = a__shuffled").count() == 0
    odd = spark.createDataFrame([(1, 5.0), (1, None), (None, 7.0), (None, 7.0)], "id long, a double")
    assert sorted(str(r.a__shuffled) for r in attribution.shuffled(odd, ["a"], "id").collect()) == ["5.0", "7.0", "7.0", "None"]
    assert attribution.shuffled(odd.limit(0), ["a"], "id").count() == 0


def test_drift_report(spark, rows, tmp_path):
    shifted = rows.withColumns({"attendance_pct": F.col("attendance_pct") - 10, "study_hours_wk": F.col("study_hours_wk") - 2,
                                "school_type": F.when(F.xxhash64(KEY) % 10 < 3, "Charter").otherwise(F.col("school_type"))})
    model = models.fit(rows, models.logistic)
    report = flows.drift_report(rows, shifted, model, str(tmp_path))
    flagged = {r.feature for r in report.features.filter("drift_detected").collect()}
    assert flagged == {"attendance_pct", "study_hours_wk", "school_type"}
    row = report.summary.first()
    assert (row.total_features, row.features_with_drift) == (13, 3)
    assert report.needs_attention == (row.significant_drift or row.performance_degradation)
    assert spark.read.json(f"{tmp_path}/features").count() == 13
    numbers, bars = drift.drift_visuals(drift.tag_sides(rows, shifted), report.features, 2)
    shown = {r.feature for part in (numbers, bars) for r in part.select("feature").distinct().collect()}
    assert shown == {r.feature for r in drift.top_drifted(report.features, 2).collect()}
    assert drift.performance_drift(rows.select(F.lit("current").alias("side"))).first().error == "No labels available"


def test_explore_tables(rows):
    out = flows.explore(rows)
    assert out["overview"].first().n_rows == rows.count()
    assert out["leakage_names"].count() == 0
    assert out["correlations"].count() == 45
