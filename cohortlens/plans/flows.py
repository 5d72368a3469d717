"""The stages a user runs, each from tables to tables: ingest, explore, train, tune, evaluate, score, watch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from cohortlens.operators import attribution, calibrate, drift, metrics, models, profile, project, quality, risk
from cohortlens.operators.split import sample_n
from cohortlens.schema import (CATEGORICAL_FEATURES, ENTITY_SCHEMA, HIGH_CORRELATION, KEY, LABEL, MAX_MISSING_RATE,
                               NON_NEGATIVE_RULES, NUMERIC_FEATURES, RANGE_RULES, TARGETS)
from cohortlens.session import materialize
from cohortlens.sources import artifacts, files


@dataclass
class Ingested:
    """Stored table with what the checks found."""

    table: DataFrame
    duplicates: int
    unconverted: list[str]
    high_missing: DataFrame
    issues: DataFrame
    summary: DataFrame


def ingest(spark: SparkSession, csv_path: str, out_path: str) -> Ingested:
    """Read a CSV, check it, drop repeated keys and store it as Parquet. Issues are reported, not fatal.

    The CSV's rows are read once: what does not convert is counted while they are staged as text, and issues, missing
    shares and the summary while the table is written.
    """
    text = quality.require_columns(files.read_csv(spark, csv_path, _header_schema(spark, csv_path)))
    staging, writing = Observation("staging"), Observation("writing")
    staged = materialize(text.observe(staging, *quality.cast_checks(text)), "staged")
    unconverted = [f.name for f in ENTITY_SCHEMA.fields if staging.get.get(f"bad_{f.name}", 0) > 0]
    raw = files.nan_to_null(quality.cast_all(staged, unconverted))
    duplicates = quality.duplicate_key_count(raw, [KEY]).first()["n_duplicates"]
    order = [c for c in ENTITY_SCHEMA.names if c != KEY]
    unique = quality.keep_first(raw, [KEY], order) if duplicates else raw
    # A column kept as text cannot be compared with bounds.
    rules = [r for r in (*RANGE_RULES, *NON_NEGATIVE_RULES) if r[0] not in unconverted]
    checks = [*quality.missing_checks(unique.columns), *quality.rule_checks(rules), *quality.summary_checks(unique.columns)]
    files.write_parquet(unique.observe(writing, *checks), out_path)
    table = files.read_parquet(spark, out_path)
    seen = spark.createDataFrame([tuple(writing.get.values())], table.limit(0).agg(*checks).schema)
    summary = seen.select(*quality.ingest_summary(table.limit(0)).columns)
    high = quality.missing_rates(seen, unique.columns).filter(F.col("missing_rate") > MAX_MISSING_RATE)
    issues = quality.rule_counts(seen, rules).filter("n_bad > 0").select("issue", "n_bad")
    return Ingested(table, duplicates, unconverted, high, issues, summary)


def _header_schema(spark: SparkSession, path: str):
    """All columns of the header as text, whatever their order."""
    from pyspark.sql import types as T

    names = spark.read.option("header", True).csv(path).columns
    return T.StructType([T.StructField(c, T.StringType()) for c in names])


def explore(df: DataFrame) -> dict[str, DataFrame]:
    """Profile, balance, leakage and correlation tables of an entity table."""
    features = [c for c in df.columns if c not in TARGETS]
    numeric = project.numeric_columns(df.select(*features))
    texts = [c for c in CATEGORICAL_FEATURES if c in features]
    return {
        "overview": profile.overview(df),
        "numeric_summary": profile.numeric_summary(df, numeric),
        "pass_balance": profile.class_balance(df, LABEL),
        "grade_balance": profile.class_balance(df, "final_grade_band"),
        "histograms": profile.histogram(df, numeric),
        "categories": profile.categorical_distributions(df, texts),
        "leakage_correlation": profile.leakage_flags(df, numeric, "final_score"),
        "leakage_names": project.name_flags(df, features).filter("suspicious"),
        "correlations": profile.correlation_matrix(df, numeric),
        "high_correlations": profile.high_correlation_pairs(df, numeric, HIGH_CORRELATION),
        "box_stats": profile.box_stats(df),
    }


def train_baselines(df: DataFrame, model_dir: str, key: str = KEY, builders: dict[str, models.Builder] | None = None,
                    folds: int = 5) -> tuple[DataFrame, str, PipelineModel]:
    """Cross-validate the baselines, refit the best by F1 on all rows and save it.

    Returns the summary of the fold scores, the best model's name and the model.
    """
    builders = builders or models.baselines()
    scores = materialize(models.cross_validate(df, key, builders, folds=folds), "scores")
    name, model = models.fit_best(df, builders, scores)
    artifacts.save_model(model, f"{model_dir}/{artifacts.artifact_name(name)}")
    return metrics.fold_summary(scores), name, model


def tune(df: DataFrame, model_dir: str, key: str = KEY, trials: Sequence[dict] | None = None
         ) -> tuple[DataFrame, dict, calibrate.CalibratedModel]:
    """Sweep the booster, calibrate the best trial over three folds and save model and parameters."""
    trials = list(trials or models.draw_params(30))
    results = materialize(models.sweep(df, key, trials), "trials")
    best = trials[metrics.best_by(results, "trial", "f1").first()["trial"]]
    model = calibrate.fit_calibrated(df, key, models.tuned_booster(best))
    model.save(f"{model_dir}/booster_calibrated")
    files.write_params(df.sparkSession, best, f"{model_dir}/best_params")
    return results, best, model


def evaluate(scored: DataFrame, dimensions: Sequence[str] = tuple(CATEGORICAL_FEATURES), label: str = LABEL
             ) -> dict[str, DataFrame]:
    """All evaluation tables of a scored table (label, probability and group columns)."""
    df = scored.filter(F.col(label).isNotNull()).withColumnRenamed(label, "label")
    dims = [d for d in dimensions if d in df.columns]
    out = {
        "confusion_matrix": metrics.confusion_counts(df),
        "metrics": metrics.binary_metrics(df),
        "classification_report": metrics.classification_report(df),
        "roc_auc": metrics.roc_auc(df),
        "brier_score": metrics.brier_score(df),
        "roc_points": metrics.roc_points(df),
        "pr_points": metrics.pr_points(df),
        "score_density": profile.histogram(df, ["probability"], ["label"]),
        "calibration_curve": metrics.calibration_curve(df),
        "threshold_sweep": metrics.threshold_sweep(df),
    }
    if dims:
        out["fairness"] = metrics.fairness_table(df, dims)
    return out


def importance(df: DataFrame, scorer, key: str = KEY, sample: int | None = None) -> DataFrame:
    """Permutation importance, over the whole table or over a sample of ``sample`` rows."""
    rows = df if sample is None else sample_n(df, key, sample)
    return attribution.permutation_importance(rows, NUMERIC_FEATURES, scorer, LABEL, key)


def score(df: DataFrame, model, key: str = KEY, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Prediction records and the batch summary; ``model`` has ``transform``."""
    out = model.transform(df)
    if out.schema["probability"].dataType.typeName() != "double":
        out = out.withColumn("probability", models.pass_probability())
    return risk.with_risk(out.select(key, "probability"), at=at), risk.batch_summary(out)


def explain(df: DataFrame, model, key: str = KEY) -> DataFrame:
    out = model.transform(df)
    if out.schema["probability"].dataType.typeName() != "double":
        out = out.withColumn("probability", models.pass_probability())
    return risk.explain(out, key)


@dataclass
class DriftReport:
    features: DataFrame
    performance: DataFrame
    summary: DataFrame
    needs_attention: bool


def drift_report(reference: DataFrame, current: DataFrame, model=None, out_path: str | None = None) -> DriftReport:
    """Feature drift, performance drift (given a model and labels) and the flags; optionally stored as JSON."""
    sides = drift.tag_sides(reference, current)
    numeric, texts = drift.feature_kinds(sides)
    features = materialize(drift.drift_table(sides, numeric, texts), "drift")
    performance = None
    if model is not None:
        scored = model.transform(sides)
        if scored.schema["probability"].dataType.typeName() != "double":
            scored = scored.withColumn("probability", models.pass_probability())
        keep = [c for c in ("side", LABEL, "probability") if c in scored.columns]
        # Stored, as rates and AUC both read it.
        performance = drift.performance_drift(materialize(scored.select(*keep), "scored"), LABEL)
        if "error" not in performance.columns:
            performance = materialize(performance, "performance")
    known = performance if performance is not None and "error" not in performance.columns else None
    summary = materialize(drift.drift_summary(features, known), "summary")
    if out_path:
        files.write_report(features, f"{out_path}/features")
        files.write_report(summary, f"{out_path}/summary")
    return DriftReport(features, performance, summary, bool(summary.first()["needs_attention"]))
