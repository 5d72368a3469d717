"""Queries that fit models, and attribution.

All run at the library's settings, as the flows do; the README has the times of those that boost.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.functions.columns import add_all, one_row_to_long
from cohortlens.operators import attribution, boosting, calibrate, fold_fits, metrics, models, risk, tree_attribution
from cohortlens.operators.features import Preprocessor
from cohortlens.operators.split import with_folds, with_holdout
from cohortlens.plans.catalog import LEARNERS, LINES, query, r6, round_columns, sql_r6
from cohortlens.plans.feature_queries import FIT, FLAGS, LEVELS, prepared, ranked_sql
from cohortlens.plans.metric_queries import auc_sql, hash_sql, metrics_sql
from cohortlens.schema import CATEGORICAL_FEATURES, CLIP_RANGES, LABEL, NUMERIC_FEATURES
from cohortlens.session import materialize
from cohortlens.sources.bindings import learners, scored_lineitem


def holdout_metrics(spark: SparkSession, sf: str, build: models.Builder) -> DataFrame:
    """Fit on the training rows, measure on the others."""
    table = materialize(with_holdout(prepared(spark, sf), LABEL, "k"), "holdout", partition_by="is_test")
    model = models.fit(table.filter("NOT is_test").drop("is_test"), build)
    scored = materialize(models.score(model, table.filter("is_test"), [LABEL]), "scored")
    area = metrics.roc_auc(scored, label=LABEL).select("roc_auc").scalar()
    return metrics.binary_metrics(scored, label=LABEL).withColumn("roc_auc", area)


@query("model_lr")
def q_lr(spark: SparkSession, sf: str) -> DataFrame:
    return holdout_metrics(spark, sf, models.logistic)


@query("model_rf")
def q_rf(spark: SparkSession, sf: str) -> DataFrame:
    return holdout_metrics(spark, sf, lambda n: models.forest())


@query("model_gbt")
def q_gbt(spark: SparkSession, sf: str) -> DataFrame:
    return holdout_metrics(spark, sf, lambda n: models.boosting())


@query("model_svc")
def q_svc(spark: SparkSession, sf: str) -> DataFrame:
    return holdout_metrics(spark, sf, models.linear_svm)


# Gaussian naive Bayes in closed form: preprocessing, means, variances and shares of the training rows, scores of the others.
_inputs = ", ".join(f"""(coalesce(CASE WHEN split.{c} IS NULL THEN NULL ELSE least(greatest(split.{c}, {lo}), {hi}) END, med.{c}) - m_{c})
  / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END""" for c, (lo, hi) in CLIP_RANGES.items() if c in NUMERIC_FEATURES)
_flag_inputs = ", ".join(f"CASE WHEN coalesce(split.{c}, modes.{c}) = '{level}' THEN 1e0 ELSE 0e0 END" for c, level, _ in FLAGS)


# Prepared inputs of all learners, fitted on the training rows, and the same cell by cell.
PREPARED = LEARNERS + f""",
split AS (SELECT *, rk <= floor(0.2 * n + 0.5) AS is_test FROM ({ranked_sql('learners')})),
train AS (SELECT * FROM split WHERE NOT is_test)""" + FIT.replace("FROM learners", "FROM train") + f""",
inputs AS (SELECT split.k AS k, passed, is_test, [{_inputs}, {_flag_inputs}] AS x FROM split, med, modes, stats),
cells AS (SELECT k, passed, is_test, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM inputs)"""


BAYES = PREPARED + f""",
floor AS (SELECT 1e-9 * max(v) AS least FROM (SELECT var_pop(x) AS v FROM cells WHERE NOT is_test GROUP BY i)),
shape AS (SELECT passed AS class, i, avg(x) AS mean, var_pop(x) + any_value(least) AS var FROM cells, floor
  WHERE NOT is_test GROUP BY passed, i),
share AS (SELECT passed AS class, ln(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)) AS share FROM train GROUP BY passed),
logs AS (SELECT k, any_value(passed) AS label, class, any_value(share) - sum((x - mean) * (x - mean) / var + ln(var)) / 2 AS l
  FROM cells JOIN shape USING (i) JOIN share USING (class) WHERE is_test GROUP BY k, class),
apart AS (SELECT k, any_value(label) AS label, sum(CASE class WHEN 1 THEN l ELSE -l END) AS d FROM logs GROUP BY k),
scored AS (SELECT k, label, {sql_r6('1 / (1 + exp(-greatest(least(d, 700.0), -700.0)))')} AS probability FROM apart)
"""


def bayes_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(k, passed, probability) of the held-out learners, by naive Bayes."""
    table = materialize(with_holdout(prepared(spark, sf), LABEL, "k"), "holdout", partition_by="is_test")
    model = models.fit(table.filter("NOT is_test").drop("is_test"), lambda n: models.naive_bayes())
    return materialize(round_columns(models.score(model, table.filter("is_test"), ["k", LABEL]), "probability"), "scored")


@query("naive_bayes_scores", BAYES + "SELECT k, probability FROM scored")
def q_nb_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the held-out learners."""
    return bayes_scores(spark, sf).select("k", "probability")


@query("model_nb", BAYES + f"SELECT m.*, {sql_r6('roc_auc')} AS roc_auc FROM ({metrics_sql('scored')}) m, ({auc_sql('scored')}) a")
def q_nb(spark: SparkSession, sf: str) -> DataFrame:
    scored = bayes_scores(spark, sf)
    area = metrics.roc_auc(scored, label=LABEL).select("roc_auc").scalar()
    out = metrics.binary_metrics(scored, label=LABEL).withColumn("roc_auc", area)
    return round_columns(out, "accuracy", "precision", "recall", "f1", "roc_auc")


@query("score_records", BAYES + f"""SELECT k, probability AS risk_probability, CASE WHEN probability >= 0.8 THEN 'Low Risk'
  WHEN probability >= 0.6 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_level, probability >= 0.5 AS prediction,
  {sql_r6('abs(probability - 0.5) * 2')} AS confidence, TIMESTAMP '2024-01-31 00:00:00' AS timestamp FROM scored""")
def q_records(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction records of the held-out learners."""
    at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    out = risk.with_risk(bayes_scores(spark, sf).select("k", "probability"), at=at).drop("probability")
    return round_columns(out, "confidence")


# The same by folds: medians, levels, moments and classes of the rows outside each fold.
_clipped = ", ".join(f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, {lo}), {hi}) END AS {c}" for c, (lo, hi) in CLIP_RANGES.items()
                     if c in NUMERIC_FEATURES)
_modes = ", ".join(f"""(SELECT t.{c} FROM fold_train t WHERE t.{c} IS NOT NULL AND t.f = fold_list.f
  GROUP BY t.{c} ORDER BY count(*) DESC, t.{c} LIMIT 1) AS mode_{c}""" for c in CATEGORICAL_FEATURES)
_fold_x = ", ".join(f"(coalesce(r.{c}, q_{c}) - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END" for c in NUMERIC_FEATURES)
_fold_flags = ", ".join(f"CASE WHEN coalesce(r.{c}, mode_{c}) = '{level}' THEN 1e0 ELSE 0e0 END" for c, level, _ in FLAGS)
FOLD_SCORES = LEARNERS + f""",
fold_rows AS (SELECT k, passed, (rk - 1) * 5 // n AS fold, {_clipped}, {', '.join(CATEGORICAL_FEATURES)} FROM ({ranked_sql('learners')})),
fold_list AS (SELECT unnest(range(5)) AS f),
fold_train AS (SELECT f, fold_rows.* FROM fold_rows JOIN fold_list ON fold <> f),
fold_med AS (SELECT f, {', '.join(f'quantile_cont({c}, 0.5) AS q_{c}' for c in NUMERIC_FEATURES)} FROM fold_train GROUP BY f),
fold_modes AS (SELECT f, {_modes} FROM fold_list),
fold_stats AS (SELECT t.f AS f, {', '.join(f'avg(coalesce(t.{c}, q_{c})) AS m_{c}, stddev_pop(coalesce(t.{c}, q_{c})) AS s_{c}' for c in NUMERIC_FEATURES)}
  FROM fold_train t JOIN fold_med ON fold_med.f = t.f GROUP BY t.f),
fold_cells AS (SELECT f, k, passed, fold = f AS is_test, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (
  SELECT fold_list.f AS f, r.k AS k, r.passed AS passed, r.fold AS fold, [{_fold_x}, {_fold_flags}] AS x
  FROM fold_rows r, fold_list JOIN fold_med USING (f) JOIN fold_modes USING (f) JOIN fold_stats USING (f))),
fold_floor AS (SELECT f, 1e-9 * max(v) AS least FROM (SELECT f, var_pop(x) AS v FROM fold_cells WHERE NOT is_test GROUP BY f, i) GROUP BY f),
fold_shape AS (SELECT c.f AS f, passed AS class, i, avg(x) AS mean, var_pop(x) + any_value(least) AS var
  FROM fold_cells c JOIN fold_floor ON fold_floor.f = c.f WHERE NOT is_test GROUP BY c.f, passed, i),
fold_share AS (SELECT f, passed AS class, ln(count(*) / CAST(sum(count(*)) OVER (PARTITION BY f) AS DOUBLE)) AS share
  FROM fold_train GROUP BY f, passed),
fold_logs AS (SELECT c.f AS f, k, any_value(passed) AS passed, s.class AS class,
    any_value(share) - sum((x - mean) * (x - mean) / var + ln(var)) / 2 AS l
  FROM fold_cells c JOIN fold_shape s ON s.f = c.f AND s.i = c.i JOIN fold_share h ON h.f = c.f AND h.class = s.class
  WHERE is_test GROUP BY c.f, k, s.class),
fold_scored AS (SELECT f AS fold, k, passed AS label, 1 / (1 + exp(-greatest(least(sum(CASE class WHEN 1 THEN l ELSE -l END), 700.0), -700.0)))
  AS probability FROM fold_logs GROUP BY f, k, passed)
"""


def scored_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Every learner scored by the naive Bayes of the other folds."""
    table = materialize(with_folds(prepared(spark, sf), LABEL, "k"), "folds")
    return fold_fits.naive_bayes_folds(table, "fold", LABEL, NUMERIC_FEATURES, LEVELS)


@query("naive_bayes_folds", FOLD_SCORES + f"SELECT k, fold, {sql_r6('probability')} AS probability FROM fold_scored")
def q_nb_folds(spark: SparkSession, sf: str) -> DataFrame:
    out = scored_by_fold(spark, sf).select("k", F.col("fold").cast("bigint").alias("fold"), "probability")
    return round_columns(out, "probability")


@query("naive_bayes_fold_metrics", FOLD_SCORES + metrics_sql("fold_scored", "fold, "))
def q_nb_fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.binary_metrics(scored_by_fold(spark, sf).withColumn("fold", F.col("fold").cast("bigint")), ["fold"], LABEL)
    return round_columns(out, "accuracy", "precision", "recall", "f1")


# Gradients are whole numbers of a small unit, so sums agree to some seven digits.
_sql_r4 = lambda expr: f"floor(({expr}) * 1e4 + 0.5001) / 1e4"
_r4 = lambda col: F.floor(col * 1e4 + 0.5001) / 1e4
_quantile_ranks = "greatest(1, CAST(ceil(j / 63e0 * n) AS BIGINT))"


# One round of one split: limits of bins, gains of all cuts, and Newton leaves.
@query("booster_stump", PREPARED + f""",
ordered AS (SELECT i, x, row_number() OVER (PARTITION BY i ORDER BY x) AS r, count(*) OVER (PARTITION BY i) AS n,
  max(x) OVER (PARTITION BY i) AS top FROM cells WHERE NOT is_test),
cuts AS (SELECT DISTINCT i, x AS cut FROM ordered JOIN range(63) t(j) ON r = {_quantile_ranks} WHERE x < top),
prior AS (SELECT avg(passed) AS p, count(*) AS n FROM train),
sides AS (SELECT c.i AS i, cut, x <= cut AS below, sum(p - passed) AS g, count(*) AS m
  FROM cells c JOIN cuts ON cuts.i = c.i, prior WHERE NOT is_test GROUP BY c.i, cut, x <= cut),
best AS (SELECT i, cut, sum(g * g / m) AS gain FROM sides GROUP BY i, cut ORDER BY gain DESC, i, cut LIMIT 1),
leaves AS (SELECT s.i AS i, s.cut AS cut, below, -g / (m * p * (1 - p)) AS value, m / CAST(n AS DOUBLE) AS share
  FROM sides s JOIN best ON best.i = s.i AND best.cut = s.cut, prior),
base AS (SELECT sum(value * share) AS v FROM leaves)
SELECT k, {_sql_r4('1 / (1 + exp(-(ln(p / (1 - p)) + value)))')} AS probability, {_sql_r4('value - v')} AS contribution
FROM cells c JOIN leaves l ON l.i = c.i AND (c.x <= l.cut) = l.below, prior, base WHERE is_test""")
def q_stump(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out learners by one tree of one split, and what its feature adds to the margin of each."""
    table = materialize(with_holdout(prepared(spark, sf), LABEL, "k"), "holdout", partition_by="is_test")
    settings = boosting.Settings(rounds=1, depth=1, rate=1.0)
    model = models.fit(table.filter("NOT is_test").drop("is_test"), lambda n: [boosting.Booster(settings, labelCol=LABEL)])
    *prep, booster = model.stages
    rows = table.filter("is_test")
    for stage in prep:
        rows = stage.transform(rows)
    names = [f"f{i}" for i in range(len(NUMERIC_FEATURES) + len(FLAGS))]
    scored = tree_attribution.tree_contributions(booster, booster.transform(rows), names, ["k", "probability"])
    return scored.select("k", _r4(models.pass_probability()).alias("probability"), _r4(add_all(F.col(n) for n in names)).alias("contribution"))


@query("tree_importance")
def q_tree_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Mean absolute contribution of each feature to the tuned booster's margin on held-out learners."""
    table = materialize(with_holdout(prepared(spark, sf), LABEL, "k"), "holdout", partition_by="is_test")
    model = models.fit(table.filter("NOT is_test").drop("is_test"), models.tuned_booster(models.TUNED_DEFAULTS))
    *prep, booster = model.stages
    rows = table.filter("is_test")
    for stage in prep:
        rows = stage.transform(rows)
    names = prep[-1].feature_names()
    return attribution.importance(tree_attribution.tree_contributions(booster, rows, names), names)


@query("isotonic_curve", LINES + f""",
points AS (SELECT probability, sum(label) AS s, count(*) AS n, row_number() OVER (ORDER BY probability) AS i FROM scored GROUP BY probability),
sums AS (SELECT i, sum(s) OVER w - s AS s0, sum(s) OVER w AS s1, sum(n) OVER w - n AS n0, sum(n) OVER w AS n1
  FROM points WINDOW w AS (ORDER BY i ROWS UNBOUNDED PRECEDING)),
spans AS (SELECT a.i AS a, b.i AS b, (b.s1 - a.s0) / CAST(b.n1 - a.n0 AS DOUBLE) AS mean FROM sums a JOIN sums b ON a.i <= b.i),
lows AS (SELECT a, p.i AS i, min(mean) AS mean FROM spans JOIN points p ON a <= p.i AND b >= p.i GROUP BY a, p.i),
fits AS (SELECT i, max(mean) AS fit FROM lows GROUP BY i)
SELECT {sql_r6('probability')} AS score, {sql_r6('fit')} AS calibrated FROM points JOIN fits ON fits.i = points.i""")
def q_isotonic(spark: SparkSession, sf: str) -> DataFrame:
    """The calibration curve at every distinct score: the greatest of the least means over spans around it."""
    rows = scored_lineitem(spark, sf)
    curve = calibrate.fit_curve(rows.select("label", "probability"), "label")
    out = curve.setFeaturesCol("probability").setPredictionCol("calibrated").transform(rows.select("probability").distinct())
    return out.select(r6("probability").alias("score"), r6("calibrated").alias("calibrated"))


@query("model_tuned")
def q_tuned(spark: SparkSession, sf: str) -> DataFrame:
    return holdout_metrics(spark, sf, models.tuned_booster(models.TUNED_DEFAULTS))


@query("cv_scores")
def q_cv(spark: SparkSession, sf: str) -> DataFrame:
    return models.cross_validate(prepared(spark, sf), "k", models.baselines())


@query("holdout_compare")
def q_compare(spark: SparkSession, sf: str) -> DataFrame:
    return models.compare_on_holdout(prepared(spark, sf), "k", models.baselines())


@query("sweep_trials")
def q_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return models.sweep(prepared(spark, sf), "k", models.draw_params(30))


def calibrated(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out learners with the calibrated score of a model that did not see them."""
    table = materialize(with_holdout(prepared(spark, sf), LABEL, "k"), "holdout", partition_by="is_test")
    model = calibrate.fit_calibrated(table.filter("NOT is_test").drop("is_test"), "k", models.tuned_booster(models.TUNED_DEFAULTS))
    return model.transform(table.filter("is_test").drop("is_test")).select("k", LABEL, "probability")


@query("calibrated_scores")
def q_calibrated(spark: SparkSession, sf: str) -> DataFrame:
    return calibrated(spark, sf)


@query("calibrated_rows", LEARNERS + f"""
SELECT k, passed, true AS in_range FROM (SELECT *, rk <= floor(0.2 * n + 0.5) AS is_test FROM ({ranked_sql('learners')})) WHERE is_test""")
def q_calibrated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every held-out learner has one calibrated score, from 0 to 1."""
    inside = F.coalesce(F.col("probability").between(0, 1), F.lit(False))
    return calibrated(spark, sf).select("k", LABEL, inside.alias("in_range"))


@query("score_table")
def q_score(spark: SparkSession, sf: str) -> DataFrame:
    df = prepared(spark, sf)
    model = models.fit(df, models.logistic)
    at = F.lit("2024-01-31 00:00:00").cast("timestamp")
    scored = risk.with_risk(models.score(model, df, ["k"]), at=at)
    return scored.select("k", "risk_probability", "risk_level", "prediction", "confidence", "timestamp")


# Fixed coefficients, so that the contributions have a SQL twin.
COEFFICIENTS = {
    "attendance_pct": 0.15, "study_hours_wk": 0.25, "quiz_avg": 0.15, "assign_avg": 0.15, "midterm": 0.20,
    "on_time_submit_pct": -0.05,
}
_parts = ", ".join(f"{b}::DOUBLE * ({c} - avg({c}) OVER ()) AS {c}" for c, b in COEFFICIENTS.items())
_contributions = LEARNERS + f", parts AS (SELECT k, {_parts} FROM learners)\n"


@query("linear_attribution", _contributions + "SELECT k, " + ", ".join(f"{sql_r6(c)} AS {c}" for c in COEFFICIENTS) + " FROM parts")
def q_linear(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(attribution.linear_contributions(learners(spark, sf), COEFFICIENTS, ["k"]), *COEFFICIENTS)


@query("top_importance", _contributions + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {sql_r6(f'avg(abs({c}))')} AS importance FROM parts" for c in COEFFICIENTS)
    + ") ORDER BY importance DESC, feature LIMIT 5")
def q_importance(spark: SparkSession, sf: str) -> DataFrame:
    parts = attribution.linear_contributions(learners(spark, sf), COEFFICIENTS)
    return round_columns(attribution.importance(parts, list(COEFFICIENTS)).limit(5), "importance")


@query("attribution_one", _contributions + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {sql_r6(c)} AS contribution FROM parts WHERE k = 7" for c in COEFFICIENTS) + ")")
def q_one(spark: SparkSession, sf: str) -> DataFrame:
    """One learner against the means of the whole table."""
    parts = attribution.linear_contributions(learners(spark, sf), COEFFICIENTS, ["k"])
    return round_columns(attribution.waterfall(parts, F.col("k") == 7, list(COEFFICIENTS)), "contribution")


@query("permutation_importance")
def q_permutation(spark: SparkSession, sf: str) -> DataFrame:
    df = prepared(spark, sf)
    model = models.fit(df, models.logistic)
    scorer = lambda frame: models.score(model, frame, ["feature", LABEL])
    return attribution.permutation_importance(df, NUMERIC_FEATURES, scorer, LABEL, "k")


_margin = lambda mixed="": sql_r6(" + ".join(
    f"{b}::DOUBLE * coalesce({'s_' if c == mixed else ''}{c}, 0.0)" for c, b in COEFFICIENTS.items()))
_mixed = ", ".join(
    f"""CASE WHEN row_number() OVER w = count(*) OVER () THEN first_value({c}) OVER (ORDER BY h, k
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE lead({c}) OVER w END AS s_{c}""" for c in COEFFICIENTS)
_variants = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, passed AS label, {_margin(c)} AS probability FROM mixed" for c in ["", *COEFFICIENTS])


@query("permutation_linear", LEARNERS + f""",
mixed AS (SELECT *, {_mixed} FROM {hash_sql('learners', 'k', 42)} WINDOW w AS (ORDER BY h, k)),
variants AS ({_variants}),
areas AS ({auc_sql('variants', 'feature, ')})
SELECT a.feature AS feature, {sql_r6('b.roc_auc - a.roc_auc')} AS importance FROM areas a, areas b
WHERE a.feature <> '' AND b.feature = ''""")
def q_permutation_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Permutation importance of a fixed linear score."""
    margin = r6(add_all(F.lit(b) * F.coalesce(F.col(c), F.lit(0.0)) for c, b in COEFFICIENTS.items()))
    scorer = lambda frame: frame.select("feature", LABEL, margin.alias("probability"))
    rows = learners(spark, sf).select("k", LABEL, *COEFFICIENTS)
    return round_columns(attribution.permutation_importance(rows, list(COEFFICIENTS), scorer, LABEL, "k"), "importance")


_names = [*NUMERIC_FEATURES, *[f"{c}_{level}" for c, level, _ in FLAGS]]
_means = [f"({c} - m_{c}) / s_{c}" for c in NUMERIC_FEATURES] + [
    f"CASE WHEN {c} = '{level}' THEN 1e0 ELSE 0e0 END" for c, level, _ in FLAGS]


@query("feature_names", LEARNERS + FIT + " UNION ALL ".join(
    f"SELECT {i} AS position, '{n}' AS feature, {sql_r6(f'avg({e})')} AS mean FROM filled, stats"
    for i, (n, e) in enumerate(zip(_names, _means))))
def q_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names behind the feature vector, with the mean of each over the table."""
    df = prepared(spark, sf)
    flat = Preprocessor().fit(df).flat(df)
    row = flat.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(flat.columns)])
    return one_row_to_long(row, [
        {"position": F.lit(i), "feature": F.lit(c), "mean": r6(f"m{i}")} for i, c in enumerate(flat.columns)])
