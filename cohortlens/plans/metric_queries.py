"""Queries for classifier metrics, fairness and model comparison."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.functions.columns import portable_hash
from cohortlens.operators import metrics
from cohortlens.plans.catalog import DOCUMENTS, LINES, query, round_columns, sql_r6
from cohortlens.sources.bindings import scored_documents, scored_lineitem, table

GROUPS = ["lang", "source", "toxic"]


def auc_sql(source: str, by: str = "") -> str:
    """Pairs won by positives over negatives, ties half, from counts per score."""
    part = f"PARTITION BY {by.rstrip(', ')} " if by else ""
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""SELECT {by}CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  sum(pos * (below + neg / 2.0)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS roc_auc FROM (
    SELECT *, CAST(sum(neg) OVER ({part}ORDER BY probability ROWS UNBOUNDED PRECEDING) - neg AS DOUBLE) AS below FROM (
      SELECT {by}probability, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg
      FROM {source} GROUP BY {by}probability)) {group}"""


_hits = ("count(*) FILTER (label = 0 AND probability < 0.5) AS tn, count(*) FILTER (label = 0 AND probability >= 0.5) AS fp, "
         "count(*) FILTER (label = 1 AND probability < 0.5) AS fn, count(*) FILTER (label = 1 AND probability >= 0.5) AS tp")


def metrics_sql(source: str, by: str = "") -> str:
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""SELECT {by}tn + fp + fn + tp AS n, {sql_r6('(tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE)')} AS accuracy,
  {sql_r6('tp / CAST(nullif(tp + fp, 0) AS DOUBLE)')} AS precision, {sql_r6('tp / CAST(nullif(tp + fn, 0) AS DOUBLE)')} AS recall,
  {sql_r6('2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE)')} AS f1
FROM (SELECT {by}{_hits} FROM {source} {group})"""


@query("align_scores", """
SELECT documents.doc_id AS doc_id, lang, source, quality, n_chars FROM documents JOIN labels ON documents.doc_id = labels.doc_id""")
def q_align(spark: SparkSession, sf: str) -> DataFrame:
    """Scores and labels kept in separate tables, aligned by key."""
    documents = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("confusion_matrix", LINES + f"SELECT {_hits} FROM scored")
def q_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_counts(scored_lineitem(spark, sf))


@query("binary_metrics", LINES + metrics_sql("scored"))
def q_binary(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(metrics.binary_metrics(scored_lineitem(spark, sf)), "accuracy", "precision", "recall", "f1")


_zero = lambda a, b: f"coalesce({a} / CAST(nullif({b}, 0) AS DOUBLE), 0.0)"


@query("classification_report", LINES + f""",
c AS (SELECT {_hits} FROM scored),
per AS (
  SELECT '0' AS class, {_zero('tn', 'tn + fn')} AS p, {_zero('tn', 'tn + fp')} AS r, {_zero('2 * tn', '2 * tn + fn + fp')} AS f, tn + fp AS s FROM c
  UNION ALL
  SELECT '1', {_zero('tp', 'tp + fp')}, {_zero('tp', 'tp + fn')}, {_zero('2 * tp', '2 * tp + fp + fn')}, tp + fn FROM c)
SELECT class, {sql_r6('p')} AS precision, {sql_r6('r')} AS recall, {sql_r6('f')} AS f1, s AS support FROM per
UNION ALL SELECT 'macro avg', {sql_r6('avg(p)')}, {sql_r6('avg(r)')}, {sql_r6('avg(f)')}, CAST(sum(s) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', {sql_r6('sum(p * s) / sum(s)')}, {sql_r6('sum(r * s) / sum(s)')}, {sql_r6('sum(f * s) / sum(s)')},
  CAST(sum(s) AS BIGINT) FROM per""")
def q_report(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(metrics.classification_report(scored_lineitem(spark, sf)), "precision", "recall", "f1")


@query("classification_report_by_group", LINES + f""",
c AS (SELECT l_linestatus, {_hits} FROM scored GROUP BY l_linestatus),
per AS (
  SELECT l_linestatus, '0' AS class, {_zero('tn', 'tn + fn')} AS p, {_zero('tn', 'tn + fp')} AS r, {_zero('2 * tn', '2 * tn + fn + fp')} AS f,
    tn + fp AS s FROM c
  UNION ALL
  SELECT l_linestatus, '1', {_zero('tp', 'tp + fp')}, {_zero('tp', 'tp + fn')}, {_zero('2 * tp', '2 * tp + fp + fn')}, tp + fn FROM c)
SELECT l_linestatus, class, {sql_r6('p')} AS precision, {sql_r6('r')} AS recall, {sql_r6('f')} AS f1, s AS support FROM per
UNION ALL SELECT l_linestatus, 'macro avg', {sql_r6('avg(p)')}, {sql_r6('avg(r)')}, {sql_r6('avg(f)')}, CAST(sum(s) AS BIGINT)
  FROM per GROUP BY l_linestatus
UNION ALL SELECT l_linestatus, 'weighted avg', {sql_r6('sum(p * s) / sum(s)')}, {sql_r6('sum(r * s) / sum(s)')},
  {sql_r6('sum(f * s) / sum(s)')}, CAST(sum(s) AS BIGINT) FROM per GROUP BY l_linestatus""")
def q_report_groups(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.classification_report(scored_lineitem(spark, sf), by=["l_linestatus"])
    return round_columns(out, "precision", "recall", "f1")


@query("brier_score", LINES + f"SELECT {sql_r6('avg((probability - label) * (probability - label))')} AS brier_score FROM scored")
def q_brier(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(metrics.brier_score(scored_lineitem(spark, sf)), "brier_score")


@query("roc_auc", LINES + f"SELECT n_pos, n_neg, {sql_r6('roc_auc')} AS roc_auc FROM ({auc_sql('scored')})")
def q_auc(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(metrics.roc_auc(scored_lineitem(spark, sf)), "roc_auc")


_price = "WITH scored AS (SELECT CAST(l_returnflag = 'R' AS BIGINT) AS label, l_extendedprice / 105000.0 AS probability FROM lineitem)"


@query("roc_auc_continuous", _price + f" SELECT n_pos, n_neg, {sql_r6('roc_auc')} AS roc_auc FROM ({auc_sql('scored')})")
def q_auc_continuous(spark: SparkSession, sf: str) -> DataFrame:
    """Nearly every score is distinct, the hard case for the value ranges."""
    df = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("bigint").alias("label"), (F.col("l_extendedprice") / 105000.0).alias("probability"))
    return round_columns(metrics.roc_auc(df), "roc_auc")


@query("roc_auc_by_group", DOCUMENTS + f"SELECT lang, n_pos, n_neg, {sql_r6('roc_auc')} AS roc_auc FROM ({auc_sql('scored', 'lang, ')})")
def q_auc_groups(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(metrics.roc_auc(scored_documents(spark, sf), ["lang"]), "roc_auc")


_curve = """,
counts AS (SELECT probability, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY probability),
run AS (SELECT probability, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM counts WINDOW w AS (ORDER BY probability DESC ROWS UNBOUNDED PRECEDING))
"""


def _roc_sql() -> str:
    return _curve + f"""SELECT {sql_r6('probability')} AS threshold, {sql_r6('CAST(fp AS DOUBLE) / nullif(n, 0)')} AS fpr,
  {sql_r6('CAST(tp AS DOUBLE) / nullif(p, 0)')} AS tpr FROM run"""


@query("roc_points", LINES + _roc_sql())
def q_roc(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(metrics.roc_points(scored_lineitem(spark, sf)), "threshold", "fpr", "tpr")


@query("roc_points_continuous", _price + _roc_sql())
def q_roc_continuous(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("bigint").alias("label"), (F.col("l_extendedprice") / 105000.0).alias("probability"))
    return round_columns(metrics.roc_points(df), "threshold", "fpr", "tpr")


@query("pr_points", DOCUMENTS + _curve + f"""
SELECT {sql_r6('probability')} AS threshold, {sql_r6('CAST(tp AS DOUBLE) / (tp + fp)')} AS precision,
  {sql_r6('CAST(tp AS DOUBLE) / nullif(p, 0)')} AS recall FROM run""")
def q_pr(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(metrics.pr_points(scored_documents(spark, sf)), "threshold", "precision", "recall")


@query("threshold_sweep_f1", LINES + f""",
steps AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(2, 18) t(i)),
hits AS (SELECT threshold, sum(label) AS pos, count(*) FILTER (probability >= threshold) AS pp,
  count(*) FILTER (label = 1 AND probability >= threshold) AS tp FROM scored, steps GROUP BY threshold)
SELECT {sql_r6('threshold')} AS threshold, {sql_r6('2 * tp / CAST(nullif(pp + pos, 0) AS DOUBLE)')} AS f1 FROM hits""")
def q_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(metrics.threshold_sweep(scored_lineitem(spark, sf)), "threshold", "f1")


@query("calibration_curve", DOCUMENTS + f"""
SELECT greatest(CAST(ceil(probability * 10) AS BIGINT) - 1, 0) AS bin, count(*) AS n,
  {sql_r6('avg(CAST(label AS DOUBLE))')} AS fraction_positive, {sql_r6('avg(probability)')} AS mean_probability
FROM scored WHERE doc_id % 17 <> 0 GROUP BY 1""")
def q_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Some scores are blanked; those rows are in no bin."""
    return round_columns(metrics.calibration_curve(blanked(scored_documents(spark, sf))), "fraction_positive", "mean_probability")


def blanked(df: DataFrame) -> DataFrame:
    return df.withColumn("probability", F.when(F.col("doc_id") % 17 != 0, F.col("probability")))


def _fairness_sql(dimensions, having: str = "TRUE") -> str:
    long = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS level, label, probability FROM scored WHERE {d} IS NOT NULL AND {having}"
        for d in dimensions)
    return f""",
long AS ({long}),
areas AS ({auc_sql('long', 'dimension, level, ')})
SELECT g.dimension AS dimension, g.level AS level, size, pass_rate, mean_probability,
  {sql_r6('coalesce(roc_auc, 0.0)')} AS roc_auc, brier_score FROM (
  SELECT dimension, level, count(*) AS size, {sql_r6('avg(CAST(label AS DOUBLE))')} AS pass_rate,
    {sql_r6('avg(probability)')} AS mean_probability, {sql_r6('avg((probability - label) * (probability - label))')} AS brier_score
  FROM long GROUP BY dimension, level HAVING count(*) >= 10) g
JOIN areas ON areas.dimension = g.dimension AND areas.level = g.level"""


FAIR = ("pass_rate", "mean_probability", "roc_auc", "brier_score")


@query("fairness_table", DOCUMENTS + _fairness_sql(GROUPS, "doc_id % 17 <> 0"))
def q_fairness(spark: SparkSession, sf: str) -> DataFrame:
    """Some scores are blanked; those rows are in no group."""
    return round_columns(metrics.fairness_table(blanked(scored_documents(spark, sf)), GROUPS), *FAIR)


@query("fairness_table_lineitem", LINES + _fairness_sql(["l_linestatus", "l_returnflag", "l_linenumber"]))
def q_fairness_lines(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.fairness_table(scored_lineitem(spark, sf), ["l_linestatus", "l_returnflag", "l_linenumber"])
    return round_columns(out, *FAIR)


# Three scoring rules stand for three models, five hash folds of the orders for five folds.
RULES = {"by_discount": ("l_discount", 10.0), "by_price": ("l_extendedprice", 1 / 65536), "by_quantity": ("l_quantity", 0.02)}


def fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        (portable_hash(F.col("l_orderkey"), 42) % 5).alias("fold"), (F.col("l_returnflag") == "R").cast("bigint").alias("label"),
        *[(F.col(c) * w).alias(name) for name, (c, w) in RULES.items()])
    long = lines.unpivot(["fold", "label"], list(RULES), "model", "probability")
    scores = metrics.binary_metrics(long, ["model", "fold"])
    return scores.unpivot(["model", "fold"], ["accuracy", "precision", "recall", "f1"], "metric", "score")


_hash = """(SELECT *, (x * x % 2147483647) * (x * x % 2147483647) % 2147483647 * x % 2147483647 AS h FROM (
  SELECT *, ({key} % 2147483647 * 48271 + {seed}) % 2147483647 AS x FROM {source}))"""


def hash_sql(source: str, key: str, seed: int) -> str:
    return _hash.format(source=source, key=key, seed=seed)


_folds = f"""WITH lines AS (SELECT h % 5 AS fold, CAST(l_returnflag = 'R' AS BIGINT) AS label, l_quantity, l_discount, l_extendedprice
  FROM {hash_sql('lineitem', 'l_orderkey', 42)}),
long AS ({' UNION ALL '.join(f"SELECT '{m}' AS model, fold, label, {c} * {w!r}::DOUBLE AS probability FROM lines" for m, (c, w) in RULES.items())}),
hits AS (SELECT model, fold, {_hits} FROM long GROUP BY model, fold),
scores AS (
  SELECT model, 'accuracy' AS metric, (tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE) AS score FROM hits
  UNION ALL SELECT model, 'precision', tp / CAST(nullif(tp + fp, 0) AS DOUBLE) FROM hits
  UNION ALL SELECT model, 'recall', tp / CAST(nullif(tp + fn, 0) AS DOUBLE) FROM hits
  UNION ALL SELECT model, 'f1', 2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE) FROM hits),
summary AS (SELECT model, metric, avg(score) AS mean, stddev_pop(score) AS std FROM scores GROUP BY model, metric)
"""


@query("cv_fold_summary", _folds + f"""SELECT model, metric, {sql_r6('mean')} AS mean, {sql_r6('std')} AS std,
  {sql_r6('std * 2.0')} AS spread FROM summary""")
def q_folds(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(metrics.fold_summary(fold_scores(spark, sf)), "mean", "std", "spread")


@query("model_ranking", _folds + f"""SELECT row_number() OVER (ORDER BY mean DESC, model) AS rank, model, {sql_r6('mean')} AS mean
FROM summary WHERE metric = 'f1'""")
def q_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(metrics.rank_models(metrics.fold_summary(fold_scores(spark, sf))), "mean")


@query("best_model", _folds + f"SELECT model, {sql_r6('mean')} AS mean FROM summary WHERE metric = 'f1' ORDER BY mean DESC, model LIMIT 1")
def q_best(spark: SparkSession, sf: str) -> DataFrame:
    summary = metrics.fold_summary(fold_scores(spark, sf)).filter("metric = 'f1'")
    return round_columns(metrics.best_by(summary, "model", "mean"), "mean")


@query("best_trial", LINES + f""",
steps AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(2, 18) t(i)),
hits AS (SELECT threshold, sum(label) AS pos, count(*) FILTER (probability >= threshold) AS pp,
  count(*) FILTER (label = 1 AND probability >= threshold) AS tp FROM scored, steps GROUP BY threshold),
trials AS (SELECT {sql_r6('threshold')} AS threshold, {sql_r6('2 * tp / CAST(nullif(pp + pos, 0) AS DOUBLE)')} AS f1 FROM hits)
SELECT threshold, f1 FROM trials ORDER BY f1 DESC, threshold LIMIT 1""")
def q_trial(spark: SparkSession, sf: str) -> DataFrame:
    """Each decision threshold is one trial."""
    trials = round_columns(metrics.threshold_sweep(scored_lineitem(spark, sf)), "threshold", "f1")
    return metrics.best_by(trials, "threshold", "f1")
