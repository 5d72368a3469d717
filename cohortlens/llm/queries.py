"""Named queries of the corpus operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm import (bpe, curves, langid, lm, neardup, negatives, packing, phrases, quality, search, sharding, toxicity,
                            urls)
from cohortlens.llm.common import fields, id_fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"),
         urls.Rule("allow", "org", "/fr/")]
SHARDS = 8
QUERY_EVERY = 50
ASK_EVERY, ANCHOR_EVERY = 20, 100


def find_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver did."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, paths) if p)


def query(name: str, oracle: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            find_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    result = quality.judge(docs.select("doc_id", "text"), quality.train(docs, labels))
    return fields(result, ["doc_id"], [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])


_RULE_CASES = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'"
    for r in sorted(RULES, key=lambda r: r.rank, reverse=True))
_VERDICTS = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in RULES)


@query("op3_url_rules", f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM rest),
parts AS (
  SELECT page_id, translate(host, '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM split),
ruled AS (SELECT *, CASE {_RULE_CASES} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE rule {_VERDICTS} ELSE 'allow' END AS verdict FROM ruled""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


@query("url_rules_joined", ORACLES["op3_url_rules"])
def urls_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same verdicts from a table of rules."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return urls.judge_joined(table(spark, sf_dir, "pages"), rules)


@query("op4_hamming_top_k", f"""
WITH bits AS (
  SELECT vec_id, [x > 0 for x in embedding[1:{search.BITS}]] AS bits FROM embeddings),
far AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id,
         len([p for p in list_zip(q.bits, r.bits) if p[1] <> p[2]]) AS distance
  FROM bits q, bits r WHERE q.vec_id % {QUERY_EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM far)
SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= {search.K}""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search.top_k(rows, rows.filter(F.col("vec_id") % QUERY_EVERY == 0))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_near_duplicates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARDS)


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_fold("doc_id", 5) == 0
    result = langid.identify(docs.select("doc_id", "text"), langid.train(docs.filter(~held_out)))
    return fields(result, ["doc_id"], ["lang_pred", "score"]).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_fold("doc_id", 3) == 1
    model = toxicity.train(docs, labels.filter(~held_out))
    result = toxicity.score(docs.select("doc_id", "text"), model)
    return fields(result, ["doc_id"], ["score", "offending"]).withColumns({
        "held_out": F.coalesce(held_out, F.lit(False)), "predicted": (F.col("score") >= toxicity.THRESHOLD).cast("int")})


@query("op10_language_model")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), id_fold("doc_id", 7) != 2)


_USABLE = "len(list_filter({0}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_FLOATS = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


# Exact; the curves find what it finds where their windows are as wide as the table, as on tables of this size.
@query("op11_hilbert_neighbours", f"""
WITH rows AS (
  SELECT vec_id, {_FLOATS} AS v FROM embeddings
  WHERE embedding IS NOT NULL AND {_USABLE.format('embedding')} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_dot_product(q.v, r.v) AS score
  FROM rows q JOIN rows r ON q.vec_id <> r.vec_id WHERE q.vec_id % {ASK_EVERY} = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM near)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {curves.K}""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return curves.search(rows, rows.filter(F.col("vec_id") % ASK_EVERY == 0))


_PAIRS_AND_MORE = " UNION ALL ".join(
    f"SELECT lang, array_to_string(w[i:i+{k - 1}], ' ') AS phrase, {k} AS width FROM placed WHERE i + {k - 1} <= len(w)" for k in (1, 2, 3))
_cut = lambda l, r: f"CAST(floor(1000000::HUGEINT * a * a // ({l}::HUGEINT * {r})) AS BIGINT)"


@query("op12_phrases", f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(coalesce(text, ''),
    '{urls.UPPER}.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9), '{urls.LOWER}' || repeat(chr(10), 9) || ' '), chr(10))) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
runs AS ({_PAIRS_AND_MORE}),
f AS MATERIALIZED (SELECT lang, phrase, any_value(width) AS width, count(*) AS n FROM runs GROUP BY lang, phrase),
totals AS (SELECT lang, count(*) AS n FROM placed GROUP BY lang),
c AS (SELECT lang, phrase, width, n AS a, string_split(phrase, ' ') AS w FROM f WHERE width > 1 AND n >= {phrases.LEAST}),
cuts AS (
  SELECT *, 1 AS cut, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM c
  UNION ALL SELECT *, 2 AS cut, array_to_string(w[1:2], ' ') AS lp, w[3] AS rp FROM c WHERE width = 3),
lefts AS MATERIALIZED (SELECT cuts.*, f.n AS l FROM cuts JOIN f ON f.lang = cuts.lang AND f.phrase = cuts.lp),
one AS (SELECT lefts.*, f.n AS r FROM lefts JOIN f ON f.lang = lefts.lang AND f.phrase = lefts.rp),
scores AS (SELECT *, {_cut('l', 'r')} AS score FROM one),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
around AS (
  SELECT lang, phrase, max(a) AS above FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE width = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE width = 3) GROUP BY lang, phrase),
kept AS (
  SELECT s.* FROM lowest s LEFT JOIN around USING (lang, phrase)
  WHERE s.width = 3 OR above IS NULL OR 100 * above < {phrases.COVERED} * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, totals.n AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {phrases.LIMIT}""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


@query("op13_hard_negatives", f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_USABLE.format('embedding')}),
near AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0),
positives AS (
  SELECT * FROM near WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES}),
windows AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN near n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE {negatives.LOW} * p.score <= 100 * n.score AND 100 * n.score <= {negatives.HIGH} * p.score),
ranked AS (SELECT *, CAST(row_number() OVER (
  PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank FROM windows)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {negatives.NEGATIVES}""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % ANCHOR_EVERY == 0)
