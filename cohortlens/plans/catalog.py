"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def r6(col: Column | str) -> Column:
    """Six decimals, written so that any IEEE engine rounds alike.

    The point where rounding turns lies a little off the middle: sums taken in another
    order differ in their last bit, which must not decide a value that ends in 5.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col * 1e6 + 0.5001) / 1e6


def round_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def sql_r6(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5001) / 1e6"


LEARNERS = """
WITH li AS (
  SELECT l_orderkey, avg(l_quantity) AS q, avg(l_discount) AS d, count(*) AS n
  FROM lineitem GROUP BY l_orderkey),
o AS (
  SELECT o_custkey, count(*) AS n_orders,
         avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END) AS f_share,
         avg(CASE WHEN o_orderstatus <> 'P' THEN 1e0 ELSE 0e0 END) AS np_share,
         avg(o_totalprice) AS avg_price, max(o_totalprice) AS max_price,
         avg(q) AS q, avg(d) AS d, sum(n) AS n_lines
  FROM orders LEFT JOIN li ON l_orderkey = o_orderkey GROUP BY o_custkey),
b AS (
SELECT c_custkey AS k,
  CASE WHEN c_custkey % 20 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
  CASE WHEN c_mktsegment IN ('BUILDING','FURNITURE','HOUSEHOLD') THEN 'Public'
       WHEN c_mktsegment = 'MACHINERY' THEN 'Private' ELSE 'Charter' END AS school_type,
  CASE c_nationkey % 5 WHEN 0 THEN 'High School' WHEN 1 THEN 'Some College' WHEN 2 THEN 'Bachelor'
       WHEN 3 THEN 'Master' ELSE 'PhD' END AS parent_edu,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE (c_acctbal + 1000.0) / 2750.0 END AS prior_gpa,
  CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE 100.0 * np_share END AS attendance_pct,
  q AS study_hours_wk, avg_price / 2000.0 AS commute_min,
  2.0 * q + 20.0 AS quiz_avg, 100.0 - 500.0 * d AS assign_avg, max_price / 5000.0 AS midterm,
  100.0 * f_share AS on_time_submit_pct,
  CAST(n_orders AS DOUBLE) AS lms_logins_wk, CAST(n_lines AS DOUBLE) / 10.0 AS forum_posts
FROM customer LEFT JOIN o ON o_custkey = c_custkey),
s AS (SELECT *, prior_gpa * 25 * 0.25 + attendance_pct * 0.15 + study_hours_wk * 2.5 * 0.10
   + quiz_avg * 0.15 + assign_avg * 0.15 + midterm * 0.20 AS raw FROM b),
learners AS (
SELECT k, gender, school_type, parent_edu, prior_gpa, attendance_pct, study_hours_wk, commute_min, quiz_avg,
  assign_avg, midterm, on_time_submit_pct, lms_logins_wk, forum_posts,
  coalesce(raw, 50.0 + k % 40) AS final_score, CAST(coalesce(raw, 50.0 + k % 40) >= 60 AS BIGINT) AS passed FROM s),
students AS (
SELECT printf('STU_%06d', k) AS student_id, gender, school_type, parent_edu, prior_gpa, attendance_pct,
  study_hours_wk, commute_min, quiz_avg, assign_avg, midterm, on_time_submit_pct, lms_logins_wk, forum_posts,
  final_score, CASE WHEN final_score >= 90 THEN 'A' WHEN final_score >= 80 THEN 'B' WHEN final_score >= 70 THEN 'C'
  WHEN final_score >= 60 THEN 'D' ELSE 'F' END AS final_grade_band, passed FROM learners)
"""

DOCUMENTS = """
WITH scored AS (
  SELECT documents.doc_id, CAST(quality AS BIGINT) AS label, least(n_chars, 4000) / 4000.0 AS probability,
         lang, source, CAST(toxic AS BIGINT) AS toxic
  FROM documents JOIN labels ON documents.doc_id = labels.doc_id)
"""

LINES = """
WITH scored AS (
  SELECT *, CAST(l_returnflag = 'R' AS BIGINT) AS label, l_quantity / 50.0 AS probability FROM lineitem)
"""

SIDES = """
WITH sides AS (
  SELECT l_orderkey, l_quantity, l_extendedprice, l_discount + 0.0 AS l_discount, l_tax + 0.0 AS l_tax,
         l_returnflag, l_linestatus, l_shipdate,
         CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN 'current' ELSE 'reference' END AS side
  FROM lineitem)
"""

EVENTS = """
WITH scored AS (
  SELECT event_id, ts, user_id, event_type, least("value", 100.0) / 100.0 AS probability FROM events)
"""
