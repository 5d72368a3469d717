"""Vectors that do not fit a code are not cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import search


def test_sign_code_lengths(spark):
    def code(vector):
        return spark.createDataFrame([(vector,)], "v array<double>").select(search.sign_code(F.col("v")).alias("c")).first()["c"]

    assert code([1.0, -1.0, 2.0]) == 5 and code([-1.0] * 63 + [1.0]) == -(2**63) and code(None) is None
    with pytest.raises(Exception, match="longer than the 64"):
        code([1.0] * 65)


def test_codes_of_256_bits(spark):
    """Against all distances, with copies, short vectors and a clashing column."""
    random_ = np.random.default_rng(9)
    near = random_.normal(size=(250, 256))
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(near)] + [(1000 + i, [0.5] * 256) for i in range(30)]
    vectors += [(2000, [1.0] * 70), (2001, []), (2002, None), (None, [1.0] * 256)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("Code", F.lit("x"))
    queries = rows.filter("vec_id in (0, 17, 1003, 2000)")
    got = search.top_k(rows, queries, k=9, bits=256).collect()
    code = {i: sum(1 << b for b, x in enumerate(v) if x > 0) for i, v in vectors if i is not None and v is not None}
    for query in (0, 17, 1003, 2000):
        want = sorted(((c ^ code[query]).bit_count(), i) for i, c in code.items())[:9]
        assert [(r.distance, r.neighbour_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == query] == want
    with pytest.raises(Exception, match="longer than the 128"):
        search.top_k(rows, queries, bits=128).collect()
    with pytest.raises(ValueError, match="whole words"):
        search.top_k(rows, queries, bits=100)
    assert search.top_k(rows.limit(0), queries.limit(0), bits=256).count() == 0
