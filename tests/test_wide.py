"""Many columns and many levels."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens.operators import features, gram, profile


def wide_table(spark, path, rows, columns, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, columns)) + rng.normal(size=(rows, 1))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 1] = 5.0  # constant
    x[:, 2] += 1e9  # large values of little spread
    pq.write_table(pa.table({f"c {i}": pa.array(x[:, i], mask=np.isnan(x[:, i])) for i in range(columns)}), path)
    return spark.read.parquet(path).repartition(3), x


def plain(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    return np.corrcoef(x[both, i], x[both, j])[0, 1]


def test_a_thousand_columns(spark, tmp_path):
    df, x = wide_table(spark, f"{tmp_path}/wide.parquet", 80, 1000, 3)
    rows = gram.correlations(df, df.columns).collect()
    assert len(rows) == 1000 * 999 // 2
    got = {(r.feature_a, r.feature_b): r["corr"] for r in rows}
    assert all(got["c 0" if i == 0 else "c 1", f"c {max(i, 2)}"] is None for i in (1, 5, 900))
    rng = np.random.default_rng(1)
    for i, j in {tuple(sorted(rng.choice(1000, 2, replace=False))) for _ in range(500)} | {(2, 700), (0, 2), (254, 255), (255, 256), (998, 999)}:
        if 1 not in (i, j):
            assert got[f"c {i}", f"c {j}"] == pytest.approx(plain(x, i, j), abs=1e-6)


def test_blocks_equal_expressions(spark, tmp_path):
    df, _ = wide_table(spark, f"{tmp_path}/narrow.parquet", 60, 10, 4)
    names = [c for c in df.columns if c != "c 1"]
    table = lambda out: {(r.feature_a, r.feature_b): r["corr"] for r in out.collect()}
    want = table(profile.correlation_matrix(df.toDF(*[c.replace(" ", "_") for c in df.columns]), [c.replace(" ", "_") for c in names]))
    got = table(gram.correlations(df, names, tile=4))
    assert {(a.replace(" ", "_"), b.replace(" ", "_")): v for (a, b), v in got.items()} == pytest.approx(want, abs=1e-6)
    assert gram.correlations(df.limit(0), names).count() in (0, 36)


def test_a_hundred_thousand_levels(spark, tmp_path):
    df = spark.range(120_000).select(
        F.concat(F.lit("level "), (F.col("id") % 100_000).cast("string")).alias("c"),
        F.when(F.col("id") % 3 > 0, F.lit("a")).otherwise("b").alias("d"), (F.col("id") % 7).cast("double").alias("x"))
    model = features.Preprocessor(numeric=["x"], categorical=["c", "d"]).fit(df)
    model.write().overwrite().save(f"{tmp_path}/prep")
    again = features.PreprocessorModel.load(f"{tmp_path}/prep")
    assert again.feature_names() == ["x", "d_a", "d_b", "c[100000]"]
    ids = spark.read.parquet(model.numbered()["c"]["table"])
    assert ids.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first()[:] == (100_000, 100_000, 0, 99_999)
    odd = df.limit(3).unionByName(spark.createDataFrame([("never seen", "a", 1.0), (None, None, None)], "c string, d string, x double"))
    rows = again.transform(odd).select("c", "features").collect()
    number = {r["value"]: r["id"] for r in ids.filter(F.col("value").isin("level 0", "level 1", "level 2", model.constants()["c"]["mode"])).collect()}
    for r in rows:
        assert r.features.size == 100_003
        own = [i - 3 for i in r.features.indices.tolist() if i >= 3]
        assert own == ([] if r.c == "never seen" else [number[r.c or model.constants()["c"]["mode"]]])
    assert again.transform(df).agg(F.count("features")).first()[0] == 120_000
    with pytest.raises(ValueError, match="too many levels"):
        model.flat(df)


def test_few_levels_stay_columns(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "c string")
    out = features.Preprocessor(numeric=[], categorical=["c"]).fit(df).transform(df)
    assert sorted(map(tuple, (r.v for r in out.select(vector_to_array("features").alias("v")).collect()))) == [(0, 1), (1, 0), (1, 0), (1, 0)]
