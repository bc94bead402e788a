"""Means at a limit do not depend on the order of rows; tables that only look generated are read."""

import random

from pyspark.sql import functions as F

from plumbgrid.operators import gates
from plumbgrid.plans import catalog


def test_mean_at_a_limit(spark):
    values = [k / 100 for k in range(11)] * 200  # the mean is 0.05, and 60 times that is 3
    found = set()
    for seed in range(4):
        random.Random(seed).shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
        found.add(df.agg(gates.exact_mean("v")).first()[0])
    assert found == {0.05}
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double").agg(gates.exact_mean("v").alias("m"))
    assert odd.select(F.isnan("m")).first()[0]
    assert spark.createDataFrame([], "v double").agg(gates.exact_mean("v")).first()[0] is None


def test_median_of_a_frame_is_no_aggregate_of_one_task(spark, data, monkeypatch):
    from plumbgrid.operators import quantiles

    want = catalog.QUERIES["covariance_frame"](spark, data).first()
    monkeypatch.setattr(quantiles.exact_quantiles, "__defaults__", (0.5, 100))
    found = catalog.QUERIES["covariance_frame"](spark, data)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.first() == want and "median" not in plan and "percentile" not in plan


def test_meshes_are_read_from_their_table(spark, data):
    for name in ("mesh_reindex", "mesh_stats"):
        plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "Range (" not in plan and "o_custkey" in plan
