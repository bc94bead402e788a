import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbgrid.operators import filters, neighbors, quantiles


def cloud(spark, rows):
    return spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(rows)], "point_id long, x double, y double, z double")


def ids(df):
    return sorted(r["point_id"] for r in df.select("point_id").collect())


def test_finite_drops_nulls_and_infinities(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, None, 2.0, 3.0), (2, float("nan"), 0.0, 0.0), (3, float("inf"), 0.0, 0.0)], "point_id long, x double, y double, z double")
    assert ids(filters.finite_points(df)) == [0]


def test_mad_removes_far_outlier(spark):
    rows = [(i % 10, i // 10, 1) for i in range(99)] + [(1000, 1000, 1000)]
    kept = filters.distance_mad(cloud(spark, rows), 4.0)
    assert kept.agg({"x": "max"}).first()[0] < 100
    few = cloud(spark, rows[-3:])
    assert filters.distance_mad(few, 1.0).count() == 3


def test_voxel_keeps_lowest_id(spark):
    rows = [(0.1, 0, 0), (0.9, 0, 0), (1.2, 0, 0), (1.3, 0, 0), (5, 5, 5)]
    assert ids(filters.voxel_downsample(cloud(spark, rows), 1.0)) == [0, 2, 4]
    assert filters.voxel_downsample(cloud(spark, rows).limit(0), 1.0).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000), st.integers(1, 9))
def test_nearest_matches_brute_force(spark, seed, k):
    rnd = random.Random(seed)
    rows = [tuple(rnd.choice([rnd.gauss(0, 1), rnd.gauss(50, 0.01)]) for _ in range(3)) for _ in range(60)]
    got = {r["point_id"]: r["mean_distance"] for r in neighbors.mean_distance(cloud(spark, rows), k).collect()}
    for i, p in enumerate(rows):
        d = sorted(math.dist(p, q) for j, q in enumerate(rows) if j != i)[:k]
        assert got[i] == pytest.approx(sum(d) / k, rel=1e-9)


def test_radius_counts_and_dense_shortcut(spark):
    rnd = random.Random(3)
    rows = [tuple(rnd.gauss(0, 0.2) for _ in range(3)) for _ in range(150)] + [(9, 9, 9)]
    df = cloud(spark, rows)
    want = [sum(math.dist(p, q) ** 2 <= 0.3**2 for q in rows) for p in rows]
    assert {r["point_id"]: r["n"] for r in neighbors.radius_counts(df, 0.3).collect()} == dict(enumerate(want))
    for m in (1, 5, 20):
        assert ids(filters.radius_outliers(df, 0.3, m)) == [i for i, n in enumerate(want) if n >= m + 1]


def test_statistical_keeps_all_of_few(spark):
    assert filters.statistical_outliers(cloud(spark, [(0, 0, 0), (9, 9, 9)]), 5, 1.0).count() == 2


def test_options_are_checked():
    for bad in ({"voxel_size": -1}, {"statistical_neighbors": 2}, {"radius": 1.0}, {"statistical_std_ratio": 0}, {"max_points": -1}, {"distance_mad_multiplier": -0.1}):
        with pytest.raises(ValueError):
            filters.FilterOptions.from_dict({**bad, "unknown": 1}).validate()


def test_chain_reports_every_stage(spark):
    rows = [(i % 10 * 0.1, i // 10 * 0.1, 0) for i in range(100)] + [(50, 50, 50)]
    left, report = filters.filter_chain(cloud(spark, rows), filters.FilterOptions(distance_mad_multiplier=5.0, voxel_size=0.25, max_points=5))
    assert [s["stage"] for s in report["steps"]] == ["finite", "distance_mad", "voxel", "max_points"]
    assert left.count() == 5 == report["output_point_count"]
    with pytest.raises(ValueError):
        filters.filter_chain(cloud(spark, []), filters.FilterOptions())


def test_core_crop_keeps_four_of_ten(spark):
    eye = [[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]]
    assert ids(filters.core_crop(cloud(spark, [(i, 0, 0) for i in range(10)]), [0, 0, 0], eye, [2, -1, -1], [5, 1, 1])) == [2, 3, 4, 5]


def test_quantiles_agree_on_both_ways(spark):
    rnd = random.Random(1)
    values = [rnd.choice([rnd.gauss(0, 1), 7.0, rnd.expovariate(1e-6)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for q in (0.0, 0.08, 0.5, 0.95, 1.0):
        assert quantiles.exact_quantiles(df, ["v"], q, direct_rows=20)[0] == pytest.approx(quantiles.exact_quantiles(df, ["v"], q)[0])
    assert quantiles.nearest_rank(df, "v", 0.5, direct_rows=20) == sorted(values)[round(499 * 0.5)]


def test_repaired_normals_are_unit(spark):
    rows = [(i, float(i), 0.0, 0.0, 0.0, 0.0, 2.0 if i else 0.0) for i in range(64)]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double, nx double, ny double, nz double")
    got = {r["point_id"]: (r["nx"], r["ny"], r["nz"]) for r in neighbors.repair_normals(df).collect()}
    assert len(got) == 64 and all(n == pytest.approx((0, 0, 1)) for n in got.values())
    lone = neighbors.repair_normals(df.where("point_id = 0")).first()
    assert (lone["nx"], lone["ny"], lone["nz"]) == (0.0, 0.0, 1.0)
