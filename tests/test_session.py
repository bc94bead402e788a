import pytest
from pyspark.sql import functions as F

from plumbgrid.operators import filters
from plumbgrid.operators.session import Session, condition_points


def square(spark):
    return spark.createDataFrame([(i, float(x), float(y), 0.0) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])], "point_id int, x double, y double, z double")


XYZ2 = "ax double, ay double, az double, bx double, by double, bz double, actual double, label string"
SEEN = "point_id string, mx double, my double, mz double, tx double, ty double, tz double, role string, sx double, sy double, sz double"
EARTH = "point_id string, mx double, my double, mz double, lon double, lat double, h double"


def test_metric_gate_and_scale(spark, tmp_path):
    s = Session(spark, cloud="a")
    line = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0)], "seq int, x double, y double, z double")
    with pytest.raises(ValueError):
        s.measure("distance", line)
    s.add_distances(spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 2.0, "")], XYZ2))
    assert s.constraint_table().first()["label"] == "scale" and s.summary()["distance_constraint_count"] == 1
    assert s.calibrate_scale()["scale"] == 2.0 and s.measure("distance", line)[0] == 2.0
    s.filter_cloud(square(spark), filters.FilterOptions(), str(tmp_path / "c"))
    assert s.has_processed_cloud and s.display_cloud(square(spark)).agg(F.max("x")).first()[0] == 2.0
    s.replace_geometry(cloud="b")
    assert not s.calibrated and s.constraints is None and s.summary()["measurement_count"] == 0


def test_every_problem_is_a_row(spark):
    s = Session(spark, cloud="a")
    bad = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, "same"), (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, -1.0, "short"), (float("nan"), 0.0, 0.0, 1.0, 0.0, 0.0, None, "nan")], XYZ2)
    with pytest.raises(ValueError, match="same: end points coincide"):
        s.add_distances(bad)
    entries = [("", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "control", None, None, None), ("p", 0.0, 0.0, float("inf"), 0.0, 0.0, 0.0, "pilot", 1.0, None, None), ("q", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "CHECK", 1.0, 1.0, -1.0)]
    from plumbgrid.operators import session

    found = session.problems(spark.createDataFrame(entries, SEEN), session._rules()[1], "point_id").collect()
    assert sorted(tuple(r) for r in found) == [
        ("", "point has no name"), ("p", "coordinates are not finite"), ("p", "role is neither control nor check"), ("p", "sigmas are not three positive numbers"),
        ("q", "role is neither control nor check"), ("q", "sigmas are not three positive numbers"),
    ]
    with pytest.raises(ValueError):
        s.add_observations(spark.createDataFrame(entries[:1], SEEN))
    assert s.observations is None
    with pytest.raises(ValueError):
        Session(spark).add_distances(bad)


def test_engineering_calibration_and_checks(spark):
    s = Session(spark, cloud="a")
    model = [(0, 0, 0), (4, 0, 1), (0, 5, 2), (3, 3, -1), (1, 2, 4)]
    rows = [(f" g{i}", *map(float, m), *(2.0 * v + 10 for v in m), "Control", 0.01, 0.01, 0.02) for i, m in enumerate(model)]
    s.add_observations(spark.createDataFrame(rows, SEEN))
    s.add_observations(spark.createDataFrame([("c", 1.0, 1.0, 1.0, 12.0, 12.0, 12.1, "check", None, None, None)], SEEN))
    assert sorted(r["seq"] for r in s.observations.collect()) == list(range(6))
    r = s.calibrate_engineering()
    assert s.transform.scale == pytest.approx(2.0) and r["control"]["rmse_3d"] < 1e-9 and r["check"]["max_3d"] == pytest.approx(0.1) and r["outliers"] == []


def test_geographic_points(spark):
    s = Session(spark, cloud="a")
    rows = [("a", 0.0, 0.0, 0.0, 120.0, 30.0, 100.0), ("b", 1.0, 1.0, 1.0, 120.00001, 30.0, 102.0)]
    s.add_geographic(spark.createDataFrame(rows, EARTH).coalesce(1))
    got = {r["point_id"]: r for r in s.observations.collect()}
    assert tuple(got["a"][c] for c in ("tx", "ty", "tz")) == pytest.approx((0, 0, 0), abs=1e-6) and 0.9 < got["b"]["tx"] < 1.1
    with pytest.raises(ValueError):
        s.add_geographic(spark.createDataFrame(rows[:1], EARTH), target_crs="EPSG:4547")
    with pytest.raises(ValueError):
        s.add_geographic(spark.createDataFrame([("c", 0.0, 0.0, 0.0, 500.0, 30.0, 1.0)], EARTH))


def test_conditioning(spark):
    p = spark.range(64).select(F.col("id").alias("point_id"), F.col("id").cast("double").alias("x"), F.pmod("id", F.lit(8)).cast("double").alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.when(F.col("id") == 5, 0.0).otherwise(1.0).alias("nz"))
    out, report = condition_points(p, 40, 8, 2.0)
    assert 3 <= out.count() <= 40 and report["sampled_point_count"] == 32
