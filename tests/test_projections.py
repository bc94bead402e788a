"""Projections against what defines them: a conformal map whose central meridian has its true length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbgrid.functions import projections as pr
from plumbgrid.operators import session


def forward(spark, crs, rows):
    d = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(rows)], "k int, lon double, lat double")
    return [(r["east"], r["north"]) for r in pr.project(d, pr.projection(crs)).orderBy("k").collect()]


def meridian_arc(lat, a=6378137.0, f=1 / 298.257223563, steps=20001):
    e2, t = f * (2 - f), np.linspace(0, np.radians(lat), steps)
    y = a * (1 - e2) / (1 - e2 * np.sin(t) ** 2) ** 1.5
    h = t[1] - t[0]
    return h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())


def test_central_meridian_has_its_true_length(spark):
    lats = (-79.5, -45.0, 0.0, 10.0, 30.0, 60.0, 84.0)
    for lat, (x, y) in zip(lats, forward(spark, "EPSG:32651", [(123.0, v) for v in lats])):
        assert x == pytest.approx(500000, abs=1e-8) and y == pytest.approx(0.9996 * meridian_arc(lat), abs=1e-6)


def test_map_is_conformal(spark):
    """The Cauchy-Riemann equations in isometric latitude, by central differences."""
    e = pr.projection("32651").eccentricity
    h = 1e-5
    places = [(120.0, 30.0), (126.0, -70.0), (121.5, 5.0), (110.0, 50.0)]
    rows = []
    for lon, lat in places:
        s = np.sin(np.radians(lat))
        step = np.degrees(h * np.cos(np.radians(lat)) * (1 - e * e * s * s) / (1 - e * e))  # of the isometric latitude, to first order
        rows += [(lon + np.degrees(h), lat), (lon - np.degrees(h), lat), (lon, lat + step), (lon, lat - step)]
    got = forward(spark, "32651", rows)
    for k, _ in enumerate(places):
        (x1, y1), (x2, y2), (x3, y3), (x4, y4) = got[4 * k : 4 * k + 4]
        assert (x1 - x2) == pytest.approx(y3 - y4, rel=1e-7) and (y1 - y2) == pytest.approx(-(x3 - x4), rel=1e-6, abs=1e-3)


def test_known_codes_and_refusals(spark):
    assert forward(spark, "EPSG:4549", [(120.0, 0.0)]) == [(500000.0, 0.0)]
    assert forward(spark, "epsg:4528", [(120.0, 0.0)]) == [(40500000.0, 0.0)]
    assert forward(spark, "4498", [(117.0, 0.0)]) == [(20500000.0, 0.0)]
    assert forward(spark, "4502", [(75.0, 0.0)]) == [(500000.0, 0.0)]
    assert forward(spark, "EPSG:32751", [(123.0, 0.0)]) == [(500000.0, 1e7)]
    (x, y), = forward(spark, "EPSG:3857", [(180.0, 85.0511287798066)])
    assert x == pytest.approx(np.pi * 6378137.0) and y == pytest.approx(np.pi * 6378137.0, rel=1e-9)
    for bad in ("EPSG:4326", "EPSG:2154", "32661", "", "UTM 50N"):
        with pytest.raises(ValueError):
            pr.projection(bad)


def test_odd_rows(spark):
    d = spark.createDataFrame([(0, None, 1.0), (1, float("nan"), 1.0), (2, 1.0, 91.0), (3, float("inf"), 0.0), (4, 33.0, 0.0), (5, 123.0, 90.0), (6, 483.0, 1.0), (7, 123.0, 1.0)], "k int, lon double, lat double")
    got = {r["k"]: (r["east"], r["north"]) for r in pr.project(d, pr.projection("32651")).collect()}
    assert all(got[k] == (None, None) for k in (0, 1, 2, 3, 4)) and got[6] == got[7]
    assert got[5][0] == pytest.approx(500000) and got[5][1] == pytest.approx(0.9996 * meridian_arc(90.0), abs=1e-5)
    assert pr.project(d.limit(0), pr.projection("32651")).count() == 0


def test_round_trip_far_from_the_meridian(spark):
    d = spark.range(4000).select("id", (F.pmod(F.col("id") * 7919, F.lit(80000)) / 1000 + 83).alias("lon"), (F.pmod(F.col("id") * 104729, F.lit(178000)) / 1000 - 89).alias("lat"))
    p = pr.projection("EPSG:32651")
    back = pr.unproject(pr.project(d, p), p, lon="lon2", lat="lat2")
    r = back.agg(F.max(F.abs(F.col("lat") - F.col("lat2"))).alias("a"), F.max(F.abs(F.col("lon") - F.col("lon2")) * F.cos(F.radians("lat"))).alias("o"), F.count("lat2").alias("n")).first()
    assert r["n"] == 4000 and r["a"] < 1e-9 and r["o"] < 1e-9


def test_session_projects_control(spark):
    d = spark.createDataFrame([("p", 120.0, 30.0, 12.5)], "point_id string, lon double, lat double, h double")
    r = session.transform_geodetic(d, session.geographic_reference("EPSG:4549")).first()
    assert r["tx"] == pytest.approx(500000) and r["ty"] == pytest.approx(meridian_arc(30.0, f=1 / 298.257222101), abs=1e-6) and r["tz"] == 12.5
    with pytest.raises(ValueError):
        session.transform_geodetic(d, session.geographic_reference("EPSG:4326"))
    with pytest.raises(ValueError):
        session.transform_geodetic(d.withColumn("lon", F.lit(30.0)).withColumn("lat", F.lit(0.0)), session.geographic_reference("EPSG:4549"))
