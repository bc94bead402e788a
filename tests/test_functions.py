import hashlib

import pytest
from pyspark.sql import functions as F

from plumbgrid.functions import hashing, scalars


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def mix(x):
    m = 2**64 - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def test_wrapping_words(spark):
    rows = spark.createDataFrame([(v,) for v in (0, 1, -1, 2**62, -(2**63), 123456789)], "v long")
    for r in rows.select("v", hashing.split_mix(F.col("v")).alias("m"), hashing.unsigned_mod(hashing.split_mix(F.col("v")), F.lit(97)).alias("u")).collect():
        assert r["m"] % 2**64 == mix(r["v"] % 2**64) and r["u"] == mix(r["v"] % 2**64) % 97


def test_hash_distance(spark):
    r = one(spark, a=hashing.hash_distance(F.lit("f" * 16), F.lit("0" * 16)), b=hashing.hash_distance(F.lit("8" + "0" * 15), F.lit("0" * 16)), c=hashing.hash_distance(F.lit(""), F.lit("0" * 16)))
    assert tuple(r) == (64, 1, 64)


def test_quick_hash_blocks(spark):
    for size in (0, 10, 65536, 100_000, 300_000):
        data = bytes(i * 7 % 251 for i in range(size))
        places = sorted({0, max(0, size // 2 - 32768), max(0, size - 65536)})
        want = hashlib.sha256(size.to_bytes(8, "little") + b"".join(data[p : p + 65536] for p in places)).hexdigest()
        got = spark.createDataFrame([(data,)], "c binary").select(hashing.quick_hash(F.col("c"))).first()[0]
        assert got == want, size


def test_gps_and_rtk(spark):
    n = lambda v: F.lit(v).cast("double")
    r = one(
        spark, lat=scalars.gps_decimal(n(30), n(15), n(0), F.lit("N")), lon=scalars.gps_decimal(n(120), n(30), n(0), F.lit("W")),
        fix=scalars.rtk_class(F.lit(""), F.lit("50"), n(1), n(1), n(0.00231), n(0.00328), n(0.01001)), flt=scalars.rtk_class(F.lit("rtk"), F.lit(""), n(1), n(1), n(None), n(0.1), n(0.1)), none=scalars.rtk_class(F.lit(None), F.lit(None), n(None), n(1), n(1), n(1), n(1)),
    )
    assert tuple(r) == (30.25, -120.5, "RTK_FIX", "RTK_FLOAT", "NONE")


def test_enu_axes_are_metric(spark):
    n = F.lit
    o = (120.0, 30.0, 100.0)
    e = spark.range(1).select(*scalars.local_enu(n(120.0 + 1e-5), n(30.0), n(100.0), o)).first()
    u = spark.range(1).select(*scalars.local_enu(n(120.0), n(30.0 + 1e-5), n(102.0), o)).first()
    assert 0.9 < e[0] < 1.1 and abs(e[1]) < 1e-3
    assert 1.0 < u[1] < 1.2 and u[2] == pytest.approx(2.0, abs=1e-3)


def test_names_and_pairs(spark):
    lo, hi = scalars.pair_members(scalars.pair_id(F.lit(9), F.lit(4)))
    r = one(spark, norm=scalars.normalized_name(F.lit(".\\..\\a\\b.jpg")), safe=scalars.safe_name(F.lit(' a<>b?. ')), empty=scalars.safe_name(F.lit("...")), lo=lo, hi=hi)
    assert tuple(r) == ("a/b.jpg", "a_b_", "project", 4, 9)


def test_capture_time_and_labels(spark):
    r = one(spark, a=scalars.capture_time(F.lit("2024:05:06 07:08:09")), b=scalars.capture_time(F.lit("nonsense")), c=scalars.orientation_label(F.lit(6)), d=scalars.orientation_label(F.lit(1)), w=scalars.photo_warnings(F.lit(10.0), F.lit(0.2), F.lit(0.0)))
    assert tuple(r) == ("2024-05-06T07:08:09", "", "rotate 90", "", "blurred; too dark")


def test_difference_hash(spark):
    grid = [c for _ in range(8) for c in range(9)]
    assert spark.createDataFrame([(grid,)], "g array<int>").select(hashing.difference_hash(F.col("g"))).first()[0] == "f" * 16


def test_vendor_attribute_and_altitude(spark):
    df = spark.createDataFrame([(b"<x drone:RtkFlag='50' other=\"1\"/>",)], "c binary")
    assert df.select(scalars.vendor_attribute(F.col("c"), "rtkflag")).first()[0] == "50"
    r = one(spark, a=scalars.altitude_reference(F.lit("\x01")), b=scalars.altitude_reference(F.lit(" 1 ")), c=scalars.altitude_reference(F.lit("x")))
    assert tuple(r) == (1, 1, None)


def test_messages(spark):
    r = one(spark, a=scalars.is_out_of_memory(F.lit("CUDA Out Of Memory")), b=scalars.is_retryable_fusion(F.lit("exit 0xC0000017")), c=scalars.is_retryable_texture(F.lit("fine")), t=scalars.telemetry(F.lit("gpu, 5, 1024, 2048, 60"))["used_gb"])
    assert tuple(r) == (True, True, False, 1.0)


def test_position_records(spark):
    rows = [(1, ["10", "30", "0"], "S", ["20", "0", "36"], "E", "12.5", "1"), (2, ["10", "x", "0"], "N", ["20", "0", "0"], "E", "1", "0"), (3, None, None, ["20", "0", "0"], "W", None, None), (4, ["1", "2"], "N", None, None, "5", None)]
    d = spark.createDataFrame(rows, "id int, lat array<string>, lat_ref string, lon array<string>, lon_ref string, alt string, alt_ref string")
    got = {r["id"]: tuple(r["g"]) for r in d.select("id", scalars.gps_record(*[F.col(c) for c in ("lat", "lat_ref", "lon", "lon_ref", "alt", "alt_ref")]).alias("g")).collect()}
    assert got[1] == (-10.5, pytest.approx(20.01), -12.5) and got[2] == got[4] == (None, None, None) and got[3] == (None, -20.0, None)
    head = b"xx drone-dji:GpsLatitude=\"+30.5\" drone-dji:GpsLongitude='120.25' drone-dji:GpsStatus=\"RTK\" drone-dji:RtkStdLon=\"0.01\" drone-dji:RtkStdLat=\"0.02\" drone-dji:RtkStdHgt=\"0.03\" DRONE-DJI:GimbalYawDegree=\"-9\""
    c = spark.createDataFrame([(1, bytearray(head)), (2, bytearray(b"none"))], "id int, content binary")
    r = {x["id"]: x["v"] for x in c.select("id", scalars.vendor_record(F.col("content")).alias("v")).collect()}
    assert (r[1]["lat"], r[1]["lon"], r[1]["yaw"], r[1]["rtk_status"], r[1]["source"]) == (30.5, 120.25, -9.0, "RTK_FIX", "vendor")
    assert r[2]["lat"] is None and r[2]["rtk_status"] == "NONE" and r[2]["source"] == ""
