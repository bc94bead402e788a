import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbgrid.sinks import files as sinks
from plumbgrid.sources import files, matchdb, ply, sparse
from plumbgrid.streaming import events


def test_ply_round_trip_and_ranges(spark, tmp_path):
    p = str(tmp_path / "a.ply")
    df = spark.range(1000).select(F.col("id").alias("point_id"), F.col("id").cast("double").alias("x"), F.lit(0.01).alias("y"), F.lit(3300000.01).alias("z"), F.lit(255).alias("r"), F.lit(20).alias("g"), F.lit(30).alias("b"))
    assert sinks.write_ply(df, p, ("note é",)) == 1000
    back = ply.colored_points(ply.read_ply(spark, p, 300))
    assert back.rdd.getNumPartitions() == 4
    rows = back.orderBy("point_id").collect()
    assert len(rows) == 1000 and tuple(rows[999]) == (999, 999.0, 0.01, 3300000.01, 255, 20, 30)
    assert ply.read_ply_files(spark, str(tmp_path)).count() == 1000 and ply.counts(p) == (1000, 0)


def test_fused_crlf_header_and_refusals(spark, tmp_path):
    head = "\r\n".join(["ply", "format binary_little_endian 1.0", "element vertex 2"] + [f"property {'float' if t == '<f4' else 'uchar'} {c}" for c, t in ply.FUSED] + ["end_header"]) + "\r\n"
    data = np.zeros(2, dtype=ply.FUSED)
    data["x"], data["red"] = [1, 2], [10, 20]
    (tmp_path / "f.ply").write_bytes(head.encode() + data.tobytes())
    assert data.dtype.itemsize == 27
    got = ply.read_ply(spark, str(tmp_path / "f.ply")).orderBy("point_id").collect()
    assert [(r["x"], r["red"]) for r in got] == [(1.0, 10), (2.0, 20)]
    ply.read_layout(str(tmp_path / "f.ply")).require_fused()
    with pytest.raises(ValueError):
        ply.Layout(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int x\nend_header\n")
    a = ply.parse_ply(b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty uchar red\nend_header\n1.5 7\n2.5 8\n")
    assert a["x"].tolist() == [1.5, 2.5] and a["red"].tolist() == [7, 8]


def test_sparse_text(spark, tmp_path):
    (tmp_path / "images.txt").write_text("# head\n1 1 0 0 0 1 2 3 1 a b.jpg\n0 0 5 1 1 -1 2 2 5 3 3 7\n2 1 0 0 0 0 0 0 1 c.jpg\n\nbroken line\n3 1 0 0 0 0 0 0 1 d.jpg\n1 1 9\n")
    v = {r["name"]: r for r in sparse.read_sparse_views(spark, str(tmp_path / "images.txt")).collect()}
    assert set(v) == {"a b.jpg", "c.jpg", "d.jpg"} and v["a b.jpg"]["point_ids"] == [5, 7] and v["c.jpg"]["point_ids"] == [] and (v["a b.jpg"]["x"], v["a b.jpg"]["z"]) == (-1.0, -3.0)
    (tmp_path / "points.txt").write_text("# c\n1 0 0 0 1 2 3 0.5 1 2 3 4\n2 nan 0 0 1 2 3 0.5\nshort\n3 1 1 1 1 2 3 1.5\n")
    p = sparse.read_sparse_points(spark, str(tmp_path / "points.txt")).orderBy("point_id").collect()
    assert [(r["point_id"], r["error"], r["track_length"]) for r in p] == [(1, 0.5, 2), (3, 1.5, 0)]
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 12))
    assert sparse.registered_count(spark, binary_path=str(tmp_path / "images.bin")) == 12


def test_match_database(spark, tmp_path):
    db = str(tmp_path / "m.db")
    c = sqlite3.connect(db)
    c.execute("CREATE TABLE images (image_id INTEGER, camera_id INTEGER, name TEXT)")
    c.execute("CREATE TABLE descriptors (image_id INTEGER, type INTEGER, rows INTEGER, cols INTEGER, data BLOB)")
    c.execute("CREATE TABLE pose_priors (corr_data_id INTEGER, position BLOB, coordinate_system INTEGER)")
    c.execute("CREATE TABLE two_view_geometries (pair_id INTEGER, rows INTEGER)")
    c.executemany("INSERT INTO images VALUES (?, 1, ?)", [(1, "a"), (2, "b")])
    c.execute("INSERT INTO descriptors VALUES (1, 1, 2, 8, ?)", (np.array([[1, 2], [3, 4]], "<f4").tobytes(),))
    c.execute("INSERT INTO descriptors VALUES (2, 0, 1, 3, ?)", (b"xy",))
    c.execute("INSERT INTO pose_priors VALUES (1, ?, 1)", (np.array([1, 2, 3], "<f8").tobytes(),))
    c.execute("INSERT INTO pose_priors VALUES (2, ?, 0)", (np.array([0, 0, 0], "<f8").tobytes(),))
    c.execute("INSERT INTO two_view_geometries VALUES (?, 30)", (1 * 2147483647 + 2,))
    c.commit()
    c.close()
    assert matchdb.read_images(spark, db).count() == 2
    assert [r["d"] for r in matchdb.read_descriptors(spark, db).collect()] == [[1.0, 2.0], [3.0, 4.0]]
    pri = {r["image_id"]: r["x"] for r in matchdb.read_pose_priors(spark, db).collect()}
    assert pri[1] == 1.0 and pri[2] == pytest.approx(6378137.0)
    assert tuple(matchdb.read_pairs(spark, db).first()) == (1, 2, 30)
    assert matchdb.read_pairs(spark, db, "matches").count() == 0 and matchdb.table_count(spark, db, "nothing") == 0


def test_control_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿point_id,role,model_x,model_y,model_z,x,y,z,longitude,latitude,height,sigma_x,sigma_y,sigma_z,target_crs\na,control,1,2,3,10,20,30,,,,0.1,0.1,0.2,X\nb,检查点,1,2,3,,,,120,30,5,0.1,,,\nc,,,2,3,1,1,1,,,,,,,\nd,check,1,2,3,,,,500,30,5,,,,\n")
    r = {x["point_id"]: x for x in files.read_control_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert (r["a"]["tx"], r["a"]["sz"], r["a"]["problem"]) == (10.0, 0.2, None)
    assert (r["b"]["role"], r["b"]["tx"], r["b"]["sx"], r["b"]["geographic"]) == ("check", 120.0, None, True)
    assert r["c"]["problem"] == "no model coordinates" and r["d"]["problem"] == "position out of range"
    with pytest.raises(ValueError):
        files.check_mixing(files.read_control_csv(spark, str(tmp_path / "c.csv")))


def test_dense_maps(spark, tmp_path):
    for folder in ("depth_maps", "normal_maps"):
        (tmp_path / folder).mkdir()
    good = b"3&2&1&" + b"\0" * 24
    (tmp_path / "depth_maps/a.jpg.photometric.bin").write_bytes(good)
    (tmp_path / "normal_maps/a.jpg.photometric.bin").write_bytes(b"3&2&3&" + b"\0" * 72)
    (tmp_path / "depth_maps/b.jpg.photometric.bin").write_bytes(good)
    (tmp_path / "depth_maps/c.jpg.photometric.bin").write_bytes(b"x")
    names = spark.createDataFrame([("a.jpg",), ("b.jpg",), ("c.jpg",)], "name string")
    assert sorted(r["name"] for r in files.pending_maps(names, files.dense_maps(spark, str(tmp_path), "photometric")).collect()) == ["b.jpg", "c.jpg"]


def test_configs_caches_and_discovery(spark, tmp_path):
    (tmp_path / "pm.cfg").write_text("﻿a.jpg\nb.jpg, c.jpg\nb.jpg\na.jpg\n", encoding="utf-8")
    got = files.read_name_source_pairs(files.read_numbered_lines(spark, str(tmp_path / "pm.cfg")))
    assert {r["name"]: r["sources"] for r in got.collect()} == {"a.jpg": ["b.jpg", "c.jpg"], "b.jpg": ["a.jpg"]}
    files.write_cache(spark.range(3).toDF("v"), str(tmp_path / "cache"), "abc")
    assert files.reusable_cache(spark, str(tmp_path / "cache"), "abc").count() == 3 and files.reusable_cache(spark, str(tmp_path / "cache"), "x") is None
    (tmp_path / "photos/sub").mkdir(parents=True)
    for n in ("photos/B.JPG", "photos/sub/a.png", "photos/readme.txt"):
        (tmp_path / n).write_bytes(b"1")
    assert [r["path"].rsplit("/", 1)[1] for r in files.discover_photos(spark, str(tmp_path / "photos")).collect()] == ["B.JPG", "a.png"]


def test_exports(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("point_id"), *[(F.col("id") + 0.0004).alias(c) for c in "xyz"], *[F.lit(1).alias(c) for c in "rgb"])
    doc = sinks.accuracy_document("<b>", {"scale": 1.0}, {"n": 3, "rmse_3d": 0.1}, None, "weak; few")
    made = sinks.export_project(df, str(tmp_path / "out"), doc, calibrated=False)
    assert "points.las" not in made and (tmp_path / "out/export.zip").exists()
    page = (tmp_path / "out/report.html").read_text()
    assert "&lt;b&gt;" in page and "<h2>Control points" in page and "<h2>Check points" not in page
    assert sinks.write_las(df, str(tmp_path / "a.las")) == 10
    raw = (tmp_path / "a.las").read_bytes()
    assert raw[:4] == b"LASF" and len(raw) == 227 + 340 and struct.unpack("<i", raw[227 + 34 : 227 + 38])[0] == 1000
    d = spark.createDataFrame([("l", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 2.0, "tape")], "label string, ax double, ay double, az double, bx double, by double, bz double, actual double, source string")
    o = spark.createDataFrame([("p", "control", "X", *[0.0] * 6, None, None, None)], "point_id string, role string, crs string, mx double, my double, mz double, tx double, ty double, tz double, sx double, sy double, sz double")
    rows = sinks.constraint_rows(d, o).collect()
    assert len(rows) == 3 and len(rows[0]) == 17 and [r["metres"] for r in rows] == ["2.0", None, None]


def test_event_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"type":"progress","time":0,"value":1}\n{"type":"progress","time":30,"value":3}\nplain text\n{"type":"result","time":70}\n')
    s = events.rollup(events.read_event_stream(spark, str(tmp_path / "in")), "type", "value")
    q = s.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["type"], r["n"]) for r in spark.table("rolled").collect()}
    assert ("progress", 2) in got and ("result", 1) in got


def test_mesh_files(spark, tmp_path):
    from plumbgrid.sinks import files as sinks

    v = spark.createDataFrame([("b", i, float(i), 0.5, -1.0, 0.25, 0.75, 0.0, 0.0, 1.0) for i in range(4)], "block string, id int, x double, y double, z double, u double, v double, nx double, ny double, nz double")
    f = spark.createDataFrame([("b", 0, 0, 1, 2), ("b", 1, 1, 2, 3)], "block string, face_id int, a int, b int, c int")
    read = lambda p: [x for q in sorted(__import__("glob").glob(f"{p}/part-*")) for x in open(q).read().splitlines()]
    lines = read(sinks.export_mesh(v, f, str(tmp_path), "obj", texture="t.png"))
    assert lines[:2] == ["mtllib surface.mtl", "usemtl surface"] and lines[2] == "v 0.000000 0.500000 -1.000000"
    assert lines[-2:] == ["f 1/1/1 2/2/2 3/3/3", "f 2/2/2 3/3/3 4/4/4"] and sum(x.startswith("vt ") for x in lines) == 4 and sum(x.startswith("vn ") for x in lines) == 4
    assert "map_Kd t.png" in read(tmp_path / "mtl")
    bare = sinks.obj_lines(v.select("block", "id", "x", "y", "z"), f).where("kind = 1").select("line").collect()
    assert {r["line"] for r in bare} == {"f 1 2 3", "f 2 3 4"}
    scene = read(sinks.export_mesh(v, f, str(tmp_path), "fbx"))
    text = "\n".join(scene)
    assert text.count("{") == text.count("}") and "Vertices: *12 { a: " in text and "PolygonVertexIndex: *6 { a: " in text
    at = scene.index("    } PolygonVertexIndex: *6 { a: ")
    assert scene[at - 1] == "3.000000,0.500000,-1.000000" and scene[at + 1 : at + 3] == ["0,1,-3,", "1,2,-4"]


def test_progress_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, rows in enumerate([[("t", 1, 10.0), ("t", 2, 30.0), ("u", 1, 5.0)], [("t", 3, 20.0), ("u", 2, 50.0)]]):
        spark.createDataFrame(rows, "task string, seq int, value double").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    s = spark.readStream.schema("task string, seq int, value double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = events.monotone_progress(s).writeStream.format("memory").queryName("progress_rows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["task"], r["progress"]) for r in spark.table("progress_rows").collect()} == {("t", 30.0), ("u", 50.0)}


def test_workspaces_are_cleared_on_request(spark):
    from plumbgrid import workspace

    ws = workspace.Workspace(spark, "t")
    assert ws.keep(spark.range(3).toDF("id"), "a").count() == 3 and ws.size("a") > 0
    workspace.clear(spark)
    with pytest.raises(Exception):
        ws.size("a")
