"""Reader-level pruning of PLY clouds, previews and the parallel record sink, after the reference's preview tests."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plumbgrid.operators import sampling
from plumbgrid.sinks import files as sinks
from plumbgrid.sinks import records
from plumbgrid.sources import ply


def cloud(spark, n, x="cast(id AS double)", y="0.0D"):
    return spark.range(n, numPartitions=5).select(F.col("id").alias("point_id"), F.expr(x).alias("x"), F.expr(y).alias("y"), F.lit(1.0).alias("z"), (F.col("id") % 255).alias("r"), F.lit(20).alias("g"), F.lit(30).alias("b"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("ply") / "cloud")
    assert records.write_cloud(cloud(spark, 10_000), p, ("note é",)) == 10_000
    return p


@pytest.fixture(scope="module")
def single(folder):
    records.join_parts(folder, folder + ".ply")
    return folder + ".ply"


@pytest.mark.parametrize("target,blocks,total", [(150, 10, 10_000), (100, 128, 10_000), (1, 1, 7), (999, 7, 1000), (64 * 40 + 3, 5, 123_457)])
def test_strata_are_the_preview_rows(spark, target, blocks, total):
    s = ply.Strata(total, target, blocks)
    rows, owner = s.rows(0, s.groups)
    want = sorted(r["idx"] for r in sampling.preview_indices(spark, total, target, blocks).collect())
    assert sorted(rows.tolist()) == want and len(rows) == target and (np.diff(owner) >= 0).all()
    halves = np.concatenate([s.rows(a, b)[0] for a, b in ((0, s.groups // 2), (s.groups // 2, s.groups)) if a < b])
    assert (halves == rows).all()


def test_preview_is_distributed_stable_and_not_periodic(spark, folder, single):
    seen = []
    for path in (folder, single, single):
        df, total = ply.preview_ply(spark, path, 100, 10)
        rows = sorted(tuple(r) for r in df.select("point_id", "x", "y", "z", "r", "g", "b").collect())
        x = np.array([r[1] for r in rows])
        assert total == 10_000 and len(rows) == 100 and np.ptp(x) > 9000 and len(np.unique(np.diff(x))) > 5
        assert all(r[4] == r[0] % 255 and r[5:] == (20, 30) for r in rows)
        seen.append(rows)
    assert seen[0] == seen[1] == seen[2]


def test_preview_has_no_scanline_bands(spark, tmp_path):
    p = str(tmp_path / "lines")
    records.write_cloud(cloud(spark, 200_000, "cast(id % 100 AS double)", "cast(floor(id / 100) AS double)"), p)
    df, total = ply.preview_ply(spark, p, 4000)
    assert total == 200_000 and df.count() == 4000 and df.select("y").distinct().count() > 500


def test_small_clouds_and_crlf_headers(spark, tmp_path):
    p = str(tmp_path / "small")
    records.write_cloud(cloud(spark, 2), p)
    df, total = ply.preview_ply(spark, p, 10)
    assert total == 2 and sorted(r["x"] for r in df.collect()) == [0.0, 1.0]
    assert records.write_cloud(cloud(spark, 0), str(tmp_path / "none")) == 0 and ply.read_ply(spark, str(tmp_path / "none")).count() == 0
    head = "\r\n".join(["ply", "format binary_little_endian 1.0", "element vertex 2"] + [f"property {'float' if t == '<f4' else 'uchar'} {c}" for c, t in ply.FUSED] + ["end_header"]) + "\r\n"
    data = np.zeros(2, dtype=ply.FUSED)
    data["x"], data["blue"] = [1, 4], [9, 12]
    (tmp_path / "c.ply").write_bytes(head.encode() + data.tobytes())
    got = sorted(tuple(r) for r in ply.preview_ply(spark, f"file://{tmp_path}/c.ply", 10)[0].select("x", "b").collect())
    assert got == [(1.0, 9), (4.0, 12)]
    (tmp_path / "cut.ply").write_bytes(head.encode() + data.tobytes()[:-1])
    with pytest.raises(Exception, match="cut short"):
        ply.read_ply(spark, str(tmp_path / "cut.ply")).collect()


def test_only_candidate_records_are_read(single):
    """Bytes are counted in the reader: the windows of the strata, not the file."""
    schema = StructType([StructField("point_id", LongType())])
    whole = ply.PlyReader({"path": single}, schema)
    assert sum(b.num_rows for p in whole.partitions() for b in whole.read(p)) == 10_000 and whole.bytes_read == 10_000 * 27
    some = ply.PlyReader({"path": single, "strata": "150", "blocks": "10", "rowsperpartition": "40"}, schema)
    assert len(some.partitions()) > 3
    assert sum(b.num_rows for p in some.partitions() for b in some.read(p)) == 150 and some.bytes_read <= 150 * 8 * 27
    pushed = ply.PushedPlyReader({"path": single}, schema)
    from pyspark.sql.datasource import GreaterThan, In, LessThanOrEqual

    left = list(pushed.pushFilters([GreaterThan(("point_id",), 9_000), LessThanOrEqual(("point_id",), 9_010), GreaterThan(("x",), 9_004.5)]))
    ids = [i for p in pushed.partitions() for b in pushed.read(p) for i in b.column("point_id").to_pylist()]
    assert ids == list(range(9_005, 9_011)) and pushed.bytes_read == 10 * 27 and len(left) == 1
    few = ply.PushedPlyReader({"path": single}, schema)
    assert not list(few.pushFilters([In(("point_id",), (3, 4, 99_999, 700))]))
    assert [i for p in few.partitions() for b in few.read(p) for i in b.column("point_id").to_pylist()] == [3, 4, 700] and few.bytes_read == 3 * 27


def test_columns_and_filters_through_spark(spark, folder, single):
    for path in (folder, single):
        df = ply.read_ply(spark, path, 3000, columns=["x"])
        assert df.columns == ["x"] and df.count() == 10_000 and df.agg(F.sum("x")).first()[0] == 9999 * 5000
    with pytest.raises(Exception, match="no nothing"):
        spark.read.format("ply").schema("nothing double").option("path", single).load().collect()
    spark.conf.set(ply.PUSHDOWN, "true")
    try:
        once = lambda where: ply.read_ply(spark, single, pushdown=True).where(where)
        assert sorted(r["point_id"] for r in once("point_id >= 10 and point_id < 13 and y < 1").collect()) == [10, 11, 12]
        assert once("point_id in (5, 9999, 10000)").count() == 2 and once("x > 9998.0 or point_id = 0").count() == 2
    finally:
        spark.conf.unset(ply.PUSHDOWN)
    part = ply.read_ply(spark, folder, 7, rows=(100, 120))
    assert part.count() == 20 and part.where("point_id = 105").count() == 1 and part.where("point_id < 100").count() == 0


def test_records_of_failed_tasks_are_never_seen(spark, folder, tmp_path):
    p = str(tmp_path / "again")
    w = records.RecordWriter({"path": p, "fields": json.dumps(records.CLOUD)}, True)
    import pyarrow as pa

    batch = lambda lo, n: pa.RecordBatch.from_pydict({"point_id": list(range(lo, lo + n)), **{c: [1.0] * n for c in "xyz"}, **{c: [1] * n for c in ("red", "green", "blue")}})
    lost, second, first, empty = w.write(iter([batch(0, 5)])), w.write(iter([batch(5, 3), batch(8, 1)])), w.write(iter([batch(0, 5)])), w.write(iter([]))
    w.commit([second, empty, first, None])
    said, n = records.manifest(p)
    assert n == 9 and [x["first"] for x in said["parts"]] == [0, 5] and lost.file not in json.dumps(said)
    assert sorted(r["point_id"] for r in ply.read_ply(spark, p).collect()) == list(range(9))
    w.abort([lost])
    assert not (tmp_path / "again" / lost.file).exists()


def test_las_of_64_bit_counts_with_a_coordinate_system(spark, tmp_path):
    p = str(tmp_path / "las")
    df = cloud(spark, 1000, "500000.0D + id * 0.25D")
    assert records.write_las_cloud(df, p, 'PROJCRS["x"]') == 1000
    records.join_parts(p, p + ".las")
    raw = open(p + ".las", "rb").read()
    assert raw[:4] == b"LASF" and raw[24:26] == bytes([1, 4]) and struct.unpack_from("<Q", raw, 247)[0] == 1000 and struct.unpack_from("<I", raw, 107)[0] == 0
    start = struct.unpack_from("<I", raw, 96)[0]
    assert b'PROJCRS["x"]\0' in raw[375:start] and struct.unpack_from("<H", raw, 6)[0] == 16
    a = np.frombuffer(raw[start:], dtype=records.LAS_RECORD)
    assert len(a) == 1000 and a.dtype.itemsize == 36 and (a["ix"] == np.arange(1000) * 250).all() and (a["g16"] == 20 * 257).all() and (a["returns"] == 0x11).all()
    assert struct.unpack_from("<d", raw, 155)[0] == 500_000.0 and struct.unpack_from("<d", raw, 179)[0] == 500_000.0 + 999 * 0.25
    assert records.write_las_cloud(df, p + "2") == 1000 and struct.unpack_from("<I", open(p + "2/header.las", "rb").read(), 100)[0] == 0


def test_fused_parts(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("point_id"), *[(F.col("id") + k).cast("float").alias(n) for k, (n, t) in enumerate(ply.FUSED) if t != "u1"], *[F.lit(k).alias(n) for k, n in enumerate(("red", "green", "blue"))])
    assert records.write_fused_cloud(df, str(tmp_path / "f")) == 100
    ply.read_layout(str(tmp_path / "f")).require_fused()
    records.join_parts(str(tmp_path / "f"), str(tmp_path / "f.ply"))
    sinks.write_fused_ply(df, str(tmp_path / "g.ply"))
    assert (tmp_path / "f.ply").read_bytes() == (tmp_path / "g.ply").read_bytes()


def test_previews_of_nearly_all_points_have_no_repeats(spark, single):
    for most in (4999, 6700):
        ids = [r["point_id"] for r in ply.preview_ply(spark, single, most, 7)[0].select("point_id").collect()]
        assert len(ids) == len(set(ids)) == most
