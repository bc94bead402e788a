"""Text exports of sparse models: views with observations, points, and their quality inputs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbgrid.functions.scalars import camera_center, view_direction

_VIEW = "image_id long, name string, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id long, observations array<long>"


def parse_views(lines: Iterator[str]) -> Iterator[tuple]:
    """Two-line records: a header of ten fields (the name may hold spaces), then observations, which may be blank.

    Every third token of the second line is a point id; ids below zero are no points; repeats count once.  Lines that are
    no header are skipped.
    """
    it = iter(lines)
    for line in it:
        if not line.strip() or line.startswith("#"):
            continue
        p = line.split(None, 9)
        try:
            if len(p) < 10:
                continue
            head = (int(p[0]), p[9].strip(), *map(float, p[1:8]), int(p[8]))
        except ValueError:
            continue
        ids = []
        for token in next(it, "").split()[2::3]:
            try:
                ids.append(int(token))
            except ValueError:
                continue
        yield (*head, list(dict.fromkeys(i for i in ids if i >= 0)))


def read_sparse_views(spark: SparkSession, path: str) -> DataFrame:
    """Views with camera centre ``x, y, z``, direction ``dx, dy, dz`` and ``point_ids``, in file order as ``pos``.

    Records span lines, so each file is one task; exports of many blocks are many files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["value"]:
                rows = list(parse_views(text.splitlines()))
                if rows:
                    f = pd.DataFrame(rows, columns=["image_id", "name", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id", "observations"])
                    yield f.assign(pos=range(len(f)))

    v = spark.read.text(path, wholetext=True).mapInPandas(run, _VIEW + ", pos long")
    q, t = tuple(F.col(c) for c in ("qw", "qx", "qy", "qz")), tuple(F.col(c) for c in ("tx", "ty", "tz"))
    center, direction = camera_center(q, t), view_direction(q)
    return v.select(
        "pos", "image_id", "name", "camera_id", *[c.alias(n) for c, n in zip(center, "xyz")], *[c.alias(f"d{n}") for c, n in zip(direction, "xyz")], F.col("observations").alias("point_ids")
    )


def observations(views: DataFrame) -> DataFrame:
    """``image_id, name, point_id``, one row per view and point."""
    return views.select("image_id", "name", F.explode("point_ids").alias("point_id")).distinct()


def read_sparse_points(spark: SparkSession, path: str) -> DataFrame:
    """``point_id, x, y, z, r, g, b, error, track_length``; comments, short and non-finite lines are left out."""
    p = F.split(F.trim("value"), r"\s+")
    num = lambda k: F.get(p, F.lit(k)).try_cast("double")
    d = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.size(p) >= 8)
    d = d.select(
        F.get(p, F.lit(0)).try_cast("long").alias("point_id"), *[num(k + 1).alias(c) for k, c in enumerate("xyz")], *[F.get(p, F.lit(k + 4)).try_cast("int").alias(c) for k, c in enumerate("rgb")],
        num(7).alias("error"), F.floor((F.size(p) - 8) / 2).cast("int").alias("track_length"),
    )
    ok = F.col("point_id").isNotNull()
    for c in "xyz":
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))
    return d.where(ok)


def require_points(points: DataFrame, least: int = 3) -> DataFrame:
    if points.limit(least).count() < least:
        raise ValueError(f"fewer than {least} sparse points")
    return points


def registered_count(spark: SparkSession, text_path: str | None = None, binary_path: str | None = None) -> int:
    """Registered images: the first 64-bit number of a binary model, else the number of headers of a text model."""
    if binary_path is not None:
        head = spark.read.format("binaryFile").load(binary_path).select(F.substring("content", 1, 8).alias("h")).first()
        if head is not None and len(head["h"]) == 8:
            return int.from_bytes(bytes(head["h"]), "little")
    return read_sparse_views(spark, text_path).count() if text_path else 0
