"""Neighbour joins: radius pairs and counts, k nearest neighbours, nearest valid normals.

For a radius, points meet only through equal cells, so all joins are hash or sort-merge equi-joins: the cell edge is the
radius and 27 cells are probed.  The k nearest come from a tree that follows the density.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgrid.workspace import Workspace

XYZ = ("x", "y", "z")


def _cell(edge: float) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(float(edge))) for c in XYZ]


def _probes(edge: float, reach: int = 1) -> Column:
    """The cells around a point's own, as structs."""
    axis = [F.sequence(c - reach, c + reach) for c in _cell(edge)]
    return F.flatten(
        F.transform(axis[0], lambda i: F.flatten(F.transform(axis[1], lambda j: F.transform(axis[2], lambda k: F.struct(i.alias("i"), j.alias("j"), k.alias("k"))))))
    )


def _squared() -> Column:
    return sum(((F.col(f"{c}") - F.col(f"o{c}")) ** 2 for c in XYZ), F.lit(0.0))


def _others(points: DataFrame, edge: float) -> DataFrame:
    return points.select(F.col("point_id").alias("other_id"), *[F.col(c).alias(f"o{c}") for c in XYZ], F.struct(*[c.alias(n) for c, n in zip(_cell(edge), "ijk")]).alias("cell"))


def radius_pairs(points: DataFrame, radius: float, others: DataFrame | None = None) -> DataFrame:
    """Ordered pairs ``point_id, other_id, distance`` within ``radius`` (inclusive); with itself unless ids differ."""
    near = points.select("point_id", *XYZ, F.explode(_probes(radius)).alias("cell"))
    met = near.join(_others(others if others is not None else points, radius), "cell").where(_squared() <= float(radius) ** 2)
    return met.select("point_id", "other_id", F.sqrt(_squared()).alias("distance"))


def radius_counts(points: DataFrame, radius: float) -> DataFrame:
    """``point_id, n``: points within ``radius``, itself included."""
    return radius_pairs(points, radius).groupBy("point_id").agg(F.count("*").alias("n"))


def well_supported(points: DataFrame, radius: float, min_neighbors: int) -> DataFrame:
    """Ids of points with ``min_neighbors`` others within ``radius``.

    Cells of edge ``radius / sqrt(3)`` that hold more points than that settle all their points at once, as no two of
    them are farther apart than the radius; only the others are joined, so dense places cost no pairs among themselves.
    """
    edge = radius / math.sqrt(3.0) * (1 - 1e-12)
    small = points.select("*", F.struct(*[c.alias(n) for c, n in zip(_cell(edge), "ijk")]).alias("small"))
    sizes = small.groupBy("small").agg(F.count("*").alias("held"))
    marked = Workspace(points.sparkSession, "radius").keep(small.join(sizes, "small").select("point_id", *XYZ, "held"), "marked")
    dense = marked.where(F.col("held") > min_neighbors).select("point_id")
    sparse = marked.where(F.col("held") <= min_neighbors)
    counted = radius_pairs(sparse, radius, marked).groupBy("point_id").agg(F.count("*").alias("n"))
    return dense.unionByName(counted.where(F.col("n") > min_neighbors).select("point_id"))


def nearest(points: DataFrame, k: int, others: DataFrame | None = None) -> DataFrame:
    """``point_id, other_id, distance, rank``: the ``k`` nearest other points (ids differ); ties by id.

    With ``others`` the neighbours come from there, whatever their ids.  Fewer than ``k`` candidates give fewer rows.  Points
    are found in a tree that follows the density (:mod:`plumbgrid.operators.point_tree`); ids that are not integers are
    numbered in their order first.
    """
    from plumbgrid.operators.captures import positions
    from plumbgrid.operators.point_tree import nearest_in_tree

    whole = lambda df: dict(df.dtypes)["point_id"] in ("bigint", "int", "smallint", "tinyint")
    if whole(points) and (others is None or whole(others)):
        numbered = lambda df: df.select(F.col("point_id").alias("num"), *XYZ)
        found = nearest_in_tree(numbered(points), k, None if others is None else numbered(others))
        kinds = dict(points.dtypes)["point_id"], dict((points if others is None else others).dtypes)["point_id"]
        return found.select(F.col("num").cast(kinds[0]).alias("point_id"), F.col("other_num").cast(kinds[1]).alias("other_id"), "distance", "rank")
    ws = Workspace(points.sparkSession, "nearest")
    number = lambda df, name: ws.keep(positions(df.select("point_id", *XYZ), "point_id").withColumnRenamed("pos", "num"), name)
    own = number(points, "own")
    pool = own if others is None else number(others, "pool")
    found = nearest_in_tree(own.drop("point_id"), k, None if others is None else pool.drop("point_id"))
    named = found.join(own.select("num", "point_id"), "num").join(pool.select(F.col("num").alias("other_num"), F.col("point_id").alias("other_id")), "other_num")
    return named.select("point_id", "other_id", "distance", "rank")


def mean_distance(points: DataFrame, k: int) -> DataFrame:
    """``point_id, mean_distance`` to the ``k`` nearest others."""
    return nearest(points, k).groupBy("point_id").agg(F.avg("distance").alias("mean_distance"))


def repair_normals(points: DataFrame, k: int = 8) -> DataFrame:
    """Unit normals ``nx, ny, nz`` for all points.

    Valid ones (finite, longer than 1e-8) are normalised.  The others get the normalised mean of the ``k`` nearest
    valid normals if there are three valid ones at all, else the direction from the median of the points, else (0,0,1).
    """
    from plumbgrid.operators.quantiles import exact_quantiles

    ws = Workspace(points.sparkSession, "normals")
    normal = ("nx", "ny", "nz")
    length = F.sqrt(sum((F.col(c).cast("double") ** 2 for c in normal), F.lit(0.0)))
    p = points.withColumn("_len", length)
    p = p.withColumn("_ok", F.coalesce((F.col("_len") > 1e-8) & ~F.isnan("_len") & (F.col("_len") != F.lit(float("inf"))), F.lit(False)))
    p = ws.keep(p, "points")
    good = p.where("_ok").select("point_id", *XYZ, *[(F.col(c) / F.col("_len")).alias(c) for c in normal])
    bad = p.where("not _ok").select("point_id", *XYZ)
    center = exact_quantiles(points, list(XYZ))
    if good.limit(3).count() >= 3:
        near = nearest(bad, k, good).join(good.select(F.col("point_id").alias("other_id"), *normal), "other_id")
        guess = near.groupBy("point_id").agg(*[F.avg(c).alias(f"g{c}") for c in normal])
    else:
        guess = bad.limit(0).select("point_id", *[F.lit(0.0).alias(f"g{c}") for c in normal])
    g_len = F.sqrt(sum((F.col(f"g{c}") ** 2 for c in normal), F.lit(0.0)))
    r = [F.col(c) - F.lit(float(m or 0.0)) for c, m in zip(XYZ, center)]
    r_len = F.sqrt(sum((v**2 for v in r), F.lit(0.0)))
    mended = bad.join(guess, "point_id", "left").select(
        "point_id",
        *[F.when(g_len > 1e-8, F.col(f"g{c}") / g_len).when(r_len > 1e-8, v / r_len).otherwise(F.lit(up)).alias(c) for c, v, up in zip(normal, r, (0.0, 0.0, 1.0))],
    )
    unit = good.select("point_id", *normal).unionByName(mended)
    return p.drop(*normal, "_len", "_ok").join(unit, "point_id")
