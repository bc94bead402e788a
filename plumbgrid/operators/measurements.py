"""Lengths, areas, volumes and plane distances of measured points ``seq, x, y, z``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
UNITS = {"distance": "m", "polyline": "m", "area": "m²", "volume": "m³", "plane_spacing": "m"}


def checked(points: DataFrame, least: int) -> DataFrame:
    """The points, if there are enough and all are finite."""
    from plumbgrid.operators.filters import is_finite

    s = points.agg(F.count("*").alias("n"), F.count(F.when(~is_finite(*XYZ), 1)).alias("bad")).first()
    if s["n"] < least:
        raise ValueError(f"{least} points are needed")
    if s["bad"]:
        raise ValueError("coordinates must be finite")
    return points


def polyline_lengths(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Length along ``seq``, of each group of ``by``."""
    order = Window.partitionBy(*(by or [])).orderBy("seq")
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(order)) ** 2 for c in XYZ), F.lit(0.0)))
    return points.withColumn("_s", step).groupBy(*(by or [])).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("length"))


def covariance(points: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, sample covariance and number, as one partial aggregate."""
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    r = points.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in XYZ], *[F.covar_samp(a, b).alias(a + b) for a, b in pairs]).first()
    c = np.zeros((3, 3))
    for (a, b), v in zip(pairs, list(r)[4:]):
        c[XYZ.index(a), XYZ.index(b)] = c[XYZ.index(b), XYZ.index(a)] = v or 0.0
    return np.array(list(r)[1:4], dtype=float), c, r["n"]


def principal_axes(points: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, axes (columns, the normal first and the main one last) and the points' reach across the main axis.

    The main axis comes from the covariance; what is left across it from a second aggregate over centred points, since
    a covariance squares the values and cannot tell a thin strip from a line.  The reach is the root of the summed
    squared distances from the main axis; 0.0 for points that are in line as exactly as their coordinates can say.
    """
    mean, cov, _ = covariance(points)
    main = np.linalg.eigh(cov)[1][:, 2]
    helper = np.eye(3)[int(np.argmin(np.abs(main)))]
    b1 = np.cross(main, helper)
    b1 /= np.linalg.norm(b1)
    b2 = np.cross(main, b1)
    flat = lambda v: sum(((F.col(c) - float(m)) * float(a) for c, m, a in zip(XYZ, mean, v)), F.lit(0.0))
    s = points.select(flat(b1).alias("u"), flat(b2).alias("v"), F.greatest(*[F.abs(c) for c in XYZ]).alias("size"))
    r = s.agg(F.covar_samp("u", "u").alias("uu"), F.covar_samp("u", "v").alias("uv"), F.covar_samp("v", "v").alias("vv"), F.count("*").alias("n"), F.max("size").alias("size")).first()
    values, turn = np.linalg.eigh(np.array([[r["uu"] or 0.0, r["uv"] or 0.0], [r["uv"] or 0.0, r["vv"] or 0.0]]))
    axes = np.column_stack((turn[0, 0] * b1 + turn[1, 0] * b2, turn[0, 1] * b1 + turn[1, 1] * b2, main))
    reach = float(np.sqrt(max(values.sum(), 0.0) * max(r["n"] - 1, 0)))
    # a coordinate is known to half a unit in its last place
    return mean, axes, 0.0 if reach <= max(1e-12, 64 * np.finfo(float).eps * r["size"]) else reach


def polygon_area(points: DataFrame) -> float:
    """Area of the polygon along ``seq`` in its best-fitting plane; points in line are refused.

    The plane comes from two aggregates, the area from each corner and its successor; only the global first corner is
    read to close the ring.
    """
    mean, axes, reach = principal_axes(checked(points, 3))
    if not reach:
        raise ValueError("the points are in line")
    flat = lambda k: sum(((F.col(c) - float(m)) * float(a) for c, m, a in zip(XYZ, mean, axes[:, k])), F.lit(0.0))
    p = points.select("seq", flat(2).alias("u"), flat(1).alias("v"))
    first = p.orderBy("seq").first()
    order = Window.orderBy("seq")  # a polygon's corners, measured by hand
    nu = F.coalesce(F.lead("u").over(order), F.lit(first["u"]))
    nv = F.coalesce(F.lead("v").over(order), F.lit(first["v"]))
    return float(p.select((F.col("u") * nv - nu * F.col("v")).alias("c")).agg(F.abs(F.sum("c")) / 2).first()[0])


def hull_planes(p: np.ndarray) -> list[tuple[int, int, int]]:
    """Outward triangles of the convex hull of few points, built point by point."""
    scale = max(float(np.ptp(p, axis=0).max()), 1e-300)
    eps = 1e-12 * scale
    a = 0
    b = int(np.argmax(np.linalg.norm(p - p[a], axis=1)))
    line = (p[b] - p[a]) / max(np.linalg.norm(p[b] - p[a]), 1e-300)
    off = np.linalg.norm((p - p[a]) - np.outer((p - p[a]) @ line, line), axis=1)
    c = int(np.argmax(off))
    normal = np.cross(p[b] - p[a], p[c] - p[a])
    d = int(np.argmax(np.abs((p - p[a]) @ normal)))
    if off[c] <= eps or abs((p[d] - p[a]) @ normal) <= eps * np.linalg.norm(normal):
        raise ValueError("the points lie in a plane")
    inner = p[[a, b, c, d]].mean(axis=0)

    def outward(i: int, j: int, k: int) -> tuple[int, int, int]:
        return (i, j, k) if np.cross(p[j] - p[i], p[k] - p[i]) @ (p[i] - inner) > 0 else (i, k, j)

    faces = [outward(*f) for f in ((a, b, c), (a, b, d), (a, c, d), (b, c, d))]
    for q in range(len(p)):
        if q in (a, b, c, d):
            continue
        lit = [f for f in faces if np.cross(p[f[1]] - p[f[0]], p[f[2]] - p[f[0]]) @ (p[q] - p[f[0]]) > eps * scale * scale]
        if not lit:
            continue
        edges = {(f[i], f[(i + 1) % 3]) for f in lit for i in range(3)}
        rim = [e for e in edges if (e[1], e[0]) not in edges]
        faces = [f for f in faces if f not in set(lit)] + [outward(i, j, q) for i, j in rim]
    return faces


def convex_hull_volume(points: DataFrame, directions: int = 4096) -> float:
    """Volume of the convex hull.

    Tasks reduce their points to those that can be corners of the hull of their own (each task's hull), so the driver
    gets hull corners only; the hull of hull corners is the hull of all.
    """
    import pandas as pd

    checked(points, 4)

    def corners(batches):
        kept = None
        for b in batches:
            a = b[list(XYZ)].to_numpy(dtype=float)
            a = np.unique(a if kept is None else np.concatenate((kept, a)), axis=0)
            try:
                kept = a[sorted({i for f in hull_planes(a) for i in f})] if len(a) > 4 else a
            except ValueError:  # still flat: nothing can be left out safely but repeats
                kept = a
        if kept is not None and len(kept):
            yield pd.DataFrame(kept, columns=list(XYZ))

    own = points.select(*[F.col(c).cast("double").alias(c) for c in XYZ])
    p = np.unique(own.mapInPandas(corners, "x double, y double, z double").toPandas().to_numpy(), axis=0)
    mid = p.mean(axis=0)
    return float(sum(abs(np.dot(p[i] - mid, np.cross(p[j] - mid, p[k] - mid))) for i, j, k in hull_planes(p)) / 6)


def _plane(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    mean, axes, reach = principal_axes(checked(points, 3))
    if not reach:
        raise ValueError("the points of a plane are in line")
    return mean, axes[:, 0]


def plane_spacing(points: DataFrame, n_first: int) -> float:
    """Distance of two measured planes: the first ``n_first`` points by ``seq`` and the rest; 20 degrees apart at most."""
    rank = F.row_number().over(Window.orderBy("seq"))  # points measured by hand
    p = points.withColumn("_r", rank)
    c1, n1 = _plane(p.where(F.col("_r") <= n_first))
    c2, n2 = _plane(p.where(F.col("_r") > n_first))
    if n1 @ n2 < 0:
        n2 = -n2
    if np.degrees(np.arccos(np.clip(n1 @ n2, -1, 1))) > 20:
        raise ValueError("the planes are not parallel")
    n = (n1 + n2) / np.linalg.norm(n1 + n2)
    return float(abs((c2 - c1) @ n))


def measure(kind: str, points: DataFrame, n_first: int | None = None) -> tuple[float, str]:
    """Value and unit of a measurement."""
    if kind == "distance":
        checked(points, 2)
        return float(polyline_lengths(points.orderBy("seq").limit(2)).first()[0]), UNITS[kind]
    if kind == "polyline":
        return float(polyline_lengths(checked(points, 2)).first()[0]), UNITS[kind]
    if kind == "area":
        return polygon_area(points), UNITS[kind]
    if kind == "volume":
        return convex_hull_volume(points), UNITS[kind]
    if kind == "plane_spacing":
        return plane_spacing(points, n_first or points.count() // 2), UNITS[kind]
    raise ValueError(f"unknown measurement {kind}")
