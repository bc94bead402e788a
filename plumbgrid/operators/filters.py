"""Point filters: finite, distance MAD, voxel, statistical, radius, boxes, and the chain that applies them in order.

Points are rows ``point_id, x, y, z, ...``; ``point_id`` is unique and orderable (a struct will do) and stands for the
input order.  Filters keep all columns.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgrid.operators import neighbors
from plumbgrid.operators.quantiles import exact_quantiles
from plumbgrid.workspace import Workspace

XYZ = ("x", "y", "z")
EPS = float(np.finfo(np.float64).eps)


def is_finite(*columns: str) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))
    return ok


def finite_points(points: DataFrame) -> DataFrame:
    return points.where(is_finite(*XYZ))


def distance_mad(points: DataFrame, multiplier: float) -> DataFrame:
    """Keep points whose distance from the per-axis median is at most median + multiplier * 1.4826 * MAD of distances.

    Fewer than ten points, or a multiplier of zero, leave all.
    """
    limit = mad_limit(points, multiplier)
    if limit is None:
        return points
    center, most = limit
    return points.where(_distance(center) <= most)


def _distance(center: list[float]) -> Column:
    return F.sqrt(sum(((F.col(c) - float(m)) ** 2 for c, m in zip(XYZ, center)), F.lit(0.0)))


def mad_limit(points: DataFrame, multiplier: float) -> tuple[list[float], float] | None:
    """Centre and largest distance kept, or None where the filter does not apply."""
    if multiplier <= 0 or points.limit(10).count() < 10:
        return None
    center = exact_quantiles(points, list(XYZ))
    d = points.select(_distance(center).alias("d"))
    middle = exact_quantiles(d, ["d"])[0]
    mad = exact_quantiles(d.select(F.abs(F.col("d") - middle).alias("a")), ["a"])[0]
    return center, middle + multiplier * max(1.4826 * mad, EPS)


def voxel_keys(size: float) -> list[Column]:
    """Voxel coordinates relative to the columns ``ox, oy, oz``."""
    return [F.floor((F.col(c) - F.col(f"o{c}")) / F.lit(float(size))).alias(f"v{c}") for c in XYZ]


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """The point with the smallest id of every occupied voxel; voxels count from the smallest x, y and z present."""
    origin = points.agg(*[F.min(c).alias(f"o{c}") for c in XYZ])
    row = F.struct("point_id", *[F.col(f"`{c}`") for c in points.columns if c != "point_id"])
    cells = points.crossJoin(F.broadcast(origin)).select(row.alias("row"), *voxel_keys(size))  # the origin is one row
    first = cells.groupBy("vx", "vy", "vz").agg(F.min_by("row", F.col("row.point_id")).alias("row"))
    return first.select("row.*").select(*points.columns)


def statistical_outliers(points: DataFrame, k: int, std_ratio: float) -> DataFrame:
    """Keep points whose mean distance to their ``k`` nearest others is within mean + std_ratio * population std.

    Fewer than two others to compare with leave all points.
    """
    n = points.count()
    if min(k + 1, n) <= 2:
        return points
    ws = Workspace(points.sparkSession, "statistical")
    means = ws.keep(neighbors.mean_distance(points, min(k, n - 1)), "means")
    most = means.agg((F.avg("mean_distance") + std_ratio * F.stddev_pop("mean_distance")).alias("most")).first()["most"]
    kept = means.where(F.col("mean_distance") <= most).select("point_id")
    return points.join(kept, "point_id", "left_semi")


def radius_outliers(points: DataFrame, radius: float, min_neighbors: int) -> DataFrame:
    """Keep points with at least ``min_neighbors`` others within ``radius`` (inclusive)."""
    return points.join(neighbors.well_supported(points, radius, min_neighbors), "point_id", "left_semi")


def in_box(lower: list[float], upper: list[float], columns: tuple[str, ...] = XYZ, tolerance: float = 0.0) -> Column:
    ok = F.lit(True)
    for c, a, b in zip(columns, lower, upper):
        ok = ok & F.col(c).between(float(a) - tolerance, float(b) + tolerance)
    return ok


def to_frame(center: list[float], basis: list[list[float]]) -> list[Column]:
    """Coordinates in a frame: ``(p - center) @ basis``, columns of ``basis`` being the axes."""
    d = [F.col(c) - float(m) for c, m in zip(XYZ, center)]
    return [sum((d[i] * float(basis[i][k]) for i in range(3)), F.lit(0.0)) for k in range(3)]


def core_crop(points: DataFrame, center: list[float], basis: list[list[float]], lower: list[float], upper: list[float]) -> DataFrame:
    """Points inside a box of a frame, within 1e-6."""
    local = [c.alias(f"_l{k}") for k, c in enumerate(to_frame(center, basis))]
    return points.select("*", *local).where(in_box(lower, upper, ("_l0", "_l1", "_l2"), 1e-6)).drop("_l0", "_l1", "_l2")


def random_cap(points: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` points: those with the smallest seeded hash of their id.  The order of ids is up to the caller."""
    chosen = points.select("point_id", F.xxhash64(F.lit(seed), F.col("point_id")).alias("h")).orderBy("h", "point_id").limit(most)
    return points.join(chosen.select("point_id"), "point_id", "left_semi")


def require_nonempty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} left")
    return df


@dataclass
class FilterOptions:
    """Zero turns a stage off."""

    distance_mad_multiplier: float = 0.0
    voxel_size: float = 0.0
    statistical_neighbors: int = 0
    statistical_std_ratio: float = 2.0
    radius: float = 0.0
    radius_min_neighbors: int = 0
    max_points: int = 0

    @classmethod
    def from_dict(cls, values: dict | None) -> FilterOptions:
        """Unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (values or {}).items() if k in known})

    def validate(self) -> None:
        rules = {
            "distance_mad_multiplier must not be negative": self.distance_mad_multiplier >= 0,
            "voxel_size must not be negative": self.voxel_size >= 0,
            "statistical_neighbors must be 0 or at least 3": self.statistical_neighbors == 0 or self.statistical_neighbors >= 3,
            "statistical_std_ratio must be positive": self.statistical_std_ratio > 0,
            "radius and radius_min_neighbors must not be negative": self.radius >= 0 and self.radius_min_neighbors >= 0,
            "radius and radius_min_neighbors go together": bool(self.radius) == bool(self.radius_min_neighbors),
            "max_points must not be negative": self.max_points >= 0,
        }
        for message, holds in rules.items():
            if not holds:
                raise ValueError(message)


def filter_chain(points: DataFrame, options: FilterOptions) -> tuple[DataFrame, dict]:
    """Apply the stages in their fixed order: finite, MAD, voxel, statistical, radius, cap.

    Returns the points left and a report with the count before and after each stage that ran.  Every stage is written
    once, so a later one never repeats an earlier one's work.  Raises ``ValueError`` where nothing is left.
    """
    options.validate()
    ws = Workspace(points.sparkSession, "chain")
    steps: list[dict] = []
    start = count = points.count()
    current = points

    def apply(name: str, after: DataFrame, **more: float) -> None:
        nonlocal current, count
        current = ws.keep(after, name)
        left = current.count()
        steps.append({"stage": name, "before": count, "after": left, "removed": count - left, **more})
        count = left

    apply("finite", finite_points(current))
    if not count:
        raise ValueError("no finite points to filter")
    if options.distance_mad_multiplier > 0 and count >= 10:
        center, most = mad_limit(current, options.distance_mad_multiplier)
        apply("distance_mad", current.where(_distance(center) <= most), distance_limit=most)
    if options.voxel_size > 0:
        apply("voxel", voxel_downsample(current, options.voxel_size), voxel_size=options.voxel_size)
    if options.statistical_neighbors > 0 and count >= 4:
        apply("statistical", statistical_outliers(current, options.statistical_neighbors, options.statistical_std_ratio), neighbors=options.statistical_neighbors)
    if options.radius > 0 and options.radius_min_neighbors > 0 and count:
        apply("radius", radius_outliers(current, options.radius, options.radius_min_neighbors), radius=options.radius)
    if options.max_points and count > options.max_points:
        apply("max_points", random_cap(current, options.max_points))
    if not count:
        raise ValueError("the filters left no points")
    report = {"options": asdict(options), "input_point_count": start, "output_point_count": count, "removed_point_count": start - count, "steps": steps}
    return current, report


def chain_report(spark, report: dict) -> DataFrame:
    rows = [(i, s["stage"], s["before"], s["after"], s["removed"]) for i, s in enumerate(report["steps"])]
    return spark.createDataFrame(rows, "step int, stage string, before long, after long, removed long")
