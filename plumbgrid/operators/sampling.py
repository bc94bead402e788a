"""Deterministic samples: strides, even spacing, stratified previews, spatially balanced subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbgrid.functions.hashing import split_mix, unsigned_mod, unsigned_order, word, wrap_add
from plumbgrid.operators.captures import positions
from plumbgrid.operators.filters import XYZ, finite_points
from plumbgrid.operators.quantiles import exact_quantiles
from plumbgrid.sources.ply import JITTER_SEED, PREVIEW_SEED
from plumbgrid.workspace import Workspace

RESOLUTION = 2048
PROBE = 100_000


def stride_sample(points: DataFrame, total: int, limit: int, index: str = "idx") -> DataFrame:
    """Every ``ceil(total / limit)``-th row by 0-based ``index``, the first ``limit`` of them; all if they fit."""
    if total <= limit:
        return points
    step = -(-total // max(limit, 1))
    return points.where((F.pmod(F.col(index), F.lit(step)) == 0) & (F.col(index) < step * limit))


def evenly_spaced(spark: SparkSession, count: int, target: int) -> DataFrame:
    """``idx``: ``target`` places from first to last, halves to even, repeats once; the middle one for a target of 1."""
    if target >= count:
        return spark.range(count).select(F.col("id").alias("idx"))
    if target <= 1:
        return spark.range(count // 2, count // 2 + 1).select(F.col("id").alias("idx"))
    at = F.bround(F.col("id") * (count - 1) / (target - 1)).cast("long")
    return spark.range(target).select(F.least(at, F.lit(count - 1).cast("long")).alias("idx")).distinct()


def preview_indices(spark: SparkSession, total: int, target: int, block_count: int = 128) -> DataFrame:
    """``idx``: exactly ``target`` row numbers spread over ``total`` in many jittered windows.

    The stream is cut into strata; each has a window, placed by hash, eight times as wide as what it takes, and one row,
    jittered by hash, from every equal bin of the window.  At most 64 rows come from a window.
    """
    target = min(max(target, 0), max(total, 0))
    if target in (0, total):
        return spark.range(target).select(F.col("id").alias("idx"))
    groups = min(target, max(max(1, block_count), (target + 63) // 64))
    base, more = divmod(target, groups)
    s = F.col("id")
    # the first ``more`` strata take one row more than the others
    group = F.when(s < more * (base + 1), F.floor(s / (base + 1))).otherwise(more + F.floor((s - more * (base + 1)) / max(base, 1))).cast("long")
    rows = spark.range(target).select(s, group.alias("g"))
    take = F.when(F.col("g") < more, base + 1).otherwise(base).cast("long")
    first = F.when(F.col("g") < more, F.col("g") * (base + 1)).otherwise(more * (base + 1) + (F.col("g") - more) * base).cast("long")
    div = lambda a, b: F.floor((a - F.pmod(a, b)) / b).cast("long")  # noqa: E731  exact below 2**53
    total_c, groups_c = F.lit(total).cast("long"), F.lit(groups).cast("long")
    begin, end = div(F.col("g") * total_c, groups_c), div((F.col("g") + 1) * total_c, groups_c)
    rows = rows.select("id", "g", take.alias("take"), (F.col("id") - first).alias("local"), begin.alias("begin"), (end - begin).alias("width"))
    rows = rows.withColumn("window", F.least("width", F.col("take") * 8))
    rows = rows.withColumn("offset", unsigned_mod(split_mix(wrap_add(F.col("g"), word(PREVIEW_SEED))), F.col("width") - F.col("window") + 1))
    low = div(F.col("local") * F.col("window"), F.col("take"))
    high = div((F.col("local") + 1) * F.col("window"), F.col("take"))
    rows = rows.withColumn("low", low).withColumn("bin", F.greatest(F.lit(1).cast("long"), high - low))
    jitter = unsigned_mod(split_mix(wrap_add(F.col("id"), word(PREVIEW_SEED + JITTER_SEED))), F.col("bin"))
    return rows.select((F.col("begin") + F.col("offset") + F.col("low") + jitter).alias("idx"))


def spatially_balanced(points: DataFrame, target: int, index: str = "idx") -> DataFrame:
    """``target`` finite points that prefer different cells of a 2048-cubed grid over the 0.5 to 99.5 percentile box.

    Every cell offers its first point by ``index``.  With too many cells those with the smallest hash of the cell stay;
    with too few, points with the smallest hash of the index are added.  Few enough points all stay.
    """
    ws = Workspace(points.sparkSession, "balanced")
    good = ws.keep(finite_points(points), "good")
    n = good.count()
    if n <= target:
        return good
    probe = good
    if n > PROBE:  # evenly spaced by position, for robust bounds only
        probe = positions(good.select(index, *XYZ), index).where(F.pmod("pos", F.lit(max(1, n // PROBE))) == 0).select(*XYZ)
    low, high = exact_quantiles(probe, list(XYZ), 0.005), exact_quantiles(probe, list(XYZ), 0.995)
    cells: list[Column] = []
    for c, a, b in zip(XYZ, low, high):
        span = (b - a) if b - a > 2.220446049250313e-16 else 1.0
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - a) / span))
        cells.append(F.floor(share * float(RESOLUTION - 1)).cast("long"))
    key = cells[0] + RESOLUTION * (cells[1] + RESOLUTION * cells[2])
    keyed = good.withColumn("_cell", key)
    heads = ws.keep(keyed.groupBy("_cell").agg(F.min(index).alias(index)), "heads")
    found = heads.count()
    score = lambda c: unsigned_order(split_mix(wrap_add(c.cast("long"), word(PREVIEW_SEED))))
    if found >= target:
        chosen = heads.orderBy(score(F.col("_cell")), "_cell").limit(target).select(index)
    else:
        rest = good.join(heads.select(index), index, "left_anti")
        chosen = heads.select(index).unionByName(rest.select(index).orderBy(score(F.col(index)), index).limit(target - found))
    return good.join(chosen, index, "left_semi")


def preview(points: DataFrame, total: int, most: int, block_count: int = 128, index: str = "idx") -> DataFrame:
    """A preview: up to twice the rows by strata (500,000 more at most), then the spatially balanced ones of them."""
    if total <= most:
        return points
    rows = preview_indices(points.sparkSession, total, min(total, most + min(most, 500_000)), block_count).withColumnRenamed("idx", index)
    return spatially_balanced(points.join(rows, index, "left_semi"), most, index)


def recent_items(items: DataFrame, most: int = 12) -> DataFrame:
    """``path, opened`` newest first, one row per case-folded path, the newest ``most``."""
    one = items.groupBy(F.lower("path").alias("_k")).agg(F.max(F.struct("opened", "path")).alias("m")).select("m.path", "m.opened")
    return one.orderBy(F.desc("opened"), "path").limit(most)


def top_values(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The ``k`` largest values, ties by smaller key."""
    return df.orderBy(F.desc(value), F.asc(key)).limit(k)


def ordered_distinct(rows: DataFrame, *columns: str, order: str = "seq") -> DataFrame:
    """Each combination of ``columns`` once, at its first place by ``order``, in that order; nulls are values."""
    return rows.groupBy(*columns).agg(F.min(order).alias(order)).orderBy(order)


def distinct_paths(paths: DataFrame, path: str = "path", order: str = "seq") -> DataFrame:
    """Paths without repeats that differ in case only: the first spelling of each, in order of first appearance."""
    first = paths.where(F.col(path).isNotNull()).groupBy(F.lower(path).alias("folded")).agg(F.min_by(path, order).alias(path), F.min(order).alias(order))
    return first.select(path, order).orderBy(order)
