"""Quality reports and gates of sparse models, retry predicates, batch plans and ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgrid.operators.quantiles import DIRECT_ROWS, nearest_rank

# thresholds of the gate (fixed values)
PASS_RATIO, PASS_ERROR = 0.95, 2.0
BLOCK_RATIO, BLOCK_ERROR = 0.5, 5.0


def sparse_quality(points: DataFrame, registered: int, expected: int) -> DataFrame:
    """One row on ``points(error, track_length)``: counts, mean, nearest-rank 50 and 95 percent errors, track lengths.

    Ranks are ``round((n - 1) * f)`` with halves to even.
    """
    n = points.where("error is not null").count()
    if n <= DIRECT_ROWS:
        rank = lambda f: F.element_at(F.sort_array(F.collect_list("error")), round((n - 1) * f) + 1) if n else F.lit(None).cast("double")
        p50, p95 = rank(0.5), rank(0.95)
    else:
        p50, p95 = F.lit(nearest_rank(points, "error", 0.5)), F.lit(nearest_rank(points, "error", 0.95))
    return points.agg(
        F.lit(registered).cast("long").alias("registered_images"), F.lit(registered / expected if expected else 0.0).alias("registration_ratio"), F.count("*").alias("sparse_point_count"),
        F.avg("error").alias("mean_error"), p50.alias("median_error"), p95.alias("p95_error"), F.avg("track_length").alias("mean_track"), F.median("track_length").alias("median_track"),
    )


def exact_mean(column: str) -> Column:
    """Mean of doubles written with up to 16 decimals: their sum is taken as decimals, so no order of rows moves a mean across a limit.

    Where a value does not fit (NaN, infinite, beyond 22 digits), the plain mean stands.
    """
    fixed = F.col(column).try_cast("decimal(38,16)")
    return F.when(F.count(fixed) == F.count(column), F.try_sum(fixed).cast("double") / F.count(column)).otherwise(F.avg(column))


def gate_status(registered: Column, ratio: Column, points: Column, error: Column) -> Column:
    """passed, review or blocked."""
    blocked = (registered < 3) | (ratio < BLOCK_RATIO) | (points < F.greatest(F.lit(30), registered * 10)) | F.coalesce(error > BLOCK_ERROR, F.lit(False))
    passed = (ratio >= PASS_RATIO) & F.coalesce(error <= PASS_ERROR, F.lit(False)) & (points >= F.greatest(F.lit(100), registered * 50))
    return F.when(blocked, "blocked").when(passed, "passed").otherwise("review")


def gate_checks(registered: Column, ratio: Column, points: Column, error: Column) -> Column:
    """Struct of the three checks of a pass."""
    return F.struct(
        (ratio >= PASS_RATIO).alias("registration"), F.coalesce(error <= PASS_ERROR, F.lit(False)).alias("reprojection"), (points >= F.greatest(F.lit(100), registered * 50)).alias("points")
    )


def needs_stable_retry(status: Column, registered: Column, ratio: Column, points: Column, error: Column) -> Column:
    return (
        (status == "blocked") | (registered < 3) | (ratio < 0.8) | (points < F.greatest(F.lit(100), registered * 25)) | error.isNull() | F.coalesce(error > 3.0, F.lit(False))
    )


def best_model(models: DataFrame) -> DataFrame:
    """Of ``models(path, registered)`` the one with most images, of equal ones the last by case-folded path."""
    return models.agg(F.max_by(F.struct("path", "registered"), F.struct("registered", F.lower("path"))).alias("m")).select("m.*")


def fusion_batches(names: DataFrame, memory_bytes: int) -> DataFrame:
    """``seq, name, batch``: all in one batch if the maps fit, else batches of 8 to 48 names in order.

    They fit in the smaller of 24 GiB and 35 percent of memory; a batch aims at 15 percent, 3 to 8 GiB.
    """
    gib = 1024**3
    s = names.agg(F.sum("map_bytes").alias("total"), F.count("*").alias("n")).first()
    total, n = s["total"] or 0, s["n"]
    if not n or total <= min(24 * gib, int(max(1, memory_bytes) * 0.35)):
        return names.select("seq", "name", F.lit(0).cast("long").alias("batch"))
    aim = min(8 * gib, max(3 * gib, int(memory_bytes * 0.15)))
    size = max(8, min(48, aim // max(1, total // n)))
    from plumbgrid.operators.captures import positions

    return positions(names.select("seq", "name"), "seq").select("seq", "name", F.floor(F.col("pos") / size).cast("long").alias("batch"))


def source_ladder(sources: int) -> list[int]:
    """Numbers of sources to try one after another."""
    return list(dict.fromkeys([sources, *[n for n in (12, 8, 6) if n < sources]]))


def scale_ladder(scale: float = 1.0) -> list[float]:
    """Texture scales to try one after another."""
    return list(dict.fromkeys(max(0.0625, scale * f) for f in (1.0, 0.75, 0.5, 0.35, 0.25, 0.125)))


def project_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.lit(name).alias("item"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
