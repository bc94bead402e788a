"""Operators on photo records: duplicates, summaries, key frames, sequence breaks and segments.

Records are rows with a unique ``seq`` (input order); names follow the record model in ``plumbgrid.plans.model``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgrid.functions.hashing import hash_distance
from plumbgrid.functions.scalars import quality_ok
from plumbgrid.operators.quantiles import exact_quantiles
from plumbgrid.workspace import Workspace

LOOK_BACK, NEAR_BITS = 4, 2


def exact_duplicates(records: DataFrame) -> DataFrame:
    """``seq, duplicate_of``: the first valid record with equal size and hashes; null for that first one and invalid ones.

    Only sizes and quick hashes that occur more than once are grouped by the full hash; the groups are plain aggregates
    and a join on the first one's key, so a large group of copies is never gathered.
    """
    key = ["size", "quick_hash", "full_hash"]
    valid = records.where("valid").select("seq", *key)
    shared = valid.groupBy("size", "quick_hash").agg(F.count("*").alias("c")).where("c > 1").select("size", "quick_hash")
    close = valid.join(shared, ["size", "quick_hash"], "left_semi")
    first = close.groupBy(*key).agg(F.min("seq").alias("head"), F.count("*").alias("c")).where("c > 1").drop("c")
    found = close.join(first, key).where("seq != head").select("seq", F.col("head").alias("duplicate_of"))
    return records.select("seq").join(found, "seq", "left")


def near_duplicates(records: DataFrame, distance=None, look_back: int = LOOK_BACK, most: int = NEAR_BITS, partition: list[str] | None = None) -> DataFrame:
    """``seq, near_duplicate_of``: among valid records that are no exact copies, the oldest of the previous ones in range.

    ``distance(a, b)`` works on ``signature`` columns; by default the bits in which hexadecimal hashes differ.
    ``partition`` names columns (a camera, a day) that part independent sequences, which also parts the work.
    """
    distance = distance or hash_distance
    order = Window.partitionBy(*(partition or [])).orderBy("seq")
    hit: list[Column] = []
    for k in range(look_back, 0, -1):
        before, name = F.lag("signature", k).over(order), F.lag("seq", k).over(order)
        hit.append(F.when(name.isNotNull() & (distance(before, F.col("signature")) <= most), name))
    live = records.where("valid and duplicate_of is null")
    return live.select("seq", F.coalesce(*hit).alias("near_duplicate_of"))


def scan_summary(records: DataFrame) -> DataFrame:
    """One row: counts, median sigmas of fixed positions and the distinct camera models, sorted."""
    from plumbgrid.operators.quantiles import exact_quantiles

    sigmas = ("sigma_x", "sigma_y", "sigma_z")
    mid = exact_quantiles(records.where("rtk_status = 'RTK_FIX'"), list(sigmas))
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    valid, fix = F.col("valid"), F.col("rtk_status") == "RTK_FIX"
    return records.agg(
        F.count("*").alias("total"), n(valid, "valid"), n(~valid, "invalid"), n(F.col("duplicate_of").isNotNull(), "exact_duplicates"),
        n(F.col("near_duplicate_of").isNotNull(), "near_duplicates"), n(F.col("selected"), "selected"), n(F.col("warnings") != "", "with_warnings"),
        n(F.col("lat").isNotNull() & F.col("lon").isNotNull(), "geotagged"), n(fix, "rtk_fix"), n(F.col("rtk_status") == "RTK_FLOAT", "rtk_float"),
        *[F.max(F.lit(m).cast("double")).alias(c) for m, c in zip(mid, sigmas)],
        F.sort_array(F.collect_set(F.when(F.col("camera_model") != "", F.col("camera_model")))).alias("camera_models"),
    )


def resolution_distribution(records: DataFrame) -> DataFrame:
    """Smallest, median and largest megapixels of the valid records."""
    from plumbgrid.operators.quantiles import exact_quantiles

    sizes = records.where("valid").select((F.col("width") * F.col("height") / 1e6).alias("mp"))
    mid = exact_quantiles(sizes, ["mp"])[0]
    return sizes.agg(F.min("mp").alias("min_mp"), F.max(F.lit(mid).cast("double")).alias("median_mp"), F.max("mp").alias("max_mp"))


def unique_names(records: DataFrame) -> DataFrame:
    """``seq, name``: if any two names agree but for case, all get their six-digit position in front."""
    clash = records.groupBy(F.lower("name").alias("k")).agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0)).alias("most"))
    if clash.first()["most"] <= 1:
        return records.select("seq", "name")
    at = _positions(records.select("seq"), "seq")
    return records.join(at, "seq").select("seq", F.concat(F.lpad(F.col("pos").cast("string"), 6, "0"), F.lit("_"), F.col("name")).alias("name"))


def sum_before(df: DataFrame, value: Column, name: str, *order: str) -> DataFrame:
    """``name``: sum of ``value`` over all rows before each one in a global order, without one task for all rows.

    Rows go to range partitions, whose sums are added up (one row per partition) and put ahead of sums within each.
    """
    ws = Workspace(df.sparkSession, "positions")
    parted = df.withColumn("_v", value.cast("long")).repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id())
    parted = ws.keep(parted, "parted")
    sizes = parted.groupBy("_p").agg(F.sum("_v").alias("c"))
    back = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("_p", F.coalesce(F.sum("c").over(back(Window.orderBy("_p"))), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("_v").over(back(Window.partitionBy("_p").orderBy(*order))), F.lit(0))
    return parted.withColumn("_i", inside).join(F.broadcast(ahead), "_p").select(*df.columns, (F.col("_i") + F.col("ahead")).alias(name))


def _positions(df: DataFrame, *order: str) -> DataFrame:
    """0-based ``pos`` in a global order."""
    return sum_before(df, F.lit(1), "pos", *order)


def positions(df: DataFrame, *order: str) -> DataFrame:
    return _positions(df, *order)


def keyframes(records: DataFrame, max_count: int, include_near: bool = False, exclude_failures: bool = False) -> DataFrame:
    """Selected records, at most ``max_count``, spread over the sequence by (capture time, name).

    The candidates are cut into equal buckets; from each the record with the largest
    ``ln(1 + sharpness) * (1 + distance from the one chosen before / 64)`` is taken, of those at least as sharp as the
    8 percent quantile if there are any; the first largest wins.

    The choice depends on the one before, so buckets are gone through in order, but few records can win: of equal hashes the
    first with the largest logarithm, and as the factor lies between 1 and 2, none below half of the bucket's largest.  Only
    these come to the driver, row by row.
    """
    live = records.where("valid and duplicate_of is null")
    if not include_near:
        live = live.where("near_duplicate_of is null")
    if exclude_failures:
        live = live.where(quality_ok(F.col("sharpness"), F.col("dark"), F.col("bright")))
    ws = Workspace(records.sparkSession, "keyframes")
    live = ws.keep(live, "live")
    n = live.count()
    if max_count <= 0 or n <= max_count:
        return live
    floor = exact_quantiles(live, ["sharpness"], 0.08)[0]
    pos = positions(live.select("seq", "captured", "name"), "captured", "name", "seq").select("seq", "pos")
    # bucket b covers trunc(b * n / m) up to trunc((b + 1) * n / m)
    bounds = records.sparkSession.range(max_count).select(F.col("id").alias("bucket"), F.floor(F.col("id") * (n / max_count) + 1e-12).alias("lo"), F.floor((F.col("id") + 1) * (n / max_count) + 1e-12).alias("hi"))
    guess = F.least(F.lit(max_count - 1), F.floor((F.col("pos") + 1e-9) * max_count / n)).cast("long")
    near = live.join(pos, "seq").withColumn("bucket", F.explode(F.array(guess - 1, guess, guess + 1)))
    placed = near.join(bounds, "bucket").where((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.greatest(F.col("hi"), F.col("lo") + 1)))
    sharp = F.col("sharpness") >= floor
    # of a bucket without sharp records all are usable; a row a bucket and hash
    slim = placed.select("bucket", "signature", sharp.alias("sharp"), F.struct(F.log1p("sharpness").alias("base"), (-F.col("pos")).alias("back"), "seq").alias("c"))
    first = slim.groupBy("bucket", "signature", "sharp").agg(F.max("c").alias("c"))
    tops = first.groupBy("bucket").agg(F.max("sharp").alias("any_sharp"), F.max(F.struct("sharp", "c.base")).alias("m")).select(F.col("bucket").alias("b"), "any_sharp", F.col("m.base").alias("top"))
    able = first.join(F.broadcast(tops), F.col("bucket") == F.col("b")).where(F.col("sharp") == F.col("any_sharp"))  # a row a bucket
    able = able.where((F.col("top") <= 0) | (2 * F.col("c.base") >= F.col("top")))
    chosen: list[int] = []
    previous, bucket, best, best_score = "", None, None, 0.0
    for row in able.select("bucket", "signature", "c.base", "c.seq", (-F.col("c.back")).alias("pos")).orderBy("bucket", "pos").toLocalIterator(prefetchPartitions=True):
        if row["bucket"] != bucket:
            if best is not None:
                chosen.append(best["seq"])
                previous = best["signature"]
            bucket, best = row["bucket"], None
        score = row["base"] * (1.0 + _bits_apart(previous, row["signature"]) / 64.0)
        if best is None or score > best_score:
            best, best_score = row, score
    if best is not None:
        chosen.append(best["seq"])
    picks = records.sparkSession.createDataFrame([(c,) for c in chosen], live.select("seq").schema)
    return live.join(picks, "seq", "left_semi")


def _bits_apart(a: str | None, b: str | None) -> int:
    return 64 if not a or not b else (int(a, 16) ^ int(b, 16)).bit_count()


def adjacent_pairs(frames: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """Each frame (``seq``) with the next one."""
    order = Window.partitionBy(*(partition or [])).orderBy("seq")
    nexts = frames.select(*(partition or []), F.col("seq").alias("first"), F.lead("seq").over(order).alias("second"))
    return nexts.where("second is not null")


def classify_pairs(pairs: DataFrame) -> DataFrame:
    """``status``: break (under 24 inliers or 6 percent coverage), weak (under 80 inliers and over 35 percent shift) or ok."""
    hard = (F.col("inlier_count") < 24) | (F.col("feature_coverage") < 0.06)
    weak = (F.col("inlier_count") < 80) & (F.col("displacement") > 0.35)
    return pairs.withColumn("status", F.when(hard, "break").when(weak, "weak").otherwise("ok"))


def segments(frames: DataFrame, breaks: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """Runs of frames between breaks: ``segment, first, last, n``.  A break after frame ``seq`` starts a new run."""
    by = partition or []
    marked = frames.select(*by, "seq").join(breaks.select(*by, "seq", F.lit(1).alias("b")), [*by, "seq"], "left")
    if by:
        order = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        runs = marked.withColumn("segment", F.coalesce(F.sum(F.coalesce("b", F.lit(0))).over(order), F.lit(0)).cast("long"))
    else:
        runs = sum_before(marked, F.coalesce("b", F.lit(0)), "segment", "seq")
    return runs.groupBy(*by, "segment").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"))


def longest_segment(runs: DataFrame, minimum: int = 1) -> DataFrame:
    """The run with most frames, the earliest of equal ones; none if shorter than ``minimum`` or if there is no break."""
    best = runs.agg(F.max_by(F.struct("segment", "first", "last", "n"), F.struct("n", -F.col("segment"))).alias("m"), F.count("*").alias("runs"))
    return best.where(F.col("runs") > 1).select("m.*").where(F.col("n") >= minimum)


def selection_policy(records: DataFrame, policy: str, max_count: int = 0) -> DataFrame:
    """keep_all: every valid record; duplicates_only: without exact copies; automatic: key frames of good quality."""
    if policy == "keep_all":
        return records.where("valid")
    if policy == "duplicates_only":
        return keyframes(records, 0, include_near=True)
    if policy == "automatic":
        return keyframes(records, max_count, exclude_failures=True)
    raise ValueError(f"unknown policy {policy}")


def feature_coverage(matches: DataFrame, width: float, height: float) -> DataFrame:
    """``pair, coverage``: product of the extents of the matched points, as shares of the image."""
    span = lambda c, size: (F.max(c) - F.min(c)) / F.lit(float(size))
    return matches.groupBy("pair").agg((span("px", width) * span("py", height)).alias("coverage"))


def weak_link_stats(matches: DataFrame, diagonal: float, width: float, height: float) -> DataFrame:
    """Per pair: matches, inliers, the smaller coverage of both sides, median displacement over the image diagonal."""
    cover = lambda x, y: (F.max(x) - F.min(x)) / float(width) * (F.max(y) - F.min(y)) / float(height)
    shift = F.sqrt((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2)
    return matches.groupBy("pair").agg(
        F.count("*").alias("match_count"), F.count(F.when(F.col("inlier"), 1)).alias("inlier_count"),
        F.least(cover("px", "py"), cover("qx", "qy")).alias("feature_coverage"), (F.median(F.when(F.col("inlier"), shift)) / float(diagonal)).alias("displacement"),
    )
