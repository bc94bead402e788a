"""Mixing sources to target weights by capped water-filling, then seeded whole and fractional repetitions.

Sources share the total size by weight; a source may be repeated ``max_epochs`` times at most, and what it cannot take
is shared again by weight among the others until nobody is above the cap.  With sources ordered by cap over weight
the fixed point has a closed form, so no loop is needed.

A source at ``r`` epochs takes every document ``floor(r)`` times and once more those whose seeded 60-bit hash lies
below the source's cut.  The cut is placed, exactly and without sorting a source, by narrowing: sizes summed by the
leading hash digits, then by further digits inside the one bin that the target falls into, down to single hash values.
Repetitions are therefore a function of the document's own row and of its source's (whole, cut): reruns agree, and no
document row moves to its source.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgrid.workspace import Workspace

from .text import n_words, pick

#: Rates of up to this many sources are broadcast; beyond it the join is salted.
BROADCAST_SOURCES = 10_000
SALTS = 64
DIGITS, LEVELS = 3, 5  # hexadecimal digits settled per level, 15 in all


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0) -> DataFrame:
    """``sizes(source, source_size)``, one row per source -> the same with ``target`` (double).

    Weights are dealt to the sources by code point, null last, repeating.  Each target is
    ``min(max_epochs * size, level * weight)`` for the one level at which the targets share all sizes; an empty source
    gets 0.  The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kind = F.row_number().over(order) - 1
    w = sizes.select(
        "source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (kind % len(weights) + 1).cast("int")).alias("w")
    )
    full = F.col("source_size") * F.lit(float(max_epochs))
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    ahead = ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = ratio.rowsBetween(0, Window.unboundedFollowing)
    w = w.select("*", full.alias("full"), (full / F.col("w")).alias("ratio"), F.sum("source_size").over(Window.partitionBy()).alias("total"))
    level = (F.col("total") - F.coalesce(F.sum("full").over(ahead), F.lit(0.0))) / F.sum("w").over(rest)
    w = w.withColumn("level", level)
    # the first source whose own cap is not below the level reached there sets the level for itself and all after it
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(Window.partitionBy())
    return w.select("source", "source_size", F.least("full", F.coalesce(free["level"], F.col("ratio")) * F.col("w")).alias("target"))


def _unit(doc_id: Column, seed: int) -> Column:
    """The leading 15 hexadecimal digits of a keyed MD5, as text: fixed width, so text order is numeric order."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mixing_rates(sized: DataFrame, weights: tuple[float, ...], max_epochs: float, seed: int, ws: Workspace) -> DataFrame:
    """``sized(source, size, u)`` -> ``source, source_size, target, whole, cut``; a row takes ``whole + (u < cut)``.

    The words that hashes below the cut hold come nearest to the target from above or below; the last, undivided step
    is a single hash value, that is one document id.
    """
    sums = ws.keep(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    rates = source_targets(sums, weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = rates.withColumn("whole", F.floor(epochs + 1e-12).cast("int"))
    rates = rates.withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    state = ws.keep(rates.withColumn("cut", F.lit("")), "rates0")
    rows = sized.where("size > 0")
    for level in range(LEVELS):
        width = min(15, DIGITS * (level + 1))
        side = state.select(F.col("source").alias("rs"), F.col("cut").alias("rc"), "need").where("need > 0")
        inside = rows.join(_limited(side), _same(F.col("source"), F.col("rs")) & F.col("u").startswith(F.col("rc")))
        bins = inside.groupBy("source", F.substring("u", 1, width).alias("bin")).agg(F.sum("size").alias("size"), F.first("need").alias("need"))
        run = Window.partitionBy("source").orderBy("bin")
        bins = bins.select("*", F.sum("size").over(run).alias("upto"))
        # the first bin that reaches the target; what lies before it is below the cut in any case
        hit = bins.where("upto >= need").groupBy("source").agg(F.min(F.struct("bin", F.col("upto"), "size")).alias("h"))
        hit = hit.select(F.col("source").alias("hs"), F.col("h.bin").alias("bin"), (F.col("h.upto") - F.col("h.size")).alias("before"), F.col("h.size").alias("held"))
        moved = state.drop("held").join(hit, _same(F.col("source"), F.col("hs")), "left")
        left = F.greatest(F.lit(0.0), F.col("need") - F.col("before"))
        # rounding may leave the target a hair above all words of the source: then every row is below the cut
        state = ws.keep(
            moved.select(
                "source", "source_size", "target", "whole",
                F.when(F.col("bin").isNull(), F.col("need")).otherwise(left).alias("need"),
                F.when(F.col("bin").isNotNull(), F.col("bin")).when(F.col("need") > 0, F.lit("g")).otherwise(F.col("cut")).alias("cut"),
                F.coalesce("held", F.lit(0)).alias("held"),
            ),
            f"rates{level + 1}",
        )
    # 'cut' is now one hash value (rows below it are in); 'need' of its 'held' words are still wanted: take the nearer
    return state.select("source", "source_size", "target", "whole", F.when((F.col("need") * 2 > F.col("held")) & (F.length("cut") == 15), F.concat("cut", F.lit("g"))).otherwise(F.col("cut")).alias("cut"))


def _limited(side: DataFrame) -> DataFrame:
    """Broadcast a per-source table if it is small, as counted now."""
    return F.broadcast(side) if side.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else side


def apply_rates(docs: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """Add ``reps`` and the source's rates to ``docs(doc_id, source, ...)``; rates are broadcast or salted by size."""
    u = _unit(F.col("doc_id"), seed)
    r = rates.select(F.col("source").alias("rate_source"), "source_size", "target", "whole", "cut")
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        out = docs.join(F.broadcast(r), _same(F.col("source"), F.col("rate_source")))
    else:
        r = r.withColumn("rate_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        out = docs.join(r, _same(F.col("source"), F.col("rate_source")) & (salt == F.col("rate_salt"))).drop("rate_salt")
    return out.withColumn("reps", F.col("whole") + (u < F.col("cut")).cast("int")).drop("rate_source", "whole", "cut")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """``docs(doc_id, text, source)`` -> ``doc_id, size, source_size, target, reps, taken``, one row per input row.

    ``size`` counts words, null texts have none; ``taken`` is ``reps * size`` and ``reps`` at most ``ceil(max_epochs)``,
    never above ``max_epochs`` for whole epochs.  The null source is a source of its own.  Rows that repeat a doc_id
    share its fate.  No rows give no rows; all-empty sources get target 0.  Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "mix")
    sized = ws.keep(pick(docs, "doc_id", "source", "text").select("doc_id", "source", n_words(F.col("text")).alias("size")), "sized")
    rates = mixing_rates(sized.withColumn("u", _unit(F.col("doc_id"), seed)), weights, max_epochs, seed, ws)
    out = apply_rates(sized, rates, seed)
    return out.select("doc_id", "size", "source_size", "target", "reps", (F.col("size") * F.col("reps")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """The mix itself: every row of ``docs`` repeated ``reps`` times, with its columns (``doc_id``, ``text``, ``source``)."""
    ws = Workspace(docs.sparkSession, "mixed")
    sized = ws.keep(pick(docs, "doc_id", "source", "text").select("doc_id", "source", n_words(F.col("text")).alias("size")), "sized")
    rates = mixing_rates(sized.withColumn("u", _unit(F.col("doc_id"), seed)), weights, max_epochs, seed, ws)
    packed = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = apply_rates(packed, rates, seed).where("reps > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("reps"))).alias("rep")).select("row.*")
