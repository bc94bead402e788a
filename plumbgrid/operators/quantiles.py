"""Exact order statistics of numeric columns.

Up to ``DIRECT_ROWS`` rows, counted first, Spark's exact ``percentile`` answers in one pass; it gathers the distinct values
of a column in one task, so beyond that the wanted ranks are narrowed down: values are counted in equal bins between the
smallest and the largest, then again between the smallest and largest value of the one bin that holds the rank, until
that bin is small or holds one value.  Each pass moves one row per task and bin.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECT_ROWS = 4_000_000
BINS = 4096


def value_at_rank(df: DataFrame, column: str, rank: int, direct_rows: int = DIRECT_ROWS) -> float:
    """The value with 0-based ``rank`` among the non-null values of ``column`` (NaN sorts last)."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    span = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()
    lo, hi, n = span["lo"], span["hi"], span["n"]
    if not 0 <= rank < n:
        raise ValueError(f"rank {rank} of {n} values")
    while n > direct_rows and lo < hi:
        inside = x.where((F.col("x") >= lo) & (F.col("x") <= hi))
        place = F.least(F.floor((F.col("x") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        rows = inside.groupBy(place.alias("b")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).orderBy("b").collect()
        for r in rows:  # BINS rows at most
            if rank < r["n"]:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            rank -= r["n"]
    if lo == hi:
        return float(lo)
    kept = x.where((F.col("x") >= lo) & (F.col("x") <= hi)) if not math.isnan(hi) else x
    return kept.agg(F.percentile("x", rank / (n - 1) if n > 1 else 0.0)).first()[0]


def exact_quantiles(df: DataFrame, columns: list[str], q: float = 0.5, direct_rows: int = DIRECT_ROWS) -> list[float | None]:
    """Quantile ``q`` of each column with linear interpolation; null where a column has no values."""
    counts = df.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    if max(counts) <= direct_rows:
        return list(df.agg(*[F.percentile(F.col(c).cast("double"), q).alias(f"q{i}") for i, c in enumerate(columns)]).first())
    out: list[float | None] = []
    for c, n in zip(columns, counts):
        if not n:
            out.append(None)
            continue
        at = q * (n - 1)
        low = value_at_rank(df, c, math.floor(at), direct_rows)
        high = low if at == math.floor(at) else value_at_rank(df, c, math.floor(at) + 1, direct_rows)
        out.append(low + (high - low) * (at - math.floor(at)))
    return out


def nearest_rank(df: DataFrame, column: str, fraction: float, direct_rows: int = DIRECT_ROWS) -> float | None:
    """The value at rank ``round(fraction * (n - 1))``, halves to even."""
    n = df.where(F.col(column).isNotNull()).count()
    return value_at_rank(df, column, round(fraction * (n - 1)), direct_rows) if n else None
