"""Quality rules: text statistics with fixed base rules, then robust multivariate outliers.

The verdict beyond the base rules comes from minimum-covariance-determinant estimates, one per language and source:
starting from two deterministic subsets, concentration steps keep the share ``support`` of documents with the smallest
Mahalanobis distances and re-estimate centre and covariance from them until the number of steps is used up (the
determinant never grows); the start with the smaller determinant is then reweighted once.  A document is rejected if
the squared distance of its transformed statistics from the reweighted estimate exceeds the chi-square quantile
``1 - tail``.  All estimates cover all documents that pass the base rules.

Several statistics are zero in most clean texts, which leaves plain covariances singular, so each variance gets a floor
(``FLOORS``), as in the regularised form of the estimator.  Subset thresholds come from exact counts in fine,
logarithmic distance bins, which partial aggregates sum, so no group is ever gathered in one task.

Everything is DataFrame expressions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgrid.workspace import Workspace

from .text import pick, words

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Groups (language, source) of up to this many are broadcast when their estimates meet the documents.
BROADCAST_GROUPS = 10_000
#: Standard deviations added (as variances) to those of the transformed statistics below, in their order.
FLOORS = (0.25, 0.06, 0.05, 0.12)
P = len(FLOORS)
BINS_PER_OCTAVE = 32


def _chi2_cdf(x: float, k: int) -> float:
    """Distribution function for an even number ``k`` of degrees of freedom."""
    return 1.0 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def _chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1.0
    while _chi2_cdf(high, k) < q:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, k) < q else (low, mid)
    return high


def text_statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """``doc_id``, the carried columns and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long).

    Null and empty texts have zeros.  Repeated windows are found by 64-bit hashes first; only texts in which two hashes
    agree compare (by sorting) the windows themselves, so the counts are exact and cost ``n log n`` in text length.
    """
    keep = ["doc_id", *carried]
    d = pick(docs, *keep, "text").withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    d = d.select(*keep, words(F.col("text")).alias("w"), F.regexp_count("text", F.lit(SYMBOLS)).alias("n_symbols"), lines.alias("lines"))
    starts = F.when(F.size("w") >= WINDOW, F.sequence(F.lit(0), F.size("w") - WINDOW)).otherwise(F.array().cast("array<int>"))
    at = lambda i: [F.get("w", i + k) for k in range(WINDOW)]
    d = d.select(
        *keep,
        "w",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        starts.alias("starts"),
        F.transform(starts, lambda i: F.xxhash64(*at(i))).alias("keys"),
    )
    windows = F.sort_array(F.transform("starts", lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("k"), i.alias("i"))))
    d = d.select(
        *keep,
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.when(F.size(F.array_distinct("keys")) < F.size("keys"), windows).alias("s"),
    )
    twin = lambda x, j: (x["k"] == F.get("s", j - 1)["k"]) | (x["k"] == F.get("s", j + 1)["k"])
    hits = F.sort_array(F.transform(F.filter("s", lambda x, j: F.coalesce(twin(x, j), F.lit(False))), lambda x: x["i"]))
    covered = F.aggregate(
        hits,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    long = lambda c: F.col(c).cast("long").alias(c)
    return d.select(
        *keep, *map(long, ("n_words", "word_chars", "n_symbols", "n_dup_lines")),
        F.coalesce(F.when(F.col("s").isNull(), F.lit(0)).otherwise(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _transformed() -> list[Column]:
    """Log length; log mean word length, drawn to 6 characters for short texts; roots of the three densities, pooled."""
    n, c = F.col("n_words"), F.col("word_chars")
    return [
        F.log1p(n),
        F.log((c + 300.0) / (n + 50.0)),
        F.sqrt(F.col("n_symbols") / (c + 100.0)),
        F.sqrt((F.col("n_dup_lines") * 5.0 + F.col("n_repeat_words")) / (n + 50.0)),
    ]


X = [f"x{i}" for i in range(P)]
KEY = ["lang", "source"]


def _meet(rows: DataFrame, groups: DataFrame, *more: str) -> DataFrame:
    """Inner join on the null-safe group key; the group side is broadcast behind a count of it."""
    g = groups
    for k in [*KEY, *more]:
        g = g.withColumnRenamed(k, f"g_{k}")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"g_{k}")) for k in [*KEY, *more]])
    small = groups.limit(2 * BROADCAST_GROUPS + 1).count() <= 2 * BROADCAST_GROUPS
    return rows.join(F.broadcast(g) if small else g, on).drop(*[f"g_{k}" for k in [*KEY, *more]])


def _estimates(rows: DataFrame, scale: float) -> DataFrame:
    """Centre, inverse Cholesky factor and log determinant of each group and start; one partial aggregate."""
    sums = [F.sum(X[i]).alias(f"s{i}") for i in range(P)]
    sums += [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)]
    g = rows.groupBy(*KEY, "start").agg(F.count("*").alias("n"), *sums)
    g = g.select(*KEY, "start", "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)], *[f"s{i}{j}" for i in range(P) for j in range(i + 1)])
    for i in range(P):
        for j in range(i + 1):
            c = (F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * scale
            g = g.withColumn(f"c{i}{j}", F.greatest(c, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else c)
    for i in range(P):  # Cholesky factor l, then its inverse k
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            g = g.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(P):
        for i in range(j, P):
            v = F.lit(1.0) if i == j else -sum((F.col(f"l{i}{k}") * F.col(f"k{k}{j}") for k in range(j, i)), F.lit(0.0))
            g = g.withColumn(f"k{i}{j}", v / F.col(f"l{i}{i}"))
    logdet = sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0))
    return g.select(*KEY, "start", F.col("n").alias("n_used"), logdet.alias("logdet"), *[f"m{i}" for i in range(P)], *[f"k{i}{j}" for i in range(P) for j in range(i + 1)])


def _distance() -> Column:
    diff = [F.col(X[i]) - F.col(f"m{i}") for i in range(P)]
    return sum((sum((F.col(f"k{i}{j}") * diff[j] for j in range(i + 1)), F.lit(0.0)) ** 2 for i in range(P)), F.lit(0.0))


_PARAMS = [*[f"m{i}" for i in range(P)], *[f"k{i}{j}" for i in range(P) for j in range(i + 1)]]


def _closest(rows: DataFrame, support: float) -> DataFrame:
    """Of rows with ``d2``, per group and start, the share ``support`` with the smallest distances (whole bins)."""
    b = F.floor(F.log2(F.col("d2") + 1e-9) * BINS_PER_OCTAVE).cast("int")
    binned = rows.withColumn("bin", b)
    counts = binned.groupBy(*KEY, "start", "bin").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*KEY, "start").orderBy("bin")
    cum = counts.select("*", F.sum("c").over(upto).alias("upto"), F.sum("c").over(Window.partitionBy(*KEY, "start")).alias("n"))
    top = cum.where(F.col("upto") >= F.col("n") * support).groupBy(*KEY, "start").agg(F.min("bin").alias("top"))
    return _meet(binned, top, "start").where("bin <= top").drop("bin", "top")


def outlier_distances(stats: DataFrame, support: float, steps: int, ws: Workspace) -> DataFrame:
    """``stats`` (rows that passed the base rules) -> group key, centre and factor of the reweighted estimate."""
    q = _chi2_quantile(support, P)
    scale = support / _chi2_cdf(q, P + 2)  # makes the concentrated covariance consistent for normal data
    mids = stats.groupBy(*KEY).agg(*[F.percentile_approx(x, 0.5, 10_000).alias(f"m{i}") for i, x in enumerate(X)])
    mids = ws.keep(mids, "mids")
    dev = _meet(stats, mids).groupBy(*KEY).agg(
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 10_000).alias(f"a{i}") for i, x in enumerate(X)]
    )
    dev = ws.keep(_meet(mids, dev), "dev")
    near = sum((((F.col(x) - F.col(f"m{i}")) ** 2) / ((F.col(f"a{i}") * 1.4826) ** 2 + FLOORS[i] ** 2) for i, x in enumerate(X)), F.lit(0.0))
    first = _closest(_meet(stats, dev).select(*KEY, *X, F.lit(0).alias("start"), near.alias("d2")), support)
    rows = first.select(*KEY, *X, "start").unionByName(stats.select(*KEY, *X, F.lit(1).alias("start")))
    both = stats.select(*KEY, *X, F.explode(F.array(F.lit(0), F.lit(1))).alias("start"))
    est = ws.keep(_estimates(rows, scale), "est0")
    for k in range(steps):
        near = _meet(both, est.drop("n_used", "logdet"), "start").withColumn("d2", _distance()).drop(*_PARAMS)
        est = ws.keep(_estimates(_closest(near, support), scale), f"est{k + 1}")
    best = est.groupBy(*KEY).agg(F.min(F.struct("logdet", "start", "n_used", *_PARAMS)).alias("b")).select(*KEY, *[F.col(f"b.{c}").alias(c) for c in _PARAMS])
    best = ws.keep(best, "best")
    used = _meet(stats.select(*KEY, *X), best).withColumn("d2", _distance()).where(F.col("d2") <= _chi2_quantile(0.975, P)).drop(*_PARAMS)
    share = 0.975 / _chi2_cdf(_chi2_quantile(0.975, P), P + 2)
    return ws.keep(_estimates(used.withColumn("start", F.lit(0)), share).drop("start", "logdet"), "final")


#: Who judges a document: the first of these that has an estimate.
JUDGES = ("group", "language", "source", "all")


def _home(judge: str) -> tuple[Column, Column]:
    """Group key of a row in the table of all judges: the judge with its value, and the source within a group."""
    value = {"group": F.col("lang"), "language": F.col("lang"), "source": F.col("source"), "all": F.lit(None)}[judge].cast("string")
    within = F.col("source").cast("string") if judge == "group" else F.lit(None).cast("string")
    return F.concat(F.lit(f"{judge}:"), F.coalesce(F.concat(F.lit("="), value), F.lit(""))), within


def _judges(stats: DataFrame, support: float, steps: int, min_group: int, ws: Workspace) -> DataFrame:
    """``stats`` (rows that passed the base rules) -> for each group the estimate that judges it and its ``judged_by``.

    That is the first in ``JUDGES`` with ``min_group`` concentrated documents; groups without any are absent.  All
    judges are estimated in the same passes, in which each row takes part once for each of them.
    """
    homes = F.array(*[F.struct(lang.alias("lang"), source.alias("source")) for lang, source in map(_home, JUDGES)])
    every = stats.select(*X, F.explode(homes).alias("home")).select("home.lang", "home.source", *X)
    est = outlier_distances(every, support, steps, ws).where(F.col("n_used") >= min_group)
    found = stats.select(*KEY).distinct()
    for k in JUDGES:
        lang, source = _home(k)
        e = est.where(F.startswith("lang", F.lit(f"{k}:"))).select(F.col("lang").alias(f"l_{k}"), F.col("source").alias(f"s_{k}"), F.struct(*_PARAMS).alias(f"e_{k}"))
        found = found.join(e, (lang == F.col(f"l_{k}")) & source.eqNullSafe(F.col(f"s_{k}")), "left").drop(f"l_{k}", f"s_{k}")
    first = F.coalesce(*[F.when(F.col(f"e_{k}").isNotNull(), F.struct(F.col(f"e_{k}").alias("e"), F.lit(k).alias("judged_by"))) for k in JUDGES])
    found = found.select(*KEY, first.alias("f")).where("f is not null")
    return ws.keep(found.select(*KEY, *[F.col(f"f.e.{c}").alias(c) for c in _PARAMS], F.col("f.judged_by").alias("judged_by")), "judges")


def quality(docs: DataFrame, support: float = 0.75, steps: int = 5, tail: float = 1e-6, min_group: int = 30) -> DataFrame:
    """``docs(doc_id, text, lang, source)`` -> statistics, ``base_failed``, ``distance``, ``kept`` and who judged, a row for each row.

    ``base_failed``: fewer than 10 words, or more than 20 percent of the words in repeated windows.  Others are kept
    unless their squared distance exceeds the chi-square quantile of ``1 - tail``.  It is the one from the estimate of
    their group (``distance``) or, in groups with fewer than ``min_group`` concentrated documents, from that of all
    documents of their language, else of their source, else of the whole table (``pool_distance``); ``judged_by`` says
    which (group, language, source, all).  The other distance is null, and all three are if the whole table has fewer
    than ``min_group``, which is too few to call any document an outlier.  Null languages and sources form groups of
    their own; null texts have no words and fail.  Rows with equal ids are judged each by itself.  Other columns are
    ignored.  No rows give no rows.
    """
    ws = Workspace(docs.sparkSession, "quality")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    s = text_statistics(docs, *KEY).withColumn("base_failed", failed)
    s = ws.keep(s.select("*", *[c.alias(x) for c, x in zip(_transformed(), X)]), "stats")
    est = _judges(s.where("not base_failed"), support, steps, min_group, ws)
    g = est.select(*[F.col(k).alias(f"g_{k}") for k in KEY], "judged_by", *_PARAMS)
    on = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    small = est.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    j = s.join(F.broadcast(g) if small else g, on, "left").withColumn("d2", _distance())
    keep = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= _chi2_quantile(1 - tail, P))
    own = F.col("judged_by") == "group"
    return j.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(own, F.col("d2")).alias("distance"), keep.alias("kept"), F.when(~own, F.col("d2")).alias("pool_distance"), "judged_by",
    )
