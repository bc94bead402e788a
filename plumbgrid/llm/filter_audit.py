"""Filter interaction audit: one pass over the documents gives the effect of every order of the filters.

Each document has a mask with one bit for each filter that it fails.  A part's documents by mask are at most 2^k
numbers; the subset-zeta transform (k rounds of additions between neighbouring subsets) turns them into the documents
that pass every filter of a subset, for every subset.  What a step of an order removes is then the difference between
two neighbouring subsets, and so it is for documents with a label.  Filters are never run again for another order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgrid.workspace import Workspace

from .text import pick, words

#: Subsets of filters are held in an array for each part: this many filters at most, and this many for all orders.
MOST_FILTERS, MOST_PERMUTED = 16, 7


def mark_copies(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, digest, ...)`` -> equal rows counted (``n``), with ``copy``: the digest also stands in a smaller ``doc_id``.

    Null ids come after all others: they are copies of any row with an id, and not of each other.  Rows are counted before
    they meet the digests' first ids and meet them on id and digest, so a group of copies is never one task's.
    """
    seen = rows.groupBy(*[F.col(f"`{c}`") for c in rows.columns]).agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("digest", "first_digest").withColumn("lead", F.lit(True))
    met = seen.join(first, (F.col("digest") == F.col("first_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    return met.select(*[F.col(f"`{c}`") for c in seen.columns], F.col("lead").isNull().alias("copy"))


def with_labels(rows: DataFrame, labels: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """``rows(doc_id, digest, ...)`` with a boolean column for each of ``flags`` over the columns of ``labels(doc_id, ...)``.

    Several labels of an id: true if any is.  Ids without a label, and rows without an id: false.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
    # rows without an id are dealt out by their digest: they have no label to meet
    keyed = rows.withColumn("met_id", F.coalesce("doc_id", F.xxhash64("digest")))
    met = keyed.join(known, (F.col("met_id") == F.col("label_id")) & F.col("doc_id").isNotNull(), "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(F.col(f"`{n}`"), F.lit(False)).alias(n) for n in flags])


def _subset_sums(counts: Column, k: int) -> Column:
    """``counts[mask]`` -> sums over all subsets of each mask: the zeta transform, one filter a round."""
    bits = F.array(*[F.lit(1 << b) for b in range(k)])
    return F.aggregate(bits, counts, lambda acc, bit: F.transform(acc, lambda x, i: F.when(i.bitwiseAND(bit) != 0, x + F.get(acc, i - bit)).otherwise(x)))


def audit(masks: DataFrame, filters: Sequence[str], measures: Mapping[str, Column], orders: Sequence[str] | None = None) -> DataFrame:
    """``masks(part, mask, ...)`` -> a row for each part, order and step.

    ``filters`` are single letters; bit b of ``mask`` is set where the document fails ``filters[b]``.  ``measures`` has
    ``n`` (documents of a row) and any labels (of them, those with it).  ``orders`` are strings of the letters, each
    filter once; all permutations if none are given (up to 7 filters).

    Columns: ``part``, ``filter_order``, ``step`` (from 1), ``kept`` after the step, ``removed`` by it, ``redundant``
    (failing its filter but removed earlier), ``unique_fails`` (failing its filter only), ``<label>_lost`` for each label,
    ``shapley`` (what the filter removes, summed over all k! orders, at any step).  Null parts are ''.  Parts without
    documents do not occur; no rows give no rows.
    """
    k = len(filters)
    if not 0 < k <= MOST_FILTERS or len(set(filters)) < k or any(len(f) != 1 or f == "\n" for f in filters):
        raise ValueError(f"from 1 to {MOST_FILTERS} different letters are needed as filters")
    if orders is None:
        if k > MOST_PERMUTED:
            raise ValueError(f"beyond {MOST_PERMUTED} filters, name the orders")
        orders = ["".join(p) for p in permutations(filters)]
    if any(sorted(o) != sorted(filters) for o in orders):
        raise ValueError("an order has each filter once")
    full = (1 << k) - 1
    cells = masks.groupBy(F.coalesce("part", F.lit("")).alias("part"), "mask").agg(*[F.sum(c).cast("long").alias(n) for n, c in measures.items()])
    # at most 2^k cells a part
    parts = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*measures)))).alias("cells"))
    subsets = F.sequence(F.lit(0), F.lit(full))

    def by_mask(measure: str) -> Column:
        return F.transform(subsets, lambda m: F.coalesce(F.try_element_at("cells", m)[measure], F.lit(0).cast("long")))

    parts = parts.select("part", *[_subset_sums(by_mask(n), k).alias(f"sum_{n}") for n in measures])

    def left(measure: str, applied: Column) -> Column:
        """Documents that fail none of the filters in ``applied``."""
        return F.get(f"sum_{measure}", F.lit(full) - applied)

    weight = F.array(*[F.lit(factorial(s.bit_count()) * factorial(max(k - 1 - s.bit_count(), 0))).cast("long") for s in range(full + 1)])
    zero = F.lit(0).cast("long")

    def shapley(bit: int) -> Column:
        gain = lambda s: F.get(F.col("weight"), s) * (left("n", s) - left("n", s + F.lit(bit)))
        return F.aggregate(F.filter(subsets, lambda s: s.bitwiseAND(F.lit(bit)) == 0), zero, lambda acc, s: acc + gain(s))

    parts = parts.withColumn("weight", weight).withColumn("shares", F.array(*[shapley(1 << b) for b in range(k)]))
    letters = "".join(filters)
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit("\n".join(orders)), "\n")))
    letter = lambda i: F.substring("filter_order", i, F.lit(1))
    places = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.call_function("locate", letter(i), F.lit(letters)) - 1)
    rows = rows.withColumn("places", places).select("*", F.posexplode("places").alias("at", "place"))
    rows = rows.withColumn("before", F.aggregate(F.slice("places", 1, F.col("at")), F.lit(0), lambda acc, b: acc + F.call_function("shiftleft", F.lit(1), b)))
    rows = rows.withColumn("bit", F.call_function("shiftleft", F.lit(1), F.col("place")))
    b, after, none = F.col("before"), F.col("before") + F.col("bit"), F.lit(0)
    removed = left("n", b) - left("n", after)
    return rows.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"), left("n", after).alias("kept"), removed.alias("removed"),
        (left("n", none) - left("n", F.col("bit")) - removed).alias("redundant"), (left("n", F.lit(full) - F.col("bit")) - left("n", F.lit(full))).alias("unique_fails"),
        *[(left(m, b) - left(m, after)).alias(f"{m}_lost") for m in measures if m != "n"], F.get("shares", F.col("place")).alias("shapley"),
    )


def audit_texts(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], copies: str, flags: Mapping[str, Column]) -> DataFrame:
    """Audit of filters over ``docs(doc_id, text, source)`` by source.

    ``filters``: letter -> expression over the columns ``text`` (null: empty) and ``words`` (array) that is true where the
    document fails; a null counts as passing.  ``copies`` is the letter of one more filter, the last one: the text also stands in a smaller
    ``doc_id`` of the whole table.  ``flags``: label -> expression over the columns of ``labels(doc_id, ...)``.

    Whole texts are read once and leave as a mask and a digest.  Equal rows count as often as they occur; other columns
    are ignored.
    """
    ws = Workspace(docs.sparkSession, "audit")
    names = [*filters, copies]
    text = pick(docs, "doc_id", "text", "source").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("words", words(F.col("text")))
    mask = sum((F.coalesce(c, F.lit(False)).cast("int") * F.lit(1 << b) for b, c in enumerate(filters.values())), F.lit(0))
    ready = text.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.coalesce("source", F.lit("")).alias("part"), mask.alias("mask"))
    rows = with_labels(mark_copies(ws.keep(ready, "masks")), labels, flags)
    rows = rows.withColumn("mask", F.col("mask") + F.col("copy").cast("int") * F.lit(1 << len(filters)))
    measures = {"n": F.col("n")} | {f: F.when(F.col(f"`{f}`"), F.col("n")).otherwise(0) for f in flags}
    return audit(rows, names, measures)
