"""Match graph: verified edges, components, bridge candidates by descriptor similarity and by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgrid.functions.scalars import pair_id
from plumbgrid.operators.filters import is_finite
from plumbgrid.operators.graph import connected_components
from plumbgrid.workspace import Workspace

#: Vectors of a block of the pool and of a block of queries that meet at once, and their bytes.
POOL_BLOCK, QUERY_BLOCK, BLOCK_BYTES = 8192, 2048, 4 << 20
#: Bytes of the smaller side's blocks that are a broadcast at a time.
PIECE_BYTES = 16 << 20
#: Queries of a block that meet a block of the pool at a time, and vectors of the pool whose largest product stands for them.
STRIP, GROUP = 256, 64


def verified_edges(images: DataFrame, geometries: DataFrame, min_inliers: int) -> DataFrame:
    """``geometries(src, dst, rows)`` with enough rows between two known ``images(image_id)``."""
    known = lambda c: images.select(F.col("image_id").alias(c))
    good = geometries.where(F.col("rows") >= min_inliers)
    return good.join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi").select("src", "dst", "rows")


def verified_pair_count(geometries: DataFrame, min_inliers: int) -> DataFrame:
    return geometries.agg(F.count(F.when(F.col("rows") >= min_inliers, 1)).alias("verified_pairs"))


def match_components(images: DataFrame, geometries: DataFrame, min_inliers: int) -> DataFrame:
    """``image_id, component`` by verified edges; images without any stand alone."""
    e = verified_edges(images, geometries, min_inliers).select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return connected_components(images.select(F.col("image_id").alias("node")), e).withColumnRenamed("node", "image_id")


def main_component(components: DataFrame) -> DataFrame:
    """Label of the largest component, of equal ones that with the smallest member."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))


def mean_descriptors(descriptors: DataFrame) -> DataFrame:
    """``descriptors(image_id, d array)`` -> unit mean vector ``v`` of each image; vanishing means are dropped.

    Means are partial aggregates by image and dimension, so an image with any number of descriptors is never gathered.
    """
    one = descriptors.select("image_id", F.posexplode("d").alias("k", "x"))
    mean = one.groupBy("image_id", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    v = mean.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("s"))
    v = v.select("image_id", F.transform("s", lambda p: p["m"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.withColumn("n", norm).where("n > 1e-12").select("image_id", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _packed(vectors: DataFrame, blocks: int, name: str) -> DataFrame:
    """``vectors(id, v)`` -> ``block, len`` and the block's vectors in order of their ids; ``len`` is the vectors' length."""
    dealt = vectors.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)), "len": F.size("v")})
    return dealt.groupBy("block", "len").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias(name))


def _matrix(cell: pa.StructScalar, length: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, vectors and which of them hold nulls."""
    rows = cell.values
    flat = rows.field("v").flatten()
    m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), length)
    return rows.field("id"), m, np.asarray(flat.is_null()).reshape(len(rows), length).any(axis=1)


def _best_of_blocks(k: int, min_similarity: float | None):
    """Pairs of blocks ``len, q, p`` -> ``src, dst, similarity``: each query's best ``k`` of the block.

    A matrix product bounds the similarities; whatever can be among the best ``k`` within its rounding errors is summed
    again in the vectors' order, as :func:`dot` does, so results do not depend on blocks.
    """

    def in_groups(rough: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates of finite products: of ``k`` groups' largest products none is above the k-th best, so only groups that reach the least of them are looked into."""
        starts = np.arange(0, rough.shape[1], GROUP)
        whole = rough.shape[1] // GROUP
        tops = rough[:, : whole * GROUP].reshape(len(rough), whole, GROUP).max(axis=2)
        if whole < len(starts):
            tops = np.column_stack((tops, rough[:, whole * GROUP :].max(axis=1)))
        floor = np.partition(tops, len(starts) - k, axis=1)[:, [len(starts) - k]] - slack
        i, g = np.nonzero(tops >= floor)
        j = starts[g][:, None] + np.arange(GROUP)
        near = (j < rough.shape[1]) & (rough[i[:, None], np.minimum(j, rough.shape[1] - 1)] >= floor[i])
        at, nth = np.nonzero(near)
        return i[at], j[at, nth]

    def best(q: tuple, p: tuple, length: int, rows: slice, same: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = q[1][rows], p[1]
        with np.errstate(all="ignore"):
            long_a, long_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1).max(initial=0.0)
            long_a, long_b = np.maximum(long_a, 1e-150), np.maximum(long_b, 1e-150)  # squares of less vanish
            rough = a @ b.T
            slack = 8 * (length + 1) * np.finfo(float).eps * long_a[:, None] * long_b
            finite = not q[2][rows].any() and not p[2].any() and long_a.max(initial=0.0) * long_b < 1e300
        if not finite:
            rough[np.isnan(rough)] = np.inf  # NaN comes first, null last
            rough[q[2][rows]] = -np.inf
            rough[:, p[2]] = -np.inf
        own = [(i, same[i + rows.start]) for i in range(len(a)) if i + rows.start in same] if same else []
        for i, j in own:
            rough[i, j] = -np.inf
        if finite and rough.shape[1] > k * GROUP:
            i, j = in_groups(rough, slack)
        else:
            if rough.shape[1] > k:
                least = np.partition(rough, rough.shape[1] - k, axis=1)[:, [rough.shape[1] - k]]
                with np.errstate(all="ignore"):
                    floor = least - slack
                can = (rough >= floor) | np.isnan(floor)
            else:
                can = np.ones(rough.shape, dtype=bool)
            for i, j in own:
                can[i, j] = False
            i, j = np.nonzero(can)
        value = np.zeros(len(i))
        with np.errstate(all="ignore"):
            for d in range(length):
                value += a[i, d] * b[j, d]
        none = q[2][rows][i] | p[2][j]
        value[none] = 0.0
        if min_similarity is not None:
            fits = ~none & ((value >= min_similarity) | np.isnan(value))
            i, j, value, none = i[fits], j[fits], value[fits], none[fits]
        high = np.isnan(value)
        order = np.lexsort((j, -np.where(high, 0.0, value), none * 2 - high, i))
        i, j, value, none = i[order], j[order], value[order], none[order]
        take = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[take] + rows.start, j[take], value[take], none[take]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                length = batch.column("len")[r].as_py()
                q, p = _matrix(batch.column("q")[r], length), _matrix(batch.column("p")[r], length)
                at = {x: j for j, x in enumerate(p[0].to_pylist())}
                same = {i: at[x] for i, x in enumerate(q[0].to_pylist()) if x in at}
                for start in range(0, len(q[0]), STRIP):
                    i, j, value, none = best(q, p, length, slice(start, start + STRIP), same)
                    yield pa.RecordBatch.from_arrays([q[0].take(pa.array(i)), p[0].take(pa.array(j)), pa.array(value, mask=none)], names=["src", "dst", "similarity"])

    return run


def cosine_top_k(queries: DataFrame, pool: DataFrame, k: int = 3, min_similarity: float | None = None) -> DataFrame:
    """``src, dst, similarity, rank``: the ``k`` pool vectors of equal length nearest to each query vector, ties by id.

    Ids are distinct on either side.  Both sides are written once and packed into blocks of bounded size; the smaller one's are
    broadcast, ``PIECE_BYTES`` at a time, to all blocks of the other, which meet them in matrix products and keep each
    query's best ``k`` of a block before the shuffle.
    """
    ws = Workspace(queries.sparkSession, "cosine")
    tidy = lambda df, name: ws.keep(df.where("image_id is not null and v is not null").select(F.col("image_id").alias("id"), F.col("v").cast("array<double>").alias("v")), name)
    q, p = tidy(queries, "queries"), tidy(pool, "pool")
    (n, wide), (held, long) = (df.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first() for df in (q, p))
    row = 8 * max(wide, long, 1)
    fits = max(1, BLOCK_BYTES // row)
    parallel = ws.spark.sparkContext.defaultParallelism
    few, many = (held, n) if held <= n else (n, held)
    blocks = {"p": -(-held // min(POOL_BLOCK, fits)), "q": -(-n // min(QUERY_BLOCK, fits))}
    small, large = ("p", "q") if held <= n else ("q", "p")
    blocks[large] = min(max(blocks[large], 2 * parallel), max(many, 1))
    pieces = max(1, -(-few * row // PIECE_BYTES))
    blocks[small] = max(blocks[small], pieces)
    packed = {c: ws.keep(_packed(df, blocks[c], c), f"packed-{c}") for c, df in (("q", q), ("p", p))}
    stream = packed[large].drop("block").repartition(min(blocks[large], 4 * parallel))
    kinds = dict(queries.dtypes)["image_id"], dict(pool.dtypes)["image_id"]

    def met(part: DataFrame) -> DataFrame:
        pairs = stream.join(F.broadcast(part.drop("block")), "len")  # a piece has PIECE_BYTES
        return pairs.select("len", "q", "p").mapInArrow(_best_of_blocks(k, min_similarity), f"src {kinds[0]}, dst {kinds[1]}, similarity double")

    if pieces == 1:
        found = met(packed[small])
    else:
        for b in range(pieces):  # each piece's result is written, so that the plan does not grow with them
            met(packed[small].where(F.col("block") % pieces == b)).write.mode("overwrite").parquet(ws.path(f"best/piece={b}"))
        found = ws.spark.read.schema(met(packed[small]).schema).parquet(*[ws.path(f"best/piece={b}") for b in range(pieces)])
    order = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def position_top_k(queries: DataFrame, pool: DataFrame, radius: float = 150.0, k: int = 3) -> DataFrame:
    """``src, dst, distance, rank``: the ``k`` nearest pool positions within ``radius`` metres, ties by id.

    The nearest come from the tree of :func:`plumbgrid.operators.neighbors.nearest`, so no place is too dense for a task however
    many positions lie within the radius; one more than ``k`` is asked for, as an image's own position does not count.
    """
    from plumbgrid.operators.neighbors import nearest

    placed = lambda df: df.where(is_finite("x", "y", "z")).select(F.col("image_id").alias("point_id"), "x", "y", "z")
    met = nearest(placed(queries), k + 1, placed(pool)).where((F.col("point_id") != F.col("other_id")) & (F.col("distance") <= float(radius)))
    met = met.select(F.col("point_id").alias("src"), F.col("other_id").alias("dst"), "distance")
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bridge_pairs(components: DataFrame, vectors: DataFrame, locations: DataFrame, k: int = 3, radius: float = 150.0) -> DataFrame:
    """``a, b, kinds``: candidate pairs between images outside the main component and those inside, each once.

    Candidates come from descriptor similarity and from positions; ``kinds`` tells from which.
    """
    ws = Workspace(components.sparkSession, "bridge")
    main = main_component(components).withColumn("inside", F.lit(True))
    sides = ws.keep(components.join(F.broadcast(main), "component", "left").select("image_id", F.coalesce("inside", F.lit(False)).alias("inside")), "sides")  # one row
    inside, outside = (ws.beside(sides.where(c).select("image_id"), "sides") for c in ("inside", "not inside"))
    part = lambda df, ids: df.join(ids, "image_id", "left_semi")
    by_look = cosine_top_k(part(vectors, outside), part(vectors, inside), k).select("src", "dst", F.lit("retrieval").alias("kind"))
    by_place = position_top_k(part(locations, outside), part(locations, inside), radius, k).select("src", "dst", F.lit("position").alias("kind"))
    both = by_look.unionByName(by_place).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "kind")
    return both.groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_set("kind")), "+").alias("kinds"))


def named_pairs(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Names of both images of each pair, sorted by pair."""
    name = lambda i, n: images.select(F.col("image_id").alias(i), F.col("name").alias(n))
    return pairs.join(name("a", "name_a"), "a").join(name("b", "name_b"), "b").orderBy("a", "b")


def purge_pairs(table: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of a table keyed by ``pair_id`` without the listed pairs ``(a, b)``."""
    return table.join(listed.select(pair_id(F.col("a"), F.col("b")).alias("pair_id")).distinct(), "pair_id", "left_anti")


def same_image_set(found: DataFrame, expected: DataFrame) -> bool:
    """Whether two sets of names agree in number and, but for case, in members."""
    a, b = (d.select(F.lower("name").alias("k")) for d in (found, expected))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def name_collisions(images: DataFrame) -> DataFrame:
    """Names that differ only in case, with their number."""
    return images.groupBy(F.lower("name").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def manifest_changes(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rows ``name, size`` that only one side has; none if a prepared folder can be used again."""
    a, b = current.select("name", "size"), recorded.select("name", "size")
    return a.exceptAll(b).withColumn("side", F.lit("current")).unionByName(b.exceptAll(a).withColumn("side", F.lit("recorded")))


def component_sizes(components: DataFrame) -> DataFrame:
    """``component, size, rank`` by (size descending, smallest member); one row per component is ranked."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "component")))
