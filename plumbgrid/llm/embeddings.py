"""Near-duplicate embeddings by Euclidean p-stable hashing.

Normalised vectors are projected on seeded Gaussian directions, shifted and cut into cells of width ``CELL``; ``k`` such
numbers make a bucket key, and every vector gets one key in each of ``L`` tables.  Vectors that share a bucket are
compared by exact cosine in double precision.  ``k`` follows the number of distinct vectors (about ``MEETINGS`` chance
members in a bucket) and ``L`` the recall wanted for a pair exactly at the threshold, both by the closed collision
probability; pairs above the threshold collide more often.

Equal vectors form one class with a count.  Pairs are never emitted: a bucket yields, for each vector, the number of
vectors linked in this bucket but in no earlier table's, and its root among the links found there.  A bucket of more
than ``BLOCK`` vectors is dealt out as pairs of blocks, each a task's group of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgrid.operators.graph import component_roots
from plumbgrid.workspace import Workspace

from .text import claim, pick

CELL, MEETINGS, BLOCK, STRIP = 2.0, 16, 4096, 512


def collision(distance: float, cell: float = CELL) -> float:
    """Probability that two points at this distance share a cell of one projection."""
    r = cell / distance
    inside = math.erf(r / math.sqrt(2))
    return inside - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Projections per key and number of tables for ``n`` distinct vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2.0))
    k = max(1, math.ceil(math.log(max(n, MEETINGS + 1) / MEETINGS) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Components of a list column one after another in double precision, and where each vector starts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    starts = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False).astype(np.float64)[starts[0] : starts[-1]], starts - starts[0]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # before squaring, so that no square over- or underflows
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _keys(k: int, tables: int, seed: int):
    """Adds the keys of all tables, packed as 64-bit integers; they mix the length of the vector, table and cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            flat, starts = _flat(batch.column("v"))
            sizes = np.diff(starts)
            out: list[bytes | None] = [None] * len(sizes)
            for dims in np.unique(sizes).tolist():
                if dims not in planes:
                    rng = np.random.default_rng([seed, dims])
                    planes[dims] = rng.standard_normal((dims, k * tables)), rng.uniform(0, CELL, k * tables)
                at = np.flatnonzero(sizes == dims)
                cells = np.floor((_unit(flat[starts[at][:, None] + np.arange(dims)]) @ planes[dims][0] + planes[dims][1]) / CELL)
                cells = cells.astype(np.int64).view(np.uint64).reshape(len(at), tables, k)
                h = np.broadcast_to(np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dims), (len(at), tables)).copy()
                for j in range(k):
                    h = (h ^ cells[:, :, j]) * np.uint64(0xD6E8FEB86659FD93)
                    h ^= h >> np.uint64(32)
                for i, row in zip(at.tolist(), h):
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "keys"])

    return run


_FOUND = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _group_links(t: int, i: int, j: int, rep: np.ndarray, n: np.ndarray, chunk: np.ndarray, v: np.ndarray, keys: np.ndarray, threshold: float) -> pa.RecordBatch | None:
    """Links inside one block (i = j) or between two blocks of a bucket of table ``t``."""
    m = len(rep)
    links, label = np.zeros(m, dtype=np.int64), np.arange(m)
    rows, cols = (np.arange(m), np.arange(m)) if i == j else (np.flatnonzero(chunk == i), np.flatnonzero(chunk == j))
    for begin in range(0, len(rows), STRIP):
        own = rows[begin : begin + STRIP]
        a, b = np.nonzero(v[own] @ v[cols].T >= threshold - 1e-9)
        a, b = own[a], cols[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        for s in range(0, len(a), 1 << 17):
            x, y = a[s : s + (1 << 17)], b[s : s + (1 << 17)]
            sure = (v[x] * v[y]).sum(axis=1) >= threshold
            sure &= ~(keys[x, :t] == keys[y, :t]).any(axis=1)
            x, y = x[sure], y[sure]
            np.add.at(links, x, n[y])
            np.add.at(links, y, n[x])
            while len(x):
                lx, ly = label[x], label[y]
                apart = lx != ly
                if not apart.any():
                    break
                x, y, low = x[apart], y[apart], np.minimum(lx, ly)[apart]
                np.minimum.at(label, np.maximum(lx, ly)[apart], low)
                while not (label[label] == label).all():
                    label = label[label]
    hit = np.flatnonzero(links)
    if not len(hit):
        return None
    return pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(links[hit]), pa.array(rep[label[hit]])], schema=_FOUND)


def _bucket_links(threshold: float, tables: int):
    """Rows in order of (bucket, block pair) -> what each group yields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("embeddings")
        rest: pa.Table | None = None

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            f = lambda c: table.column(c).to_numpy()
            key, t, i, j, rep, n, chunk = map(f, ("key", "t", "i", "j", "rep", "n", "chunk"))
            change = np.flatnonzero((np.diff(key) != 0) | (np.diff(t) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            flat, starts = _flat(table.column("v"))
            sizes, ks = np.diff(starts), table.column("keys").to_pylist()
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(key)]):
                if b - a < 2 or (sizes[a:b] != sizes[a]).any():  # keys mix the length: differing ones met by chance
                    continue
                v = _unit(flat[starts[a] : starts[b]].reshape(b - a, sizes[a]))
                if b - a <= STRIP and np.count_nonzero(v @ v.T >= threshold - 1e-9) == b - a:  # each is near itself only
                    continue
                k = np.frombuffer(b"".join(ks[a:b]), dtype=np.int64).reshape(-1, tables)
                out = _group_links(int(t[a]), int(i[a]), int(j[a]), rep[a:b], n[a:b], chunk[a:b], v, k, threshold)
                if out is not None:
                    yield out

        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            last = table.slice(table.num_rows - 1)
            same = np.logical_and.reduce([table.column(c).to_numpy() == last.column(c)[0].as_py() for c in ("key", "t", "i", "j")])
            k = int(np.argmax(same))  # the last group may go on in the next batch
            if k:
                yield from work(table.slice(0, k))
            rest = table.slice(k).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from work(rest)

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99, seed: int = 11) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``vec_id, n_links, component_id, kept``, a row for each row.

    Two vectors of one length link if a bucket brings them together and their cosine is ``threshold`` or more.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest vec_id that links reach, and
    ``kept`` marks the rows that bear it.  Null, zero and empty vectors and those with null or non-finite components
    link with nothing.  Equal vectors always link.  Rows that repeat a vec_id count as different vectors; a null vec_id
    counts as larger than any other.  Other columns are ignored.  No rows give no rows.
    """
    ws = Workspace(vectors.sparkSession, "embeddings")
    d = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    sound = F.coalesce(~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    d = d.withColumn("sound", sound)
    # numbers given once and written, so that classes stay apart whatever ids or hashes their vectors have
    classes = d.where("sound").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = ws.keep(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    k, tables = plan_tables(classes.count(), threshold, recall)
    hashed = classes.select("rep", "n", "v").mapInArrow(_keys(k, tables, seed), f"rep long, n long, v {dict(classes.dtypes)['v']}, keys binary")
    hashed = ws.keep(hashed, "hashed")
    placed = hashed.select("rep", F.posexplode(F.array(*[F.xxhash64(F.substring("keys", t * 8 + 1, 8), F.lit(t)) for t in range(tables)])).alias("t", "key"))
    sizes = placed.groupBy("key", "t").agg(F.count("*").alias("m")).where("m > 1")
    sizes = sizes.select("key", "t", F.ceil(F.col("m") / BLOCK).cast("int").alias("g"))
    met = placed.join(sizes, ["key", "t"]).withColumn("chunk", F.pmod("rep", "g").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o")
    met = met.select("rep", "t", "key", "chunk", other).select("rep", "t", "key", "chunk", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"))
    full = met.join(hashed, "rep").select("key", "t", "i", "j", "rep", "n", "chunk", "v", "keys")
    dealt = full.repartition("key", "t", "i", "j").sortWithinPartitions("key", "t", "i", "j")
    found = ws.keep(dealt.mapInArrow(_bucket_links(threshold, tables), "rep long, links long, root long"), "found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = component_roots(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    named = classes.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("v", "first", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(least, "root").select(F.col("v").alias("cv"), (F.col("links") + F.col("n") - 1).alias("n_links"), "component")
    named = ws.keep(named, "named")
    out = d.join(named, F.col("sound") & (F.col("v") == F.col("cv")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
