"""SimHash near-duplicates by segment popcounts.

A fingerprint is embedded as the bit counts of its 16 four-bit segments.  The Manhattan distance of two embeddings never
exceeds the Hamming distance of the fingerprints, so all links lie within Manhattan distance 2.  Two integer points at
that distance share a point at distance 1 or less, hence a range join on the grid needs only the 33 cells around each
distinct fingerprint, not all cells within 2; whoever shares a cell is a candidate.

Candidates are verified exactly: two that are alone in a cell by comparison, all others without forming pairs: two fingerprints differ in 2 bits or fewer
if and only if they share one of the 65 values at Hamming distance 1 or less from each.  Each such value links its
holders to the smallest of them.  The work is linear in the number of distinct fingerprints, however many meet.

Texts of a given similarity (``similar_groups``) can be too far apart for that: at a Jaccard index of 0.8 about ten of 64
bits differ, and popcounts bound nothing at this distance.  There the fingerprints' links are candidates beside those of
banded minimum hashes of the same shingles, and every candidate is verified by the exact index of the shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgrid.operators.graph import component_roots
from plumbgrid.workspace import Workspace

from .text import claim, pick, slices, to_bytes, trim

SHINGLE, SEED, BITS = 3, 42, 64
SEGMENT = 4  # bits in a segment
_LANES = np.uint64(0x0101010101010101)


def _majority(hashes: list[int]) -> int:
    """Bits that are set in over half the hashes, summed eight bit planes at a time in byte lanes."""
    n = len(hashes)
    a = np.zeros(-(-n // 255) * 255, dtype=np.uint64)
    a[:n] = hashes
    a = a.reshape(-1, 255)
    counts = np.empty((8, 8), dtype=np.int64)  # [byte, bit]
    for bit in range(8):
        counts[:, bit] = ((a >> np.uint64(bit)) & _LANES).sum(axis=1).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits((counts * 2 > n).reshape(64), bitorder="little").view(np.int64)[0])


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    """Hashes of the text's ``size``-word shingles, repeats included; of the whole text if it has fewer words."""
    words = (text or b"").lower().split()  # bytes: only A-Z are lowered
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(line, SEED)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]


def fingerprint(text: bytes | None, size: int) -> int:
    """Signed 64-bit SimHash of the text's ``size``-word shingles; zero without words."""
    hashes = shingle_hashes(text, size)
    return _majority(hashes) if hashes else 0


def _fingerprints(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(t, size) for t in to_bytes(b.column("text"))], pa.int64())], schema=schema)
        trim()

    return run


def _segments(fp: str) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(F.col(fp), SEGMENT * k).bitwiseAND(F.lit(2**SEGMENT - 1))).cast("long") for k in range(BITS // SEGMENT)]


def _cells(fp: str) -> Column:
    """The grid points at Manhattan distance 1 or less from the embedding, packed four bits to a coordinate."""
    counts = _segments(fp)
    here = sum((F.shiftleft(c, SEGMENT * k) for k, c in enumerate(counts)), F.lit(0).cast("long"))
    near = [here]
    for k, c in enumerate(counts):
        near.append(F.when(c < SEGMENT, here + F.lit(1 << SEGMENT * k)))
        near.append(F.when(c > 0, here - F.lit(1 << SEGMENT * k)))
    return F.array_compact(F.array(*near))


def _balls(fp: str) -> Column:
    """All values at Hamming distance 1 or less."""
    signed = lambda k: (1 << k) - (1 << 64) if k == 63 else 1 << k
    return F.array(F.col(fp), *[F.col(fp).bitwiseXOR(F.lit(signed(k)).cast("long")) for k in range(BITS)])


def fingerprint_links(fps: DataFrame, ws: Workspace) -> DataFrame:
    """Distinct ``fps(fp)`` -> star links ``(u, v)`` whose components are those of Hamming distance 2 or less."""
    cells = fps.select("fp", F.explode(_cells("fp")).alias("cell"))
    met = cells.groupBy("cell").agg(F.min("fp").alias("u"), F.max("fp").alias("v"), F.count("*").alias("n"))
    met = ws.keep(met.where("n > 1"), "met")
    # two alone in a cell are compared at once, which settles most chance meetings; the others are verified by balls
    pairs = met.where((F.col("n") == 2) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).select("u", "v")
    crowded = ws.beside(ws.keep(met.where("n > 2").select("cell"), "crowded"), "crowded")
    candidates = ws.keep(cells.join(crowded, "cell").select("fp").distinct(), "candidates")
    near = candidates.select("fp", F.explode(_balls("fp")).alias("value"))
    heads = near.groupBy("value").agg(F.min("fp").alias("u"), F.max("fp").alias("hi")).where("u != hi").select("value", "u").hint("merge")
    return near.join(heads, "value").where("u != fp").select("u", F.col("fp").alias("v")).unionByName(pairs)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, fingerprint, component_id``, a row for each row.

    Texts are lower-cased (A-Z); fewer words than a shingle make one shingle of the whole, none at all make fingerprint
    zero, linked like any other.  Fingerprints link at 2 or fewer differing bits; ``component_id`` is the smallest
    doc_id that links reach.  Null texts have no words.  Rows with equal ids keep their own fingerprints; a null id
    counts as larger than any other and is null only if its component holds nothing else.  Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = ws.keep(d.mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "prints")
    classes = ws.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = component_roots(fingerprint_links(classes.select("fp"), ws)).withColumnRenamed("node", "fp")
    named = ws.keep(classes.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    least = ws.keep(named.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    reached = ws.keep(named.join(ws.beside(least, "least"), "root").select("fp", "component_id"), "reached")
    out = prints.join(ws.beside(reached, "reached"), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


BLOCK, STRIP = 512, 2048  # texts on a side of a block, shingles compared at once
ROWS, BANDS = 5, 20  # a pair at 0.8 shares a band with probability 0.9996, one at 0.9 with 1 - 1e-8


def _sketches(size: int, rows: int, bands: int):
    """Texts -> digest, fingerprint and band keys."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                digests, prints, keys = [], [], []
                for t in to_bytes(b.column("text")):
                    hashes = shingle_hashes(t, size)
                    digests.append(hashlib.sha256(t or b"").digest())
                    prints.append(_majority(hashes) if hashes else 0)
                    h = np.unique(np.array(hashes or [0], dtype=np.uint64))
                    least = np.full(rows * bands, np.uint64(2**64 - 1))
                    for a in range(0, len(h), 1024):
                        np.minimum(least, (factors[:, None] * h[None, a : a + 1024]).min(axis=1), out=least)
                    keys.append(least.tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digests, pa.binary()), pa.array(prints, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "digest", "fp", "keys"])
        trim()

    return run


def _verified(size: int, similarity: float):
    """Pairs of texts -> those whose shingle sets have the Jaccard index wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash-verify")
        last: tuple[int, set[int]] = (-1, set())
        for b in batches:
            keep = []
            for u, a, c in zip(b.column("u").to_pylist(), b.column("a"), b.column("c")):
                if last[0] != u:
                    last = u, set(shingle_hashes(a.as_buffer().to_pybytes(), size))
                other = set(shingle_hashes(c.as_buffer().to_pybytes(), size))
                both = len(last[1] & other)
                keep.append(both >= similarity * (len(last[1]) + len(other) - both))  # two texts without words are equal
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        trim()

    return run


def _shingle_sets(size: int):
    """``rep, text`` -> ``rep, s``: the sorted distinct hashes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash-sets")
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                sets = [np.unique(np.array(shingle_hashes(t.as_buffer().to_pybytes(), size), dtype=np.uint64)).tobytes() for t in b.column("text")]
                yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(sets, pa.binary())], names=["rep", "s"])
        trim()

    return run


def _overlaps(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """How many members each of the sets ``rows`` shares with each of ``cols``; a strip of shared members at a time."""
    out = np.zeros((len(rows), len(cols)), dtype=np.float32)
    if not rows or not cols:
        return out
    a, b = np.concatenate(rows), np.concatenate(cols)
    shared = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    if not len(shared):
        return out

    def placed(values: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[at] == values
        return np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit], at[hit]

    (ra, ca), (rb, cb) = placed(a, rows), placed(b, cols)
    for start in range(0, len(shared), STRIP):
        m = []
        for r, c, n in ((ra, ca, len(rows)), (rb, cb, len(cols))):
            own = (c >= start) & (c < start + STRIP)
            x = np.zeros((n, min(STRIP, len(shared) - start)), dtype=np.float32)
            x[r[own], c[own] - start] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def _block_links(similarity: float):
    """Rows in order of ``g, i, j`` -> links between the blocks' sides that join what is not joined yet in the block."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        few, every = ([r for r in rows if r[0] == side] for side in (0, 1))
        sets = [[np.frombuffer(r[3], dtype=np.uint64) for r in x] for x in (few, every)]
        both = _overlaps(*sets)
        size = [np.array([len(s) for s in x], dtype=np.float32) for x in sets]
        x, y = np.nonzero((both >= similarity * (size[0][:, None] + size[1][None] - both)) & (np.array([r[2] for r in few])[:, None] != np.array([r[2] for r in every])[None]))
        parent: dict[int, int] = {}

        def find(c: int) -> int:
            while (p := parent.setdefault(c, c)) != c:
                parent[c] = c = parent[p]
            return c

        u, v = [], []
        for k, m in zip(x.tolist(), y.tolist()):
            p, q = find(few[k][2]), find(every[m][2])
            if p != q:
                parent[p] = q
                u.append(few[k][1])
                v.append(every[m][1])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash-blocks")
        current, held = None, []
        for b in batches:
            for g, i, j, *row in zip(*[b.column(c).to_pylist() for c in ("g", "i", "j", "side", "rep", "root", "s")]):
                if (g, i, j) != current:
                    if held:
                        yield work(held)
                    current, held = (g, i, j), []
                held.append(tuple(row))
        if held:
            yield work(held)
        trim()

    return run


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, fingerprint, component_id, group_id, digest``, a row for each row.

    Two texts link if the Jaccard index of their sets of ``shingle``-word shingles (lower-cased, a shorter text being one
    shingle) is ``similarity`` or more; ``component_id`` is the smallest doc_id that links reach.  Candidates are texts
    whose fingerprints differ in 2 bits or fewer and texts that share a band of ``rows`` minimum hashes; ``bands`` of them
    are tried.  Equal texts are one candidate.  In a bucket every text is first compared with its smallest.  Where that
    leaves several components of a group that candidates hold together, the texts outside its largest component are
    compared with all others of the group in blocks, whose size is bounded and which yield joining links only.  Null texts count as empty, empty ones link with each other.  Rows with
    equal ids keep their own fingerprints; a null id counts as larger than any other.  ``group_id`` tells groups apart that
    share their smallest doc_id, or have none (a number of this call); ``digest`` is the text's SHA-256, null counting as
    empty.  Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "similar")
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    prints = ws.keep(d.mapInArrow(_sketches(shingle, rows, bands), "doc_id long, digest binary, fp long, keys binary"), "prints")
    # numbers given once and written, so that classes stay apart
    classes = prints.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("keys").alias("keys"))
    classes = ws.keep(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    band = lambda t: F.xxhash64(F.substring("keys", t * rows * 8 + 1, rows * 8), F.lit(t))
    placed = classes.select("rep", F.posexplode(F.array(*[band(t) for t in range(bands)])).alias("t", "key"))
    shared = placed.groupBy("t", "key").agg(F.min("rep").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = ws.keep(placed.join(ws.beside(ws.keep(shared, "shared"), "shared"), ["t", "key"]), "members")
    prime = ws.keep(classes.groupBy("fp").agg(F.min("rep").alias("r")), "prime")
    near = fingerprint_links(prime.select("fp"), ws)
    for c in ("u", "v"):
        near = near.join(ws.beside(prime.select(F.col("fp").alias(c), F.col("r").alias(f"r{c}")), "prime"), c).drop(c).withColumnRenamed(f"r{c}", c)
    pairs = members.select("u", F.col("rep").alias("v")).unionByName(near).unionByName(classes.join(ws.beside(prime, "prime"), "fp").select(F.col("r").alias("u"), F.col("rep").alias("v")))
    pairs = ws.keep(pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    used = pairs.select(F.explode(F.array("u", "v")).alias("rep")).distinct().join(classes.select("rep", "digest").hint("merge"), "rep")
    used = ws.beside(ws.keep(used, "used"), "used")
    texts = d.withColumn("digest", F.unhex(F.sha2("text", 256))).join(used, "digest").groupBy("rep").agg(F.first("text").alias("text"))
    texts = ws.keep(texts.select("rep", F.col("text").cast("binary").alias("text")), "texts")

    def verify(some: DataFrame) -> DataFrame:
        a, c = (ws.beside(texts, "texts").select(F.col("rep").alias(k), F.col("text").alias(x)) for k, x in (("u", "a"), ("v", "c")))
        return some.join(a, "u").join(c, "v").select("u", "v", "a", "c").mapInArrow(_verified(shingle, similarity), "u long, v long")

    links = ws.keep(verify(pairs), "links")
    roots = component_roots(links).withColumnRenamed("node", "rep")
    # what candidates hold together but links do not yet: texts outside the largest component against all of the group
    loose = component_roots(pairs).withColumnRenamed("node", "rep").withColumnRenamed("root", "g")
    housed = ws.keep(loose.join(roots.hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "housed")
    sizes = housed.groupBy("g", "root").agg(F.count("*").alias("n")).groupBy("g")
    sizes = sizes.agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("k"), F.sum("n").alias("n"), F.max("n").alias("top")).where("k > 1")
    sizes = ws.beside(ws.keep(sizes, "sizes"), "sizes")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = housed.join(sizes.select("g", "most", blocks(F.col("n") - F.col("top")).alias("bi"), blocks(F.col("n")).alias("bj")), "g")
    sets = texts.join(open_.select("rep").hint("merge"), "rep", "left_semi").mapInArrow(_shingle_sets(shingle), "rep long, s binary")
    open_ = ws.keep(open_.join(sets.hint("merge"), "rep"), "open")
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["rep", "root", "s"]
    few = open_.where("root != most").select("g", place("bi").alias("i"), upto("bj").alias("j"), F.lit(0).alias("side"), *own)
    every = open_.select("g", upto("bi").alias("i"), place("bj").alias("j"), F.lit(1).alias("side"), *own)
    dealt = few.unionByName(every).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    more = dealt.mapInArrow(_block_links(similarity), "u long, v long")
    links = ws.keep(links.unionByName(more), "all-links")
    roots = component_roots(links).withColumnRenamed("node", "rep")
    named = classes.select("rep", "digest", "first").join(roots.hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = ws.keep(named, "named")
    least = ws.keep(named.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    reached = ws.keep(named.join(ws.beside(least, "least"), "root").select("digest", "component_id", F.col("root").alias("group_id")), "reached")
    out = prints.join(ws.beside(reached, "reached"), "digest")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group_id", "digest")
