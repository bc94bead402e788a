import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbgrid.llm import passages, simhash
from plumbgrid.llm.queries import op2_simhash, op10_passages


def print_of(text):
    w = (text or "").encode().lower().split()
    s = [] if not w else [b" ".join(w)] if len(w) <= 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))


def components(ids, fps):
    a, root = np.array(fps, dtype=np.uint64), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2).tolist():
            root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_fingerprint_query_against_brute_force(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    fps = [print_of(t) for _, t in docs]
    want = sorted((d, f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, components([d for d, _ in docs], fps)))
    assert sorted(tuple(r) for r in op2_simhash(spark, data).collect()) == want


def shingles_of(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w)} if len(w) <= 5 else {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def similar_brute(rows, least=0.8):
    sets = [shingles_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low.setdefault(find(k), []).append(i)
    return [min((x for x in low[find(k)] if x is not None), default=None) for k in range(len(rows))]


def test_similar_groups_against_brute_force(spark):
    """Pairs just above and below 0.8, chains, copies, and texts without five words."""
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(3000))
    rows = [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "ONE two"), (905, "one three"), (None, "alone null id"), (903, "same id other text here now")]
    for g in range(40):
        base = [word() for _ in range(rnd.choice([12, 60, 300]))]
        rows.append((g * 20, " ".join(base)))
        for k in range(1, rnd.choice([2, 3, 9])):
            own = list(base)
            for _ in range(max(1, round(len(own) * rnd.choice([0.01, 0.02, 0.023, 0.03])))):
                own[rnd.randrange(len(own))] = word()
            rows.append((g * 20 + k, " ".join(own)))
            base = own if g % 3 == 0 else base
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, rep int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.similar_groups(df).collect()), key=str)
    assert got == sorted(zip([i for i, _ in rows], similar_brute(rows)), key=str)
    assert simhash.similar_groups(df.limit(0)).count() == 0


def test_links_are_exactly_two_bits(spark, tmp_path):
    from plumbgrid.workspace import Workspace

    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(base) | {b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base} | {b ^ 7 for b in base[:20]} | {base[0] ^ (1 << i) for i in range(64)} | {0, 3, 2**64 - 1, 2**64 - 4}
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in sorted(fps)]
    from plumbgrid.operators.graph import component_roots

    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in component_roots(simhash.fingerprint_links(df, Workspace(spark, "t"))).collect()}
    got = {}
    for i, f in enumerate(signed):
        got.setdefault(roots.get(f, f), []).append(i)
    want = {}
    for i, c in enumerate(components(list(range(len(signed))), [f % 2**64 for f in signed])):
        want.setdefault(c, []).append(i)
    assert sorted(got.values()) == sorted(want.values())


def test_simhash_edges(spark):
    rows = [(3, None, 1), (2, "", 1), (9, "\t \n", 1), (5, "one two", 1), (4, "ONE  two", 1), (None, "alone here", 1), (7, "x " * 20000, 1), (7, "x " * 20000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    zero = "0" * 16
    assert [g for g in got if g[1] == zero] == [(2, zero, 2), (3, zero, 2), (9, zero, 2)]
    assert {g[2] for g in got if g[0] in (4, 5)} == {4} and len(got) == 8 and [g[2] for g in got if g[0] is None] == [None]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def brute_passages(docs):
    seen, out = set(), {}
    for d, t in sorted(docs):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(left).hexdigest())
    return out


def tricky(n=60, seed=2):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "cc", "longer", "é", "Ünï", "of", "the"])
    passage = [word() for _ in range(70)]
    docs = [(0, None), (1, ""), (2, "a " * 19), (3, "a " * 500), (4, "a\t" * 25 + "\n" + "b " * 40)]
    for i in range(5, n):
        w = [word() for _ in range(rnd.randrange(120))]
        if i % 3 == 0:
            at = rnd.randrange(len(w) + 1)
            w[at:at] = passage[rnd.randrange(30) :]
        docs.append((i, rnd.choice([" ", "\n", " \t "]).join(w)))
    docs += [(n + k, docs[10][1]) for k in range(5)]
    near = passage + passage[:35]
    docs += [(n + 10 + k, " ".join(near[:k] + ["new"] + near[k:])) for k in range(60)]
    return docs


@pytest.mark.parametrize("limit", [passages.BUCKET_BYTES, 500])
def test_passages_against_brute_force(spark, limit):
    docs = tricky()
    df = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, novel int, h int").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in passages.remove_repeats(df, bucket_bytes=limit).collect()}
    assert got == brute_passages(docs)


def test_passage_query_against_brute_force(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: tuple(r)[1:] for r in op10_passages(spark, data).collect()} == brute_passages(docs)


def test_passage_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "k"), (1, text, "k"), (None, text, "n"), (2, "short", None)], "doc_id long, text string, lang string")
    got = sorted(((r["doc_id"], r["n_removed"], r["kept_text"], r["lang"]) for r in passages.remove_repeats(df, carry=("lang",)).collect()), key=str)
    assert got == sorted([(1, 0, text, "k"), (1, 0, text, "k"), (2, 0, "short", None), (None, 30, "", "n")], key=str)
    assert passages.remove_repeats(df.limit(0)).count() == 0


def test_rows_without_ids_are_told_apart(spark):
    """Texts that share the low 31 bits of their hash, and a row with the largest id beside one without any."""
    text = " ".join(f"w{i}" for i in range(30))
    low = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) & 0x7FFFFFFF
    first = {low(t): t for t in (f"{text} a{i}" for i in range(100_000))}
    a, b = next((first[low(t)], t) for t in (" ".join(f"v{i}" for i in range(30)) + f" b{k}" for k in range(400_000)) if low(t) in first)
    big = 2**63 - 1
    other = " ".join(f"x{i}" for i in range(25))
    rows = [(1, text), (None, a), (None, b), (big, other), (None, other), (5, b), (5, a)]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(1, 30, 0, text), (None, 31, 31, ""), (None, 31, 31, ""), (big, 25, 0, other), (None, 25, 25, ""), (5, 31, 0, b), (5, 31, 30, a.split()[-1])]
    assert got == sorted(want, key=str)


def test_hash_helpers():
    h = np.arange(50, dtype=np.uint64) * np.uint64(7919)
    for n in (1, 2, 3, 5, 20):
        x = passages._joined(h, n)
        assert len(x) == 50 - n + 1 and passages._joined(h[10:], n)[0] == x[10]
    v = np.array([5, 3, 9, 1, 7, 7, 2], dtype=np.uint64)
    assert passages._window_min(v, 3).tolist() == [3, 1, 1, 1, 2]
