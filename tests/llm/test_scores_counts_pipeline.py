import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from plumbgrid.llm import brown
from plumbgrid.llm.queries import op9_brown
from plumbgrid.llm.token_counts import TokenLedger
from plumbgrid.workspace import Workspace


def check_base(rows, got):
    c, ends = collections.Counter(), 0
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            c.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        b = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        r = got[i]
        assert r["base_score"] == pytest.approx(b, rel=1e-9, abs=1e-9) and r["n_known"] == sum(c[x] > 0 for x in w) + (ends > 0)
        assert (r["n_tokens"], r["train_tokens"], r["held_out"]) == (len(w) + 1, n, i is not None and zlib.crc32(str(i).encode()) % 10 == 0)


def test_query_base_and_gain(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in op9_brown(spark, data).collect()}
    check_base(rows, got)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def tokens_of(t):
    return (t or "").encode().lower().split()


def brute_scores(rows, model, classes):
    """Scores from the model's word classes alone: every count is made again from the texts."""
    kind = {w: int(k) for w, k in zip(model.hot, model.own)} | {bytes(r["w"]): r["k"] for r in model.rare.collect()}
    seen = collections.Counter()
    pairs = np.zeros((classes + 1, classes + 1))
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            w = tokens_of(t)
            seen.update(w)
            c = [classes, *[kind[x] for x in w], classes]
            np.add.at(pairs, (c[:-1], c[1:]), 1)
    assert set(seen) == set(kind)  # every training word has a class
    once = np.bincount([kind[w] for w, c in seen.items() if c == 1], minlength=classes)
    assert once[model.unknown] == once.max()
    mass = np.zeros(classes)
    for w, c in seen.items():
        mass[kind[w]] += c + 0.1
    mass[model.unknown] += 0.1
    emit = lambda w: (seen[w] + 0.1) / mass[kind.get(w, model.unknown)]
    prior = np.where(np.append(mass > 0, True), pairs.sum(axis=0) + 0.1, 0)
    prior /= prior.sum()
    trans = 0.75 * (pairs + 5.0 * prior) / (pairs.sum(axis=1, keepdims=True) + 5.0) + 0.25 * prior
    # the next token after any class: the end, every word that was seen and one that was not
    share = np.bincount([*[kind[w] for w in seen], model.unknown], weights=[*[emit(w) for w in seen], emit(b"\0")], minlength=classes)
    assert np.allclose(trans[:, :classes] @ share + trans[:, classes], 1.0)
    out = []
    for _, t in rows:
        w = tokens_of(t)
        c = [classes, *[kind.get(x, model.unknown) for x in w], classes]
        out.append(sum(math.log10(emit(x)) for x in w) + sum(math.log10(trans[x, y]) for x, y in zip(c, c[1:])))
    return out


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_edges_small_tables_and_brute_force_scores(spark, hot):
    rows = [(1, None), (2, ""), (3, "A b a"), (4, "b c é"), (5, "zz " * 500), (None, "a b"), (36, "never seen"), (29, "a b c"), (7, "r r s r t u v"), (8, "y" * 100 + " a"), (8, "a b a"), (46, "s t r " * 3)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, held_out string")
    got = brown.score_texts(df, hot_words=hot, classes=3, sweeps=2).collect()
    check_base_rows(rows, got)
    assert all(r["score"] < 0 and r["perplexity"] > 1 for r in got)
    model, _, _ = brown.fit(df, Workspace(spark, "t"), hot, 3, 2)
    want = sorted(zip([str(i) for i, _ in rows], brute_scores(rows, model, 3)))
    assert [x for x, _ in want] == sorted(str(r["doc_id"]) for r in got)
    for (_, a), b in zip(want, sorted((str(r["doc_id"]), r["score"]) for r in got)):
        assert b[1] == pytest.approx(a, rel=1e-9)
    assert brown.score_texts(df.limit(0)).count() == 0


def check_base_rows(rows, got):
    """As ``check_base`` for rows whose ids repeat: by id and number of tokens."""
    have = {(r["doc_id"], r["n_tokens"]): r for r in got}
    for i, t in rows:
        r = have[(i, len(tokens_of(t)) + 1)]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 10 == 0)
    c = collections.Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10 for w in tokens_of(t))
    ends = sum(i is None or zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows)
    n, v = sum(c.values()) + ends, len(c) + 1
    for i, t in rows:
        r = have[(i, len(tokens_of(t)) + 1)]
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens_of(t)) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        assert r["base_score"] == pytest.approx(want, rel=1e-9) and r["train_tokens"] == n


def test_query_scores_equal_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, _, _ = brown.fit(docs, Workspace(spark, "t"), 200, 8, 2)  # most words are rare ones
    got = {r["doc_id"]: r["score"] for r in brown.score_texts(docs, 200, 8, 2).collect()}
    for (i, _), s in zip(rows, brute_scores(rows, model, 8)):
        assert got[i] == pytest.approx(s, rel=1e-9)


@pytest.mark.parametrize("seed", range(5))
def test_best_class_is_that_of_the_greatest_likelihood(seed):
    """Against recounting all pairs with the word in every class."""
    rng = np.random.default_rng(seed)
    classes, v = 4, 12
    seq = rng.integers(0, v, 300)
    own = rng.integers(0, classes + 1, v)  # the last class can be left only
    m = classes + 2

    def count(own):
        n = np.zeros((m, m), dtype=np.int64)
        c = own[seq]
        np.add.at(n, (c[:-1], c[1:]), 1)
        return n

    for w in range(v):
        s, p = np.zeros((1, m), dtype=np.int64), np.zeros((1, m), dtype=np.int64)
        d = np.zeros(1, dtype=np.int64)
        for a, b in zip(seq, seq[1:]):
            if a == b == w:
                d += 1
            elif a == w:
                s[0, own[b]] += 1
            elif b == w:
                p[0, own[a]] += 1
        tried = [brown.likelihood(count(np.where(np.arange(v) == w, k, own))) for k in range(classes)]
        got = brown.best_classes(count(own), own[[w]], s, p, d, classes)[0]
        assert tried[got] == pytest.approx(max(tried), abs=1e-6)
        without = count(own)
        np.subtract.at(without, (own[seq[:-1]], own[seq[1:]]), ((seq[:-1] == w) | (seq[1:] == w)).astype(np.int64))
        got = brown.best_classes(without, np.array([-1]), s, p, d, classes)[0]
        assert tried[got] == pytest.approx(max(tried), abs=1e-6)


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    truth = np.array([0, 0, 0, 1, 1, 1])
    seq = []
    for i in range(4000):
        seq.append(int(rng.choice(np.flatnonzero(truth == i % 2))))
    seq = np.array(seq)
    own, m = np.arange(6) % 2, 4
    for step in range(12):
        c = own[seq]
        n = np.zeros((m, m), dtype=np.int64)
        np.add.at(n, (c[:-1], c[1:]), 1)
        succ, pred, same = np.zeros((6, m), dtype=np.int64), np.zeros((6, m), dtype=np.int64), np.zeros(6, dtype=np.int64)
        for a, b in zip(seq, seq[1:]):
            if a == b:
                same[a] += 1
            else:
                succ[a, own[b]] += 1
                pred[b, own[a]] += 1
        w = np.array([step % 6])
        own[w] = brown.best_classes(n, own[w], succ[w], pred[w], same[w], 2)
    assert len(set(own[:3])) == 1 and len(set(own[3:])) == 1 and own[0] != own[3]


SCHEMA = "doc_id long, version string, seq int, op string, source string, lang string, n_tokens long"


def recount(batches):
    state = {}
    rank = {"delete": 3, "revise": 2, "insert": 1}
    for rows in batches:
        last = {}
        for r in rows:
            if r[0] is None or r[1] is None or r[3] not in rank:
                continue
            k = (r[2], rank[r[3]], r[6] or 0)
            if r[:2] not in last or k > last[r[:2]][0]:
                last[r[:2]] = (k, r)
        for key, (_, r) in last.items():
            if r[3] == "insert":
                state[key] = (r[4], r[5], r[6] or 0)
            elif r[3] == "delete":
                state.pop(key, None)
            elif key in state:
                old = state[key]
                state[key] = (*(old[:2] if r[4] is None and r[5] is None else r[4:6]), r[6] or 0)
    out = collections.defaultdict(lambda: [0, 0])
    for (_, v), (s, g, n) in state.items():
        out[(s, g, v)][0] += 1
        out[(s, g, v)][1] += n
    return {k: tuple(v) for k, v in out.items()}


def test_ledger_equals_recount(spark):
    rnd = random.Random(7)
    ledger = TokenLedger(spark, Workspace(spark, "t").path("ledger"), parts=3)
    batches = []
    for b in range(4):
        rows = [
            (rnd.choice([None, *range(12)]), rnd.choice(["v1", "v2"]), s, rnd.choice(["insert", "insert", "revise", "delete", "odd"]), rnd.choice(["a", "b", None]), rnd.choice(["en", None]), rnd.choice([None, 5, 7, s * 1000]))
            for s in range(15)
        ]
        batches.append(rows)
        assert ledger.commit(f"b{b}", spark.createDataFrame(rows, SCHEMA))
        got = {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}
        assert got == recount(batches)
        assert not ledger.commit(f"b{b}", spark.createDataFrame(rows, SCHEMA))  # again: no change
    assert ledger.commit("empty", spark.createDataFrame([], SCHEMA)) and ledger.batches()[-1] == "empty"
    assert {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()} == recount(batches)
    assert TokenLedger(spark, Workspace(spark, "t").path("none")).totals().count() == 0


def test_ledger_survives_a_half_written_commit(spark, monkeypatch):
    """What a lost driver leaves behind is overwritten; extra columns with the ledger's own names are ignored."""
    ledger = TokenLedger(spark, Workspace(spark, "t").path("ledger"))
    rows = [(i, "v", 1, "insert", "a", "en", i) for i in range(20)]
    df = lambda r: spark.createDataFrame([(*x, 9, "x", 3) for x in r], SCHEMA + ", part int, c string, hit int")
    assert ledger.commit("one", df(rows))
    more = [(i, "v", 1, "revise", None, None, 100) for i in range(5)]
    with monkeypatch.context() as patch:
        patch.setattr(TokenLedger, "_publish", lambda self, m: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            ledger.commit("two", df(more))
    assert {(r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()} == {(20, 190)} and ledger.batches() == ["one"]
    assert ledger.commit("two", df(more)) and not ledger.commit("two", df(more))
    assert {(r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()} == {(20, 680)} and ledger.state().count() == 20


def test_pipeline_stages_against_their_operators(spark, data):
    """Each stage's decisions on what the one before it left, from brute-force versions where they exist."""
    from test_quality import stats
    from test_simhash_and_passages import brute_passages, similar_brute

    ws = Workspace(spark, "t")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    rows = {r["doc_id"]: r for r in docs.collect()}
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = ws.keep(stage(spark, docs, data), f"s{k}")
        out[k] = docs.collect()
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    kept = {r["doc_id"] for r in out[0]}
    for i, r in rows.items():
        s = stats(r["text"])
        if s[0] < 10 or 100 * s[4] > 20 * s[0]:
            assert i not in kept
    ids = [r["doc_id"] for r in out[0]]
    comp = similar_brute([(r["doc_id"], r["text"]) for r in out[0]])
    assert {r["doc_id"] for r in out[1]} == {i for i, c in zip(ids, comp) if i == c}
    want = brute_passages([(r["doc_id"], r["text"]) for r in out[1]])
    got = {r["doc_id"]: len(r["text"].encode().split()) for r in out[2]}
    assert got == {i: n - gone for i, (n, gone, _) in want.items() if gone < n or n == 0}
    size = {r["doc_id"]: len(r["text"].encode().split()) for r in out[2]}
    times = collections.Counter(r["doc_id"] for r in out[3])
    assert set(times) <= set(size) and max(times.values()) <= 3
    assert abs(sum(size[i] * t for i, t in times.items()) / sum(size.values()) - 1) < 0.1
    assert sorted(r["doc_id"] for r in out[4]) == sorted(r["doc_id"] for r in out[3]) and all(r["n_tokens"] == len(r["ids"]) for r in out[4])


def test_pipeline_stages_on_odd_rows_and_empty_tables(spark, data):
    ws = Workspace(spark, "t")
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, text(3)), (3, text(3)), (3, text(4)), (None, text(5)), (7, "short"), (8, text(8) + " tail"), (9, text(8) + " end")]
    df = spark.createDataFrame([(i, t, None if k % 2 else "en", "s" if k % 3 else None, len(t or ""), "k", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, key string, rank int")
    for docs, empty in ((df, False), (df.limit(0), True)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = ws.keep(stage(spark, docs, data), f"odd{k}-{empty}")
            assert (docs.count() == 0) == empty
            if k < 4:
                assert docs.columns == list(corpus_pipeline.COLUMNS)
            if k == 0 and not empty:  # rejected: null, empty and short texts
                assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["3", "3", "3", "8", "9", "None"]
            if k == 1 and not empty:  # 8 and 9 share 56 of 58 shingles; of the rows with id 3 the two equal ones are one
                assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["3", "3", "8", "None"]


def test_near_duplicates_lose_no_document(spark, data):
    """Unlike texts stay whatever their ids; of a group one stays, and a unique text under a copy's id stays too."""
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(60))

    def kept(rows):
        df = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, data).collect()), key=str)

    apart = [(i, text(k)) for k, i in enumerate((None, None, None, 7, 7, 8))]
    assert kept(apart) == sorted(apart, key=str)
    assert kept([(None, text(1))] * 3 + [(4, text(2))] * 3) == sorted([(None, text(1)), (4, text(2))], key=str)
    shared = [x for k in range(20) for x in ((100 + k, text(k)), (500 + k, text(k) + " tail"), (500 + k, text(1000 + k)))]
    assert kept(shared) == sorted([x for n, x in enumerate(shared) if n % 3 != 1], key=str)
    assert kept([(9, text(1) + " a"), (None, text(1)), (9, text(1) + " b"), (9, text(2)), (None, None), (3, ""), (5, " ")]) == sorted([(9, min(text(1) + " a", text(1) + " b", key=lambda t: hashlib.sha256(t.encode()).digest())), (9, text(2)), (3, "")], key=str)
