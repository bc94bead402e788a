import numpy as np
import pytest

from plumbgrid.llm import embeddings
from plumbgrid.llm.queries import op3_embeddings


def brute(rows, t=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    root = {i: i for i, _ in rows}
    links = {i: 0 for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, u) in enumerate(ok):
        for j, v in ok[a + 1 :]:
            if len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= t:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows}


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rep int, n int")
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicate_vectors(df, **k).collect()}


@pytest.mark.parametrize("block", [4096, 16])
def test_groups_and_odd_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = []
    for c in range(8):
        center = rng.normal(size=16)
        rows += [(len(rows) + k, (center + rng.normal(scale=0.05, size=16)).tolist()) for k in range(3 + 12 * (c == 0))]
    for c in range(60):
        rows.append((len(rows), rng.normal(size=16).tolist()))
    rows += [(500 + k, rows[3][1]) for k in range(5)] + [(600, [2 * x for x in rows[3][1]])]
    rows += [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, []), (704, [None] * 16), (705, [1.0, 0.0]), (706, [1.0, 1e-3]), (707, [1e300, 1e300])]
    assert run(spark, rows, recall=0.9999) == brute(rows)


def test_recall_on_the_tables(spark, data):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op3_embeddings(spark, data).collect()}
    assert sum(g[0] for g in got.values()) >= 0.95 * sum(w[0] for w in want.values()) and all(got[i][0] <= want[i][0] for i in want) and len(got) == len(want)


def test_collision_probability_is_right():
    rng = np.random.default_rng(0)
    for d in (0.3162, 1.0, 1.414):
        a, b = rng.normal(size=200_000) * d, rng.uniform(0, embeddings.CELL, 200_000)
        assert abs((np.floor(b / embeddings.CELL) == np.floor((a + b) / embeddings.CELL)).mean() - embeddings.collision(d)) < 0.01
    k, t = embeddings.plan_tables(50_000, 0.95, 0.99)
    assert 1 - (1 - embeddings.collision(np.sqrt(0.1)) ** k) ** t >= 0.99


def test_empty(spark):
    assert run(spark, [(1, [1.0])], threshold=0.95) == {1: (0, 1, True)}
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicate_vectors(df).count() == 0
