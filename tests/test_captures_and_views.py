import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbgrid.operators import blocks, captures, covisibility, gates, graph, matching, sampling, stages


def test_lookback_takes_the_oldest(spark):
    sig = ["0" * 16, "0" * 15 + "1", "f" * 16, "0" * 15 + "3", "0" * 15 + "7"]
    df = spark.createDataFrame([(i, s, True, None) for i, s in enumerate(sig)], "seq int, signature string, valid boolean, duplicate_of int")
    got = {r["seq"]: r["near_duplicate_of"] for r in captures.near_duplicates(df).collect()}
    assert got == {0: None, 1: 0, 2: None, 3: 0, 4: 1}  # three bits from the oldest, two from the next


def test_exact_duplicates_first_wins(spark):
    rows = [(0, False, 1, "a", "x"), (1, True, 1, "a", "x"), (2, True, 1, "a", "y"), (3, True, 1, "a", "x"), (4, True, None, None, None), (5, True, None, None, None)]
    df = spark.createDataFrame(rows, "seq int, valid boolean, size int, quick_hash string, full_hash string")
    assert {r["seq"]: r["duplicate_of"] for r in captures.exact_duplicates(df).collect()} == {0: None, 1: None, 2: None, 3: 1, 4: None, 5: None}


def test_segments_and_longest(spark):
    f = spark.range(6).select(F.col("id").alias("seq"))
    runs = captures.segments(f, f.where("seq = 2"))
    assert sorted((r["first"], r["last"], r["n"]) for r in runs.collect()) == [(0, 2, 3), (3, 5, 3)]
    assert captures.longest_segment(runs).first()["first"] == 0
    assert captures.longest_segment(captures.segments(f, f.limit(0))).count() == 0


def test_break_rules(spark):
    p = spark.createDataFrame([(10, 0.5, 0.1), (30, 0.01, 0.1), (50, 0.5, 0.4), (90, 0.5, 0.4)], "inlier_count int, feature_coverage double, displacement double")
    assert [r["status"] for r in captures.classify_pairs(p).collect()] == ["break", "break", "weak", "ok"]


def test_keyframes_follow_the_fold(spark):
    rows = [(i, f"n{i:02d}", f"2024-01-01T00:00:{i:02d}", float(100 + (i * 37) % 50), f"{(i * 2654435761) % 2**64:016x}") for i in range(40)]
    df = spark.createDataFrame(rows, "seq int, name string, captured string, sharpness double, signature string").withColumns(
        {"valid": F.lit(True), "duplicate_of": F.lit(None).cast("int"), "near_duplicate_of": F.lit(None).cast("int"), "dark": F.lit(0.0), "bright": F.lit(0.0)}
    )
    import numpy as np

    floor, prev, want = float(np.quantile([r[3] for r in rows], 0.08)), "", []
    bounds = np.linspace(0, 40, 8, dtype=int)
    for a, b in zip(bounds, bounds[1:]):
        group = [r for r in rows[a:b] if r[3] >= floor] or rows[a:b]
        best = max(group, key=lambda r: np.log1p(r[3]) * (1 + captures._bits_apart(prev, r[4]) / 64))
        want.append(best[0])
        prev = best[4]
    assert sorted(r["seq"] for r in captures.keyframes(df, 7).collect()) == want
    assert captures.keyframes(df, 0).count() == 40


def test_positions_are_global(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert all(r["k"] == r["pos"] for r in captures.positions(df, "k").collect())


def test_unique_names(spark):
    df = spark.createDataFrame([(5, "A.jpg"), (7, "a.JPG"), (9, "b.jpg")], "seq int, name string")
    assert sorted(r["name"] for r in captures.unique_names(df).collect()) == ["000000_A.jpg", "000001_a.JPG", "000002_b.jpg"]
    assert [r["name"] for r in captures.unique_names(df.where("seq > 5").where("seq < 9")).collect()] == ["a.JPG"]


def test_components_chain_star_and_isolated(spark):
    nodes = spark.range(12).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 3), (5, 4), (5, 6), (8, 8), (1, 99)], "u long, v long")
    got = {r["node"]: r["component"] for r in graph.connected_components(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 3, 7: 7, 8: 8, 9: 9, 10: 10, 11: 11}
    assert graph.component_roots(edges.limit(0)).count() == 0


def test_bridges_between_components(spark):
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "image_id long, component long")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1]), (4, [0.1, 1.0])], "image_id long, v array<double>")
    loc = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 500.0, 0.0, 0.0), (3, 10.0, 0.0, 0.0), (4, 510.0, 0.0, 0.0)], "image_id long, x double, y double, z double")
    got = {(r["a"], r["b"]): r["kinds"] for r in matching.bridge_pairs(comp, vec, loc, 1).collect()}
    assert got == {(1, 3): "position+retrieval", (2, 4): "position+retrieval"}


def test_image_sets(spark):
    a = spark.createDataFrame([("First",), ("second",)], "name string")
    assert matching.same_image_set(a, spark.createDataFrame([("first",), ("SECOND",)], "name string"))
    assert not matching.same_image_set(a.limit(1), a)


def views(spark, sets):
    obs = [(f"v{i}", p) for i, s in enumerate(sets) for p in s]
    return spark.createDataFrame([(i, f"v{i}") for i in range(len(sets))], "pos int, name string"), spark.createDataFrame(obs, "name string, point_id int")


def test_reference_selection(spark):
    v, o = views(spark, [{1, 2, 3}, {2, 3, 4}, {4, 5, 6}, {6, 7, 8}, {8, 9, 10}])
    names, report = covisibility.select_references(v, o, 0.6)
    assert len(names) == 3 and names[0] == "v0" and names[-1] == "v4" and 0.7 <= report["sparse_point_coverage_ratio"] <= 1
    assert len(covisibility.select_references(v, o, 0.6, "all")[0]) == 5
    v6 = v.unionByName(spark.createDataFrame([(5, "v5")], "pos int, name string"))
    r = covisibility.select_references(v6, o, 1.0)[1]
    assert (r["registered_image_count"], r["depth_supported_image_count"], r["excluded_reference_images"]) == (6, 5, ["v5"])


def test_greedy_coverage(spark):
    obs = spark.createDataFrame([(n, p) for n, s in {"owner": (1, 2), "a": (1, 2, 3), "b": (3, 4), "c": (4,)}.items() for p in s], "name string, point_id int")
    core = spark.createDataFrame([(0, p) for p in (1, 2, 3, 4)], "block int, point_id int")
    refs = spark.createDataFrame([(0, 0, "owner")], "block int, seq int, name string")
    cand = spark.createDataFrame([(0, n) for n in ("owner", "a", "b", "c")], "block int, name string")
    rows = covisibility.augment_coverage(core, obs, refs, cand).orderBy("step").collect()
    assert [r["name"] for r in rows] == ["owner", "a", "b", "c"] and rows[-1]["coverage"] == 1.0 and sum(r["added"] for r in rows) == 3


def test_stable_sources_first(spark):
    obs = spark.createDataFrame([("ref", p) for p in range(1, 5)] + [(f"s{i}", p) for i in range(4) for p in (1, 2)] + [("u", p) for p in range(1, 5)], "name string, point_id int")
    src = spark.createDataFrame([(i, n) for i, n in enumerate(["ref", "u", "s0", "s1", "s2", "s3"])], "pos int, name string")
    stable = spark.createDataFrame([(f"s{i}",) for i in range(4)], "name string")
    got = covisibility.source_selection(obs, src.where("pos = 0"), src, stable, 4)
    assert sorted(r["source"] for r in got.collect()) == ["s0", "s1", "s2", "s3"]
    assert covisibility.patch_match_lines(got).first()["sources"].startswith("s0")


def test_corridor_blocks(spark):
    pts = spark.createDataFrame([(i, float(i), float(i % 3), float(i % 2)) for i in range(80)], "point_id int, x double, y double, z double")
    obs = [(f"v{v:02d}", p) for v in range(16) for p in range(v * 5 - 4, v * 5 + 9) if 0 <= p < 80]
    o = spark.createDataFrame(obs, "name string, point_id int")
    v = spark.createDataFrame([(i, f"v{i:02d}", i * 5.0, 0.0, 10.0) for i in range(16)], "pos int, name string, x double, y double, z double")
    frame, rows, images = blocks.plan_blocks(pts, o, v, target_images=8, min_core_points=10)
    assert frame.corridor and len(rows) == 2 and sum(r["core_point_count"] for r in rows) == 80
    local = pts.select("point_id", *frame.columns())
    core = blocks.core_points(local, rows)
    assert core.count() == 80
    scores = o.join(core, "point_id").groupBy("block", "name").agg(F.count("*").alias("shared"))
    owners = blocks.assign_owners(scores, v, rows, frame, [79.0, 2.0, 1.0], 8)
    assert len(owners) == 16 and set(owners.values()) == {r["block"] for r in rows}
    assert images.count() >= 16 and rows[0]["core_upper"][2] > 0.5


def test_mesh_partition_is_complete(spark):
    f = spark.range(1000).select(F.col("id").alias("face_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 2).alias("c"))
    v = spark.range(1002).select("id", F.col("id").cast("double").alias("x"), F.pmod("id", F.lit(10)).cast("double").alias("y"), F.lit(0.0).alias("z"))
    parts = blocks.mesh_partition(f, v, 300)
    sizes = {r["block"]: r["n"] for r in parts.groupBy("block").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 1000 and sorted(sizes) == [1, 2, 3, 4] and set(sizes.values()) == {250}
    stats = blocks.mesh_block_stats(f, parts).collect()
    assert all(r["vertex_count"] == r["face_count"] + 2 for r in stats)


def test_gates_batches_and_ladders(spark):
    g = spark.createDataFrame([(80, 0.98, 20000, 1.2), (70, 0.9, 10000, 2.5), (10, 0.2, 50, 8.0), (503, 503 / 565, 95610, 0.885), (350, 350 / 565, 40000, 1.0)], "a int, b double, c int, d double")
    cols = [F.col(x) for x in "abcd"]
    s = g.withColumn("s", gates.gate_status(*cols)).withColumn("r", gates.needs_stable_retry(F.col("s"), *cols)).collect()
    assert [r["s"] for r in s[:3]] == ["passed", "review", "blocked"] and (s[3]["r"], s[4]["r"]) == (False, True)
    names = spark.range(100).select(F.col("id").alias("seq"), F.format_string("n%d", "id").alias("name"), F.lit(10).alias("map_bytes"))
    sizes = gates.fusion_batches(names, 1).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [48, 48, 4] and gates.fusion_batches(names, 1 << 40).select("batch").distinct().count() == 1
    assert gates.source_ladder(20) == [20, 12, 8, 6] and gates.source_ladder(5) == [5] and gates.scale_ladder()[:3] == [1.0, 0.75, 0.5]
    q = gates.sparse_quality(spark.createDataFrame([(0.5, 2), (1.5, 4)], "error double, track_length int"), 2, 3).first()
    assert q["mean_error"] == 1.0 and q["median_error"] == 0.5 and q["registration_ratio"] == pytest.approx(2 / 3)


def test_previews_are_exact_spread_and_repeatable(spark):
    ramp = spark.range(10_000).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    a = sorted(r["idx"] for r in sampling.preview(ramp, 10_000, 100, 10).collect())
    assert len(set(a)) == 100 and a[-1] - a[0] > 9000 and len({y - x for x, y in zip(a, a[1:])}) > 5
    assert a == sorted(r["idx"] for r in sampling.preview(ramp, 10_000, 100, 10).collect())
    assert sampling.preview_indices(spark, 10_000, 100, 10).distinct().count() == 100
    grid = spark.range(20_000).select(F.col("id").alias("idx"), F.pmod("id", F.lit(100)).cast("double").alias("x"), F.floor(F.col("id") / 100).cast("double").alias("y"), F.lit(0.0).alias("z"))
    got = sampling.preview(grid, 20_000, 800)
    assert got.count() == 800 and got.select("y").distinct().count() > 100
    assert sampling.spatially_balanced(grid.limit(50), 100).count() == 50
    same = spark.range(50).select(F.col("id").alias("idx"), *[F.lit(1.0).alias(c) for c in "xyz"])
    assert sampling.spatially_balanced(same, 10).count() == 10


def test_balanced_bounds_do_not_depend_on_the_index_values(spark, monkeypatch):
    """Only odd ids and an even step: the probe goes by rank, whatever the number of points."""
    monkeypatch.setattr(sampling, "PROBE", 100)
    odd = spark.range(2_000).select((F.col("id") * 2 + 1).alias("idx"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    got = [r["x"] for r in sampling.spatially_balanced(odd, 500).collect()]
    assert len(set(got)) == 500 and max(got) - min(got) > 1_800


def test_even_places(spark):
    assert sorted(r["idx"] for r in sampling.evenly_spaced(spark, 10, 3).collect()) == [0, 4, 9]
    assert [r["idx"] for r in sampling.evenly_spaced(spark, 9, 1).collect()] == [4]


def test_stage_recovery(spark):
    rows = [("p", s, "running", i) for i, s in enumerate("abc")] + [("p", "d", "completed", 9)]
    e = spark.createDataFrame(rows, "project string, stage string, status string, seq long").withColumn("at", F.timestamp_seconds("seq"))
    s = stages.recover_interrupted(stages.stage_states(stages.check_statuses(e)), e.select("project").limit(0), F.timestamp_seconds(F.lit(99)))
    assert sorted(r["status"] for r in s.collect()) == ["completed", "interrupted", "interrupted", "interrupted"]
    with pytest.raises(ValueError):
        stages.check_statuses(e.withColumn("status", F.lit("odd")))
    back = stages.invalidated(stages.stage_states(e), {"a": ["b"], "b": ["d"]}, ["a"])
    assert {r["stage"]: r["status"] for r in back.collect()} == {"a": "running", "b": "pending", "c": "running", "d": "pending"}


def test_sources_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    sets = {f"n{i:02d}": {p for p in range(40) if rnd.random() < 0.04} for i in range(30)}
    names = list(sets)
    stable = {n for i, n in enumerate(names) if i % 4 == 0}
    obs = spark.createDataFrame([(n, p) for n, s in sets.items() for p in s], "name string, point_id int")
    src = spark.createDataFrame(list(enumerate(names)), "pos int, name string")
    got = covisibility.source_selection(obs, src, src, spark.createDataFrame([(n,) for n in stable], "name string"), 10)
    have = {}
    for r in got.orderBy("reference", "rank").collect():
        have.setdefault(r["reference"], []).append((r["source"], r["shared"]))
    want = {}
    for i, ref in enumerate(names):
        if sets[ref]:
            c = sorted(((n in stable, len(sets[ref] & sets[n]), -abs(i - j), n) for j, n in enumerate(names) if n != ref), reverse=True)
            want[ref] = [(n, s) for _, s, _, n in c[:10]]
    assert have == want


def test_cosine_blocks_give_what_one_block_gives(spark, monkeypatch):
    from plumbgrid.operators import matching

    rnd = __import__("random").Random(3)
    df = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(20)], "image_id int, v array<double>")
    whole = sorted(tuple(r) for r in matching.cosine_top_k(df, df, 3).select("src", "dst", "rank").collect())
    monkeypatch.setattr(matching, "QUERY_BLOCK", 6)
    assert sorted(tuple(r) for r in matching.cosine_top_k(df, df, 3).select("src", "dst", "rank").collect()) == whole and len(whole) == 60


def test_references_against_the_definition(spark):
    """Views of equal weight, copies and views without points; the pool is smaller than the list."""
    rnd = random.Random(4)
    for n, points, ratio in ((30, 60, 0.5), (40, 400, 0.3)):
        sets = [set(rnd.sample(range(points), rnd.choice([0, 3, 8, 20]))) for _ in range(n)]
        sets[7] = set(sets[6] or {1, 2})
        sets[0] = sets[0] or {5}
        v, o = views(spark, sets)
        often = {p: sum(p in s for s in sets) for p in range(points)}
        have = [i for i, s in enumerate(sets) if s]
        weigh = lambda ps: round(sum(often[p] ** -0.5 for p in ps), 9)  # noqa: B023, E731
        order = list(dict.fromkeys([have[0], have[-1], max(have, key=lambda i: (weigh(sets[i]), len(sets[i]), -i))]))
        place = {i: k for k, i in enumerate(have)}
        while len(order) < min(len(have), max(3, math.ceil(n * ratio))):
            seen = set().union(*(sets[i] for i in order))
            share = lambda i: max(len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) for j in order)  # noqa: B023, E731
            gap = lambda i: min(abs(place[i] - place[j]) for j in order) / (len(have) - 1)  # noqa: B023, E731
            order.append(max((i for i in have if i not in order), key=lambda i: (weigh(sets[i] - seen), 1 - share(i), gap(i), weigh(sets[i]), -i)))
        names, report = covisibility.select_references(v, o, ratio)
        assert names == [f"v{i}" for i in sorted(order)] and report["covered_sparse_point_count"] == len(set().union(*(sets[i] for i in order)))


def test_references_take_few_jobs(spark, monkeypatch):
    rnd = random.Random(1)
    calls = []
    for name in ("_race_on", "_rescore"):
        job = getattr(covisibility, name)
        monkeypatch.setattr(covisibility, name, lambda *a, job=job: (calls.append(1), job(*a)))
    v, o = views(spark, [set(rnd.sample(range(3000), rnd.randrange(5, 60))) for _ in range(120)])
    names, _ = covisibility.select_references(v, o, 0.5)
    assert len(names) == 60 and len(calls) <= 20


def test_only_the_best_sources_leave_a_block(spark, monkeypatch):
    """Sources with many ties, counted in blocks and in small pieces, against the definition; few pairs are sorted."""
    monkeypatch.setattr(covisibility, "COUNT_BLOCK", 7)
    monkeypatch.setattr(covisibility, "COUNT_ROWS", 50)
    counted, job = [], covisibility._counted
    monkeypatch.setattr(covisibility, "_counted", lambda *a: (counted.append(job(*a)), counted[-1])[1])
    rnd = random.Random(8)
    sets = [set(rnd.sample(range(120), rnd.choice([1, 10, 30]))) for _ in range(50)]
    _, o = views(spark, sets)
    src = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "pos int, name string")
    got = covisibility.source_selection(o, src, src, src.where("pos % 3 = 0"), 4)
    key = lambda i: lambda j: (j % 3 == 0, len(sets[i] & sets[j]), -abs(i - j), f"v{j}")
    want = [(f"v{i}", f"v{j}", len(sets[i] & sets[j]), k + 1) for i in range(50) for k, j in enumerate(sorted((j for j in range(50) if j != i), key=key(i), reverse=True)[:4])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert counted[0].count() < sum(bool(a & b) for i, a in enumerate(sets) for b in sets[:i])  # half of all pairs


def test_references_of_overlapping_views(spark, monkeypatch):
    """Views that overlap much, their points soon all covered: one round where the pool has all, the same views by small pools."""
    rnd = random.Random(2)
    rounds = []
    job = covisibility._race_on
    monkeypatch.setattr(covisibility, "_race_on", lambda *a: (rounds.append(1), job(*a)))
    v, o = views(spark, [set(rnd.sample(range(60), 20)) for _ in range(80)])
    whole = covisibility.select_references(v, o, 0.3)
    assert len(whole[0]) == 24 and len(rounds) == 1
    for name, bound in (("POOL", 40), ("POOL_ROWS", 500)):
        with monkeypatch.context() as m:
            m.setattr(covisibility, name, bound)
            assert covisibility.select_references(v, o, 0.3) == whole and len(rounds) > 2


def test_coverage_of_many_blocks_against_the_definition(spark):
    rnd = random.Random(9)
    core = {b: set(rnd.sample(range(200), rnd.choice([5, 40, 90]))) for b in range(4)} | {9: set()}
    seen = {f"{rnd.choice('aAbB')}{i}": set(rnd.sample(range(200), rnd.choice([0, 5, 30]))) for i in range(30)}
    names = sorted(seen)
    refs = {b: rnd.sample(names, rnd.choice([0, 2, 4])) for b in core}
    cand = {b: rnd.sample(names, rnd.choice([3, 12, 30])) for b in core}
    want = []
    for b in (b for b in core if core[b]):
        have, chosen, need = dict.fromkeys(core[b], 0), [], list(refs[b])
        full = lambda: sum(x >= 2 for x in have.values()) / len(have)  # noqa: B023, E731
        for name in refs[b]:
            for p in seen[name] & core[b]:
                have[p] += 1
        out = [(b, k, name, False, round(full(), 9)) for k, name in enumerate(refs[b])]
        while full() < 0.95:
            rated = [((-sum(have[p] == 1 for p in mine), -sum(have[p] < 2 for p in mine), -len(mine), n.lower(), n), n) for n in cand[b] if n not in need for mine in [seen[n] & core[b]]]  # noqa: B023
            key, best = min((r for r in rated if r[0][1] < 0), default=(None, None))
            if best is None:
                break
            need.append(best)
            for p in seen[best] & core[b]:
                have[p] += 1
            out.append((b, len(out), best, True, round(full(), 9)))
        want += out
    table = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    got = covisibility.augment_coverage(
        table([(b, p) for b, ps in core.items() for p in ps], "block int, point_id int"), table([(n, p) for n, ps in seen.items() for p in ps], "name string, point_id int"),
        table([(b, k, n) for b, ns in refs.items() if core[b] for k, n in enumerate(ns)], "block int, seq int, name string"), table([(b, n) for b, ns in cand.items() for n in ns], "block int, name string"),
    )
    assert sorted((r["block"], r["step"], r["name"], r["added"], round(r["coverage"], 9)) for r in got.collect()) == sorted(want)


def test_coverage_takes_few_rounds(spark, monkeypatch):
    """Many choices a round; pools too small for the block, or for their first candidate, choose the same."""
    rnd = random.Random(5)
    obs = spark.createDataFrame([(f"v{i:02d}", p) for i in range(60) for p in rnd.sample(range(300), 25)], "name string, point_id int")
    core = spark.createDataFrame([(p % 2, p) for p in range(300)], "block int, point_id int")
    cand = obs.select("name").distinct().crossJoin(core.select("block").distinct())
    kept = []
    keep = covisibility.Workspace.keep
    monkeypatch.setattr(covisibility.Workspace, "keep", lambda self, df, name: (kept.append(name), keep(self, df, name))[1])
    run = lambda c: sorted(map(tuple, covisibility.augment_coverage(c, obs, cand.where("name = 'v00'").withColumn("seq", F.lit(0)), cand).collect()))
    assert len(run(core)) > 20 and sum(n.startswith("pick") for n in kept) == 1
    some = core.where("point_id < 20")
    whole = run(some)
    monkeypatch.setattr(covisibility, "AUGMENT_VIEWS", 4)
    monkeypatch.setattr(covisibility, "AUGMENT_ENTRIES", 12)
    assert run(some) == whole and len(whole) > 4


def test_owners_against_the_definition(spark):
    from plumbgrid.operators.blocks import Frame, assign_owners

    rnd = random.Random(6)
    rows = [{"block": f"b{k}", "core_lower": [10.0 * k, 0.0, 0.0], "core_upper": [10.0 * k + 8, 5.0, 1.0]} for k in range(4)]
    frame = Frame([1.0, 2.0, 3.0], [[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [3.0, 2.0, 1.0], False)
    cams = [(i, f"{rnd.choice('vV')}{i:02d}", *(rnd.choice([(rnd.uniform(0, 5), rnd.uniform(0, 40), 1.0), (None, 1.0, 1.0), (float("nan"), 0.0, 0.0)]))) for i in range(40)]
    shared = {(n, r["block"]): rnd.choice([1, 2, 5, 5]) for _, n, *_ in cams[:25] for r in rows if rnd.random() < 0.5}
    own = lambda n: [shared.get((n, r["block"]), 0) for r in rows]
    loads, want = [0] * 4, {}
    for _, n, *c in sorted(cams, key=lambda v: (sum(x > 0 for x in own(v[1])), -max(own(v[1])), v[1].casefold())):
        s = own(n)
        if max(s):
            k = min((k for k in range(4) if s[k]), key=lambda k: (1 - s[k] / max(s) + loads[k] / 10, loads[k], k))  # noqa: B023
        elif None in c or any(map(math.isnan, c)):
            k = min(range(4), key=lambda k: loads[k])
        else:
            u, w = c[1] - 2.0, c[0] - 1.0
            off = lambda k: math.hypot((u - min(max(u, 10.0 * k), 10.0 * k + 8)) / 38, (w - min(max(w, 0), 5)) / 5)  # noqa: B023, E731
            k = min(range(4), key=lambda k: off(k) + 0.2 * loads[k] / 8)  # noqa: B023
        want[n], loads[k] = f"b{k}", loads[k] + 1
    scores = spark.createDataFrame([(n, b, x) for (n, b), x in shared.items()], "name string, block string, shared int")
    assert assign_owners(scores, spark.createDataFrame(cams, "pos int, name string, x double, y double, z double"), rows, frame, [38.0, 5.0, 1.0], 8) == want


def test_hot_points_meet_as_masks(spark, monkeypatch):
    """Points of every view, of many and of few; masks and blocks give what the plain count gives."""
    monkeypatch.setattr(covisibility, "HOT_VIEWS", 5)
    monkeypatch.setattr(covisibility, "VIEW_BLOCK", 7)
    rnd = random.Random(3)
    sets = [{0} | set(rnd.sample(range(1, 90), 40)) | set(rnd.sample(range(100, 4000), 6)) for _ in range(60)]
    _, o = views(spark, sets)
    want = {(f"v{i}", f"v{j}"): len(a & b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j}
    assert {(r["a"], r["b"]): r["shared"] for r in covisibility.shared_counts(o).collect()} == want
    src = spark.createDataFrame([(i, f"V{i}") for i in range(60)], "pos int, name string")
    got = covisibility.source_selection(o, src.where("pos = 3"), src, src.limit(0), 59).collect()
    assert {r["source"].lower(): r["shared"] for r in got} == {b: n for (a, b), n in want.items() if a == "v3"}
    one = spark.createDataFrame([(f"v{i}", 1) for i in range(40)], "name string, point_id int")
    assert covisibility.shared_counts(one).agg(F.count("*"), F.max("shared")).first()[:] == (40 * 39, 1)


def test_cosine_top_k_is_exact_over_blocks_ties_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    v = {i: base[i % 40].tolist() for i in range(120)}  # three copies of each
    v |= {200: [None] * 8, 201: [float("nan")] * 8, 202: [0.0] * 8, 203: [1.0, 2.0]}
    df = spark.createDataFrame(list(v.items()), "image_id long, v array<double>")

    def expected(src):
        found = []
        for dst, w in v.items():
            if dst != src and len(w) == len(v[src]):
                s = 0.0
                for x, y in zip(v[src], w):
                    s = None if s is None or x is None or y is None else s + x * y
                found.append(((2, 0) if s is None else (0, 0) if s != s else (1, -s), dst))
        return [(src, dst, k + 1) for k, (_, dst) in enumerate(sorted(found)[:3])]

    want = sorted(r for src in v for r in expected(src))
    for size in (matching.QUERY_BLOCK, 50):
        monkeypatch.setattr(matching, "QUERY_BLOCK", size)
        assert sorted(tuple(r) for r in matching.cosine_top_k(df, df, 3).select("src", "dst", "rank").collect()) == want


def test_cosine_top_k_meets_vectors_in_matrix_products(spark):
    import time

    rng = np.random.default_rng(6)
    rows = [(i, x) for i, x in enumerate(rng.normal(size=(6000, 64)).tolist())]
    df = spark.createDataFrame(rows, "image_id long, v array<double>").cache()
    df.count()
    start = time.time()
    assert matching.cosine_top_k(df, df, 3).count() == 18_000
    assert time.time() - start < 40  # 36 million pairs


def test_position_top_k_in_a_dense_place(spark):
    import time

    rng = np.random.default_rng(7)
    rows = [(i, *x) for i, x in enumerate(rng.random((30_000, 3)).tolist())] + [(30_000, None, 0.0, 0.0), (30_001, float("nan"), 0.0, 0.0), (30_002, float("inf"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "image_id long, x double, y double, z double").cache()
    df.count()
    start = time.time()
    found = matching.position_top_k(df, df, 2.0, 3).collect()  # 900 million pairs lie within the radius
    assert time.time() - start < 60 and len(found) == 90_000 and all(r["src"] != r["dst"] for r in found)
    at = np.array([r[1:] for r in rows[:30_000]])
    for src in (0, 777, 29_999):
        d = np.sqrt(((at - at[src]) ** 2).sum(axis=1))
        d[src] = np.inf
        assert [r["dst"] for r in sorted((r for r in found if r["src"] == src), key=lambda r: r["rank"])] == np.argsort(d, kind="stable")[:3].tolist()


def test_position_top_k_ties_by_id(spark):
    df = spark.createDataFrame([(i, 0.0, 0.0, float(i % 2)) for i in range(40)], "image_id long, x double, y double, z double")
    found = {(r["src"], r["dst"]) for r in matching.position_top_k(df, df, 0.5, 3).collect()}
    assert found == {(i, j) for i in range(40) for j in [x for x in range(40) if x % 2 == i % 2 and x != i][:3]}


def test_shared_counts_send_lists_not_meetings(spark, monkeypatch):
    import collections
    import itertools

    rng = random.Random(3)
    seen = {(f"V{(v * 7) % 60:02d}", p) for p in range(300) for v in rng.sample(range(60), 12)}
    obs = spark.createDataFrame(sorted(seen), "name string, point_id long")
    want = collections.Counter()
    for p in range(300):
        want.update(itertools.permutations(sorted(n for n, q in seen if q == p), 2))
    for size in (covisibility.COUNT_BLOCK, 8):
        monkeypatch.setattr(covisibility, "COUNT_BLOCK", size)
        found = covisibility.shared_counts(obs)
        assert {(r["a"], r["b"]): r["shared"] for r in found.collect()} == want
    # the pairs are counted where they are made: no exchange lies between the lists and the counts
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [block" in plan and plan.count("Generate explode") == 2


def test_plan_blocks_cuts_leaves_of_a_level_together(spark, monkeypatch):
    rng = random.Random(11)
    pts = spark.createDataFrame([(i, rng.random() * 100, rng.random() * 60, rng.random()) for i in range(900)], "point_id long, x double, y double, z double")
    obs = spark.createDataFrame(sorted({(f"v{rng.randrange(90):02d}", p) for p in range(900) for _ in range(6)}), "name string, point_id long")
    views = spark.createDataFrame([(f"v{i:02d}",) for i in range(90)], "name string")
    calls, once = [], covisibility.ranked_images
    monkeypatch.setattr(covisibility, "ranked_images", lambda *a, **k: calls.append(a) or once(*a, **k))
    _, rows, images = blocks.plan_blocks(pts, obs, views, target_images=10, min_core_points=20)
    assert len(rows) == 9 and sum(r["core_point_count"] for r in rows) == 900
    assert len(calls) < 9  # a pass a level, not two a split and one a block


def test_cosine_top_k_starts_no_job_for_each_block_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(size=(240, 4)).tolist())], "image_id long, v array<double>")
    monkeypatch.setattr(matching, "QUERY_BLOCK", 6)
    spark.sparkContext.setJobGroup("blocks", "40 blocks of queries")
    try:
        assert matching.cosine_top_k(df, df.where("image_id < 20"), 2).count() == 480
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("blocks")) < 40


def test_cosine_top_k_looks_into_groups_of_the_pool_and_pieces_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(150, 5))
    v = np.concatenate([base, base[:70], base[:3].repeat(130, axis=0), 1e-170 * base[:2], 1e100 * base[:2]])  # copies of a few vectors fill groups
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "image_id long, v array<double>")
    want = []
    for src in range(0, len(v), 3):
        s = np.zeros(len(v))
        for d in range(5):
            s += v[src, d] * v[:, d]
        want += [(src, int(dst), r + 1) for r, dst in enumerate([j for j in np.lexsort((np.arange(len(v)), -s)) if j != src][:3])]
    asked = df.where("image_id % 3 = 0")
    for piece, pool_block in ((matching.PIECE_BYTES, matching.POOL_BLOCK), (4000, 250)):
        monkeypatch.setattr(matching, "PIECE_BYTES", piece)
        monkeypatch.setattr(matching, "POOL_BLOCK", pool_block)
        assert sorted(tuple(r) for r in matching.cosine_top_k(asked, df, 3).select("src", "dst", "rank").collect()) == sorted(want)
        assert [r["dst"] for r in matching.cosine_top_k(df, asked, 1).where("src < 9").orderBy("src").collect()] == [max((j for j in range(0, len(v), 3) if j != i), key=lambda j: (sum(np.multiply(v[i], v[j]).tolist()), -j)) for i in range(9)]


def test_redundancy_moves_no_pairs(spark, monkeypatch):
    """Packs smaller than a point's views, pairs in small batches; no exchange and no join lies above the pairs."""
    for name, bound in (("PACK_ROWS", 60), ("COUNT_ROWS", 30), ("PAIR_ROWS", 7)):
        monkeypatch.setattr(covisibility, name, bound)
    rnd = random.Random(6)
    sets = [set(rnd.sample(range(150), rnd.choice([1, 9, 25]))) for _ in range(45)]
    _, o = views(spark, sets)
    want = {(f"v{i}", f"v{j}"): len(a & b) / min(len(a), len(b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a & b}
    found = covisibility.redundancy(o)
    assert sorted(map(tuple, found.collect())) == sorted((*k, v) for k, v in want.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.index("MapInArrow") < plan.index("Join") and plan.count("Join") == 1


def test_equal_sources_do_not_leave_their_packs(spark, monkeypatch):
    """All views share one point each two: of equal counts only the nearest in sequence are passed on."""
    monkeypatch.setattr(covisibility, "PACK_ROWS", 11)
    counted, job = [], covisibility._counted
    monkeypatch.setattr(covisibility, "_counted", lambda *a: (counted.append(job(*a)), counted[-1])[1])
    n = 40
    _, o = views(spark, [{0, 100 + i} for i in range(n)])
    src = spark.createDataFrame([(i, f"v{i}") for i in range(n)], "pos int, name string")
    got = covisibility.source_selection(o, src, src, src.where("pos % 3 = 0"), 4)
    key = lambda i: lambda j: (j % 3 == 0, -abs(i - j), f"v{j}")
    want = [(f"v{i}", f"v{j}", 1, k + 1) for i in range(n) for k, j in enumerate(sorted((j for j in range(n) if j != i), key=key(i), reverse=True)[:4])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert counted[0].count() == n * 4 * 2


def test_reference_rounds_write_nothing(spark, monkeypatch):
    """Rounds read the points' lists, whatever their number; meetings are made in pieces, a point of every view included."""
    kept, rounds = [], []
    keep, job = covisibility.Workspace.keep, covisibility._race_on
    monkeypatch.setattr(covisibility.Workspace, "keep", lambda self, df, name: (kept.append(name), keep(self, df, name))[1])
    monkeypatch.setattr(covisibility, "_race_on", lambda *a: (rounds.append(1), job(*a)))
    rnd = random.Random(12)
    v, o = views(spark, [{0} | set(rnd.sample(range(1, 300), 20)) for _ in range(40)])
    whole, first = covisibility.select_references(v, o, 0.3), len(kept)
    monkeypatch.setattr(covisibility, "POOL", 12)
    monkeypatch.setattr(covisibility, "COUNT_ROWS", 25)
    assert covisibility.select_references(v, o, 0.3) == whole and len(rounds) > 3 and len(kept) == 2 * first
