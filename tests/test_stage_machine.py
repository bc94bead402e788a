"""The stage machine on a stream: any cut into micro-batches, late rows, silent workers, restarts."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from plumbgrid.streaming import stage_machine as sm

pytest.importorskip("google.protobuf")
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "project string, stage string, status string, message string, seq long, at timestamp"


def event(project, stage, status, seq, second, message=""):
    return {"project": project, "stage": stage, "status": status, "seq": seq, "message": message, "at": (START + dt.timedelta(seconds=second)).strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z"}


def run(spark, root, cuts, silence, late="10 minutes", forget=None, restart_after=None):
    """Writes each cut as a file, a micro-batch each; with ``restart_after`` the first files run in a query of their own."""
    src, out, cp = root / "in", str(root / "out"), str(root / "cp")
    src.mkdir(parents=True)

    def go():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(src))
        with sm.rocks_state(spark):
            q = sm.stage_machine(stream, silence, late, forget).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
            assert q.awaitTermination(240)
        assert q.exception() is None

    for k, cut in enumerate(cuts):
        (src / f"{k:03d}.json").write_text("\n".join(map(json.dumps, cut)))
        import os

        os.utime(src / f"{k:03d}.json", (1_700_000_000 + k, 1_700_000_000 + k))
        if restart_after == k:
            go()
    go()
    return spark.read.parquet(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("project", "stage", "status", "message", "updated_at", "started_at", "finished_at").collect())


def batch(spark, events, silence, until):
    df = spark.createDataFrame([(e["project"], e["stage"], e["status"], e["message"], e["seq"], dt.datetime.fromisoformat(e["at"])) for e in events], SCHEMA)
    return rows_of(sm.stage_table(df, silence, F.lit(START + dt.timedelta(seconds=until))))


@pytest.mark.parametrize("seed,restart", [(1, None), (2, 2)])
def test_any_cut_gives_the_states_of_the_batch(spark, tmp_path, seed, restart):
    rnd = random.Random(seed)
    events, clock = [], 0
    for seq in range(220):
        clock += rnd.choice([0, 1, 3, 7])
        p = f"p{rnd.randrange(6 if seq < 120 else 3)}"
        events.append(event(p, rnd.choice(["match", "dense", None]), rnd.choice(["pending", "running", "running", "completed", "failed"]), seq, clock + rnd.randrange(3), rnd.choice(["", "note"])))
    events = [e | ({"status": None, "seq": None} if e["stage"] is None else {}) for e in events]
    shuffled = list(events)
    for _ in range(400):  # late within ten minutes
        i = rnd.randrange(len(shuffled) - 30)
        j = i + rnd.randrange(30)
        shuffled[i], shuffled[j] = shuffled[j], shuffled[i]
    cuts, at = [], 0
    while at < len(shuffled):
        n = rnd.choice([5, 40, 80])
        cuts.append(shuffled[at : at + n])
        at += n
    end = clock + 5000
    cuts.append([event("end", None, None, None, end)])
    got = sm.latest(run(spark, tmp_path / "s", cuts, 120, restart_after=restart))
    want = batch(spark, events, 120, end - 600)
    assert rows_of(got) == want and {r[2] for r in want} >= {"interrupted", "completed"}


def test_orphaned_stages_are_recovered_and_come_back(spark, tmp_path):
    """As a store finds the running stages of a lost worker: they end as interrupted, completed ones stay."""
    first = [event("a", "sparse", "completed", 1, 0), event("a", "match", "running", 2, 10, "matching"), event("a", "dense", "running", 3, 20), event("b", "sparse", "running", 1, 20), event("x", "s", "strange", 1, 20), event(None, "s", "running", 1, 20)]
    cuts = [first, [event("b", None, None, None, 1000), event("b", None, None, None, 1700)], [event("b", "sparse", "completed", 2, 2400)], [event("a", "match", "running", 4, 2410)], [event("z", None, None, None, 2900)], [event("a", None, None, None, 2910)]]
    rows = run(spark, tmp_path / "s", cuts, 900, "1 minute")
    seen = [(r["project"], r["stage"], r["status"]) for r in rows.orderBy("project", "stage", "version").collect()]
    assert [s for p, t, s in seen if (p, t) == ("a", "match")] == ["running", "interrupted", "running"]
    assert [s for p, t, s in seen if (p, t) == ("a", "dense")][:2] == ["running", "interrupted"] and [s for p, t, s in seen if (p, t) == ("b", "sparse")] == ["running", "completed"]
    assert not any(p in ("x", None) for p, _, _ in seen)
    lost = rows.where("project = 'a' and stage = 'match' and status = 'interrupted'").first()
    assert lost["finished_at"] - lost["started_at"] == dt.timedelta(seconds=910) and lost["message"] == "matching"
    all_events = [e for c in cuts for e in c if e["project"] and e["status"] != "strange"]
    assert rows_of(sm.latest(rows)) == batch(spark, all_events, 900, 2910 - 60)


def test_forgotten_projects_start_anew(spark, tmp_path):
    cuts = [[event("a", "s", "completed", 9, 0)], [event("z", None, None, None, 5000)], [event("z", None, None, None, 5001)], [event("a", "s", "running", 1, 5001)], [event("z", None, None, None, 5002)]]
    kept = rows_of(sm.latest(run(spark, tmp_path / "k", cuts, 1000, "1 second")))
    assert [r[2] for r in kept] == ["completed"]
    rows = run(spark, tmp_path / "f", cuts, 1000, "1 second", forget=2000)
    found = rows.orderBy("version").collect()
    assert [r["status"] for r in found] == ["completed", "running"] and found[1]["version"] > found[0]["version"] + 1 and [r[2] for r in rows_of(sm.latest(rows))] == ["running"]
    with pytest.raises(ValueError):
        sm.stage_machine(spark.readStream.schema(SCHEMA).json(str(tmp_path / "f" / "in")), 10, forget_s=5)


class Kept:
    """State, timers and clock of one project, in memory; counts the calls."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls, self.now = None, {}, set(), 0, 0

    def getValueState(self, name, schema):
        call = self._counted
        return type("V", (), {"get": call(lambda: self.value), "exists": call(lambda: self.value is not None), "update": call(lambda v: setattr(self, "value", v)), "clear": call(lambda: setattr(self, "value", None))})()

    def getMapState(self, name, key, schema):
        call = self._counted
        return type("M", (), {"containsKey": call(lambda k: k in self.map), "getValue": call(lambda k: self.map[k]), "updateValue": call(lambda k, v: self.map.update({k: v})), "iterator": call(lambda: iter(list(self.map.items()))), "clear": call(self.map.clear)})()

    def _counted(self, f):
        def run(_, *args):
            self.calls += 1
            return f(*args)

        return run

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.expired


def machine_rows(batches, forget=None):
    """Batches ``(watermark, rows)`` of one project -> the rows given, and the calls of the state for each batch."""
    h, out, calls = Kept(), [], []
    m = sm.StageMachine(100, forget)
    m.init(h)
    names = ("stage", "status", "message", "seq", "at_us")
    for now, rows in batches:
        h.now, before = now, h.calls
        out += [tuple(r) for r in m.handleInputRows(("p",), iter([type("R", (), dict(zip(names, r))) for r in rows]), h)] if rows else []
        for t in sorted(t for t in h.timers if t <= now):
            h.timers.discard(t)
            h.expired = t
            out += [tuple(r) for r in m.handleExpiredTimer(("p",), h, h)]
        calls.append(h.calls - before)
        assert len(h.timers) <= 1
    return out, calls


def test_a_project_costs_few_calls_of_the_state_however_many_stages_it_has():
    batches = [(0, [(f"s{i}", "running", "", 10 * k + i, 1000 * (10 * k + i)) for i in range(5)]) for k in range(4)]
    _, calls = machine_rows(batches)
    assert max(calls) <= 4


@pytest.mark.parametrize("forget", [None, 300])
def test_stages_beyond_the_packed_ones_have_the_same_states(monkeypatch, forget):
    rnd = random.Random(11)
    batches, clock = [], 0
    for k in range(200):
        clock += rnd.choice([1, 5, 40, 150, 500])
        rows = [(rnd.choice(["a", "b", "c", "d", "e", None]), rnd.choice(["pending", "running", "running", "completed"]), "", 10 * k + i, 1000 * (clock + i)) for i in range(rnd.randrange(4))]
        batches.append((max(clock - 20, 0), rows))
    want, _ = machine_rows(batches, forget)
    assert any(r[2] == "interrupted" for r in want)
    monkeypatch.setattr(sm, "PACKED", 1)
    got, _ = machine_rows(batches, forget)
    assert sorted(got) == sorted(want)


def test_a_new_stream_has_no_more_partitions_than_the_cores_need(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    try:
        with sm.rocks_state(spark):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) <= 2 * spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.shuffle.partitions") == "500"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
