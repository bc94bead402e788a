"""Stage states of projects on a stream, with arbitrary state and event-time timers.

Each project is a key; its state holds a row for each stage and when the project was last heard of.  A call of the state costs
more than the work on a row, so the rows of a project's first ``PACKED`` stages lie in one value, read and written once a batch;
further stages are entries of a map.  What a stage's
row keeps (the last change, the last start, the last reset, the last end, each by sequence) can be put together in any
order, so late rows and any cut into micro-batches give the states that :func:`plumbgrid.operators.stages.stage_states`
gives on all events at once.  A timer runs out when the watermark has passed the last sign of life by ``silence``: the
project's worker is lost, and stages that run become interrupted, as ``recover_interrupted`` makes them.  A later event
makes them what the events say.  A second timer, ``forget`` after the last sign, drops the state of projects that ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from plumbgrid.operators.stages import ENDED, STATUSES, recover_interrupted, stage_states

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Of a stage: the last change, the last start, reset and end by sequence, rows given so far, given as interrupted.
STAGE_STATE = "seq long, status string, message string, at long, run_seq long, run_at long, reset_seq long, done_seq long, done_at long, version long, lost boolean"
FIELDS = [f.split()[0] for f in STAGE_STATE.split(", ")]
#: A project: when it was last heard of, given as lost, its timer, whether there are stages in the map, the first stages.
PROJECT_STATE = f"at long, lost boolean, timer long, more boolean, packed array<struct<stage: string, {STAGE_STATE.replace(' ', ': ').replace(',: ', ', ')}>>"
PACKED = 32
OUTPUT = "project string, stage string, status string, message string, updated_us long, started_us long, finished_us long, version long"


class StageMachine(StatefulProcessor):
    """Rows ``project, stage, status, message, seq, at_us`` in; a row for each stage whose state changed out."""

    def __init__(self, silence_ms: int, forget_ms: int | None) -> None:
        self.silence_ms, self.forget_ms = silence_ms, forget_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.project = handle.getValueState("project", PROJECT_STATE)
        self.others = handle.getMapState("others", "stage string", STAGE_STATE)

    def _load(self) -> dict | None:
        kept = self.project.get()
        if kept is None:
            return None
        last, lost, timer, more, packed = kept
        return {"at": last, "lost": lost, "timer": timer, "more": more, "stages": {s[0]: dict(zip(FIELDS, s[1:])) for s in packed}}

    def _save(self, p: dict) -> None:
        self.project.update((p["at"], p["lost"], p["timer"], p["more"], [(stage, *(s[f] for f in FIELDS)) for stage, s in p["stages"].items()]))

    def _row(self, project: str, p: dict, stage: str, s: dict, ended_us: int | None) -> Row:
        lost = ended_us is not None and s["status"] == "running"
        s["version"] += 1
        s["lost"] = lost
        if stage not in p["stages"]:
            self.others.updateValue((stage,), tuple(s[f] for f in FIELDS))
        started = s["run_at"] if s["run_seq"] > s["reset_seq"] else None
        finished = s["done_at"] if s["done_seq"] > max(s["run_seq"], s["reset_seq"]) else None
        return Row(
            project=project, stage=stage, status="interrupted" if lost else s["status"], message=s["message"], updated_us=s["at"], started_us=started, finished_us=ended_us if lost else finished, version=s["version"]
        )

    def _forgotten(self, p: dict, watermark: int) -> bool:
        """Clears the state of a project whose last row lies further back than ``forget``."""
        if self.forget_ms is None or p["at"] // 1000 + self.forget_ms >= watermark:
            return False
        self.project.clear()
        if p["more"]:
            self.others.clear()
        return True

    def _stage(self, p: dict, stage: str, watermark: int) -> dict:
        """What is kept of a stage; a new one counts its rows from the watermark on."""
        if stage in p["stages"]:
            return p["stages"][stage]
        if p["more"] and self.others.containsKey((stage,)):
            return dict(zip(FIELDS, self.others.getValue((stage,))))
        new = dict.fromkeys(FIELDS, -1) | {"status": None, "message": None, "at": None, "run_at": None, "done_at": None, "version": max(watermark, 0), "lost": False}
        if len(p["stages"]) < PACKED:
            p["stages"][stage] = new
        else:
            p["more"] = True
        return new

    def _running(self, p: dict) -> Iterator[tuple[str, dict]]:
        found = list(p["stages"].items())
        if p["more"]:
            found += [(stage, dict(zip(FIELDS, s))) for (stage,), s in self.others.iterator()]
        return ((stage, s) for stage, s in found if s["status"] == "running")

    def _wake(self, p: dict, at: int | None) -> None:
        """A project has one timer at most; which is known, so the timers are not listed."""
        if p["timer"] != at:
            if p["timer"] is not None:
                self.handle.deleteTimer(p["timer"])
            if at is not None:
                self.handle.registerTimer(at)
            p["timer"] = at

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        p = self._load()
        old = None
        if p is not None and self._forgotten(p, watermark):
            p, old = None, p["timer"]
        p = p or {"at": None, "lost": False, "timer": old, "more": False, "stages": {}}
        before, was_lost = p["at"], p["lost"]
        last, touched = before, {}
        for r in rows:
            last = r.at_us if last is None else max(last, r.at_us)
            if r.stage is None:  # a sign of life only
                continue
            s = touched.get(r.stage) or self._stage(p, r.stage, watermark)
            touched[r.stage] = s
            if s["status"] is None or (r.seq, r.status, r.message or "", r.at_us) > (s["seq"], s["status"], s["message"] or "", s["at"]):
                s.update(seq=r.seq, status=r.status, message=r.message, at=r.at_us)
            if r.status == "running" and (r.seq, r.at_us) > (s["run_seq"], s["run_at"] or 0):
                s.update(run_seq=r.seq, run_at=r.at_us)
            if r.status == "pending":
                s["reset_seq"] = max(s["reset_seq"], r.seq)
            if r.status in ENDED and (r.seq, r.at_us) > (s["done_seq"], s["done_at"] or 0):
                s.update(done_seq=r.seq, done_at=r.at_us)
        if last is None:
            return
        gone = last // 1000 + self.silence_ms < watermark
        if last != before:
            self._wake(p, last // 1000 + self.silence_ms if not gone else None if self.forget_ms is None else last // 1000 + self.forget_ms)
        p["at"], p["lost"] = last, gone
        ended = (last // 1000 + self.silence_ms) * 1000 if gone else None
        if was_lost != gone or (gone and last != before):
            for stage, s in self._running(p):
                touched.setdefault(stage, s)
        out = [self._row(key[0], p, stage, s, ended) for stage, s in touched.items()]
        self._save(p)
        yield from out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        p = self._load()
        if p is None:
            return
        last, watermark = p["at"], timerValues.getCurrentWatermarkInMs()
        p["timer"] = None  # this one
        if expiredTimerInfo.getExpiryTimeInMs() > last // 1000 + self.silence_ms:  # the second timer
            if not self._forgotten(p, watermark):
                self._save(p)
            return
        p["lost"] = True
        out = [self._row(key[0], p, stage, s, (last // 1000 + self.silence_ms) * 1000) for stage, s in self._running(p)]
        if not self._forgotten(p, watermark):
            if self.forget_ms is not None:
                self._wake(p, last // 1000 + self.forget_ms)
            self._save(p)
        yield from out

    def close(self) -> None:
        pass


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which arbitrary state needs; the settings go back afterwards.

    A task opens and commits its partition's state in every batch, even one without rows, so a new stream has no more
    partitions than two for each core; one that goes on keeps those it has.
    """
    most = min(int(spark.conf.get(PARTITIONS)), 2 * spark.sparkContext.defaultParallelism)
    was = {name: spark.conf.get(name, None) for name in (PROVIDER, PARTITIONS)}
    spark.conf.set(PROVIDER, ROCKS)
    spark.conf.set(PARTITIONS, str(most))
    try:
        yield
    finally:
        for name, value in was.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def stage_machine(events: DataFrame, silence_s: int, late: str = "10 minutes", forget_s: int | None = None, mode: str = "Append") -> DataFrame:
    """A stream ``project, stage, status, seq, at[, message]`` -> a row whenever a stage's state changes; see :func:`latest`.

    A null ``stage`` is a sign of life of the project's worker.  Rows that are later than ``late`` are dropped by the
    watermark; all others count, in whatever order they come.  A stage is interrupted once the watermark is more than
    ``silence_s`` seconds past the project's last row.  After ``forget_s`` (at least ``silence_s``) without a row a project is
    forgotten: what comes later starts anew.  Rows with an unknown status, without a project, a time or (if they have a
    stage) a sequence are left out.

    Start it within :func:`rocks_state`.
    """
    if forget_s is not None and forget_s < silence_s:
        raise ValueError("a project cannot be forgotten before it is silent")
    e = events if "message" in events.columns else events.withColumn("message", F.lit(""))
    known = F.col("stage").isNull() | (F.col("status").isin(*STATUSES) & F.col("seq").isNotNull())
    e = e.where(F.col("project").isNotNull() & F.col("at").isNotNull() & known).withWatermark("at", late)
    e = e.select(F.col("project").cast("string").alias("project"), F.col("stage").cast("string").alias("stage"), "status", "message", F.col("seq").cast("long").alias("seq"), "at", F.unix_micros("at").alias("at_us"))
    machine = StageMachine(silence_s * 1000, None if forget_s is None else forget_s * 1000)
    out = e.groupBy("project").transformWithState(machine, OUTPUT, mode, "EventTime")
    time = lambda c: F.timestamp_micros(F.col(f"{c}_us")).alias(f"{c}_at")
    return out.select("project", "stage", "status", "message", time("updated"), time("started"), time("finished"), "version")


def latest(rows: DataFrame) -> DataFrame:
    """The last state given of each stage; ``version`` never goes back (a forgotten project's goes on from the watermark's milliseconds)."""
    m = F.max_by(F.struct("status", "message", "updated_at", "started_at", "finished_at"), "version").alias("m")
    return rows.groupBy("project", "stage").agg(m).select("project", "stage", "m.*")


def stage_table(events: DataFrame, silence_s: int, until) -> DataFrame:
    """The same states from all events at once, as of the watermark ``until`` (a timestamp column or literal)."""
    states = stage_states(events.where("stage is not null"))
    seen = events.groupBy("project").agg(F.date_trunc("millisecond", F.max("at")).alias("seen"))
    ended = F.col("seen") + F.make_interval(secs=F.lit(silence_s))
    live = seen.where(ended >= until)
    return recover_interrupted(states.join(seen.select("project", ended.alias("ended")), "project"), live, F.col("ended")).drop("ended")
