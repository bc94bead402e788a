"""Stage states, task events and project records as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "running", "completed", "failed", "cancelled", "interrupted")
ENDED = ("completed", "failed", "cancelled", "interrupted")


def check_statuses(events: DataFrame) -> DataFrame:
    bad = events.where(~F.col("status").isin(*STATUSES) | F.col("status").isNull())
    if not bad.isEmpty():
        raise ValueError("unknown stage status")
    return events


def stage_states(events: DataFrame) -> DataFrame:
    """``project, stage, status, seq, at[, message]`` -> current state of every stage.

    ``started_at`` is the last start since the last reset; ``finished_at`` the last end, if no start or reset followed.
    """
    e = events if "message" in events.columns else events.withColumn("message", F.lit(""))
    last = lambda cond: F.max(F.when(cond, F.struct("seq", "at")))
    s = e.groupBy("project", "stage").agg(
        F.max(F.struct("seq", "status", "message", "at")).alias("m"), last(F.col("status") == "running").alias("run"), last(F.col("status") == "pending").alias("reset"), last(F.col("status").isin(*ENDED)).alias("done")
    )
    seq = lambda c: F.coalesce(F.col(f"{c}.seq"), F.lit(-1).cast("long"))
    return s.select(
        "project", "stage", F.col("m.status").alias("status"), F.col("m.message").alias("message"), F.col("m.at").alias("updated_at"),
        F.when(seq("run") > seq("reset"), F.col("run.at")).alias("started_at"),
        F.when((seq("done") > seq("run")) & (seq("done") > seq("reset")), F.col("done.at")).alias("finished_at"),
    )


def recover_interrupted(states: DataFrame, live: DataFrame, at) -> DataFrame:
    """Running stages of projects without a live worker become interrupted, ending at ``at``; others stay as they are."""
    alive = live.select("project").distinct().withColumn("_live", F.lit(True))
    s = states.join(alive, "project", "left")
    lost = (F.col("status") == "running") & F.col("_live").isNull()
    return s.withColumns({"finished_at": F.when(lost, at).otherwise(F.col("finished_at")), "status": F.when(lost, "interrupted").otherwise(F.col("status"))}).drop("_live")


def runnable(states: DataFrame, outputs: DataFrame) -> DataFrame:
    """Stages that must run: not completed, or completed without a valid output (``project, stage, valid``)."""
    j = states.join(outputs, ["project", "stage"], "left")
    return j.where((F.col("status") != "completed") | ~F.coalesce("valid", F.lit(False))).select("project", "stage", "status")


def invalidated(states: DataFrame, graph: dict[str, list[str]], changed: list[str]) -> DataFrame:
    """States after ``changed`` stages: everything that depends on them, directly or not, is pending again."""
    gone, queue = set(), list(changed)
    while queue:
        for nxt in graph.get(queue.pop(), []):
            if nxt not in gone:
                gone.add(nxt)
                queue.append(nxt)
    hit = F.col("stage").isin(*sorted(gone)) if gone else F.lit(False)
    empty = lambda c: F.when(hit, None).otherwise(F.col(c)).alias(c)
    return states.select("project", "stage", F.when(hit, "pending").otherwise(F.col("status")).alias("status"), "message", "updated_at", empty("started_at"), empty("finished_at"))


def session_flags(session: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """What a session has: geometry, model, calibration, and a filtered cloud in the coordinates now in use."""
    return session.select(
        "project",
        (F.coalesce("cloud_path", F.lit("")) != "").alias("has_geometry"),
        F.coalesce((F.size("mesh_ok") > 0) & F.forall("mesh_ok", lambda x: x) & F.forall("texture_ok", lambda x: x), F.lit(False)).alias("has_model"),
        (F.col("mode") != "model").alias("calibrated"),
        (F.col("processed_points").isNotNull() & (F.col("processed_mode") == F.col("mode"))).alias("has_processed_cloud"),
    )


def display_source(session: DataFrame) -> DataFrame:
    """The filtered cloud as it is, else the raw cloud with the session's transform, else none."""
    return session.select(
        "project",
        F.when(F.col("has_processed_cloud"), "filtered").when(F.col("has_geometry"), "raw").otherwise("none").alias("source"),
        F.when(F.col("has_processed_cloud"), False).otherwise(F.col("has_geometry")).alias("transform"),
    )
