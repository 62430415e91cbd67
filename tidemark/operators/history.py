"""Durable-execution operators over run histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import history_checksum
from tidemark.operators.fairness import page
from tidemark.operators.joins import _FIFO, paired_activities, run_chains, stuck_runs
from tidemark.registry import RAW, op
from tidemark.sources.views import Tables
from tidemark.worker import DeadLetter, Requeue, handled

# event types of a run's history: fixed values
STARTED, TASK_COMPLETED, SCHEDULED, COMPLETED, FAILED, SIGNALLED, WF_COMPLETED, WF_FAILED, WF_CANCELLED = 1, 3, 4, 5, 6, 9, 10, 11, 13


@op("wf_01", "SELECT event_id, event_type, event_time_ms, activity_no FROM history WHERE run_id = 7 ORDER BY event_id")
def run_history(t: Tables, run_id: int = 7) -> DataFrame:
    return t.history.where(F.col("run_id") == run_id).select("event_id", "event_type", "event_time_ms", "activity_no").orderBy("event_id")


@op("wf_02", "SELECT run_id, CAST(coalesce(CASE max_by(event_type, event_id) FILTER (WHERE event_type >= 10) WHEN 10 THEN 2 WHEN 11 THEN 3 END, 1) AS BIGINT) AS status FROM history GROUP BY run_id")
def status_of_history(t: Tables) -> DataFrame:
    """The last terminal event decides; without one the run is running."""
    last = F.max_by(F.when(F.col("event_type") >= 10, F.col("event_type")), F.when(F.col("event_type") >= 10, F.col("event_id")))
    h = t.history.groupBy("run_id").agg(last.alias("x"))
    return h.select("run_id", F.when(F.col("x") == 10, 2).when(F.col("x") == 11, 3).otherwise(1).cast("long").alias("status"))


def requests(t: Tables) -> DataFrame:
    """A decision per run, as its decider sends it: epoch, the next event id it has seen and the checksum of that history.

    Each third decider has missed the last event, each seventh replays the first activity as another event type, and
    each fifth sends no checksum.
    """
    r = F.col("run_id")
    last = t.history.groupBy("run_id").agg(F.max("event_id").alias("n"))
    h = t.history.join(last, "run_id").where((r % 3 != 0) | (F.col("event_id") < F.col("n")))
    replayed = F.when((r % 7 == 0) & (F.col("event_id") == 2), F.col("event_type") + 1).otherwise(F.col("event_type"))
    sums = history_checksum(h.select("run_id", "event_id", replayed.alias("event_type"), attrs().alias("attrs")))
    return sums.select("run_id", F.lit(0).cast("long").alias("epoch"), (F.col("events") + 1).alias("seq"), F.when(r % 5 != 0, F.col("checksum")).alias("checksum"))


def attrs():
    return F.concat(F.lit("a"), F.col("activity_no").cast("string"))


def gated(t: Tables) -> DataFrame:
    """The gate: an open run, the same epoch and sequence, and the checksum of the history that stands."""
    now = history_checksum(t.history.withColumn("attrs", attrs())).select("run_id", (F.col("events") + 1).alias("cur_seq"), F.col("checksum").alias("stands"))
    x = t.runs.select("run_id", "status", F.lit(0).cast("long").alias("run_epoch")).join(now, "run_id").join(requests(t), "run_id", "left")
    stale = F.col("epoch").isNull() | (F.col("epoch") != F.col("run_epoch")) | (F.col("seq") != F.col("cur_seq"))
    reason = F.when(F.col("status") != 1, "closed").when(stale, "stale").when(F.col("checksum").isNull(), "checksum_required").when(F.col("checksum") != F.col("stands"), "non_determinism").otherwise("applied")
    return x.select("run_id", reason.alias("outcome"))


_SUM = "sha256(unhex(string_agg(concat(lpad(hex(event_id), 16, '0'), lpad(hex({0}), 8, '0'), hex(concat('a', CAST(activity_no AS VARCHAR)))), '' ORDER BY event_id)))"
_GATE = f"""SELECT r.run_id, CASE WHEN r.status <> 1 THEN 'closed' WHEN q.n IS NULL OR q.n <> c.n THEN 'stale' WHEN r.run_id % 5 = 0 THEN 'checksum_required' WHEN q.checksum <> c.checksum THEN 'non_determinism' ELSE 'applied' END AS outcome FROM runs r
    JOIN (SELECT run_id, count(*) AS n, {_SUM.format("event_type")} AS checksum FROM history GROUP BY run_id) c ON c.run_id = r.run_id
    LEFT JOIN (SELECT run_id, count(*) AS n, {_SUM.format("CASE WHEN run_id % 7 = 0 AND event_id = 2 THEN event_type + 1 ELSE event_type END")} AS checksum
      FROM (SELECT *, max(event_id) OVER (PARTITION BY run_id) AS last FROM history) WHERE run_id % 3 <> 0 OR event_id < last GROUP BY run_id) q ON q.run_id = r.run_id"""
op("wf_03", _GATE)(gated)

COMMAND_EVENTS = {"schedule_activity": 4, "start_timer": 7, "complete": 10, "fail": 11, "continue_as_new": 12}


@op(
    "wf_04",
    """SELECT run_id, pos, event_type FROM (SELECT run_id, CAST(0 AS BIGINT) AS pos, CAST(3 AS BIGINT) AS event_type FROM runs WHERE run_id % 10 = 1 UNION ALL
    SELECT run_id, CAST(p + 1 AS BIGINT), CAST(CASE (run_id + p) % 5 WHEN 0 THEN 4 WHEN 1 THEN 7 WHEN 2 THEN 10 WHEN 3 THEN 11 ELSE 12 END AS BIGINT) FROM runs, (SELECT unnest(range(3)) AS p) WHERE run_id % 10 = 1)""",
)
def translated_commands(t: Tables) -> DataFrame:
    """Commands of a decision become events after a TASK_COMPLETED; an unknown kind is an error."""
    kinds = F.array(*map(F.lit, COMMAND_EVENTS))
    commands = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda p: F.element_at(kinds, ((F.col("run_id") + p) % 5 + 1).cast("int")))
    names = F.create_map(*[F.lit(x) for kv in COMMAND_EVENTS.items() for x in kv])
    event = F.transform(commands, lambda c: F.coalesce(F.try_element_at(names, c), F.raise_error(F.concat(F.lit("unknown command "), c)).cast("int")))
    out = t.runs.where("run_id % 10 = 1").select("run_id", F.posexplode(F.concat(F.array(F.lit(TASK_COMPLETED)), event)).alias("pos", "event_type"))
    return out.select("run_id", F.col("pos").cast("long").alias("pos"), F.col("event_type").cast("long").alias("event_type"))


@op(
    "wf_05",
    """SELECT x.run_id, x.activity_no, x.event_id, CASE WHEN r.status <> 1 AND x.event_id % 5 = 0 THEN 'closed' WHEN s.event_id IS NULL THEN 'invalid_completion'
      WHEN row_number() OVER (PARTITION BY x.run_id, x.activity_no, r.status <> 1 AND x.event_id % 5 = 0 ORDER BY x.event_id) > 1 THEN 'duplicate_completion' ELSE 'applied' END AS outcome FROM
    (SELECT run_id, activity_no, event_id FROM (SELECT run_id, CASE WHEN event_id % 7 = 0 THEN activity_no + 100 ELSE activity_no END AS activity_no, event_id FROM history WHERE event_type IN (5, 6)
     UNION ALL SELECT run_id, activity_no, event_id + 100 FROM history WHERE event_type = 5 AND run_id % 3 = 0)) x
    JOIN runs r ON r.run_id = x.run_id LEFT JOIN history s ON s.run_id = x.run_id AND s.activity_no = x.activity_no AND s.event_type = 4""",
)
def activity_terminals(t: Tables) -> DataFrame:
    """Completions, each with what becomes of it: the first that applies marks its activity done, so what was closed
    or invalid leaves no mark, and a repeat of an invalid one is invalid again."""
    h = t.history.where("event_type IN (5, 6)")
    wrong = F.when(F.col("event_id") % 7 == 0, F.col("activity_no") + 100).otherwise(F.col("activity_no")).alias("activity_no")
    again = h.where("event_type = 5 AND run_id % 3 = 0").select("run_id", "activity_no", (F.col("event_id") + 100).alias("event_id"))
    x = h.select("run_id", wrong, "event_id").union(again)
    s = t.history.where("event_type = 4").select("run_id", "activity_no", F.lit(True).alias("known"))
    j = x.join(t.runs.select("run_id", "status"), "run_id").join(s, ["run_id", "activity_no"], "left")
    closed = (F.col("status") != 1) & (F.col("event_id") % 5 == 0)
    valid = j.withColumn("valid", ~closed & F.col("known").isNotNull())
    k = F.row_number().over(Window.partitionBy("run_id", "activity_no", "valid").orderBy("event_id"))
    o = F.when(closed, "closed").when(F.col("known").isNull(), "invalid_completion").when(k > 1, "duplicate_completion").otherwise("applied")
    return valid.select("run_id", "activity_no", "event_id", o.alias("outcome"))


@op(
    "wf_06",
    """SELECT run_id, event_id, what, what <> 'decided' AND (r.status = 1 OR NOT ends) AND coalesce(lag(what) OVER w = 'decided', TRUE) AS dispatches FROM
    (SELECT run_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'decided' ELSE 'trigger' END AS what, event_id = max(event_id) OVER (PARTITION BY run_id) AS ends FROM history WHERE event_type IN (1, 4, 5, 6)) h JOIN runs r USING (run_id)
    WINDOW w AS (PARTITION BY run_id ORDER BY event_id)""",
)
def dispatches(t: Tables) -> DataFrame:
    """A trigger dispatches a task where none is pending: the flag is set by a dispatch and cleared by a decision.

    Each third event stands for a finished decision. So a trigger dispatches exactly if a decision, or nothing, is the
    last thing before it; the last event of a closed run dispatches nothing.
    """
    w = Window.partitionBy("run_id").orderBy("event_id")
    what = F.when(F.col("event_id") % 3 == 0, "decided").otherwise("trigger")
    h = t.history.where("event_type IN (1, 4, 5, 6)").select("run_id", "event_id", what.alias("what"))
    h = h.withColumn("ends", F.col("event_id") == F.max("event_id").over(Window.partitionBy("run_id"))).join(t.runs.select("run_id", "status"), "run_id")
    free = F.coalesce(F.lag("what").over(w) == "decided", F.lit(True))
    return h.select("run_id", "event_id", "what", ((F.col("what") != "decided") & ((F.col("status") == 1) | ~F.col("ends")) & free).alias("dispatches"))


op("wf_07", RAW["jn_15"])(run_chains)


@op(
    "wf_08",
    """SELECT s.run_id, s.event_id AS started_event_id, fire_at_ms, CASE WHEN fire_at_ms <= 1704100000000 AND r.status = 1 THEN n + row_number() OVER (PARTITION BY s.run_id, fire_at_ms <= 1704100000000 ORDER BY fire_at_ms, s.event_id) END AS fired_event_id FROM
    (SELECT run_id, event_id, event_time_ms + 1000 * (run_id % 3600) AS fire_at_ms FROM history WHERE event_type = 4 AND activity_no <= 2) s
    JOIN runs r ON r.run_id = s.run_id JOIN (SELECT run_id, max(event_id) AS n FROM history GROUP BY run_id) e ON e.run_id = s.run_id""",
)
def durable_timers(t: Tables, until_ms: int = 1704100000000) -> DataFrame:
    """Timers started by a run, and the id of the TIMER_FIRED event that a due one appends to an open run's history."""
    at = F.col("event_time_ms") + 1000 * (F.col("run_id") % 3600)
    s = t.history.where("event_type = 4 AND activity_no <= 2").select("run_id", F.col("event_id").alias("started_event_id"), at.alias("fire_at_ms"))
    due = F.col("fire_at_ms") <= until_ms
    k = F.row_number().over(Window.partitionBy("run_id", due).orderBy("fire_at_ms", "started_event_id"))
    s = s.withColumn("k", k).join(appended_at(t), "run_id")
    return s.select("run_id", "started_event_id", "fire_at_ms", F.when(due & (F.col("status") == 1), F.col("n") + F.col("k")).alias("fired_event_id"))


def appended_at(t: Tables) -> DataFrame:
    """run_id, status, n: the last event id of each run, after which new events are appended."""
    return t.history.groupBy("run_id").agg(F.max("event_id").alias("n")).join(t.runs.select("run_id", "status"), "run_id")


@op(
    "wf_09",
    """SELECT r.run_id, d.event_id AS dead_letter, n + row_number() OVER (PARTITION BY r.run_id ORDER BY d.event_id) AS event_id, CAST(6 AS BIGINT) AS event_type, concat('activity_dead_lettered: ', d.reason) AS result FROM
    (SELECT *, 1 + event_id % 5000 AS rid FROM dead_letters WHERE event_id % 2 = 1) d JOIN runs r ON r.run_id = d.rid JOIN (SELECT run_id, max(event_id) AS n FROM history GROUP BY run_id) e ON e.run_id = r.run_id WHERE r.status = 1""",
)
def dead_letter_bridge(t: Tables) -> DataFrame:
    """A dead activity message appends ACTIVITY_FAILED to its open run's history, under the next event id."""
    from tidemark.operators.joins import dead_activity_runs

    d = dead_activity_runs(t).withColumnRenamed("event_id", "dead_letter").join(appended_at(t).select("run_id", "n"), "run_id")
    k = F.row_number().over(Window.partitionBy("run_id").orderBy("dead_letter"))
    return d.select("run_id", "dead_letter", (F.col("n") + k).alias("event_id"), F.lit(FAILED).cast("long").alias("event_type"), F.concat(F.lit("activity_dead_lettered: "), "reason").alias("result"))


_TIMELINE = """SELECT run_id, min(event_time_ms) AS start_ms, max(event_time_ms) AS end_ms, CAST(count(*) FILTER (WHERE event_type = 4) AS BIGINT) AS activities,
    CAST(count(*) FILTER (WHERE event_type = 3) AS BIGINT) AS decisions, CAST(count(*) FILTER (WHERE event_type IN (7, 8, 9)) AS BIGINT) AS signals, max(event_type) FILTER (WHERE event_type >= 10) AS terminal,
    count(*) FILTER (WHERE event_type = 4) > count(*) FILTER (WHERE event_type IN (5, 6)) AS has_running FROM history GROUP BY run_id"""


@op("wf_10", _TIMELINE)
def timelines(t: Tables) -> DataFrame:
    ty = F.col("event_type")
    n = lambda *k: F.count_if(ty.isin(*k))
    return t.history.groupBy("run_id").agg(
        F.min("event_time_ms").alias("start_ms"), F.max("event_time_ms").alias("end_ms"), n(4).alias("activities"), n(3).alias("decisions"),
        n(7, 8, 9).alias("signals"), F.max(F.when(ty >= 10, ty)).alias("terminal"), (n(4) > n(5, 6)).alias("has_running"),
    )


@op(
    "wf_11",
    f"""SELECT p.run_id, p.activity, CAST(p.start_ms - t.start_ms AS DOUBLE) / s * 100.0E0 AS left_pct,
    greatest(0.8E0, CAST(coalesce(p.end_ms, t.end_ms) - p.start_ms AS DOUBLE) / s * 100.0E0) AS width_pct FROM ({_FIFO}) p
    JOIN (SELECT *, CAST(CASE WHEN end_ms = start_ms THEN 1000 ELSE end_ms - start_ms END AS DOUBLE) AS s FROM ({_TIMELINE})) t ON t.run_id = p.run_id""",
)
def swimlanes(t: Tables) -> DataFrame:
    """Bars of a run's activities in percent of its span; a span of nothing counts as a second."""
    span = F.when(F.col("t1") == F.col("t0"), 1000).otherwise(F.col("t1") - F.col("t0")).cast("double")
    ends = t.history.groupBy("run_id").agg(F.min("event_time_ms").alias("t0"), F.max("event_time_ms").alias("t1"))
    p = paired_activities(t).join(ends, "run_id").withColumn("s", span)
    width = (F.coalesce("end_ms", "t1") - F.col("start_ms")).cast("double") / F.col("s") * 100.0
    return p.select("run_id", "activity", ((F.col("start_ms") - F.col("t0")).cast("double") / F.col("s") * 100.0).alias("left_pct"), F.greatest(F.lit(0.8), width).alias("width_pct"))


op("wf_12", RAW["jn_06"])(stuck_runs)


@op("wf_13", f"SELECT run_id, CASE WHEN outcome IN ('applied', 'stale', 'closed') THEN 'ack' ELSE 'requeue' END AS disposition, CAST(CASE WHEN outcome IN ('applied', 'stale', 'closed') THEN 0 ELSE 1000 END AS BIGINT) AS delay_ms FROM ({_GATE})")
def dispositions(t: Tables) -> DataFrame:
    ok = F.col("outcome").isin("applied", "stale", "closed")
    return gated(t).select("run_id", F.when(ok, "ack").otherwise("requeue").alias("disposition"), F.when(ok, 0).otherwise(1000).cast("long").alias("delay_ms"))


@op("wf_14", "SELECT run_id, workflow_type, (SELECT count(*) FROM runs WHERE status = 1 AND run_id > 1000) <= 50 AS last_page FROM runs WHERE status = 1 AND run_id > 1000 ORDER BY run_id LIMIT 50")
def run_page(t: Tables) -> DataFrame:
    return page(t.runs.where("status = 1").select("run_id", "workflow_type"), ["run_id"], 50, (1000,))


@op("wf_15", "SELECT run_id, bool_or(event_type = 6) AS failed_activity, bool_or(event_type = 5) AS completed_activity, CASE WHEN bool_or(event_type >= 10) THEN 'none' WHEN bool_or(event_type = 6) THEN 'fail' WHEN bool_or(event_type = 5) THEN 'complete' ELSE 'wait' END AS decision FROM history GROUP BY run_id")
def decisions(t: Tables) -> DataFrame:
    """A decider made of any() predicates over the history."""
    any_ = lambda c: F.bool_or(c)
    ty = F.col("event_type")
    d = F.when(any_(ty >= 10), "none").when(any_(ty == 6), "fail").when(any_(ty == 5), "complete").otherwise("wait")
    return t.history.groupBy("run_id").agg(any_(ty == 6).alias("failed_activity"), any_(ty == 5).alias("completed_activity"), d.alias("decision"))


def decide(history: DataFrame, decider) -> DataFrame:
    """A Python decider per run: (run_id, [event types in order]) -> [command]; commands come back as rows."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        events = pdf.sort_values("event_id")["event_type"].tolist()
        commands = decider(int(pdf["run_id"].iloc[0]), events)
        return pd.DataFrame({"run_id": [pdf["run_id"].iloc[0]] * len(commands), "pos": range(len(commands)), "command": commands}).astype({"run_id": "int64", "pos": "int64", "command": "object"})

    return history.select("run_id", "event_id", "event_type").groupBy("run_id").applyInPandas(run, "run_id long, pos long, command string")


@op("udf_05", "SELECT run_id, CAST(0 AS BIGINT) AS pos, CASE WHEN bool_or(event_type = 6) THEN 'fail' ELSE 'complete' END AS command FROM history WHERE run_id < 500 GROUP BY run_id HAVING NOT bool_or(event_type >= 10) AND bool_or(event_type IN (5, 6))")
def python_decider(t: Tables) -> DataFrame:
    def decider(run_id: int, events: list[int]) -> list[str]:
        if any(e >= 10 for e in events) or not {5, 6} & set(events):
            return []
        return ["fail" if 6 in events else "complete"]

    return decide(t.history.where("run_id < 500"), decider)


@op("udf_04", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'requeue' WHEN 1 THEN 'dead' WHEN 2 THEN 'retry' ELSE 'ack' END AS outcome FROM events")
def handler_outcomes(t: Tables) -> DataFrame:
    """What a message handler's result or exception means for the lease."""

    def handler(message: dict) -> None:
        kind = message["event_id"] % 5
        if kind == 0:
            raise Requeue
        if kind == 1:
            raise DeadLetter
        if kind == 2:
            raise ValueError(message["event_id"])

    return handled(t.events.select("event_id"), handler)


@op("udf_06", "SELECT event_id, concat(upper(event_type), ':', CAST(user_id AS VARCHAR)) AS result FROM events WHERE event_id % 3 = 0")
def activity_handler(t: Tables) -> DataFrame:
    """A Python activity handler over Arrow batches."""

    def handle(batches):
        for pdf in batches:
            yield pdf.assign(result=pdf["event_type"].str.upper() + ":" + pdf["user_id"].astype(str))[["event_id", "result"]]

    return t.events.where("event_id % 3 = 0").select("event_id", "event_type", "user_id").mapInPandas(handle, "event_id long, result string")


def checksum_matches(t: Tables, claimed: DataFrame) -> DataFrame:
    """claimed: run_id, checksum. Whether each run's history still has that checksum."""
    h = t.history.withColumn("attrs", F.concat(F.lit("a"), F.col("activity_no").cast("string")))
    now = history_checksum(h).withColumnRenamed("checksum", "now")
    return claimed.join(now, "run_id", "left").select("run_id", F.col("checksum").eqNullSafe(F.col("now")).alias("same"))
