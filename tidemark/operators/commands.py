"""State folding: an ordered command log becomes current tables, and timers move it on.

Each operator takes its command log from the events table by a fixed rule, so that SQL can check it. Folds
whose step needs the state before it run as a pure Python function per key, shared with streaming.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import retry_base
from tidemark.operators.fairness import teardown
from tidemark.operators.history import SIGNALLED, STARTED, WF_CANCELLED, activity_terminals, appended_at, durable_timers
from tidemark.operators.scans import idle_groups, publish_batch
from tidemark.operators.sequence import cut_points, keyed_row_number
from tidemark.plans.scheduling import next_leases, policy_versions
from tidemark.registry import RAW, op
from tidemark.sources.views import Tables, ms

op("cmd_02", RAW["src_07"])(publish_batch)


@op(
    "cmd_03",
    f"""SELECT x.lane, x.group_id, x.msg_id, last + CAST(row_number() OVER (ORDER BY x.lane) AS BIGINT) AS lease_id, CAST(1 AS BIGINT) AS epoch, 1706659230000 AS deadline_ms,
    CASE WHEN length(x.lane) % 2 = 0 THEN 1706659260000 END AS max_life_ms, g.ready - 1 AS ready, g.inflight + 1 AS inflight FROM ({RAW["sch_14"]}) x
    JOIN groups_t g ON g.lane = x.lane AND g.group_id = x.group_id, (SELECT max(lease_id) AS last FROM leases)""",
)
def leased(t: Tables, visibility_ms: int = 30_000, max_life_ms: int = 60_000) -> DataFrame:
    """One lease command per open lane and all it changes: the head message of the picked group gets a fresh lease id,
    its epoch rises, a deadline timer and (in lanes that ask for it) a lifetime cap are set, and the group's counters move."""
    g = t.groups.select("lane", "group_id", "ready", "inflight")
    last = t.leases.agg(F.coalesce(F.max("lease_id"), F.lit(0)).alias("last"))
    picked = next_leases(t).select("lane", "group_id", "msg_id").join(g, ["lane", "group_id"])
    n = F.row_number().over(Window.orderBy("lane"))  # one row per lane
    cap = F.when(F.length("lane") % 2 == 0, F.lit(t.asof_ms + max_life_ms))
    return picked.join(F.broadcast(last)).select(
        "lane", "group_id", "msg_id", (F.col("last") + n).alias("lease_id"), F.lit(1).cast("long").alias("epoch"), F.lit(t.asof_ms + visibility_ms).alias("deadline_ms"),
        cap.alias("max_life_ms"), (F.col("ready") - 1).alias("ready"), (F.col("inflight") + 1).alias("inflight"),
    )


@op("cmd_04", "SELECT l.lease_id, l.lane, l.msg_id FROM leases l WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(1, 100000, 3)) AS id) a WHERE a.id = l.lease_id)")
def after_acks(t: Tables) -> DataFrame:
    """Leases left after acks of every third id; acks of unknown leases change nothing."""
    acks = t.spark.range(1, 100000, 3).withColumnRenamed("id", "lease_id")
    return t.leases.join(acks, "lease_id", "left_anti").select("lease_id", "lane", "msg_id")


DEFAULT_ATTEMPTS, REQUEUE, RETRY, DEAD = 3, 0, 1, 2


_NACK = """SELECT *, CASE WHEN stale THEN 'stale' WHEN mode = 0 THEN 'requeued' WHEN mode = 2 THEN 'terminal_nack' WHEN attempt + 1 >= most THEN 'max_attempts' ELSE 'retry' END AS outcome"""


@op(
    "cmd_05",
    f"""SELECT grant_id, outcome, CASE WHEN stale OR mode <> 1 THEN attempt ELSE attempt + 1 END AS attempt, CASE outcome WHEN 'requeued' THEN 'READY' WHEN 'retry' THEN 'DELAYED' WHEN 'stale' THEN NULL ELSE 'DEAD' END AS state,
    CASE outcome WHEN 'retry' THEN 1706659200000 + CASE WHEN grant_id % 7 = 0 THEN 5000 ELSE least(500 * CAST(power(2, least(attempt + 1, 16)) AS BIGINT), 30000) END END AS not_before_ms FROM
    ({_NACK} FROM (SELECT g.grant_id, g.grant_id <> g.cur_lease AS stale, g.attempt, g.grant_id % 3 AS mode, CASE WHEN m.max_attempts = 0 THEN 3 ELSE m.max_attempts END AS most
      FROM grants g JOIN messages m ON m.lane = g.lane AND m.group_id = g.group_id AND m.msg_id = g.msg_id))""",
)
def nacks(t: Tables) -> DataFrame:
    """A nack of each grant, and what becomes of its message.

    The lease goes in any case; a stale one changes nothing else. Requeue makes the message ready with no attempt
    used. Retry uses one and delays it by the backoff, or by the delay that the command names (each seventh does), until
    the message's own limit of attempts makes it dead, as a terminal nack does at once.
    """
    mode, a, stale = F.col("grant_id") % 3, F.col("attempt"), F.col("grant_id") != F.col("cur_lease")
    most = F.when(F.col("max_attempts") == 0, DEFAULT_ATTEMPTS).otherwise(F.col("max_attempts"))
    m = t.messages.select("lane", "group_id", "msg_id", "max_attempts")
    x = t.grants.join(m, ["lane", "group_id", "msg_id"])
    outcome = F.when(stale, "stale").when(mode == REQUEUE, "requeued").when(mode == DEAD, "terminal_nack").when(a + 1 >= most, "max_attempts").otherwise("retry")
    x = x.select("grant_id", outcome.alias("outcome"), F.when(~stale & (mode == RETRY), a + 1).otherwise(a).alias("attempt"))
    o = F.col("outcome")
    state = F.when(o == "requeued", "READY").when(o == "retry", "DELAYED").when(o != "stale", "DEAD")
    delay = F.when(F.col("grant_id") % 7 == 0, F.lit(5000).cast("long")).otherwise(retry_base(F.col("attempt")))
    return x.withColumn("state", state).withColumn("not_before_ms", F.when(o == "retry", F.lit(t.asof_ms) + delay))


@op("cmd_06", "SELECT lease_id, deadline_ms + 1000 * extend_count AS deadline_ms, extend_count, 1 + extend_count AS epoch FROM leases")
def extended(t: Tables) -> DataFrame:
    """Each extend replaces the deadline, counts itself and bumps the epoch."""
    log = t.leases.where("extend_count > 0").select("lease_id", F.explode(F.sequence(F.lit(1).cast("long"), "extend_count")).alias("k"), "deadline_ms")
    last = log.groupBy("lease_id").agg(F.max_by(F.col("deadline_ms") + 1000 * F.col("k"), "k").alias("d"), F.count(F.lit(1)).alias("n"))
    x = t.leases.join(last, "lease_id", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return x.select("lease_id", F.coalesce("d", "deadline_ms").alias("deadline_ms"), n.alias("extend_count"), (1 + n).alias("epoch"))


op("cmd_08", RAW["sch_12"])(policy_versions)


def config_log(t: Tables) -> DataFrame:
    """Group commands: configure (weight or batch size, either may be unset), pause, resume."""
    e = F.col("event_id")
    return t.events.select(
        "event_id", F.col("event_type").alias("lane"), F.concat(F.lit("g"), (F.col("user_id") % 8).cast("string")).alias("group_id"),
        F.when(e % 4 == 0, (e % 3).cast("double")).alias("weight"), F.when(e % 4 == 1, e % 7).alias("batch"),
        F.when(e % 4 == 2, True).when(e % 4 == 3, False).alias("pause"),
    )


_CONFIG = """SELECT event_id, event_type AS lane, concat('g', CAST(user_id % 8 AS VARCHAR)) AS group_id, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 3 AS DOUBLE) END AS weight,
    CASE WHEN event_id % 4 = 1 THEN event_id % 7 END AS batch, CASE event_id % 4 WHEN 2 THEN TRUE WHEN 3 THEN FALSE END AS pause FROM events"""


@op(
    "cmd_09",
    f"""SELECT lane, group_id, CASE WHEN w = 0 THEN 1.0E0 ELSE w END AS weight, batch FROM (SELECT lane, group_id, coalesce(max_by(weight, event_id) FILTER (WHERE weight IS NOT NULL), 1.0E0) AS w,
    max_by(batch, event_id) FILTER (WHERE batch IS NOT NULL) AS batch FROM ({_CONFIG}) GROUP BY lane, group_id)""",
)
def group_config(t: Tables) -> DataFrame:
    """Last set value per field; an unset field leaves the one before, weight 0 means 1."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("event_id")))
    g = config_log(t).groupBy("lane", "group_id").agg(F.coalesce(last("weight"), F.lit(1.0)).alias("w"), last("batch").alias("batch"))
    return g.select("lane", "group_id", F.when(F.col("w") == 0, 1.0).otherwise(F.col("w")).alias("weight"), "batch")


@op("cmd_10", f"SELECT lane, group_id, coalesce(max_by(pause, event_id) FILTER (WHERE pause IS NOT NULL), FALSE) AS paused FROM ({_CONFIG}) GROUP BY lane, group_id")
def paused_groups(t: Tables) -> DataFrame:
    last = F.max_by("pause", F.when(F.col("pause").isNotNull(), F.col("event_id")))
    return config_log(t).groupBy("lane", "group_id").agg(F.coalesce(last, F.lit(False)).alias("paused"))


op("cmd_11", f"SELECT lane, group_id FROM (SELECT lane, group_id, coalesce(max_by(pause, event_id) FILTER (WHERE pause IS NOT NULL), FALSE) AS paused FROM ({_CONFIG}) GROUP BY lane, group_id) WHERE NOT paused")(
    lambda t: paused_groups(t).where("NOT paused").select("lane", "group_id")
)


@op("cmd_12", "SELECT lane, group_id, CAST(count(*) FILTER (WHERE fate IN (1, 2)) AS BIGINT) AS affected, CAST(count(*) FILTER (WHERE fate = 3) AS BIGINT) AS total_after FROM messages WHERE group_id IN ('g1', 'g3') GROUP BY lane, group_id")
def cancelled(t: Tables, groups: tuple[str, ...] = ("g1", "g3")) -> DataFrame:
    """Cancel drops ready and delayed messages and leaves leased ones."""
    m = t.fates.where(F.col("group_id").isin(*groups)).groupBy("lane", "group_id")
    return m.agg(F.count_if(F.col("fate").isin(1, 2)).alias("affected"), F.count_if(F.col("fate") == 3).alias("total_after"))


op("cmd_13", RAW["cmd_12"])(cancelled)

_CRONS = """SELECT concat('cron', CAST(user_id % 20 AS VARCHAR)) AS cron_id, event_id, CASE event_id % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'pause' WHEN 2 THEN 'resume' ELSE 'schedule' END AS cmd, 60000 * (1 + event_id % 9) AS every_ms, epoch_us(ts) // 1000 AS at_ms FROM events"""


def cron_log(t: Tables) -> DataFrame:
    e = F.col("event_id")
    cmd = F.when(e % 5 == 0, "delete").when(e % 5 == 1, "pause").when(e % 5 == 2, "resume").otherwise("schedule")
    return t.events.select(F.concat(F.lit("cron"), (F.col("user_id") % 20).cast("string")).alias("cron_id"), "event_id", cmd.alias("cmd"), (60000 * (1 + e % 9)).alias("every_ms"), ms("ts").alias("at_ms"))


_CRON_STATE = f"""SELECT c.cron_id, max_by(c.every_ms, c.event_id) FILTER (WHERE cmd = 'schedule') AS every_ms, max(c.event_id) FILTER (WHERE cmd = 'schedule') AS scheduled_by,
    coalesce(max_by(cmd, c.event_id) FILTER (WHERE cmd IN ('pause', 'resume', 'schedule')) = 'pause', FALSE) AS paused,
    max_by(at_ms, c.event_id) FILTER (WHERE cmd IN ('resume', 'schedule')) AS from_ms FROM ({_CRONS}) c JOIN
    (SELECT cron_id, coalesce(max(event_id) FILTER (WHERE cmd = 'delete'), -1) AS gone FROM ({_CRONS}) GROUP BY cron_id) d ON d.cron_id = c.cron_id AND c.event_id > d.gone GROUP BY c.cron_id HAVING count(*) FILTER (WHERE cmd = 'schedule') > 0"""


@op("cmd_14", f"SELECT cron_id, every_ms, scheduled_by FROM ({_CRON_STATE})")
def scheduled_crons(t: Tables) -> DataFrame:
    return cron_state(t).select("cron_id", "every_ms", "scheduled_by")


def cron_state(t: Tables) -> DataFrame:
    """Crons after their log: what came before the last delete is gone; a new schedule unpauses."""
    log = cron_log(t)
    gone = log.where("cmd = 'delete'").groupBy("cron_id").agg(F.max("event_id").alias("gone"))
    rest = log.join(gone, "cron_id", "left").where("gone IS NULL OR event_id > gone")
    at = lambda *k: F.when(F.col("cmd").isin(*k), F.col("event_id"))
    out = rest.groupBy("cron_id").agg(
        F.max_by("every_ms", at("schedule")).alias("every_ms"), F.max(at("schedule")).alias("scheduled_by"),
        F.coalesce(F.max_by("cmd", at("pause", "resume", "schedule")) == "pause", F.lit(False)).alias("paused"), F.max_by("at_ms", at("resume", "schedule")).alias("from_ms"),
    )
    return out.where("scheduled_by IS NOT NULL")


@op("cmd_15", f"SELECT DISTINCT cron_id FROM ({_CRONS}) WHERE cron_id NOT IN (SELECT cron_id FROM ({_CRON_STATE}))")
def deleted_crons(t: Tables) -> DataFrame:
    return cron_log(t).select("cron_id").distinct().join(cron_state(t).select("cron_id"), "cron_id", "left_anti")


@op("cmd_16", f"SELECT cron_id, paused FROM ({_CRON_STATE})")
def paused_crons(t: Tables) -> DataFrame:
    return cron_state(t).select("cron_id", "paused")


@op("cmd_17", f"SELECT cron_id, CASE WHEN NOT paused THEN from_ms + every_ms END AS next_fire_ms FROM ({_CRON_STATE})")
def next_fires(t: Tables) -> DataFrame:
    """Pausing removes the timer; resuming counts from the resume."""
    return cron_state(t).select("cron_id", F.when(~F.col("paused"), F.col("from_ms") + F.col("every_ms")).alias("next_fire_ms"))


@op("cmd_18", f"SELECT cron_id, greatest(0, (1706659200000 - from_ms) // every_ms) AS slots, from_ms + every_ms * (greatest(0, (1706659200000 - from_ms) // every_ms) + 1) AS next_fire_ms FROM ({_CRON_STATE}) WHERE NOT paused")
def fired_crons(t: Tables) -> DataFrame:
    """How often each cron has fired by now, each slot once, and when it fires next."""
    n = F.greatest(F.lit(0).cast("long"), F.floor((F.lit(t.asof_ms) - F.col("from_ms")) / F.col("every_ms")))
    return cron_state(t).where("NOT paused").select("cron_id", n.alias("slots"), (F.col("from_ms") + F.col("every_ms") * (n + 1)).alias("next_fire_ms"))


@op("cmd_19", "SELECT k.id AS lease_id, l.lease_id IS NOT NULL AS ok, CASE WHEN l.lease_id IS NOT NULL THEN sha256(concat('new', CAST(k.id AS VARCHAR))) END AS token_hash FROM (SELECT CAST(unnest(range(1, 3001, 7)) AS BIGINT) AS id) k LEFT JOIN leases l ON l.lease_id = k.id")
def issued_tokens(t: Tables) -> DataFrame:
    """A token is issued for a lease that exists; otherwise the answer is not ok."""
    k = t.spark.range(1, 3001, 7).withColumnRenamed("id", "lease_id")
    j = k.join(t.leases.select("lease_id", F.lit(True).alias("known")), "lease_id", "left")
    return j.select("lease_id", F.col("known").isNotNull().alias("ok"), F.when(F.col("known"), F.sha2(F.concat(F.lit("new"), F.col("lease_id").cast("string")), 256)).alias("token_hash"))


@op(
    "cmd_20",
    """SELECT k.token_no, l.lease_id, CASE WHEN l.lease_id IS NULL THEN 'unknown' WHEN k.token_no % 2 = 1 THEN 'acked' WHEN attempt_at_lease + 1 >= most THEN 'max_attempts' ELSE 'retry' END AS outcome,
    CASE WHEN l.lease_id IS NOT NULL AND k.token_no % 2 = 0 AND attempt_at_lease + 1 < most THEN 1706659205000 END AS not_before_ms FROM (SELECT CAST(unnest(range(1, 401)) AS BIGINT) AS token_no) k
    LEFT JOIN (SELECT l.*, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 3 END AS most FROM leases l) l ON l.token_hash = sha256(concat('tok', CAST(token_no AS VARCHAR)))""",
)
def completed_by_token(t: Tables, n: int = 400, delay_ms: int = 5000) -> DataFrame:
    """Complete by token: an unknown one is benign, success (odd tokens) acks, failure is a retry nack with its own delay."""
    token = F.sha2(F.concat(F.lit("tok"), F.col("id").cast("string")), 256)
    k = t.spark.range(1, n + 1).select(F.col("id").alias("token_no"), token.alias("token_hash"))
    m = t.messages.select("lane", "group_id", "msg_id", F.when(F.col("max_attempts") == 0, DEFAULT_ATTEMPTS).otherwise(F.col("max_attempts")).alias("most"))
    held = t.leases.where("token_hash <> ''").select("token_hash", "lease_id", "attempt_at_lease", "lane", "group_id", "msg_id").join(m, ["lane", "group_id", "msg_id"])
    again = F.col("attempt_at_lease") + 1 < F.col("most")
    outcome = F.when(F.col("lease_id").isNull(), "unknown").when(F.col("token_no") % 2 == 1, "acked").when(again, "retry").otherwise("max_attempts")
    out = k.join(held, "token_hash", "left").select("token_no", "lease_id", outcome.alias("outcome"))
    return out.withColumn("not_before_ms", F.when(F.col("outcome") == "retry", F.lit(t.asof_ms + delay_ms)))


# ---------------------------------------------------------------- timers
_TIMER_SQL = """SELECT 'ready_at' AS kind, lane, group_id, msg_id, CAST(0 AS BIGINT) AS epoch, not_before_ms AS due_ms, fate = 2 AS live FROM messages WHERE not_before_ms > 0 AND fate IN (1, 2)
    UNION ALL SELECT 'ttl', lane, group_id, msg_id, 0, enqueue_ms + ttl_ms, fate IN (1, 2) FROM messages WHERE ttl_ms > 0
    UNION ALL SELECT 'lease_timeout', lane, group_id, msg_id, epoch, due_ms, epoch = extend_count FROM lease_timers
    UNION ALL SELECT 'max_life', lane, group_id, msg_id, 0, deadline_ms - visibility_ms + 60000, TRUE FROM leases
    UNION ALL SELECT 'dedup', lane, dedup_key, CAST(0 AS BIGINT), 0, max(enqueue_ms) + 300000, TRUE FROM messages WHERE fate = 1 GROUP BY lane, dedup_key
    UNION ALL SELECT 'cron_due', '__cron', cron_id, CAST(0 AS BIGINT), 0, from_ms + every_ms, NOT paused FROM ({0})
    UNION ALL SELECT 'wf_fired', '__wf', CAST(s.run_id AS VARCHAR), event_id, 0, event_time_ms + 1000 * (s.run_id % 3600), r.status = 1 FROM history s JOIN runs r ON r.run_id = s.run_id WHERE event_type = 4 AND activity_no <= 2"""


def timers(t: Tables) -> DataFrame:
    """The timer index: kind, lane, group_id, msg_id, epoch, due_ms, and live: whether the row it was set for still
    stands in the state and epoch of then. Seven kinds in one table; crons and runs stand in the group's place."""
    m, x, k = t.messages, t.leases, ["lane", "group_id", "msg_id"]
    fate, yes, zero = F.col("fate"), F.lit(True), F.lit(0).cast("long")

    def one(df: DataFrame, kind: str, due, live=yes, epoch=zero) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), *k, epoch.alias("epoch"), due.cast("long").alias("due_ms"), live.alias("live"))

    keys = t.fates.where(fate == 1).groupBy("lane", F.col("dedup_key").alias("group_id")).agg(F.max("enqueue_ms").alias("at")).withColumn("msg_id", zero)
    crons = cron_state(t).withColumns({"lane": F.lit("__cron"), "group_id": F.col("cron_id"), "msg_id": zero})
    runs = durable_timers(t).join(t.runs.select("run_id", "status"), "run_id").withColumns({"lane": F.lit("__wf"), "group_id": F.col("run_id").cast("string"), "msg_id": F.col("started_event_id").cast("long")})
    parts = [
        one(m.where((F.col("not_before_ms") > 0) & fate.isin(1, 2)), "ready_at", F.col("not_before_ms"), fate == 2),
        one(m.where(F.col("ttl_ms") > 0), "ttl", F.col("enqueue_ms") + F.col("ttl_ms"), fate.isin(1, 2)),
        one(t.lease_timers, "lease_timeout", F.col("due_ms"), F.col("epoch") == F.col("extend_count"), F.col("epoch")),
        one(x, "max_life", F.col("deadline_ms") - F.col("visibility_ms") + 60000),
        one(keys, "dedup", F.col("at") + 300000),
        one(crons, "cron_due", F.col("from_ms") + F.col("every_ms"), ~F.col("paused")),
        one(runs, "wf_fired", F.col("fire_at_ms"), F.col("status") == 1),
    ]
    return reduce(DataFrame.unionByName, parts)


_TIMERS = _TIMER_SQL.format(_CRON_STATE)


@op("set_03", f"SELECT due_ms, kind, lane, group_id, msg_id, CAST(epoch AS BIGINT) AS epoch FROM ({_TIMERS})")
def timer_index(t: Tables) -> DataFrame:
    """All timers of seven kinds in one index, stale ones included."""
    return timers(t).select("due_ms", "kind", "lane", "group_id", "msg_id", "epoch")


@op("cmd_07", f"SELECT kind, CAST(count(*) AS BIGINT) AS due, CAST(count(*) FILTER (WHERE live) AS BIGINT) AS fired FROM ({_TIMERS}) WHERE due_ms <= 1706659200000 GROUP BY kind")
def fired_by_kind(t: Tables) -> DataFrame:
    """Due timers by kind, and how many act: one whose row is gone, or has moved to another state or epoch, does nothing."""
    return timers(t).where(F.col("due_ms") <= t.asof_ms).groupBy("kind").agg(F.count(F.lit(1)).alias("due"), F.count_if("live").alias("fired"))


# ---------------------------------------------------------------- singletons
def fold_singleton(commands: Iterable[tuple[int, str, str, int, int, int]]):
    """(now, op, holder, fence, ttl, id) in order -> (id, ok, fence). Free: vacant, expired, or held by the asker.

    Every acquire raises the fence, which a release keeps; renew and release need holder and fence, and renew
    does not look at the expiry.
    """
    holder, fence, deadline = "", 0, 0
    for now, what, who, given, ttl, ident in commands:
        ok = False
        if what == "acquire" and (not holder or deadline <= now or holder == who):
            holder, fence, deadline, ok = who, fence + 1, now + ttl, True
        elif what == "renew" and holder == who and given == fence:
            deadline, ok = now + ttl, True
        elif what == "release" and holder == who and given == fence:
            holder, deadline, ok = "", 0, True
        yield ident, ok, fence


def singleton_log(t: Tables) -> DataFrame:
    """Acquires by four holders on ten names; renews and releases quote the number of acquires before them."""
    e = F.col("event_id")
    what = F.when(e % 5 < 3, "acquire").when(e % 5 == 3, "renew").otherwise("release")
    return t.events.select(F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("name"), "event_id", ms("ts").alias("now"), what.alias("what"), F.concat(F.lit("h"), (e % 4).cast("string")).alias("who"))


_SINGLETON = """WITH RECURSIVE log AS MATERIALIZED (SELECT concat('s', CAST(user_id % 10 AS VARCHAR)) AS name, event_id, epoch_us(ts) // 1000 AS now, event_id % 5 AS what, CAST(event_id % 4 AS INTEGER) + 1 AS who,
      row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS k FROM events),
    run(name, event_id, k, ok, holder, fence, deadline, known) AS (SELECT DISTINCT name, CAST(0 AS BIGINT), CAST(0 AS BIGINT), FALSE, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), [CAST(-1 AS BIGINT), -1, -1, -1] FROM log
    UNION ALL SELECT name, event_id, k, ok, CASE WHEN ok AND what < 3 THEN who WHEN ok AND what = 4 THEN 0 ELSE holder END, CASE WHEN ok AND what < 3 THEN fence + 1 ELSE fence END,
      CASE WHEN ok AND what < 4 THEN now + 3600000 WHEN ok THEN 0 ELSE deadline END, CASE WHEN ok AND what < 3 THEN list_transform(known, lambda f, i: CASE WHEN i = who THEN fence + 1 ELSE f END) ELSE known END FROM
      (SELECT l.name, l.event_id, l.k, l.what, l.who, l.now, r.holder, r.fence, r.deadline, r.known, CASE WHEN l.what < 3 THEN r.holder = 0 OR r.deadline <= l.now OR r.holder = l.who ELSE r.holder = l.who AND r.known[l.who] = r.fence END AS ok
      FROM run r JOIN log l ON l.name = r.name AND l.k = r.k + 1))
    SELECT name, event_id, ok, fence FROM run WHERE k > 0"""


@op("cmd_21", _SINGLETON)
def singletons(t: Tables) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fences: dict[str, int] = {}
        out = []
        rows = pdf.sort_values("event_id")

        def commands():
            for now, what, who, ident in zip(rows["now"], rows["what"], rows["who"], rows["event_id"], strict=True):
                yield int(now), what, who, fences.get(who, -1), 3_600_000, int(ident)

        for (ident, ok, fence), who, what in zip(fold_singleton(commands()), rows["who"], rows["what"], strict=True):
            if ok and what == "acquire":
                fences[who] = fence
            out.append((pdf["name"].iloc[0], ident, ok, fence))
        return pd.DataFrame(out, columns=["name", "event_id", "ok", "fence"])

    return singleton_log(t).groupBy("name").applyInPandas(run, "name string, event_id long, ok boolean, fence long")


op("cmd_22", f"{_SINGLETON} AND event_id % 5 = 3")(lambda t: singletons(t).join(singleton_log(t).where("what = 'renew'").select("event_id"), "event_id", "left_semi"))
op("cmd_23", f"{_SINGLETON} AND event_id % 5 = 4")(lambda t: singletons(t).join(singleton_log(t).where("what = 'release'").select("event_id"), "event_id", "left_semi"))


@op("cmd_24", "SELECT event_type AS lane, max_by(CAST(event_id % 100 AS DOUBLE), event_id) AS rate, max_by(1 + event_id % 10, event_id) AS burst FROM events WHERE event_id % 20 = 0 GROUP BY event_type")
def lane_config(t: Tables) -> DataFrame:
    c = t.events.where("event_id % 20 = 0").groupBy(F.col("event_type").alias("lane"))
    return c.agg(F.max_by((F.col("event_id") % 100).cast("double"), "event_id").alias("rate"), F.max_by(1 + F.col("event_id") % 10, "event_id").alias("burst"))


op("cmd_25", RAW["flt_08"])(idle_groups)
op("cmd_26", RAW["agg_16"])(teardown)


@op("cmd_27", "SELECT d.lane, d.group_id, d.msg_id AS old_id, g.next_seq - 1 + CAST(row_number() OVER (PARTITION BY d.lane, d.group_id ORDER BY dead_at_ms, d.msg_id) AS BIGINT) AS new_id, CAST(0 AS BIGINT) AS attempt FROM dead_letters d JOIN groups_t g ON g.lane = d.lane AND g.group_id = d.group_id WHERE reason = 'ttl'")
def redriven(t: Tables, reason: str = "ttl") -> DataFrame:
    """Dead letters back in their queue under fresh ids, oldest death first, attempt 0."""
    o = [F.col(f"original.{c}").alias(c) for c in ("lane", "group_id", "msg_id")]
    d = t.dead_letters.where(F.col("reason") == reason).select(*o, "dead_at_ms").join(t.groups.select("lane", "group_id", "next_seq"), ["lane", "group_id"])
    n = F.row_number().over(Window.partitionBy("lane", "group_id").orderBy("dead_at_ms", "msg_id"))
    return d.select("lane", "group_id", F.col("msg_id").alias("old_id"), (F.col("next_seq") - 1 + n).alias("new_id"), F.lit(0).cast("long").alias("attempt"))


@op(
    "cmd_28",
    """SELECT run_id, CAST(1 AS BIGINT) AS event_id, CAST(1 AS BIGINT) AS event_type, started_ms AS event_time_ms, CAST(2 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS epoch, concat('__wf/', workflow_type) AS lane,
    CAST(row_number() OVER (PARTITION BY workflow_type ORDER BY run_id) AS BIGINT) AS task_no FROM runs""",
)
def started_runs(t: Tables) -> DataFrame:
    """A start appends STARTED as event 1, leaves the run at epoch 0, and dispatches its first task into the type's lane."""
    n = lambda x: F.lit(x).cast("long")
    rows = t.runs.select("run_id", n(1).alias("event_id"), n(STARTED).alias("event_type"), F.col("started_ms").alias("event_time_ms"), n(2).alias("seq"), n(0).alias("epoch"), F.concat(F.lit("__wf/"), "workflow_type").alias("lane"))
    return keyed_row_number(rows, ["lane"], "run_id", "task_no", cut_points(t.orders, "o_orderkey"))


def fold_appends(requests: Iterable[tuple[int, int, int, int]]):
    """(id, epoch, seq, events) in order -> (id, outcome, epoch, seq) of one run under optimistic concurrency."""
    epoch, seq = 0, 1
    for ident, e, s, n in requests:
        ok = e == epoch and s == seq
        if ok:
            epoch, seq = epoch + 1, seq + n
        yield ident, "applied" if ok else "stale", epoch, seq


@op(
    "cmd_29",
    """WITH RECURSIVE log AS MATERIALIZED (SELECT user_id % 50 AS run_id, event_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS k FROM events),
    run(run_id, event_id, k, outcome, epoch, seq, epoch0, seq0) AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM log
    UNION ALL SELECT run_id, event_id, k, CASE WHEN ok THEN 'applied' ELSE 'stale' END, epoch + CAST(ok AS BIGINT), seq + 2 * CAST(ok AS BIGINT), epoch, seq FROM
      (SELECT l.run_id, l.event_id, l.k, r.epoch, r.seq, l.k % 3 <> 0 OR (r.epoch0 = r.epoch AND r.seq0 = r.seq) AS ok FROM run r JOIN log l ON l.run_id = r.run_id AND l.k = r.k + 1))
    SELECT run_id, event_id, outcome, epoch, seq FROM run WHERE k > 0""",
)
def appended(t: Tables) -> DataFrame:
    """Appends of two events each, as deciders send them: every third one has missed the append before it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf["event_id"])
        state = [0, 1]
        out = []

        def requests():
            before = (0, 1)
            for k, ident in enumerate(ids):
                now = tuple(state)
                yield (ident, *(before if k % 3 == 2 else now), 2)
                before = now

        for ident, outcome, epoch, seq in fold_appends(requests()):
            state[:] = [epoch, seq]
            out.append((int(pdf["run_id"].iloc[0]), int(ident), outcome, epoch, seq))
        return pd.DataFrame(out, columns=["run_id", "event_id", "outcome", "epoch", "seq"])

    log = t.events.select((F.col("user_id") % 50).alias("run_id"), "event_id")
    return log.groupBy("run_id").applyInPandas(run, "run_id long, event_id long, outcome string, epoch long, seq long")


op("cmd_30", RAW["wf_05"])(activity_terminals)


_LAST = "runs r JOIN (SELECT run_id, max(event_id) AS n FROM history GROUP BY run_id) h ON h.run_id = r.run_id"


@op("cmd_31", f"SELECT r.run_id, TRUE AS applied, CASE WHEN status = 1 THEN n + s.k END AS event_id, CASE WHEN status = 1 THEN CAST(9 AS BIGINT) END AS event_type FROM {_LAST}, (SELECT CAST(unnest(range(1, 3)) AS BIGINT) AS k) s WHERE r.run_id % 4 = 0")
def signalled(t: Tables, signals: int = 2) -> DataFrame:
    """Signals append SIGNAL_RECEIVED events one after the other; to a closed run they change nothing, and still count as applied."""
    x = appended_at(t).where("run_id % 4 = 0").select("run_id", "status", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(signals).cast("long"))).alias("k"))
    live = F.col("status") == 1
    return x.select("run_id", F.lit(True).alias("applied"), F.when(live, F.col("n") + F.col("k")).alias("event_id"), F.when(live, F.lit(SIGNALLED).cast("long")).alias("event_type"))


@op("cmd_32", f"SELECT r.run_id, CASE WHEN c THEN 4 ELSE status END AS status, CASE WHEN c THEN n + 1 END AS event_id, CASE WHEN c THEN CAST(13 AS BIGINT) END AS event_type FROM (SELECT r.*, n, status = 1 AND r.run_id % 6 = 0 AS c FROM {_LAST}) r")
def cancelled_runs(t: Tables) -> DataFrame:
    """Cancelling (each sixth run here) appends a terminal event to an open run and closes it as cancelled."""
    hit = (F.col("status") == 1) & (F.col("run_id") % 6 == 0)
    return appended_at(t).select("run_id", F.when(hit, 4).otherwise(F.col("status")).alias("status"), F.when(hit, F.col("n") + 1).alias("event_id"), F.when(hit, F.lit(WF_CANCELLED).cast("long")).alias("event_type"))


# ---------------------------------------------------------------- principals
def auth_log(t: Tables) -> DataFrame:
    e = F.col("event_id")
    cmd = F.element_at(F.array(*map(F.lit, ("create", "rotate", "disable", "grant", "grant", "revoke"))), (e % 6).cast("int") + 1)
    return t.events.select(F.concat(F.lit("p"), (F.col("user_id") % 30).cast("string")).alias("name"), "event_id", cmd.alias("cmd"))


_AUTH = "SELECT concat('p', CAST(user_id % 30 AS VARCHAR)) AS name, event_id, CASE event_id % 6 WHEN 0 THEN 'create' WHEN 1 THEN 'rotate' WHEN 2 THEN 'disable' WHEN 5 THEN 'revoke' ELSE 'grant' END AS cmd FROM events"


@op("cmd_33", f"SELECT name, min(event_id) AS created_by, CAST(count(*) - 1 AS BIGINT) AS duplicates FROM ({_AUTH}) WHERE cmd = 'create' GROUP BY name")
def created_principals(t: Tables) -> DataFrame:
    """The first create of a name makes it; later ones are errors."""
    return auth_log(t).where("cmd = 'create'").groupBy("name").agg(F.min("event_id").alias("created_by"), (F.count(F.lit(1)) - 1).alias("duplicates"))


@op("cmd_34", f"SELECT name, sha256(concat('salt', CAST(max(event_id) AS VARCHAR))) AS hash FROM ({_AUTH}) WHERE cmd IN ('create', 'rotate') GROUP BY name")
def rotated_tokens(t: Tables) -> DataFrame:
    return auth_log(t).where("cmd IN ('create', 'rotate')").groupBy("name").agg(F.sha2(F.concat(F.lit("salt"), F.max("event_id").cast("string")), 256).alias("hash"))


@op("cmd_35", f"SELECT name, bool_or(cmd = 'disable') AS disabled FROM ({_AUTH}) GROUP BY name")
def disabled_principals(t: Tables) -> DataFrame:
    return auth_log(t).groupBy("name").agg(F.bool_or(F.col("cmd") == "disable").alias("disabled"))


@op("cmd_36", f"SELECT name, CAST(count(*) AS BIGINT) AS granted, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS grants FROM ({_AUTH}) WHERE cmd = 'grant' GROUP BY name")
def granted(t: Tables) -> DataFrame:
    g = auth_log(t).where("cmd = 'grant'").groupBy("name").agg(F.count(F.lit(1)).alias("granted"), F.array_sort(F.collect_list("event_id")).alias("x"))
    return g.select("name", "granted", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("grants"))


@op("cmd_37", f"SELECT name, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS grants FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY event_id) AS i FROM ({_AUTH}) WHERE cmd = 'grant') WHERE i <> 2 GROUP BY name")
def revoked(t: Tables, index: int = 1) -> DataFrame:
    """Grants after revoking one by its index; an index out of bounds would be an error."""
    g = auth_log(t).where("cmd = 'grant'").groupBy("name").agg(F.array_sort(F.collect_list("event_id")).alias("x"))
    kept = F.filter("x", lambda v, i: i != index)
    return g.where(F.size(kept) > 0).select("name", F.array_join(F.transform(kept, lambda v: v.cast("string")), ",").alias("grants"))


# ---------------------------------------------------------------- time
@op("st_01", "SELECT lane, group_id, msg_id, CASE WHEN not_before_ms <= 1706659200000 THEN 'READY' ELSE 'DELAYED' END AS state FROM messages WHERE fate = 2")
def delayed_to_ready(t: Tables) -> DataFrame:
    return t.messages.where("fate = 2").select("lane", "group_id", "msg_id", F.when(F.col("not_before_ms") <= t.asof_ms, "READY").otherwise("DELAYED").alias("state"))


@op("st_02", "SELECT lease_id, lane, group_id, msg_id, attempt_at_lease AS attempt FROM leases WHERE deadline_ms <= 1706659200000 AND lease_id % 3 <> 0")
def timed_out(t: Tables) -> DataFrame:
    """Leases past their deadline that nobody acked go back, with no attempt used."""
    return t.leases.where((F.col("deadline_ms") <= t.asof_ms) & (F.col("lease_id") % 3 != 0)).select("lease_id", "lane", "group_id", "msg_id", F.col("attempt_at_lease").alias("attempt"))


@op("st_03", "SELECT lane, group_id, msg_id, 'ttl' AS reason, enqueue_ms + ttl_ms AS dead_at_ms FROM messages WHERE ttl_ms > 0 AND enqueue_ms + ttl_ms <= 1706659200000 AND fate IN (1, 2)")
def expired_messages(t: Tables) -> DataFrame:
    at = F.col("enqueue_ms") + F.col("ttl_ms")
    return t.messages.where((F.col("ttl_ms") > 0) & (at <= t.asof_ms) & F.col("fate").isin(1, 2)).select("lane", "group_id", "msg_id", F.lit("ttl").alias("reason"), at.alias("dead_at_ms"))


@op("st_04", "SELECT lease_id, deadline_ms - visibility_ms + 25000 AS cap_ms FROM leases WHERE deadline_ms - visibility_ms + 25000 <= 1706659200000")
def over_max_life(t: Tables, cap_ms: int = 25000) -> DataFrame:
    """The cap counts from the grant and no extend moves it."""
    at = F.col("deadline_ms") - F.col("visibility_ms") + cap_ms
    return t.leases.where(at <= t.asof_ms).select("lease_id", at.alias("cap_ms"))


def fold_dedup(times: Iterable[int], window_ms: int):
    """Whether each publish of a key is accepted: the window counts from the last accepted one."""
    until = None
    for at in times:
        ok = until is None or until <= at
        if ok:
            until = at + window_ms
        yield ok


_DEDUP_WINDOW = 86_400_000


@op(
    "st_05",
    """WITH RECURSIVE nxt AS (SELECT lane, dedup_key, event_id, enqueue_ms, (SELECT min(n.event_id) FROM messages n WHERE n.lane = m.lane AND n.dedup_key = m.dedup_key AND n.event_id > m.event_id AND n.enqueue_ms >= m.enqueue_ms + 86400000) AS follow FROM messages m),
    acc AS (SELECT lane, dedup_key, event_id, follow FROM nxt WHERE event_id = (SELECT min(f.event_id) FROM messages f WHERE f.lane = nxt.lane AND f.dedup_key = nxt.dedup_key)
    UNION ALL SELECT n.lane, n.dedup_key, n.event_id, n.follow FROM nxt n JOIN acc a ON n.lane = a.lane AND n.dedup_key = a.dedup_key AND n.event_id = a.follow)
    SELECT m.event_id, a.event_id IS NOT NULL AS accepted FROM messages m LEFT JOIN acc a ON a.event_id = m.event_id""",
)
def dedup(t: Tables, window_ms: int = _DEDUP_WINDOW) -> DataFrame:
    """Publishes accepted under the deduplication window (a day here, events being sparse).

    A publish that follows the one before it by a window or more is accepted whatever came earlier, so keys
    fall into sessions. In a session shorter than the window only the first is accepted; the fold runs on
    longer sessions alone.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("event_id")
        return pd.DataFrame({"event_id": rows["event_id"], "accepted": list(fold_dedup(rows["enqueue_ms"].tolist(), window_ms))})

    key = ["lane", "dedup_key"]
    w = Window.partitionBy(*key).orderBy("event_id")
    gap = F.col("enqueue_ms") - F.lag("enqueue_ms").over(w)
    m = t.fates.select(*key, "event_id", "enqueue_ms").withColumn("starts", gap.isNull() | (gap >= window_ms))
    m = m.withColumn("session", F.count_if("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy(*key, "session")
    m = m.withColumn("long", F.max("enqueue_ms").over(s) - F.min("enqueue_ms").over(s) >= window_ms)
    folded = m.where("long").groupBy(*key, "session").applyInPandas(run, "event_id long, accepted boolean")
    return m.where("NOT long").select("event_id", F.col("starts").alias("accepted")).union(folded)


_WEIGHT = "CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 3 AS DOUBLE) END"


@op(
    "cmd_01",
    f"""SELECT event_id, NOT accepted AS duplicate, last_value(mid IGNORE NULLS) OVER (PARTITION BY lane, dedup_key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS msg_id,
    CASE WHEN accepted THEN CAST(CASE WHEN not_before_ms > enqueue_ms THEN 2 ELSE 1 END AS BIGINT) END AS state, CASE WHEN accepted AND ttl_ms > 0 THEN enqueue_ms + ttl_ms END AS ttl_due_ms,
    coalesce(nullif(last_value(hint IGNORE NULLS) OVER (PARTITION BY lane, group_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 1.0E0) AS weight FROM
    (SELECT m.lane, m.group_id, m.dedup_key, m.event_id, m.enqueue_ms, m.not_before_ms, m.ttl_ms, a.accepted, CASE WHEN a.accepted THEN {_WEIGHT.replace("event_id", "m.event_id")} END AS hint,
      CASE WHEN a.accepted THEN CAST(count(*) FILTER (WHERE a.accepted) OVER (PARTITION BY m.lane, m.group_id ORDER BY m.event_id) AS BIGINT) END AS mid FROM messages m JOIN ({RAW["st_05"]}) a ON a.event_id = m.event_id)""",
)
def published(t: Tables, window_ms: int = _DEDUP_WINDOW) -> DataFrame:
    """Publish commands with all their effects.

    A key inside its window answers with the original's id and changes nothing. Otherwise the group's next id is taken,
    a weight hint (each fourth command has one) becomes the group's weight, 0 meaning 1, the message is ready or, with
    not_before ahead, delayed, and a time to live sets its timer.
    """
    accepted = dedup(t, window_ms)
    m = t.fates.join(accepted, "event_id")
    ids = keyed_row_number(m.where("accepted").select("lane", "group_id", "event_id"), ["lane", "group_id"], "event_id", "mid", t.event_cuts)
    m = m.join(ids.select("event_id", "mid"), "event_id", "left")
    so_far = lambda *by: Window.partitionBy(*by).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    hint = F.when(F.col("accepted"), F.expr("CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 3 AS DOUBLE) END"))
    weight = F.last(hint, ignorenulls=True).over(so_far("lane", "group_id"))
    ok = F.col("accepted")
    return m.select(
        "event_id",
        (~ok).alias("duplicate"),
        F.last("mid", ignorenulls=True).over(so_far("lane", "dedup_key")).alias("msg_id"),
        F.when(ok, F.when(F.col("not_before_ms") > F.col("enqueue_ms"), 2).otherwise(1)).cast("long").alias("state"),
        F.when(ok & (F.col("ttl_ms") > 0), F.col("enqueue_ms") + F.col("ttl_ms")).alias("ttl_due_ms"),
        F.when(F.coalesce(weight, F.lit(0.0)) == 0, 1.0).otherwise(weight).alias("weight"),
    )


op("st_06", RAW["wf_08"])(durable_timers)


class TokenBucket:
    """A rate of 0 or less is no limit; a burst is at least 1. tokens and before are its whole state."""

    def __init__(self, rate: float, burst: float, tokens: float | None = None, before: int | None = None):
        self.rate, self.burst = rate, max(1.0, burst)
        self.tokens, self.before = self.burst if tokens is None else tokens, before

    def allow(self, at_ms: int) -> bool:
        if self.rate <= 0:
            return True
        if self.before is not None:
            self.tokens = min(self.burst, self.tokens + self.rate * (at_ms - self.before) / 1000.0)
        self.before = at_ms
        ok = self.tokens >= 1
        self.tokens -= ok
        return ok


_BUCKET = """WITH RECURSIVE log AS MATERIALIZED (SELECT event_type AS lane, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
    run(lane, event_id, k, allowed, tokens, before) AS (SELECT lane, event_id, k, TRUE, CAST(1 AS DOUBLE), ms FROM log WHERE k = 1
    UNION ALL SELECT lane, event_id, k, have >= 1, CASE WHEN have >= 1 THEN have - 1 ELSE have END, ms FROM
      (SELECT l.lane, l.event_id, l.k, l.ms, least(CAST(2 AS DOUBLE), r.tokens + CAST(0.001 AS DOUBLE) * (l.ms - r.before) / CAST(1000 AS DOUBLE)) AS have FROM run r JOIN log l ON l.lane = r.lane AND l.k = r.k + 1))
    SELECT lane, event_id, allowed FROM run"""


@op("st_08", _BUCKET)
def rate_limited(t: Tables, rate: float = 0.001, burst: float = 2.0) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, bucket = pdf.sort_values(["at", "event_id"]), TokenBucket(rate, burst)
        return pd.DataFrame({"lane": rows["lane"], "event_id": rows["event_id"], "allowed": [bucket.allow(x) for x in rows["at"].tolist()]})

    log = t.events.select(F.col("event_type").alias("lane"), "event_id", ms("ts").alias("at"))
    return log.groupBy("lane").applyInPandas(run, "lane string, event_id long, allowed boolean")


@op("st_09", "SELECT event_type AS lane, max_by(CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 + 86400000 ELSE 0 END, event_id) > 1706659200000 AS paused FROM events WHERE event_id % 37 = 0 GROUP BY event_type")
def paused_lanes(t: Tables) -> DataFrame:
    """The last pause or resume of a lane; a pause ends by itself."""
    until = F.when(F.col("event_id") % 2 == 0, ms("ts") + 86400000).otherwise(0)
    return t.events.where("event_id % 37 = 0").groupBy(F.col("event_type").alias("lane")).agg((F.max_by(until, "event_id") > t.asof_ms).alias("paused"))


@op("st_12", "SELECT lane, tick, n, avg(CAST(n AS DOUBLE)) OVER (PARTITION BY lane ORDER BY tick ROWS 3 PRECEDING) AS smooth FROM samples")
def sampled_rates(t: Tables) -> DataFrame:
    """Tumbling counts with empty windows filled, so that rates decay."""
    w = Window.partitionBy("lane").orderBy("tick").rowsBetween(-3, 0)
    return t.samples.select("lane", "tick", "n", F.avg(F.col("n").cast("double")).over(w).alias("smooth"))


@op(
    "st_13",
    """SELECT lane, min(tick) AS since, CAST(count(*) AS BIGINT) AS hours, count(*) >= 3 AS firing FROM (SELECT lane, tick, tick - row_number() OVER (PARTITION BY lane ORDER BY tick) AS island FROM samples WHERE n >= 3) GROUP BY lane, island""",
)
def alerts(t: Tables, threshold: int = 3, hold: int = 3) -> DataFrame:
    """Runs of consecutive hours over a threshold; an alert fires once it has held long enough."""
    over = t.samples.where(F.col("n") >= threshold)
    island = F.col("tick") - F.row_number().over(Window.partitionBy("lane").orderBy("tick"))
    return over.withColumn("island", island).groupBy("lane", "island").agg(F.min("tick").alias("since"), F.count(F.lit(1)).alias("hours"), (F.count(F.lit(1)) >= hold).alias("firing")).drop("island")


@op("st_14", "SELECT g.grant_id, e.epoch, CASE WHEN g.grant_id <> g.cur_lease THEN 'stale_lease' WHEN e.epoch <> g.extend_count THEN 'stale_epoch' ELSE 'applied' END AS outcome FROM grants g JOIN (SELECT CAST(unnest(range(0, 4)) AS BIGINT) AS epoch) e ON e.epoch <= g.extend_count")
def fenced(t: Tables) -> DataFrame:
    """Operations that quote a grant and each epoch it has seen: only the present lease under the present epoch changes anything."""
    x = t.grants.select("grant_id", "cur_lease", "extend_count", F.explode(F.sequence(F.lit(0).cast("long"), "extend_count")).alias("epoch"))
    outcome = F.when(F.col("grant_id") != F.col("cur_lease"), "stale_lease").when(F.col("epoch") != F.col("extend_count"), "stale_epoch").otherwise("applied")
    return x.select("grant_id", "epoch", outcome.alias("outcome"))


op("st_15", RAW["flt_08"])(idle_groups)
