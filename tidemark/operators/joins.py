"""Key lookups as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.fairness import dlq_depth, lane_stats, rolling_counts, shares
from tidemark.operators.scans import allowed
from tidemark.registry import op
from tidemark.session import checkpoint
from tidemark.sources.views import LEASED, Tables

KEYS = ["lane", "group_id", "msg_id"]


@op("jn_01", "SELECT g.grant_id, m.lane, m.group_id, m.msg_id, m.enqueue_ms FROM grants g JOIN live m ON m.lane = g.lane AND m.group_id = g.group_id AND m.msg_id = g.msg_id WHERE m.fate = 3 AND g.grant_id = 4 * g.lease_id + g.attempt_at_lease")
def current_leases(t: Tables) -> DataFrame:
    """Grants with their message, without stale ones: the message must be leased, and by this grant."""
    x = t.grants.where("grant_id = cur_lease").select("grant_id", *KEYS)
    return x.join(t.live.where(F.col("fate") == LEASED).select(*KEYS, "enqueue_ms"), KEYS).select("grant_id", *KEYS, "enqueue_ms")


@op(
    "jn_02",
    """SELECT 'ready_at' AS kind, lane, group_id, msg_id, not_before_ms AS due_ms FROM messages WHERE fate = 2 AND not_before_ms > 0 AND not_before_ms <= 1706659200000
    UNION ALL SELECT 'lease_timeout', m.lane, m.group_id, m.msg_id, l.deadline_ms FROM leases l JOIN messages m ON m.lane = l.lane AND m.group_id = l.group_id AND m.msg_id = l.msg_id
      WHERE l.deadline_ms <= 1706659200000 AND m.fate = 3
    UNION ALL SELECT 'ttl', lane, group_id, msg_id, enqueue_ms + ttl_ms FROM messages WHERE fate IN (1, 2) AND ttl_ms > 0 AND enqueue_ms + ttl_ms <= 1706659200000
    UNION ALL SELECT 'max_life', lane, group_id, msg_id, deadline_ms - visibility_ms + 25000 FROM leases WHERE deadline_ms - visibility_ms + 25000 <= 1706659200000""",
)
def fired_timers(t: Tables) -> DataFrame:
    """Due timers whose row is still in the state and epoch the timer was set for."""
    ready = t.messages.where((F.col("fate") == 2) & (F.col("not_before_ms") > 0) & (F.col("not_before_ms") <= t.asof_ms)).select(F.lit("ready_at").alias("kind"), *KEYS, F.col("not_before_ms").alias("due_ms"))
    # of a lease's timers, those that an extend has replaced carry an older epoch
    x = t.lease_timers.where((F.col("due_ms") <= t.asof_ms) & (F.col("epoch") == F.col("extend_count")))
    late = x.select(*KEYS, "due_ms").join(t.messages.where(F.col("fate") == LEASED).select(*KEYS), KEYS)
    at = F.col("enqueue_ms") + F.col("ttl_ms")
    old = t.messages.where(F.col("fate").isin(1, 2) & (F.col("ttl_ms") > 0) & (at <= t.asof_ms)).select(F.lit("ttl"), *KEYS, at)
    cap = F.col("deadline_ms") - F.col("visibility_ms") + 25000  # from the grant; no extend moves it
    held = t.leases.where(cap <= t.asof_ms).select(F.lit("max_life"), *KEYS, cap)
    return ready.union(late.select(F.lit("lease_timeout"), *KEYS, "due_ms")).union(old).union(held)


@op("jn_03", "SELECT k.token_no, l.lease_id, l.lease_id IS NULL AS unknown FROM (SELECT CAST(unnest(range(1, 41)) AS BIGINT) AS token_no) k LEFT JOIN leases l ON l.token_hash = sha256(concat('tok', CAST(token_no AS VARCHAR)))")
def completions(t: Tables, n: int = 40) -> DataFrame:
    """Completion tokens looked up by hash; one without a lease is unknown, not an error."""
    k = t.spark.range(1, n + 1).select(F.col("id").alias("token_no"), F.sha2(F.concat(F.lit("tok"), F.col("id").cast("string")), 256).alias("token_hash"))
    held = t.leases.where("token_hash <> ''").select("token_hash", "lease_id")
    return k.join(held, "token_hash", "left").select("token_no", "lease_id", F.col("lease_id").isNull().alias("unknown"))


_RING = "SELECT lane, group_id, CAST(count(*) AS BIGINT) AS served FROM served WHERE seq > (SELECT max(seq) FROM served) - 512 GROUP BY lane, group_id"


@op("jn_04", f"SELECT g.lane, g.group_id, ready, CAST(coalesce(served, 0) AS BIGINT) AS served FROM groups_t g LEFT JOIN ({_RING}) s ON s.lane = g.lane AND s.group_id = g.group_id")
def groups_with_served(t: Tables) -> DataFrame:
    s = rolling_counts(t)  # at most the ring's 512 rows
    return t.groups.join(F.broadcast(s), ["lane", "group_id"], "left").select("lane", "group_id", "ready", F.coalesce("served", F.lit(0).cast("long")).alias("served"))


@op("jn_05", f"SELECT coalesce(g.lane, s.lane) AS lane, coalesce(g.group_id, s.group_id) AS group_id, CAST(coalesce(s.served, 0) AS BIGINT) AS served, coalesce(g.weight, 0.0E0) AS weight FROM (SELECT * FROM groups_t WHERE group_id <> 'g7') g FULL JOIN ({_RING}) s ON s.lane = g.lane AND s.group_id = g.group_id")
def ribbon_entries(t: Tables) -> DataFrame:
    """Share entries and served groups together; a served group without a row has weight 0."""
    g = t.groups.where("group_id <> 'g7'").select("lane", "group_id", "weight")
    return g.join(rolling_counts(t), ["lane", "group_id"], "full").select("lane", "group_id", F.coalesce("served", F.lit(0).cast("long")).alias("served"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


@op(
    "jn_06",
    """SELECT r.run_id, r.workflow_type FROM runs r LEFT JOIN (SELECT concat('wf', CAST(1 + (event_id % 3) AS VARCHAR)) AS wf, count(*) AS depth FROM live WHERE event_id % 4 <> 3 GROUP BY 1) d
    ON d.wf = r.workflow_type WHERE r.status = 1 AND coalesce(d.depth, 0) = 0""",
)
def stuck_runs(t: Tables) -> DataFrame:
    """Running runs whose task lane is empty or absent."""
    wf = F.concat(F.lit("wf"), (1 + F.col("event_id") % 3).cast("string")).alias("workflow_type")
    depth = t.live.where("event_id % 4 <> 3").groupBy(wf).agg(F.count(F.lit(1)).alias("depth")).where("depth > 0")
    return t.runs.where("status = 1").join(depth, "workflow_type", "left_anti").select("run_id", "workflow_type")


@op(
    "jn_07",
    """SELECT d.event_id, r.run_id, d.reason FROM (SELECT *, 1 + event_id % 5000 AS rid FROM dead_letters WHERE event_id % 2 = 1) d JOIN runs r ON r.run_id = d.rid WHERE r.status = 1""",
)
def dead_activity_runs(t: Tables) -> DataFrame:
    """Dead letters of activity lanes joined to the run their payload names."""
    e = F.col("original.event_id")
    payload = F.to_json(F.struct((1 + e % 5000).alias("run_id")))
    d = t.dead_letters.where(e % 2 == 1).select(e.alias("event_id"), "reason", payload.alias("payload"))
    d = d.withColumn("run_id", F.from_json("payload", "run_id long")["run_id"])
    return d.join(t.runs.where("status = 1").select("run_id"), "run_id").select("event_id", "run_id", "reason")


@op(
    "jn_08",
    """SELECT run_id, max(event_id) FILTER (WHERE event_type <> 4) AS event_id, max(event_id) FILTER (WHERE event_type = 4) AS scheduled_event_id FROM history WHERE event_type IN (4, 5, 6)
    GROUP BY run_id, activity_no HAVING count(*) FILTER (WHERE event_type <> 4) > 0 AND count(*) FILTER (WHERE event_type = 4) > 0""",
)
def terminal_of_scheduled(t: Tables) -> DataFrame:
    h = t.history
    s = h.where("event_type = 4").select("run_id", "activity_no", F.col("event_id").alias("scheduled_event_id"))
    return h.where("event_type IN (5, 6)").join(s, ["run_id", "activity_no"]).select("run_id", "event_id", "scheduled_event_id")


@op(
    "jn_09",
    """SELECT p.name, c.call, bool_and(NOT disabled AND (list_contains(tags, 'administrator') OR ((list_contains(tags, 'dashboard') OR list_contains(tags, 'monitoring')) AND c.action = 1)
    OR EXISTS (SELECT 1 FROM grants_t g WHERE g.name = p.name AND (list_contains(g.actions, c.action) OR list_contains(g.actions, 4))
    AND regexp_matches(c.lane, g.lane_pattern) AND regexp_matches(c.group_id, g.group_pattern)))) AS allowed FROM principals_t p, checks_t c GROUP BY p.name, c.call""",
)
def authorized_calls(t: Tables) -> DataFrame:
    """A call passes when all its checks pass, each by any grant."""
    both = t.principals.crossJoin(F.broadcast(t.checks))
    return both.groupBy("name", "call").agg(F.every(allowed()).alias("allowed"))


@op("jn_10", "SELECT lane, group_id, msg_id FROM messages m WHERE fate = 1 AND NOT EXISTS (SELECT 1 FROM messages d WHERE d.fate = 5 AND d.lane = m.lane AND d.dedup_key = m.dedup_key AND d.enqueue_ms <= m.enqueue_ms AND m.enqueue_ms < d.enqueue_ms + 86400000)")
def fresh_keys(t: Tables, window_ms: int = 86_400_000) -> DataFrame:
    """Messages whose dedup key no window (a day from the publish that opened it) holds when they come."""
    at = F.col("enqueue_ms")
    held = t.fates.where("fate = 5").select(F.col("lane").alias("l"), F.col("dedup_key").alias("d"), at.alias("opened"))
    held_then = (F.col("l") == F.col("lane")) & (F.col("d") == F.col("dedup_key")) & (F.col("opened") <= at) & (at < F.col("opened") + window_ms)
    return t.messages.where("fate = 1").join(held, held_then, "left_anti").select(*KEYS)


_TERMINALS = """SELECT run_id, activity_no, event_id, event_type FROM history WHERE event_type IN (5, 6)
    UNION ALL SELECT run_id, activity_no, event_id + 1000, 6 FROM history WHERE event_type IN (5, 6) AND run_id % 2 = 0"""


@op("jn_11", f"SELECT run_id, activity_no, min(event_id) AS event_id, CAST(min_by(event_type, event_id) AS BIGINT) AS event_type, CAST(count(*) - 1 AS BIGINT) AS rejected FROM ({_TERMINALS}) GROUP BY run_id, activity_no")
def first_terminal(t: Tables) -> DataFrame:
    """The first terminal event of an activity counts; later ones are duplicates."""
    h = t.history.where("event_type IN (5, 6)").select("run_id", "activity_no", "event_id", "event_type")
    again = h.where("run_id % 2 = 0").select("run_id", "activity_no", (F.col("event_id") + 1000).alias("event_id"), F.lit(6).cast("long").alias("event_type"))
    return h.union(again).groupBy("run_id", "activity_no").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"), (F.count(F.lit(1)) - 1).alias("rejected"))


@op("jn_12", "SELECT lane, group_id, msg_id, min(dead_at_ms) AS dead_at_ms, min_by(reason, dead_at_ms) AS reason FROM dead_letters WHERE msg_id % 10 = 3 GROUP BY lane, group_id, msg_id")
def dlq_lookup(t: Tables) -> DataFrame:
    """Dead letters by message id; of several the earliest death."""
    o = [F.col(f"original.{c}").alias(c) for c in KEYS]
    d = t.dead_letters.select(*o, "dead_at_ms", "reason").where("msg_id % 10 = 3")
    return d.groupBy(*KEYS).agg(F.min("dead_at_ms").alias("dead_at_ms"), F.min_by("reason", "dead_at_ms").alias("reason"))


@op("jn_13", "SELECT lane, CAST(count(*) AS BIGINT) AS dropped FROM live WHERE group_id = 'g2' GROUP BY lane")
def group_across_lanes(t: Tables, group: str = "g2") -> DataFrame:
    return t.live.where(F.col("group_id") == group).groupBy("lane").agg(F.count(F.lit(1)).alias("dropped"))


_FIFO = """SELECT s.run_id, s.k AS activity, s.event_time_ms AS start_ms, x.event_time_ms AS end_ms, CASE WHEN x.event_type = 5 THEN 'completed' WHEN x.event_type = 6 THEN 'failed' ELSE 'running' END AS state FROM
    (SELECT run_id, event_time_ms, CAST(row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS BIGINT) AS k FROM history WHERE event_type = 4) s LEFT JOIN
    (SELECT run_id, event_time_ms, event_type, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS k FROM history WHERE event_type IN (5, 6)) x ON x.run_id = s.run_id AND x.k = s.k"""


@op("jn_14", _FIFO)
def paired_activities(t: Tables) -> DataFrame:
    """The k-th scheduled event of a run with its k-th terminal; one window ranks both kinds."""
    kind = F.when(F.col("event_type") == 4, 0).otherwise(1)
    h = t.history.where("event_type IN (4, 5, 6)").withColumn("kind", kind)
    h = h.withColumn("activity", F.row_number().over(Window.partitionBy("run_id", "kind").orderBy("event_id")).cast("long"))
    s, x = F.col("kind") == 0, F.col("kind") == 1
    out = h.groupBy("run_id", "activity").agg(F.max(F.when(s, F.col("event_time_ms"))).alias("start_ms"), F.max(F.when(x, F.col("event_time_ms"))).alias("end_ms"), F.max(F.when(x, F.col("event_type"))).alias("ty"))
    state = F.when(F.col("ty") == 5, "completed").when(F.col("ty") == 6, "failed").otherwise("running")
    return out.where("start_ms IS NOT NULL").select("run_id", "activity", "start_ms", "end_ms", state.alias("state"))


@op(
    "jn_15",
    """WITH RECURSIVE chain(run_id, root, depth) AS (SELECT run_id, run_id, CAST(0 AS BIGINT) FROM runs WHERE parent_run_id IS NULL
    UNION ALL SELECT r.run_id, c.root, c.depth + 1 FROM runs r JOIN chain c ON r.parent_run_id = c.run_id) SELECT run_id, root, depth FROM chain""",
)
def run_chains(t: Tables, most_rounds: int = 40) -> DataFrame:
    """Each run's first ancestor and its distance, by pointer doubling: a chain of d links takes log2(d) joins.

    Runs whose chain leaves the table or loops have no first ancestor and give no row.
    """
    top = F.col("parent_run_id").isNull()
    at = t.runs.select("run_id", F.when(top, F.col("run_id")).otherwise(F.col("parent_run_id")).alias("root"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), top.alias("done"))
    at = checkpoint(at)
    for _ in range(most_rounds):
        if at.where("NOT done").isEmpty():
            break
        up = at.select(F.col("run_id").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        rest = at.where("NOT done").join(up, "root")
        moved = rest.select("run_id", F.col("up").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))
        at = checkpoint(at.where("done").union(moved))
    return at.where("done").select("run_id", "root", "depth")


@op(
    "jn_16",
    """SELECT g.lane, ready, CAST(coalesce(d.n, 0) AS BIGINT) AS dlq, CAST(coalesce(p.version, 0) AS BIGINT) AS policy_version FROM
    (SELECT lane, CAST(sum(ready) AS BIGINT) AS ready FROM groups_t GROUP BY lane) g LEFT JOIN (SELECT lane, count(*) AS n FROM dead_letters WHERE lane <> 'view' GROUP BY lane) d ON d.lane = g.lane
    LEFT JOIN (VALUES ('view', 3), ('click', 1)) p(lane, version) ON p.lane = g.lane""",
)
def enriched_lanes(t: Tables) -> DataFrame:
    p = t.values("lane string, version long", [("view", 3), ("click", 1)])
    out = lane_stats(t).join(dlq_depth(t).where("lane <> 'view'"), "lane", "left").join(F.broadcast(p), "lane", "left")
    zero = F.lit(0).cast("long")
    return out.select("lane", "ready", F.coalesce("depth", zero).alias("dlq"), F.coalesce("version", zero).alias("policy_version"))


@op(
    "jn_17",
    """SELECT a.name, CAST(count(*) FILTER (WHERE l.deadline_ms <= a.asof_ms) AS BIGINT) AS due, CAST(count(*) FILTER (WHERE l.deadline_ms <= a.asof_ms + a.warn_ms) AS BIGINT) AS near FROM leases l,
    (VALUES ('now', 1706659200000, 5000), ('earlier', 1706659195000, 2000), ('later', 1706659205000, 0)) a(name, asof_ms, warn_ms) GROUP BY a.name""",
)
def due_at(t: Tables) -> DataFrame:
    """Timers due at each of a few instants: a range join whose other side is configuration."""
    a = t.values("name string, asof_ms long, warn_ms long", [("now", t.asof_ms, 5000), ("earlier", t.asof_ms - 5000, 2000), ("later", t.asof_ms + 5000, 0)])
    j = t.leases.select("deadline_ms").join(F.broadcast(a), F.col("deadline_ms") <= F.col("asof_ms") + F.col("warn_ms"))
    return j.groupBy("name").agg(F.count_if(F.col("deadline_ms") <= F.col("asof_ms")).alias("due"), F.count(F.lit(1)).alias("near"))
