"""Sources and predicates: point gets, prefix and due scans, ingestion, filters, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequence import keyed_row_number
from tidemark.registry import op
from tidemark.sources.views import ACKED, ASOF_MS, DELAYED, LEASED, READY, Tables

KEYS = ("lane", "group_id", "msg_id")


# ---------------------------------------------------------------- sources
@op("src_01", "SELECT lane, group_id, msg_id, enqueue_ms FROM live WHERE (lane = 'view' AND group_id = 'g1' AND msg_id IN (1, 3)) OR (lane = 'click' AND group_id = 'g2' AND msg_id = 2)")
def point_get(t: Tables) -> DataFrame:
    """Batch point get: an equi-join on the key; a missing key gives no row."""
    keys = t.values("lane string, group_id string, msg_id long", [("view", "g1", 1), ("view", "g1", 3), ("click", "g2", 2), ("view", "g1", -1)])
    return t.live.join(F.broadcast(keys), list(KEYS)).select(*KEYS, "enqueue_ms")


@op("src_02", "SELECT lane, group_id, msg_id, enqueue_ms, fate FROM live")
def full_scan(t: Tables) -> DataFrame:
    return t.live.select(*KEYS, "enqueue_ms", "fate")


@op("src_03", "SELECT lane, group_id, msg_id, enqueue_ms FROM live WHERE lane = 'signup' AND group_id = 'g3'")
def prefix_scan(t: Tables, lane: str = "signup", group: str = "g3") -> DataFrame:
    """A key prefix is an equality filter; it reaches the scan of a table partitioned by lane."""
    return t.live.where((F.col("lane") == lane) & (F.col("group_id") == group)).select(*KEYS, "enqueue_ms")


@op(
    "src_04",
    """SELECT not_before_ms AS due_ms, 1 AS kind, lane, group_id, msg_id FROM messages WHERE fate = 2 AND not_before_ms > 0 AND not_before_ms <= 1705449600000
    ORDER BY due_ms, kind, length(lane), lane, length(group_id), group_id, msg_id""",
)
def due_scan(t: Tables, until_ms: int = 1705449600000) -> DataFrame:
    """Timers due at or before an instant (inclusive), by due time."""
    due = t.messages.where((F.col("fate") == DELAYED) & (F.col("not_before_ms") > 0) & (F.col("not_before_ms") <= until_ms))
    out = due.select(F.col("not_before_ms").alias("due_ms"), F.lit(1).alias("kind"), *KEYS)
    return out.orderBy("due_ms", "kind", F.length("lane"), "lane", F.length("group_id"), "group_id", "msg_id")


@op("src_05", "SELECT lane, group_id AS id, ready, inflight, weight, paused FROM groups_t")
def list_groups(t: Tables) -> DataFrame:
    return t.groups.select("lane", F.col("group_id").alias("id"), "ready", "inflight", "weight", "paused")


@op(
    "src_06",
    """SELECT event_type AS lane, concat('u', CAST(user_id AS VARCHAR)) AS group_id, event_id,
    CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS BIGINT) AS msg_id,
    epoch_us(ts) // 1000 AS enqueue_ms, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 + 5000 ELSE 0 END AS not_before_ms,
    CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS state FROM events""",
)
def publish(t: Tables) -> DataFrame:
    """Publish: a sequence number per (lane, group); delayed when not_before lies ahead."""
    rows = t.events.select(F.col("event_type").alias("lane"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("group_id"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("enqueue_ms"))
    delay = F.col("event_id") % 3 == 0
    rows = rows.withColumn("not_before_ms", F.when(delay, F.col("enqueue_ms") + 5000).otherwise(0)).withColumn("state", F.when(delay, DELAYED).otherwise(READY))
    return keyed_row_number(rows, ["lane", "group_id"], "event_id", "msg_id", t.event_cuts)


@op(
    "src_07",
    """WITH b AS (SELECT *, event_id // 50 AS batch, row_number() OVER (PARTITION BY event_id // 50, lane, dedup_key ORDER BY event_id) AS k,
      first_value(event_id) OVER (PARTITION BY event_id // 50, lane, dedup_key ORDER BY event_id) AS original, event_id % 1000 = 17 AS bad FROM messages),
    f AS (SELECT batch, bool_or(bad) AS failed FROM b GROUP BY batch)
    SELECT b.batch, event_id, CASE WHEN failed THEN 'aborted' WHEN k = 1 THEN 'published' ELSE 'duplicate' END AS result,
      CASE WHEN NOT failed THEN original END AS event_of FROM b JOIN f ON b.batch = f.batch""",
)
def publish_batch(t: Tables, size: int = 50) -> DataFrame:
    """Atomic batches: one bad item aborts all; inside a batch a (lane, dedup key) repeats the first item."""
    rows = t.fates.withColumn("batch", F.floor(F.col("event_id") / size)).withColumn("bad", F.col("event_id") % 1000 == 17)
    first = Window.partitionBy("batch", "lane", "dedup_key")
    whole = Window.partitionBy("batch")
    rows = rows.withColumn("original", F.min("event_id").over(first)).withColumn("failed", F.max("bad").over(whole))
    result = F.when(F.col("failed"), "aborted").when(F.col("event_id") == F.col("original"), "published").otherwise("duplicate")
    return rows.select("batch", "event_id", result.alias("result"), F.when(~F.col("failed"), F.col("original")).alias("event_of"))


@op(
    "src_08",
    """SELECT id AS cron_id, CAST(k + 1 AS BIGINT) AS slot, start_ms + (k + 1) * every_ms AS fire_ms FROM
    (VALUES ('hourly', 1706572800000, 3600000), ('quick', 1706655600000, 600000), ('daily', 1704067200000, 86400000)) c(id, start_ms, every_ms),
    (SELECT unnest(range(0, 100)) AS k) r WHERE start_ms + (k + 1) * every_ms <= 1706659200000""",
)
def cron_source(t: Tables) -> DataFrame:
    """@every schedules expanded into their fire times up to the as-of instant."""
    specs = t.values("cron_id string, start_ms long, every_ms long", [("hourly", 1706572800000, 3600000), ("quick", 1706655600000, 600000), ("daily", 1704067200000, 86400000)])
    fires = F.sequence(F.col("start_ms") + F.col("every_ms"), F.lit(t.asof_ms), F.col("every_ms"))
    out = specs.where(F.col("start_ms") + F.col("every_ms") <= t.asof_ms).select("cron_id", F.posexplode(fires).alias("slot", "fire_ms"))
    return out.select("cron_id", (F.col("slot") + 1).cast("long").alias("slot"), "fire_ms")


@op("src_12", "SELECT CAST(i AS BIGINT) AS i, concat('g-', CAST(i % 10 AS VARCHAR)) AS group_id, concat('lane-', CAST((i + 3) % 4 AS VARCHAR)) AS lane FROM (SELECT unnest(range(1000)) AS i)")
def synthetic_workload(t: Tables, n: int = 1000, groups: int = 10, lanes: int = 4) -> DataFrame:
    i = F.col("id")
    return t.spark.range(n).select(i.alias("i"), F.concat(F.lit("g-"), (i % groups).cast("string")).alias("group_id"), F.concat(F.lit("lane-"), ((i + 3) % lanes).cast("string")).alias("lane"))


# ---------------------------------------------------------------- filters
@op("flt_01", "SELECT lane, group_id, ready, weight FROM groups_t WHERE ready > 0 AND NOT paused")
def eligible_groups(t: Tables) -> DataFrame:
    return t.groups.where((F.col("ready") > 0) & ~F.col("paused")).select("lane", "group_id", "ready", "weight")


@op("flt_02", "SELECT lane, group_id, ready FROM groups_t WHERE group_id IN ('g1', 'g2', 'g3') AND group_id NOT IN ('g2')")
def allow_deny(t: Tables, allow: tuple[str, ...] = ("g1", "g2", "g3"), deny: tuple[str, ...] = ("g2",)) -> DataFrame:
    """Empty allow means all; deny wins."""
    out = t.groups
    if allow:
        out = out.where(F.col("group_id").isin(*allow))
    if deny:
        out = out.where(~F.col("group_id").isin(*deny))
    return out.select("lane", "group_id", "ready")


PAUSES = [("view", ASOF_MS + 5000), ("click", ASOF_MS - 1), ("error", ASOF_MS)]


@op(
    "flt_03",
    """SELECT g.lane, group_id, coalesce(until_ms, 0) AS paused_until_ms FROM groups_t g LEFT JOIN
    (VALUES ('view', 1706659205000), ('click', 1706659199999), ('error', 1706659200000)) p(lane, until_ms) ON g.lane = p.lane
    WHERE coalesce(until_ms, 0) <= 1706659200000""",
)
def lane_gate(t: Tables) -> DataFrame:
    """Groups of lanes that are not paused now; a pause that has run out no longer blocks."""
    p = t.values("lane string, until_ms long", PAUSES)
    out = t.groups.join(F.broadcast(p), "lane", "left").withColumn("paused_until_ms", F.coalesce("until_ms", F.lit(0).cast("long")))
    return out.where(F.col("paused_until_ms") <= t.asof_ms).select("lane", "group_id", "paused_until_ms")


@op("flt_04", "SELECT lane, group_id, ready, delayed_n, inflight FROM groups_t WHERE lane = 'purchase'")
def stats_filter(t: Tables, lane: str | None = "purchase", group: str | None = None) -> DataFrame:
    out = t.groups
    out = out.where(F.col("lane") == lane) if lane else out
    out = out.where(F.col("group_id") == group) if group else out
    return out.select("lane", "group_id", "ready", "delayed_n", "inflight")


@op("flt_05", "SELECT lane, group_id, msg_id FROM messages WHERE fate IN (1, 2)")
def leasable(t: Tables) -> DataFrame:
    return t.messages.where(F.col("fate").isin(READY, DELAYED)).select(*KEYS)


@op("flt_06", "SELECT lease_id, group_id, msg_id, deadline_ms FROM leases WHERE lane = 'view'")
def leases_of_lane(t: Tables, lane: str = "view") -> DataFrame:
    return t.leases.where(F.col("lane") == lane).select("lease_id", "group_id", "msg_id", "deadline_ms")


STATUSES = {"WF_PENDING": 0, "WF_RUNNING": 1, "WF_COMPLETED": 2, "WF_FAILED": 3, "WF_CANCELED": 4, "WF_CONTINUED_AS_NEW": 5}


@op("flt_07", "SELECT run_id, workflow_type, status FROM runs WHERE status = 3")
def runs_by_status(t: Tables, name: str | None = "WF_FAILED") -> DataFrame:
    """An unknown name filters nothing."""
    out = t.runs if name not in STATUSES else t.runs.where(F.col("status") == STATUSES[name])
    return out.select("run_id", "workflow_type", "status")


@op(
    "flt_08",
    "SELECT lane, group_id, last_activity_ms FROM groups_t WHERE (CASE WHEN group_id IN ('g0', 'g5') THEN 0 ELSE ready + delayed_n + inflight END) = 0 AND last_activity_ms > 0 AND 1706659200000 - last_activity_ms > 60000",
)
def idle_groups(t: Tables, idle_ms: int = 60000) -> DataFrame:
    """Groups to reap: empty, once active, idle for longer than idle_ms. Two groups are drained here."""
    total = F.when(F.col("group_id").isin("g0", "g5"), 0).otherwise(F.col("ready") + F.col("delayed_n") + F.col("inflight"))
    idle = (total == 0) & (F.col("last_activity_ms") > 0) & (F.lit(t.asof_ms) - F.col("last_activity_ms") > idle_ms)
    return t.groups.where(idle).select("lane", "group_id", "last_activity_ms")


@op(
    "flt_09",
    """SELECT g.lane, g.group_id, NOT paused AND (ready + delayed_n > 0 OR coalesce(n, 0) > 0) AS active FROM groups_t g LEFT JOIN
    (SELECT lane, group_id, count(*) AS n FROM served WHERE seq > (SELECT max(seq) FROM served) - 512 GROUP BY ALL) s ON s.lane = g.lane AND s.group_id = g.group_id""",
)
def active_for_share(t: Tables) -> DataFrame:
    from tidemark.operators.fairness import rolling_counts

    s = rolling_counts(t).withColumnRenamed("served", "n")
    active = ~F.col("paused") & ((F.col("ready") + F.col("delayed_n") > 0) | (F.coalesce("n", F.lit(0)) > 0))
    return t.groups.join(F.broadcast(s), ["lane", "group_id"], "left").select("lane", "group_id", active.alias("active"))


@op(
    "flt_10",
    """SELECT lease_id, CASE WHEN deadline_ms <= 1706659200000 THEN 'expired' WHEN deadline_ms <= 1706659205000 THEN 'near' ELSE 'ok' END AS deadline FROM leases""",
)
def lease_deadlines(t: Tables, warn_ms: int = 5000) -> DataFrame:
    d = F.col("deadline_ms")
    return t.leases.select("lease_id", F.when(d <= t.asof_ms, "expired").when(d <= t.asof_ms + warn_ms, "near").otherwise("ok").alias("deadline"))


@op("flt_11", "SELECT run_id, lane FROM (SELECT run_id, CASE WHEN run_id % 3 = 0 THEN concat('__wf/', workflow_type) WHEN run_id % 3 = 1 THEN concat('__act/', workflow_type) ELSE workflow_type END AS lane FROM runs) WHERE starts_with(lane, '__act/') OR starts_with(lane, '__wf/')")
def system_lanes(t: Tables) -> DataFrame:
    m = F.col("run_id") % 3
    lane = F.when(m == 0, F.concat(F.lit("__wf/"), "workflow_type")).when(m == 1, F.concat(F.lit("__act/"), "workflow_type")).otherwise(F.col("workflow_type"))
    out = t.runs.select("run_id", lane.alias("lane"))
    return out.where(F.col("lane").startswith("__act/") | F.col("lane").startswith("__wf/"))


READ, PUBLISH, CONSUME, ADMIN = 1, 2, 3, 4
_ALLOWED = """NOT disabled AND (list_contains(tags, 'administrator') OR ((list_contains(tags, 'dashboard') OR list_contains(tags, 'monitoring')) AND c.action = 1)
    OR EXISTS (SELECT 1 FROM grants_t g WHERE g.name = p.name AND (list_contains(g.actions, c.action) OR list_contains(g.actions, 4))
    AND regexp_matches(c.lane, g.lane_pattern) AND regexp_matches(c.group_id, g.group_pattern)))"""


def allowed():
    """A principal may do an action on a lane and group: by tag, or by a grant whose patterns match anywhere."""
    grant = F.exists(
        "grants",
        lambda g: (F.array_contains(g["actions"], F.col("action")) | F.array_contains(g["actions"], ADMIN))
        & F.rlike(F.col("lane"), g["lane_pattern"])
        & F.rlike(F.col("group_id"), g["group_pattern"]),
    )
    reads = (F.array_contains("tags", "dashboard") | F.array_contains("tags", "monitoring")) & (F.col("action") == READ)
    return ~F.col("disabled") & (F.array_contains("tags", "administrator") | reads | grant)


@op("flt_12", f"SELECT p.name, c.call, c.action, c.lane, c.group_id, {_ALLOWED} AS allowed FROM principals_t p, checks_t c")
def authorize(t: Tables) -> DataFrame:
    """Each principal against each check; both tables are configuration."""
    both = t.principals.crossJoin(F.broadcast(t.checks))
    return both.select("name", "call", "action", "lane", "group_id", allowed().alias("allowed"))


METHODS = [
    ("Publish", "PUBLISH", True, True), ("PublishBatch", "PUBLISH", True, True), ("Work", "CONSUME", True, False), ("Complete", "CONSUME", False, False),
    ("GetStats", "READ", True, True), ("ListGroups", "READ", True, False), ("ListDeadLetters", "READ", True, True), ("RedriveDeadLetter", "ADMIN", True, True),
    ("PauseGroup", "ADMIN", True, True), ("SetPolicy", "ADMIN", True, False), ("ListPrincipals", "ADMIN", False, False), ("GetLaneFairness", "READ", True, False),
]


@op(
    "flt_13",
    "SELECT m.method, action, CASE WHEN by_lane THEN lane ELSE '' END AS lane, CASE WHEN by_group THEN group_id ELSE '' END AS group_id FROM (VALUES "
    + ", ".join(f"('{m}', '{a}', {x}, {y})" for m, a, x, y in METHODS)
    + ") m(method, action, by_lane, by_group), (SELECT DISTINCT lane, group_id FROM groups_t WHERE group_id = 'g1') g",
)
def derived_checks(t: Tables) -> DataFrame:
    """What a call must be allowed to do: its method's action on its lane and group, '' where it names none."""
    m = t.values("method string, action string, by_lane boolean, by_group boolean", METHODS)
    calls = t.groups.where("group_id = 'g1'").select("lane", "group_id")
    out = calls.crossJoin(F.broadcast(m))
    return out.select("method", "action", F.when(F.col("by_lane"), F.col("lane")).otherwise("").alias("lane"), F.when(F.col("by_group"), F.col("group_id")).otherwise("").alias("group_id"))


# ---------------------------------------------------------------- projections
@op("prj_01", "SELECT lane, group_id, ready, delayed_n AS delayed, inflight, ready + delayed_n + inflight AS total, weight, paused, next_seq, last_activity_ms, virtual_time FROM groups_t")
def group_stats(t: Tables) -> DataFrame:
    total = (F.col("ready") + F.col("delayed_n") + F.col("inflight")).alias("total")
    return t.groups.select("lane", "group_id", "ready", F.col("delayed_n").alias("delayed"), "inflight", total, "weight", "paused", "next_seq", "last_activity_ms", "virtual_time")


@op("prj_02", "SELECT lane, group_id, msg_id, enqueue_ms, max_attempts, dead_at_ms, reason FROM dead_letters")
def dead_letter_info(t: Tables) -> DataFrame:
    o = [F.col(f"original.{c}") for c in ("lane", "group_id", "msg_id", "enqueue_ms", "max_attempts")]
    return t.dead_letters.select(*o, "dead_at_ms", "reason")


@op("prj_03", "SELECT lease_id, lane, group_id, msg_id, consumer_id, deadline_ms, deadline_ms - visibility_ms AS granted_ms, attempt_at_lease AS attempt, extend_count FROM leases")
def lease_info(t: Tables) -> DataFrame:
    """granted_ms is the grant, deadline less visibility; the stored field of that name holds the deadline."""
    granted = (F.col("deadline_ms") - F.col("visibility_ms")).alias("granted_ms")
    return t.leases.select("lease_id", *KEYS, "consumer_id", "deadline_ms", granted, F.col("attempt_at_lease").alias("attempt"), "extend_count")


@op("prj_04", "SELECT msg_id, group_id, fate AS state, enqueue_ms, max_attempts FROM live WHERE lane = 'error'")
def message_peek(t: Tables, lane: str = "error") -> DataFrame:
    return t.live.where(F.col("lane") == lane).select("msg_id", "group_id", F.col("fate").alias("state"), "enqueue_ms", "max_attempts")


@op("prj_05", "SELECT lease_id, consumer_id, token_hash <> '' AS has_token FROM leases")
def redacted_leases(t: Tables) -> DataFrame:
    """Listings keep no token material, only whether there is one."""
    row = F.struct("lease_id", "consumer_id", "token_hash", (F.col("token_hash") != "").alias("has_token"))
    return t.leases.select(row.dropFields("token_hash").alias("r")).select("r.*")


@op("prj_06", "SELECT run_id, concat('__wf/', workflow_type) AS wf_lane, CAST(run_id AS VARCHAR) AS wf_group, concat('__act/', workflow_type) AS act_lane, tenant_id AS act_group FROM runs")
def namespaces(t: Tables) -> DataFrame:
    return t.runs.select(
        "run_id", F.concat(F.lit("__wf/"), "workflow_type").alias("wf_lane"), F.col("run_id").cast("string").alias("wf_group"),
        F.concat(F.lit("__act/"), "workflow_type").alias("act_lane"), F.col("tenant_id").alias("act_group"),
    )


@op("prj_07", "SELECT lane, group_id, CASE WHEN paused THEN 'paused' WHEN inflight > 0 THEN 'inflight' WHEN ready > 0 THEN 'ready' WHEN delayed_n > 0 THEN 'delayed' ELSE 'idle' END AS status FROM groups_t")
def group_status(t: Tables) -> DataFrame:
    s = F.when(F.col("paused"), "paused").when(F.col("inflight") > 0, "inflight").when(F.col("ready") > 0, "ready").when(F.col("delayed_n") > 0, "delayed").otherwise("idle")
    return t.groups.select("lane", "group_id", s.alias("status"))


EVENT_NAMES = {
    1: "HET_WORKFLOW_STARTED", 2: "HET_WORKFLOW_TASK_SCHEDULED", 3: "HET_WORKFLOW_TASK_COMPLETED", 4: "HET_ACTIVITY_SCHEDULED", 5: "HET_ACTIVITY_COMPLETED",
    6: "HET_ACTIVITY_FAILED", 7: "HET_TIMER_STARTED", 8: "HET_TIMER_FIRED", 9: "HET_SIGNAL_RECEIVED", 10: "HET_WORKFLOW_COMPLETED", 11: "HET_WORKFLOW_FAILED",
}


def named(col, names: dict[int, str]):
    return F.create_map(*[F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for pair in names.items() for x in pair])[col]


_NAME_SQL = "CASE event_type " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in EVENT_NAMES.items()) + " END"


@op(
    "prj_08",
    f"""SELECT event_type, lower(replace(regexp_replace({_NAME_SQL}, '^(WF|HET)_', ''), '_', ' ')) AS label,
    CASE WHEN event_type IN (6, 11) THEN 'bad' WHEN event_type IN (5, 10) THEN 'good' ELSE 'neutral' END AS tone, CAST(count(*) AS BIGINT) AS n FROM history GROUP BY event_type""",
)
def event_labels(t: Tables) -> DataFrame:
    n = t.history.groupBy("event_type").count()
    label = F.lower(F.replace(F.regexp_replace(named(F.col("event_type"), EVENT_NAMES), "^(WF|HET)_", ""), F.lit("_"), F.lit(" ")))
    tone = F.when(F.col("event_type").isin(6, 11), "bad").when(F.col("event_type").isin(5, 10), "good").otherwise("neutral")
    return n.select("event_type", label.alias("label"), tone.alias("tone"), F.col("count").alias("n"))
