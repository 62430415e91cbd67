"""Observability: lane statistics, the fairness observatory, health findings, ordering and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequence import ranged_row_number
from tidemark.registry import op
from tidemark.sources.views import ASOF_MS, LEASED, READY, REASONS, Tables, ms

RING, RIBBON = 512, 200
_RING_SQL = "SELECT lane, group_id, CAST(count(*) AS BIGINT) AS served FROM served WHERE seq > (SELECT max(seq) FROM served) - 512 GROUP BY lane, group_id"


# ---------------------------------------------------------------- aggregates
def oldest_by_group(t: Tables) -> DataFrame:
    """Age of each group's lowest live message id (not the least enqueue time); never negative."""
    first = t.live.groupBy("lane", "group_id").agg(F.min_by("enqueue_ms", "msg_id").alias("at"))
    age = F.when((F.col("at") == 0) | (F.col("at") > t.asof_ms), 0).otherwise(F.lit(t.asof_ms) - F.col("at"))
    return first.select("lane", "group_id", age.cast("long").alias("oldest_age_ms"))


_OLDEST = """SELECT lane, group_id, CAST(CASE WHEN a = 0 OR a > 1706659200000 THEN 0 ELSE 1706659200000 - a END AS BIGINT) AS oldest_age_ms
    FROM (SELECT lane, group_id, min_by(enqueue_ms, msg_id) AS a FROM live GROUP BY lane, group_id)"""


@op(
    "agg_01",
    f"""SELECT g.lane, CAST(sum(ready) AS BIGINT) AS ready, CAST(sum(delayed_n) AS BIGINT) AS delayed, CAST(sum(inflight) AS BIGINT) AS inflight,
    CAST(count(*) AS BIGINT) AS groups_n, CAST(coalesce(max(oldest_age_ms), 0) AS BIGINT) AS oldest_age_ms FROM groups_t g
    LEFT JOIN ({_OLDEST}) o ON o.lane = g.lane AND o.group_id = g.group_id GROUP BY g.lane""",
)
def lane_stats(t: Tables) -> DataFrame:
    rows = t.groups.join(oldest_by_group(t), ["lane", "group_id"], "left")
    return rows.groupBy("lane").agg(
        F.sum("ready").alias("ready"), F.sum("delayed_n").alias("delayed"), F.sum("inflight").alias("inflight"), F.count(F.lit(1)).alias("groups_n"),
        F.coalesce(F.max("oldest_age_ms"), F.lit(0).cast("long")).alias("oldest_age_ms"),
    )


op("agg_02", _OLDEST)(oldest_by_group)


@op("agg_03", "SELECT lane, CAST(count(*) AS BIGINT) AS depth FROM dead_letters GROUP BY lane")
def dlq_depth(t: Tables) -> DataFrame:
    return t.dead_letters.groupBy(F.col("original.lane").alias("lane")).agg(F.count(F.lit(1)).alias("depth"))


@op("agg_04", "SELECT lane, reason, CAST(count(*) AS BIGINT) AS n FROM dead_letters GROUP BY lane, reason")
def dlq_by_reason(t: Tables) -> DataFrame:
    return t.dead_letters.groupBy(F.col("original.lane").alias("lane"), "reason").agg(F.count(F.lit(1)).alias("n"))


@op(
    "agg_05",
    """SELECT lane, group_id, CAST(count(*) FILTER (WHERE fate = 1) AS BIGINT) AS ready, CAST(count(*) FILTER (WHERE fate = 2) AS BIGINT) AS delayed,
    CAST(count(*) FILTER (WHERE fate = 3) AS BIGINT) AS inflight, CAST(count(*) FILTER (WHERE fate <= 3) AS BIGINT) AS total, max(msg_id) + 1 AS next_seq,
    max(enqueue_ms) AS last_activity_ms FROM messages GROUP BY lane, group_id""",
)
def group_counters(t: Tables) -> DataFrame:
    n = lambda c: F.count_if(c)
    f = F.col("fate")
    return t.messages.groupBy("lane", "group_id").agg(
        n(f == 1).alias("ready"), n(f == 2).alias("delayed"), n(f == 3).alias("inflight"), n(f <= 3).alias("total"),
        (F.max("msg_id") + 1).alias("next_seq"), F.max("enqueue_ms").alias("last_activity_ms"),
    )


def ring(t: Tables, size: int = RING) -> DataFrame:
    """The last served events over all lanes: one bounded tail, found by a maximum and a filter."""
    last = t.served.agg(F.max("seq").alias("last"))
    return t.served.join(F.broadcast(last)).where(F.col("seq") > F.col("last") - size).drop("last")


@op("agg_06", _RING_SQL)
def rolling_counts(t: Tables) -> DataFrame:
    return ring(t).groupBy("lane", "group_id").agg(F.count(F.lit(1)).alias("served"))


_SHARES = f"""SELECT g.*, coalesce(s.served, 0) AS served, NOT paused AND (ready + delayed_n > 0 OR coalesce(s.served, 0) > 0) AS active
    FROM groups_t g LEFT JOIN ({_RING_SQL}) s ON s.lane = g.lane AND s.group_id = g.group_id"""
_EXPECTED = f"""SELECT *, CASE WHEN active THEN weight / (CASE WHEN w <= 0 THEN 1.0E0 ELSE w END) ELSE 0.0E0 END AS expected,
    CASE WHEN s = 0 THEN 0.0E0 ELSE CAST(served AS DOUBLE) / CAST(s AS DOUBLE) END AS actual FROM
    (SELECT *, coalesce(sum(weight) FILTER (WHERE active AND weight > 0) OVER (PARTITION BY lane), 0.0E0) AS w, sum(served) OVER (PARTITION BY lane) AS s FROM ({_SHARES}))"""


def shares(t: Tables) -> DataFrame:
    """Groups with served counts, whether they count for shares, and expected and actual share."""
    g = t.groups.join(F.broadcast(rolling_counts(t)), ["lane", "group_id"], "left").withColumn("served", F.coalesce("served", F.lit(0).cast("long")))
    g = g.withColumn("active", ~F.col("paused") & ((F.col("ready") + F.col("delayed_n") > 0) | (F.col("served") > 0)))
    lane = Window.partitionBy("lane")
    w = F.coalesce(F.sum(F.when(F.col("active") & (F.col("weight") > 0), F.col("weight"))).over(lane), F.lit(0.0))
    g = g.withColumn("w", w).withColumn("s", F.sum("served").over(lane))
    expected = F.when(F.col("active"), F.col("weight") / F.when(F.col("w") <= 0, 1.0).otherwise(F.col("w"))).otherwise(0.0)
    actual = F.when(F.col("s") == 0, 0.0).otherwise(F.col("served").cast("double") / F.col("s").cast("double"))
    return g.withColumn("expected", expected).withColumn("actual", actual)


@op("agg_07", f"SELECT lane, group_id, expected FROM ({_EXPECTED})")
def expected_share(t: Tables) -> DataFrame:
    return shares(t).select("lane", "group_id", "expected")


@op("agg_08", f"SELECT lane, group_id, actual FROM ({_EXPECTED})")
def actual_share(t: Tables) -> DataFrame:
    return shares(t).select("lane", "group_id", "actual")


_SCORED = f"""SELECT *, CASE WHEN m = 0 THEN 0.0E0 ELSE raw / m END AS score FROM (SELECT *, max(raw) OVER (PARTITION BY lane) AS m FROM
    (SELECT *, CAST(greatest(1706659200000 - last_activity_ms, 0) AS DOUBLE) * CAST(ready + delayed_n AS DOUBLE) * greatest(expected - actual, 0.0E0) AS raw FROM ({_EXPECTED})))"""


def starvation(t: Tables) -> DataFrame:
    """shares with raw pressure and the starvation score, normalised by the lane's largest."""
    age = F.greatest(F.lit(t.asof_ms) - F.col("last_activity_ms"), F.lit(0)).cast("double")
    raw = age * (F.col("ready") + F.col("delayed_n")).cast("double") * F.greatest(F.col("expected") - F.col("actual"), F.lit(0.0))
    g = shares(t).withColumn("raw", raw).withColumn("m", F.max("raw").over(Window.partitionBy("lane")))
    return g.withColumn("score", F.when(F.col("m") == 0, 0.0).otherwise(F.col("raw") / F.col("m")))


@op("agg_09", f"SELECT lane, group_id, raw, score FROM ({_SCORED})")
def starvation_score(t: Tables) -> DataFrame:
    return starvation(t).select("lane", "group_id", "raw", "score")


def doctor_counts(t: Tables, warn_ms: int = 5000) -> DataFrame:
    backlog = F.col("ready") + F.col("delayed_n") > 0
    g = t.groups.groupBy("lane").agg(F.count_if(backlog & ~F.col("paused")).alias("backlogged"), F.count_if(backlog & F.col("paused")).alias("paused_backlogged"))
    d = F.col("deadline_ms")
    x = t.leases.groupBy("lane").agg(F.count(F.lit(1)).alias("leases_n"), F.count_if(d <= t.asof_ms).alias("expired"), F.count_if((d > t.asof_ms) & (d <= t.asof_ms + warn_ms)).alias("near_deadline"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return g.join(x, "lane", "left").select("lane", "backlogged", "paused_backlogged", zero("leases_n"), zero("expired"), zero("near_deadline"))


_DOCTOR = """SELECT g.lane, backlogged, paused_backlogged, CAST(coalesce(leases_n, 0) AS BIGINT) AS leases_n, CAST(coalesce(expired, 0) AS BIGINT) AS expired, CAST(coalesce(near_deadline, 0) AS BIGINT) AS near_deadline FROM
    (SELECT lane, CAST(count(*) FILTER (WHERE ready + delayed_n > 0 AND NOT paused) AS BIGINT) AS backlogged, CAST(count(*) FILTER (WHERE ready + delayed_n > 0 AND paused) AS BIGINT) AS paused_backlogged FROM groups_t GROUP BY lane) g
    LEFT JOIN (SELECT lane, count(*) AS leases_n, count(*) FILTER (WHERE deadline_ms <= 1706659200000) AS expired,
    count(*) FILTER (WHERE deadline_ms > 1706659200000 AND deadline_ms <= 1706659205000) AS near_deadline FROM leases GROUP BY lane) x ON x.lane = g.lane"""
op("agg_10", _DOCTOR)(doctor_counts)

_FINDINGS = f"""SELECT 'WARN' AS status, 'paused_group_backlog' AS code, lane, paused_backlogged AS n FROM ({_DOCTOR}) WHERE paused_backlogged > 0
    UNION ALL SELECT 'FAIL', 'expired_leases', lane, expired FROM ({_DOCTOR}) WHERE expired > 0
    UNION ALL SELECT 'WARN', 'near_deadline_leases', lane, near_deadline FROM ({_DOCTOR}) WHERE near_deadline > 0
    UNION ALL SELECT 'WARN', 'dead_letters', lane, CAST(count(*) AS BIGINT) FROM dead_letters GROUP BY lane
    UNION ALL SELECT 'WARN', 'stuck_runs', concat('__wf/', workflow_type), CAST(count(*) AS BIGINT) FROM runs WHERE status = 1 AND NOT wf_task_pending GROUP BY workflow_type"""


def findings(t: Tables) -> DataFrame:
    """Health findings of five detectors: status, code, lane, n."""
    c = doctor_counts(t)
    one = lambda df, status, code, lane, n: df.where(n > 0).select(F.lit(status).alias("status"), F.lit(code).alias("code"), lane.alias("lane"), n.cast("long").alias("n"))
    stuck = t.runs.where((F.col("status") == 1) & ~F.col("wf_task_pending")).groupBy("workflow_type").count()
    parts = [
        one(c, "WARN", "paused_group_backlog", F.col("lane"), F.col("paused_backlogged")),
        one(c, "FAIL", "expired_leases", F.col("lane"), F.col("expired")),
        one(c, "WARN", "near_deadline_leases", F.col("lane"), F.col("near_deadline")),
        one(dlq_depth(t), "WARN", "dead_letters", F.col("lane"), F.col("depth")),
        one(stuck, "WARN", "stuck_runs", F.concat(F.lit("__wf/"), "workflow_type"), F.col("count")),
    ]
    return reduce(DataFrame.unionByName, parts)


@op("agg_11", f"SELECT CASE max(CASE status WHEN 'FAIL' THEN 2 ELSE 1 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'OK' END AS status, CAST(count(*) AS BIGINT) AS findings FROM ({_FINDINGS})")
def doctor_status(t: Tables) -> DataFrame:
    """The worst status of all findings; OK where there are none."""
    rank = F.max(F.when(F.col("status") == "FAIL", 2).otherwise(1))
    return findings(t).agg(F.when(rank == 2, "FAIL").when(rank == 1, "WARN").otherwise("OK").alias("status"), F.count(F.lit(1)).alias("findings"))


@op(
    "agg_12",
    """SELECT workflow_type, CAST(count(*) FILTER (WHERE status = 1) AS BIGINT) AS running, CAST(count(*) FILTER (WHERE status = 1 AND wf_task_pending) AS BIGINT) AS task_pending,
    CAST(count(*) FILTER (WHERE status = 1 AND NOT wf_task_pending) AS BIGINT) AS possibly_stuck FROM runs GROUP BY workflow_type""",
)
def workflow_counts(t: Tables) -> DataFrame:
    r, p = F.col("status") == 1, F.col("wf_task_pending")
    return t.runs.groupBy("workflow_type").agg(F.count_if(r).alias("running"), F.count_if(r & p).alias("task_pending"), F.count_if(r & ~p).alias("possibly_stuck"))


@op("agg_13", " UNION ALL ".join(f"SELECT '{n}' AS name, CAST(count(*) AS BIGINT) AS n FROM {v}" for n, v in (("messages", "live"), ("groups", "groups_t"), ("leases", "leases"), ("dead_letters", "dead_letters"), ("runs", "runs"), ("history", "history"), ("principals", "principals_t"))))
def table_counts(t: Tables) -> DataFrame:
    every = {"messages": t.live, "groups": t.groups, "leases": t.leases, "dead_letters": t.dead_letters, "runs": t.runs, "history": t.history, "principals": t.principals}
    return reduce(DataFrame.unionByName, [df.agg(F.lit(k).alias("name"), F.count(F.lit(1)).alias("n")) for k, df in every.items()])


@op(
    "agg_14",
    """SELECT lane, CAST(count(*) AS BIGINT) AS n, CASE WHEN max(served_ms) <= min(served_ms) THEN 0.0E0 ELSE CAST(count(*) AS DOUBLE) / (CAST(max(served_ms) - min(served_ms) AS DOUBLE) / 1000.0E0) END AS per_second FROM served GROUP BY lane""",
)
def served_rates(t: Tables) -> DataFrame:
    span = F.max("served_ms") - F.min("served_ms")
    return t.served.groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.when(span <= 0, 0.0).otherwise(F.count(F.lit(1)).cast("double") / (span.cast("double") / 1000.0)).alias("per_second"))


@op("agg_15", "SELECT lane, group_id, CAST(count(*) AS BIGINT) AS affected FROM messages WHERE fate IN (1, 2) AND group_id = 'g4' GROUP BY lane, group_id")
def cancel_affected(t: Tables, group: str = "g4") -> DataFrame:
    """What cancelling or purging a group drops: its ready and delayed rows; leased ones stay."""
    return t.fates.where(F.col("fate").isin(1, 2) & (F.col("group_id") == group)).groupBy("lane", "group_id").agg(F.count(F.lit(1)).alias("affected"))


@op("agg_16", "SELECT string_agg(lane, ',' ORDER BY lane) AS lanes, CAST(sum(n) AS BIGINT) AS total FROM (SELECT lane, count(*) AS n FROM live WHERE group_id = 'g5' GROUP BY lane)")
def teardown(t: Tables, group: str = "g5") -> DataFrame:
    """Removing a group everywhere: the lanes it touches and the messages it drops."""
    by = t.live.where(F.col("group_id") == group).groupBy("lane").count()
    return by.agg(F.array_join(F.array_sort(F.collect_list("lane")), ",").alias("lanes"), F.sum("count").alias("total"))


@op(
    "agg_17",
    f"""SELECT CAST(count(*) FILTER (WHERE active) AS BIGINT) AS active_tenants, CAST(count(*) FILTER (WHERE NOT paused AND score >= 0.5E0 AND actual - expected < -0.02E0) AS BIGINT) AS starving_tenants,
    CAST(sum(ready) AS BIGINT) AS ready, CAST(sum(served) AS BIGINT) AS served FROM ({_SCORED})""",
)
def cluster_header(t: Tables) -> DataFrame:
    starving = ~F.col("paused") & (F.col("score") >= 0.5) & (F.col("actual") - F.col("expected") < -0.02)
    return starvation(t).agg(F.count_if("active").alias("active_tenants"), F.count_if(starving).alias("starving_tenants"), F.sum("ready").alias("ready"), F.sum("served").alias("served"))


@op("agg_18", f"SELECT lane, coalesce(bool_and(abs(actual - expected) <= 0.03E0) FILTER (WHERE NOT paused), TRUE) AS converged FROM ({_EXPECTED}) GROUP BY lane")
def converged(t: Tables) -> DataFrame:
    ok = F.every(F.when(~F.col("paused"), F.abs(F.col("actual") - F.col("expected")) <= 0.03))
    return shares(t).groupBy("lane").agg(F.coalesce(ok, F.lit(True)).alias("converged"))


@op(
    "agg_19",
    """SELECT user_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT user_id, lower(trim(tag)) AS tag FROM
    (SELECT user_id, concat('  ', upper(event_type), ' ') AS tag FROM events UNION ALL SELECT user_id, event_type FROM events)) GROUP BY user_id""",
)
def canonical_tags(t: Tables) -> DataFrame:
    """Tags trimmed, lower-cased, distinct and sorted."""
    tags = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("x"))
    raw = F.concat("x", F.transform("x", lambda v: F.concat(F.lit("  "), F.upper(v), F.lit(" "))))
    return tags.select("user_id", F.array_join(F.array_sort(F.array_distinct(F.transform(raw, lambda v: F.lower(F.trim(v))))), ",").alias("tags"))


# What a tick (an hour here, events being sparse) counts of each lane, as conditions on its events.
SIGNALS = {
    "up": "TRUE", "leaders": "event_id % 2 = 0", "split": "event_id % 17 = 0", "dead_letters": "event_id % 10 = 9", "retry_nacks": "event_id % 10 = 5",
    "task_rejections": "event_id % 13 = 0", "redirects": "event_id % 4 = 1", "policy_faults": "event_id % 3 = 0",
}
# alert, severity, condition, ticks it must hold. Range functions look back over whole ticks, the present one included.
_INCREASE = "sum({0}) OVER (PARTITION BY lane ORDER BY tick ROWS BETWEEN {1} PRECEDING AND CURRENT ROW)"
ALERTS = (
    ("target_down", "critical", "up = 0", 1),
    ("no_leader", "critical", "sum(CASE WHEN leaders > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY tick) = 0", 1),
    ("no_quorum", "critical", "min(CASE WHEN split > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY tick) = 0", 1),
    ("dead_letters_rising", "warning", _INCREASE.format("dead_letters", 9) + " > 0", 5),
    ("retry_pressure_high", "warning", _INCREASE.format("retry_nacks", 4) + " > 1 * 5", 10),
    ("task_rejected", "warning", _INCREASE.format("task_rejections", 4) + " > 0", 1),
    ("redirects_high", "warning", _INCREASE.format("redirects", 4) + " > 5 * 5", 10),
    ("policy_faults", "warning", _INCREASE.format("policy_faults", 4) + " > 0", 1),
)
WHOLE = ("no_leader", "no_quorum")  # one alert for all lanes together
_SIGNALS_SQL = (
    "SELECT s.lane, s.tick, " + ", ".join(f"CAST(coalesce(q.{n}, 0) AS BIGINT) AS {n}" for n in SIGNALS)
    + " FROM samples s LEFT JOIN (SELECT event_type AS lane, (epoch_us(ts) // 1000) // 3600000 AS h, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in SIGNALS.items())
    + " FROM events GROUP BY 1, 2) q ON q.lane = s.lane AND q.h = s.tick + (SELECT min(h) FROM hourly)"
)
_STATES_SQL = " UNION ALL ".join(
    f"SELECT {'DISTINCT ' if a in WHOLE else ''}'{a}' AS alert, '{sev}' AS severity, {chr(39) + '*' + chr(39) if a in WHOLE else 'lane'} AS instance, tick, {hold} AS hold FROM (SELECT *, {cond} AS hit FROM signals) WHERE hit"
    for a, sev, cond, hold in ALERTS
)


@op(
    "agg_22",
    f"""WITH signals AS ({_SIGNALS_SQL}), states AS ({_STATES_SQL}) SELECT alert, severity, instance, min(tick) AS since, CAST(count(*) AS BIGINT) AS ticks, count(*) > hold AS firing FROM
    (SELECT *, tick - row_number() OVER (PARTITION BY alert, instance ORDER BY tick) AS island FROM states) GROUP BY alert, severity, instance, hold, island""",
)
def alert_rules(t: Tables) -> DataFrame:
    """Eight alert rules over counters sampled by tick: three instant ones (a lane, a sum and a minimum over lanes) and five
    over increase or rate in a window. Each row is a spell in which a condition held without a break, pending until it has held
    for the rule's ticks and firing from then on. One scan, one partial aggregate; what follows has one row per lane and tick.
    """
    counts = [F.count_if(F.expr(c)).alias(n) for n, c in SIGNALS.items()]
    hours = t.events.groupBy(F.col("event_type").alias("lane"), F.floor(ms("ts") / 3600000).alias("h")).agg(*counts)
    span = hours.agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    grid = span.select("lo", F.explode(F.sequence("lo", "hi")).alias("h")).join(F.broadcast(hours.select("lane").distinct()))  # lanes are configuration
    tick = (F.col("h") - F.col("lo")).alias("tick")
    s = grid.join(hours, ["lane", "h"], "left").select("lane", tick, *[F.coalesce(n, F.lit(0)).alias(n) for n in SIGNALS])
    rules = [
        F.struct(F.lit(a).alias("alert"), F.lit(sev).alias("severity"), (F.lit("*") if a in WHOLE else F.col("lane")).alias("instance"), F.lit(hold).alias("hold"), F.expr(cond).alias("hit"))
        for a, sev, cond, hold in ALERTS
    ]
    hits = s.select("tick", *[r.alias(f"r{i}") for i, r in enumerate(rules)]).select("tick", F.inline(F.array(*[f"r{i}" for i in range(len(rules))]))).where("hit")
    hits = hits.drop("hit").distinct()  # the rules over all lanes say the same in each
    island = F.col("tick") - F.row_number().over(Window.partitionBy("alert", "instance").orderBy("tick"))
    spells = hits.withColumn("island", island).groupBy("alert", "severity", "instance", "hold", "island")
    return spells.agg(F.min("tick").alias("since"), F.count(F.lit(1)).alias("ticks")).select("alert", "severity", "instance", "since", "ticks", (F.col("ticks") > F.col("hold")).alias("firing"))


# ---------------------------------------------------------------- order, top-k, pages
def by_key(*cols: str) -> list[Column]:
    """Names sort by length, then bytes."""
    return [x for c in cols for x in (F.length(F.encode(F.col(c), "utf-8")), F.col(c))]


@op("ord_01", "SELECT lane, group_id, min(msg_id) AS msg_id, min_by(enqueue_ms, msg_id) AS enqueue_ms FROM messages WHERE fate = 1 GROUP BY lane, group_id")
def head_ready(t: Tables) -> DataFrame:
    """The message each group would lease next: its lowest ready id."""
    r = t.messages.where(F.col("fate") == READY)
    return r.groupBy("lane", "group_id").agg(F.min("msg_id").alias("msg_id"), F.min_by("enqueue_ms", "msg_id").alias("enqueue_ms"))


@op("ord_02", "SELECT msg_id, fate AS state, enqueue_ms FROM live WHERE lane = 'view' AND group_id = 'g2' ORDER BY msg_id LIMIT 3")
def peek(t: Tables, lane: str = "view", group: str = "g2", n: int = 3) -> DataFrame:
    n = n if 0 < n <= 200 else 200
    return t.live.where((F.col("lane") == lane) & (F.col("group_id") == group)).select("msg_id", F.col("fate").alias("state"), "enqueue_ms").orderBy("msg_id").limit(n)


def page(df: DataFrame, keys: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """Rows strictly after a key, in key order, at most size; last_page says whether more follow."""
    if after is not None:
        df = df.where(F.struct(*keys) > F.struct(*[F.lit(v).cast(df.schema[k].dataType) for k, v in zip(keys, after, strict=True)]))
    rows = df.orderBy(*keys).limit(size + 1)
    w = Window.orderBy(*keys)  # over one bounded page
    n = rows.withColumn("_n", F.row_number().over(w)).withColumn("last_page", F.max("_n").over(Window.partitionBy()) <= size)
    return n.where(F.col("_n") <= size).drop("_n")


@op(
    "ord_03",
    """SELECT lease_id, lane, (SELECT count(*) FROM leases WHERE lease_id > 40) <= 25 AS last_page FROM leases WHERE lease_id > 40 ORDER BY lease_id LIMIT 25""",
)
def lease_page(t: Tables) -> DataFrame:
    return page(t.leases.select("lease_id", "lane"), ["lease_id"], 25, (40,))


@op("ord_04", "SELECT n AS requested, CASE WHEN n = 0 OR n > 1000 THEN 100 ELSE n END AS size FROM (VALUES (0), (1), (100), (1000), (1001), (5000)) v(n)")
def page_sizes(t: Tables) -> DataFrame:
    """0 and sizes over 1000 reset to 100, they do not clamp."""
    n = F.col("requested")
    return t.values("requested int", [(0,), (1,), (100,), (1000,), (1001,), (5000,)]).select("requested", F.when((n == 0) | (n > 1000), 100).otherwise(n).alias("size"))


@op("ord_05", "SELECT deadline_ms AS due_ms, lease_id FROM leases WHERE deadline_ms <= 1706659200000 ORDER BY due_ms, lease_id LIMIT 256")
def timer_sweep(t: Tables, batch: int = 256) -> DataFrame:
    """One tick's due timers, oldest first."""
    return t.leases.where(F.col("deadline_ms") <= t.asof_ms).select(F.col("deadline_ms").alias("due_ms"), "lease_id").orderBy("due_ms", "lease_id").limit(batch)


@op("ord_06", "SELECT lane, group_id, CAST(row_number() OVER (ORDER BY length(lane), lane, length(group_id), group_id) AS BIGINT) AS pos FROM groups_t")
def group_order(t: Tables) -> DataFrame:
    """Position of each group in key order."""
    return ranged_row_number(t.groups.select("lane", "group_id"), [], by_key("lane", "group_id"), "pos")


@op("ord_07", "SELECT lane, group_id, dead_at_ms, msg_id, CAST(row_number() OVER (PARTITION BY lane, group_id ORDER BY dead_at_ms, msg_id) AS BIGINT) AS pos FROM dead_letters")
def dlq_order(t: Tables) -> DataFrame:
    d = t.dead_letters.select("original.lane", "original.group_id", "dead_at_ms", "original.msg_id")
    return ranged_row_number(d, ["lane", "group_id"], ["dead_at_ms", "msg_id"], "pos")


@op("ord_08", "SELECT lease_id, deadline_ms FROM leases ORDER BY deadline_ms, lease_id LIMIT 50")
def soonest_leases(t: Tables, n: int = 50) -> DataFrame:
    return t.leases.select("lease_id", "deadline_ms").orderBy("deadline_ms", "lease_id").limit(n)


@op("ord_09", "SELECT lane, group_id, CAST(row_number() OVER (PARTITION BY lane ORDER BY CASE WHEN ready + inflight > 0 THEN 0 ELSE 1 END, CAST(ready AS DOUBLE) / weight, group_id) AS BIGINT) AS pos FROM groups_t")
def fairness_grid(t: Tables) -> DataFrame:
    """Backlogged groups first, then by virtual time (here the time that draining the backlog would take)."""
    o = [F.when(F.col("ready") + F.col("inflight") > 0, 0).otherwise(1), F.col("ready").cast("double") / F.col("weight"), F.col("group_id")]
    return t.groups.select("lane", "group_id", F.row_number().over(Window.partitionBy("lane").orderBy(*o)).cast("long").alias("pos"))


@op(
    "ord_10",
    f"""SELECT lane, group_id, score, CASE WHEN score >= 0.66E0 THEN 'high' WHEN score >= 0.33E0 THEN 'medium' ELSE 'low' END AS band,
    CAST(row_number() OVER (PARTITION BY lane ORDER BY score DESC, group_id) AS BIGINT) AS pos FROM ({_SCORED})""",
)
def starvation_radar(t: Tables) -> DataFrame:
    band = F.when(F.col("score") >= 0.66, "high").when(F.col("score") >= 0.33, "medium").otherwise("low")
    return starvation(t).select("lane", "group_id", "score", band.alias("band"), F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("score"), "group_id")).cast("long").alias("pos"))


@op(
    "ord_11",
    f"""SELECT lane, group_id, NOT paused AND score >= 0.5E0 AND actual - expected < -0.02E0 AS starving, abs(actual - expected) <= 0.02E0 AS fair FROM ({_SCORED})""",
)
def starving_flags(t: Tables) -> DataFrame:
    drift = F.col("actual") - F.col("expected")
    return starvation(t).select("lane", "group_id", (~F.col("paused") & (F.col("score") >= 0.5) & (drift < -0.02)).alias("starving"), (F.abs(drift) <= 0.02).alias("fair"))


@op(
    "ord_12",
    """SELECT r.run_id, status, last_event_ms FROM runs r JOIN (SELECT run_id, max(event_time_ms) AS last_event_ms FROM history GROUP BY run_id) h ON h.run_id = r.run_id
    ORDER BY CASE WHEN status = 1 THEN 0 ELSE 1 END, last_event_ms DESC, r.run_id LIMIT 5""",
)
def recent_runs(t: Tables) -> DataFrame:
    last = t.history.groupBy("run_id").agg(F.max("event_time_ms").alias("last_event_ms"))
    rows = t.runs.join(last, "run_id").select("run_id", "status", "last_event_ms")
    return rows.orderBy(F.when(F.col("status") == 1, 0).otherwise(1), F.desc("last_event_ms"), "run_id").limit(5)


@op(
    "ord_13",
    f"""SELECT s.lane, coalesce(d.n, 0) * 1000 + inflight * 50 + ready * 10 + delayed * 5 + oldest // 1000 AS interest FROM
    (SELECT g.lane, CAST(sum(ready) AS BIGINT) AS ready, CAST(sum(delayed_n) AS BIGINT) AS delayed, CAST(sum(inflight) AS BIGINT) AS inflight, coalesce(max(oldest_age_ms), 0) AS oldest
     FROM groups_t g LEFT JOIN ({_OLDEST}) o ON o.lane = g.lane AND o.group_id = g.group_id GROUP BY g.lane) s
    LEFT JOIN (SELECT lane, CAST(count(*) AS BIGINT) AS n FROM dead_letters GROUP BY lane) d ON d.lane = s.lane ORDER BY interest DESC, s.lane LIMIT 32""",
)
def lane_interest(t: Tables) -> DataFrame:
    s = lane_stats(t).join(dlq_depth(t), "lane", "left")
    score = F.coalesce("depth", F.lit(0)) * 1000 + F.col("inflight") * 50 + F.col("ready") * 10 + F.col("delayed") * 5 + F.floor(F.col("oldest_age_ms") / 1000)
    return s.select("lane", score.alias("interest")).orderBy(F.desc("interest"), "lane").limit(32)


@op("ord_14", "SELECT name, CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS pos FROM principals_t")
def principal_order(t: Tables) -> DataFrame:
    return t.principals.select("name", F.row_number().over(Window.orderBy("name")).cast("long").alias("pos"))


@op("ord_15", "SELECT lane, group_id, 500 - ready AS deficit, CAST(row_number() OVER (PARTITION BY lane ORDER BY 500 - ready DESC, group_id) AS BIGINT) AS pos FROM groups_t WHERE ready < 500")
def refill_order(t: Tables, target: int = 500) -> DataFrame:
    d = (F.lit(target) - F.col("ready")).alias("deficit")
    return t.groups.where(F.col("ready") < target).select("lane", "group_id", d, F.row_number().over(Window.partitionBy("lane").orderBy((F.lit(target) - F.col("ready")).desc(), "group_id")).cast("long").alias("pos"))


# ---------------------------------------------------------------- sets
@op("set_01", "SELECT lease_id, lane FROM leases WHERE lease_id <= 60")
def pages_union(t: Tables, size: int = 20, pages: int = 3) -> DataFrame:
    """Pages follow one another without overlap or gap; their union is the scan's head."""
    rows, out, after = t.leases.select("lease_id", "lane"), [], None
    for _ in range(pages):
        out.append(page(rows, ["lease_id"], size, after).drop("last_page"))
        last = out[-1].agg(F.max("lease_id")).first()[0]  # the page's token: its last key
        if last is None:
            break
        after = (last,)
    return reduce(DataFrame.unionByName, out)


op("set_02", _FINDINGS)(findings)


@op("set_04", "SELECT coalesce(p.lane, s.lane) AS lane, CAST(coalesce(p.n, 0) AS BIGINT) AS published, CAST(coalesce(s.n, 0) AS BIGINT) AS served FROM (SELECT lane, count(*) AS n FROM messages WHERE lane <> 'view' GROUP BY lane) p FULL JOIN (SELECT lane, count(*) AS n FROM served WHERE lane <> 'error' GROUP BY lane) s ON s.lane = p.lane")
def lanes_seen(t: Tables) -> DataFrame:
    """Lanes seen by either counter, with zero where one has not seen them."""
    p = t.fates.where("lane <> 'view'").groupBy("lane").agg(F.count(F.lit(1)).alias("p"))
    s = t.served.where("lane <> 'error'").groupBy("lane").agg(F.count(F.lit(1)).alias("s"))
    return p.join(s, "lane", "full").select("lane", F.coalesce("p", F.lit(0)).alias("published"), F.coalesce("s", F.lit(0)).alias("served"))
