"""Sequences, running values, averages and bounded tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.fairness import _SCORED, RIBBON, ring, starvation
from tidemark.registry import op
from tidemark.sources.views import Tables


@op("win_01", "SELECT lane, group_id, CAST(count(*) AS BIGINT) AS n, min(msg_id) AS lo, max(msg_id) AS hi FROM messages GROUP BY lane, group_id")
def sequence_ids(t: Tables) -> DataFrame:
    """Sequence ids of each group run from 1 without a gap."""
    return t.messages.groupBy("lane", "group_id").agg(F.count(F.lit(1)).alias("n"), F.min("msg_id").alias("lo"), F.max("msg_id").alias("hi"))


@op("win_02", "SELECT lease_id, event_id FROM leases")
def lease_ids(t: Tables) -> DataFrame:
    return t.leases.select("lease_id", "event_id")


@op("win_03", "SELECT run_id, max(event_id) AS last_event_id, CAST(count(*) AS BIGINT) AS events, max(event_id) = count(*) AS gap_free FROM history GROUP BY run_id")
def event_ids(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return t.history.groupBy("run_id").agg(F.max("event_id").alias("last_event_id"), n.alias("events"), (F.max("event_id") == n).alias("gap_free"))


_K = """SELECT m.lane, m.group_id, m.msg_id, weight, CAST(row_number() OVER (PARTITION BY m.lane, m.group_id ORDER BY msg_id) AS BIGINT) AS k, CAST(count(*) OVER (PARTITION BY m.lane, m.group_id) AS BIGINT) AS n
    FROM messages m JOIN groups_t g ON g.lane = m.lane AND g.group_id = m.group_id WHERE fate = 1 AND NOT paused"""


def virtual_time(t: Tables) -> DataFrame:
    """Virtual time of each group before each serve: a running sum of costs, added one by one."""
    from tidemark.plans.scheduling import ready_ranked

    w = Window.partitionBy("lane", "group_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return ready_ranked(t).withColumn("vt", F.coalesce(F.sum(1 / F.col("weight")).over(w), F.lit(0.0)))


@op("win_04", f"SELECT lane, group_id, msg_id, CAST(k - 1 AS DOUBLE) / weight AS vt FROM ({_K})")
def running_virtual_time(t: Tables) -> DataFrame:
    return virtual_time(t).select("lane", "group_id", "msg_id", "vt")


@op("win_05", "SELECT lane, group_id FROM (SELECT lane, group_id, row_number() OVER (PARTITION BY lane ORDER BY ready DESC, group_id) AS r FROM groups_t WHERE ready > 0 AND NOT paused) WHERE r = 1")
def arg_max_pick(t: Tables) -> DataFrame:
    """The group of highest score in each lane, ties to the smallest id, by a combinable aggregate."""
    g = t.groups.where("ready > 0 AND NOT paused")
    return g.groupBy("lane").agg(F.min_by("group_id", F.struct(-F.col("ready"), "group_id")).alias("group_id"))


@op("win_06", "SELECT lane, group_id, max(ready / weight) OVER (PARTITION BY lane) - ready / weight AS deficit FROM (SELECT lane, group_id, CAST(ready AS DOUBLE) AS ready, weight FROM groups_t)")
def deficits(t: Tables) -> DataFrame:
    vt = F.col("ready").cast("double") / F.col("weight")
    return t.groups.select("lane", "group_id", (F.max(vt).over(Window.partitionBy("lane")) - vt).alias("deficit"))


@op(
    "win_07",
    """SELECT lane, string_agg(group_id, ',' ORDER BY seq) AS ribbon FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY seq DESC) AS r FROM served
    WHERE seq > (SELECT max(seq) FROM served) - 512) WHERE r <= 200 GROUP BY lane""",
)
def ribbon(t: Tables) -> DataFrame:
    """Served group ids of each lane, oldest first, the last 200 inside the ring of 512."""
    tail = ring(t).withColumn("r", F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("seq")))).where(F.col("r") <= RIBBON)
    return tail.groupBy("lane").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "group_id"))), lambda x: x["group_id"]), ",").alias("ribbon"))


def fold(values: Column, first: Column, step) -> Column:
    return F.aggregate(values, first, step)


def series(t: Tables) -> DataFrame:
    """One row per lane with its hourly counts in order, as doubles; lanes and hours are few."""
    s = t.samples.groupBy("lane").agg(F.array_sort(F.collect_list(F.struct("tick", "n"))).alias("x"))
    return s.select("lane", F.transform("x", lambda v: v["n"].cast("double")).alias("x"))


_SERIES = "SELECT lane, list(CAST(n AS DOUBLE) ORDER BY tick) AS x FROM samples GROUP BY lane"


@op("win_08", f"SELECT lane, list_reduce(x, lambda a, b: 0.45E0 * b + 0.55E0 * a, 0.0E0) AS ewma FROM ({_SERIES})")
def ewma(t: Tables) -> DataFrame:
    return series(t).select("lane", fold(F.col("x"), F.lit(0.0), lambda a, b: 0.45 * b + 0.55 * a).alias("ewma"))


@op("win_09", f"SELECT lane, list_reduce(x[2:], lambda a, b: 0.6E0 * a + 0.4E0 * b, x[1]) AS ewma FROM ({_SERIES})")
def seeded_ewma(t: Tables) -> DataFrame:
    """The first sample starts the average."""
    return series(t).select("lane", fold(F.slice("x", 2, F.size("x")), F.col("x")[0], lambda a, b: 0.6 * a + 0.4 * b).alias("ewma"))


@op("win_10", "SELECT lane, tick, CAST(total - lag(total, 1, 0) OVER (PARTITION BY lane ORDER BY tick) AS DOUBLE) / 3600.0E0 AS per_second FROM (SELECT lane, tick, CAST(sum(n) OVER (PARTITION BY lane ORDER BY tick) AS BIGINT) AS total FROM samples)")
def counter_deltas(t: Tables) -> DataFrame:
    w = Window.partitionBy("lane").orderBy("tick")
    s = t.samples.withColumn("total", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.select("lane", "tick", ((F.col("total") - F.lag("total", 1, 0).over(w)).cast("double") / 3600.0).alias("per_second"))


@op(
    "win_11",
    """SELECT lane, tick, greatest(0.06E0, n / greatest(0.0001E0, max(n) OVER (PARTITION BY lane))) AS bar FROM
    (SELECT lane, tick, CAST(n AS DOUBLE) AS n, row_number() OVER (PARTITION BY lane ORDER BY tick DESC) AS r FROM samples) WHERE r <= 28""",
)
def sparkline(t: Tables, points: int = 28) -> DataFrame:
    """Bars of the last samples, relative to their peak; hours are never missing, so no padding is due."""
    last = t.samples.groupBy("lane").agg(F.max("tick").alias("hi"))
    s = t.samples.join(F.broadcast(last), "lane").where(F.col("tick") > F.col("hi") - points).withColumn("n", F.col("n").cast("double"))
    peak = F.greatest(F.lit(0.0001), F.max("n").over(Window.partitionBy("lane")))
    return s.select("lane", "tick", F.greatest(F.lit(0.06), F.col("n") / peak).alias("bar"))


@op("win_12", f"SELECT lane, abs(sum(expected) - 1) < 1e-9 AND abs(sum(actual) - 1) < 1e-9 AS shares_sum_to_one, CAST(CASE WHEN max(score) = 1 THEN 1 ELSE 0 END AS BIGINT) AS top_scores FROM ({_SCORED}) GROUP BY lane")
def normalised(t: Tables) -> DataFrame:
    """Expected and actual shares sum to 1 in each lane, and its largest score is 1."""
    one = lambda c: F.abs(F.sum(c) - 1) < 1e-9
    s = starvation(t).groupBy("lane").agg((one("expected") & one("actual")).alias("shares_sum_to_one"), F.max("score").alias("top"))
    return s.select("lane", "shares_sum_to_one", F.when(F.col("top") == 1, 1).otherwise(0).cast("long").alias("top_scores"))


_LOG = "SELECT lane, group_id, msg_id % 50 AS m, event_id, CASE event_id % 4 WHEN 0 THEN 'lease' WHEN 1 THEN 'retry' WHEN 2 THEN 'extend' ELSE 'requeue' END AS cmd FROM messages"


@op(
    "win_13",
    f"""SELECT lane, group_id, m, event_id, CAST(count(*) FILTER (WHERE cmd = 'retry') OVER w AS BIGINT) AS attempt, CAST(count(*) OVER w AS BIGINT) AS epoch FROM ({_LOG})
    WINDOW w AS (PARTITION BY lane, group_id, m ORDER BY event_id)""",
)
def attempts_and_epochs(t: Tables) -> DataFrame:
    """Attempt and epoch of a message after each command: retries count one, each command bumps the other."""
    cmd = F.element_at(F.array(*map(F.lit, ("lease", "retry", "extend", "requeue"))), (F.col("event_id") % 4).cast("int") + 1)
    log = t.messages.select("lane", "group_id", (F.col("msg_id") % 50).alias("m"), "event_id", cmd.alias("cmd"))
    w = Window.partitionBy("lane", "group_id", "m").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return log.select("lane", "group_id", "m", "event_id", F.count_if(F.col("cmd") == "retry").over(w).alias("attempt"), F.count(F.lit(1)).over(w).alias("epoch"))


@op("win_14", "SELECT lane, dedup_key, min(event_id) AS event_id FROM messages GROUP BY lane, dedup_key")
def first_wins(t: Tables) -> DataFrame:
    return t.fates.groupBy("lane", "dedup_key").agg(F.min("event_id").alias("event_id"))


@op("win_15", "SELECT seq, lane, group_id FROM served WHERE seq > (SELECT max(seq) FROM served) - 40")
def recent_feed(t: Tables, n: int = 40) -> DataFrame:
    return ring(t, n).select("seq", "lane", "group_id")
