"""Domain tables over the driver's tables: messages, groups, leases, runs, histories and more.

The Spark form is Tables; CTES has the same definitions in SQL for the oracle. ASOF_MS stands for the
clock everywhere. Instants are long milliseconds.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.sequence import bucketed_counts, by_cuts, cut_points, grouped_row_number, keyed_row_number

ASOF_MS = 1706659200000
READY, DELAYED, LEASED, DEAD, ACKED = 1, 2, 3, 4, 5
REASONS = ("max_attempts", "terminal_nack", "max_lease_lifetime", "ttl")


def ms(col: str | Column) -> Column:
    return F.unix_millis(F.col(col).cast("timestamp") if isinstance(col, str) else col.cast("timestamp"))


class Tables:
    """Lazily built views of one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, asof_ms: int = ASOF_MS):
        self.spark, self.sf_dir, self.asof_ms = spark, sf_dir, asof_ms

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def values(self, schema: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def event_cuts(self) -> list[float]:
        """Quantiles of the event ids, for numbering; one narrow scan."""
        return cut_points(self.events, "event_id")

    @cached_property
    def fates(self) -> DataFrame:
        """One row per published message, before numbering; fate says what became of it."""
        e, at = F.col("event_id"), ms("ts")
        r = e % 10
        return self.events.select(
            F.col("event_type").alias("lane"),
            F.concat(F.lit("g"), (F.col("user_id") % 8).cast("string")).alias("group_id"),
            "event_id",
            at.alias("enqueue_ms"),
            F.when(e % 7 == 0, at + 3600000).otherwise(F.lit(0)).cast("long").alias("not_before_ms"),
            F.when(e % 11 == 0, 7200000).otherwise(0).cast("long").alias("ttl_ms"),
            F.when(e % 5 == 0, 1).otherwise(0).cast("long").alias("max_attempts"),
            F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), (e % 3).cast("string")).alias("dedup_key"),
            F.when(r < 5, READY).when(r == 5, DELAYED).when(r < 8, LEASED).when(r == 8, ACKED).otherwise(DEAD).cast("long").alias("fate"),
        )

    @cached_property
    def numbered(self) -> DataFrame:
        """fates with msg_id, and ready_no: how many of the group's messages up to this one are ready."""
        cut = by_cuts(self.fates, "event_id", self.event_cuts)
        return bucketed_counts(cut, ["lane", "group_id"], ["event_id"], {"msg_id": None, "ready_no": F.col("fate") == READY})

    @cached_property
    def messages(self) -> DataFrame:
        """One row per published message, numbered inside its group."""
        return self.numbered.drop("ready_no")

    @cached_property
    def live(self) -> DataFrame:
        """Messages that still have a row: ready, delayed or leased."""
        return self.messages.where(F.col("fate") <= LEASED)

    @cached_property
    def groups(self) -> DataFrame:
        """One row per group, with counters recomputed from its messages; weights are powers of two, so that virtual time
        (what has been served, by weight) is exact."""
        n = lambda k: F.count_if(F.col("fate") == k)
        out = self.fates.groupBy("lane", "group_id").agg(
            n(READY).alias("ready"),
            n(DELAYED).alias("delayed_n"),
            n(LEASED).alias("inflight"),
            F.count_if(F.col("fate").isin(LEASED, ACKED)).alias("_served"),
            (F.count(F.lit(1)) + 1).alias("next_seq"),  # ids have no gaps
            F.max("enqueue_ms").alias("last_activity_ms"),
        )
        weight = F.when(F.col("group_id").isin("g0", "g4"), 1.0).when(F.col("group_id").isin("g1", "g5"), 2.0)
        weight = weight.when(F.col("group_id").isin("g2", "g6"), 4.0).otherwise(8.0)
        out = out.withColumn("weight", weight).withColumn("virtual_time", F.col("_served").cast("double") / F.col("weight")).drop("_served")
        return out.withColumn("paused", (F.col("group_id") == "g6") & (F.col("lane") == "error"))

    @cached_property
    def leases(self) -> DataFrame:
        """Leased messages; deadlines lie within 10 s of the as-of instant."""
        e = F.col("event_id")
        rows = self.messages.where(F.col("fate") == LEASED).select(
            "lane",
            "group_id",
            "msg_id",
            "event_id",
            F.concat(F.lit("c"), (e % 4).cast("string")).alias("consumer_id"),
            (F.lit(ASOF_MS) + (e % 21 - 10) * 1000).alias("deadline_ms"),
            F.lit(30000).cast("long").alias("visibility_ms"),
            (e % 3).alias("attempt_at_lease"),
            (e % 4).alias("extend_count"),
        )
        out = keyed_row_number(rows, [], "event_id", "lease_id", self.event_cuts)
        token = F.when(F.col("lease_id") % 4 == 0, F.sha2(F.concat(F.lit("tok"), F.col("lease_id").cast("string")), 256)).otherwise("")
        return out.withColumn("token_hash", token)

    @cached_property
    def grants(self) -> DataFrame:
        """Every lease a leased message has had: one per attempt. grant_id rises with the attempt, and cur_lease is
        the message's present one, so that all others are stale."""
        rows = self.leases.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "attempt_at_lease")).alias("attempt"))
        rows = rows.withColumn("grant_id", 4 * F.col("lease_id") + F.col("attempt"))
        return rows.withColumn("cur_lease", F.max("grant_id").over(Window.partitionBy("lane", "group_id", "msg_id")))

    @cached_property
    def lease_timers(self) -> DataFrame:
        """The deadline timers of leases: one is set at the grant and at each extend, with the message's epoch then."""
        rows = self.leases.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "extend_count")).alias("epoch"))
        return rows.withColumn("due_ms", F.col("deadline_ms") - 1000 * (F.col("extend_count") - F.col("epoch")))

    @cached_property
    def dead_letters(self) -> DataFrame:
        reason = F.element_at(F.array(*map(F.lit, REASONS)), (F.col("event_id") % 4).cast("int") + 1)
        return self.messages.where(F.col("fate") == DEAD).select(
            F.struct("lane", "group_id", "msg_id", "event_id", "enqueue_ms", "max_attempts").alias("original"),
            (F.col("enqueue_ms") + 60000 * (1 + F.col("event_id") % 3)).alias("dead_at_ms"),
            reason.alias("reason"),
        )

    @cached_property
    def served(self) -> DataFrame:
        """Delivered messages in delivery order: seq, lane, group_id, served_ms."""
        rows = self.messages.where(F.col("fate").isin(LEASED, ACKED)).select("event_id", "lane", "group_id", "msg_id", F.col("enqueue_ms").alias("served_ms"))
        return keyed_row_number(rows, [], "event_id", "seq", self.event_cuts)

    @cached_property
    def orders(self) -> DataFrame:
        return self.read("orders")

    @cached_property
    def runs(self) -> DataFrame:
        k, s = F.col("o_orderkey"), F.col("o_orderstatus")
        return self.orders.select(
            k.alias("run_id"),
            F.concat(F.lit("wf"), F.substring("o_orderpriority", 1, 1)).alias("workflow_type"),
            F.concat(F.lit("c"), (F.col("o_custkey") % 16).cast("string")).alias("tenant_id"),
            F.when(s == "F", 2).when(s == "P", 3).otherwise(1).cast("long").alias("status"),
            ms("o_orderdate").alias("started_ms"),
            F.when(k % 5 != 0, k - 1).alias("parent_run_id"),
            (k % 7 == 0).alias("wf_task_pending"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        ordered = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus"]
        rows = grouped_row_number(self.read("lineitem"), ["l_orderkey"], ordered, "ln")
        return rows.select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "ln")

    @cached_property
    def history(self) -> DataFrame:
        """Event histories of runs: 1 started, 4 scheduled, 5 / 6 completed / failed, 10 / 11 run completed / failed."""
        o = self.orders.select(F.col("o_orderkey").alias("run_id"), ms("o_orderdate").alias("t"), "o_orderstatus")
        j = self.lines.join(o, F.col("l_orderkey") == F.col("run_id"))
        pick = lambda df, at, ord_, ln, ty: df.select("run_id", at.alias("ms"), F.lit(ord_).alias("ord"), ln.cast("long").alias("ln"), ty.cast("long").alias("ty"))
        t, ln = F.col("t"), F.col("ln")
        parts = [
            pick(o, t, 0, F.lit(0), F.lit(1)),
            pick(j, t + 1000 * ln, 1, ln, F.lit(4)),
            pick(j.where("l_linestatus = 'F'"), t + 1000 * ln + 1 + 1000 * (F.col("l_partkey") % 600), 2, ln, F.when(F.col("l_returnflag") == "R", 6).otherwise(5)),
            pick(o.where("o_orderstatus <> 'O'"), t + 7200000, 3, F.lit(0), F.when(F.col("o_orderstatus") == "F", 10).otherwise(11)),
        ]
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        out = grouped_row_number(every, ["run_id"], ["ms", "ord", "ln"], "event_id")
        return out.select("run_id", "event_id", F.col("ty").alias("event_type"), F.col("ms").alias("event_time_ms"), F.col("ln").alias("activity_no"))

    @cached_property
    def samples(self) -> DataFrame:
        """Hourly counters: lane, tick (hours from the first), n (events in the hour, 0 where none), total so far."""
        hours = self.events.select(F.col("event_type").alias("lane"), F.floor(ms("ts") / 3600000).alias("h")).groupBy("lane", "h").count()
        span = hours.agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
        grid = span.select("lo", F.explode(F.sequence("lo", "hi")).alias("h")).join(F.broadcast(hours.select("lane").distinct()))
        filled = grid.join(hours, ["lane", "h"], "left").select("lane", (F.col("h") - F.col("lo")).alias("tick"), F.coalesce("count", F.lit(0)).cast("long").alias("n"))
        return filled

    @cached_property
    def principals(self) -> DataFrame:
        """Principals with tags and grants; actions: 1 read, 2 publish, 3 consume, 4 admin."""
        grant = "struct<lane_pattern:string,group_pattern:string,actions:array<int>>"
        return self.values(f"name string, disabled boolean, tags array<string>, grants array<{grant}>", PRINCIPALS)

    @cached_property
    def checks(self) -> DataFrame:
        return self.values("call string, action int, lane string, group_id string", CHECKS)


PRINCIPALS = [
    ("ada", False, ["administrator"], []),
    ("bob", False, [], [("view|click", "g[0-3]", [1, 3])]),
    ("cyd", False, ["dashboard"], []),
    ("dee", True, ["administrator"], []),
    ("eve", False, [], [("^sign", ".*", [2]), ("error", "^g1$", [4])]),
    ("fay", False, ["monitoring", "ops"], [("purchase", ".*", [3])]),
]
CHECKS = [
    ("peek", 1, "view", "g1"),
    ("publish", 2, "signup", "g5"),
    ("work", 3, "click", "g2"),
    ("work", 3, "purchase", "g7"),
    ("pause", 4, "error", "g1"),
    ("pause", 4, "error", "g12"),
    ("batch", 2, "signup", "g1"),
    ("batch", 2, "view", "g1"),
]

_M = "epoch_us({}) // 1000"
CTES: dict[str, str] = {
    "messages": """SELECT event_type AS lane, concat('g', CAST(user_id % 8 AS VARCHAR)) AS group_id,
        CAST(row_number() OVER (PARTITION BY event_type, user_id % 8 ORDER BY event_id) AS BIGINT) AS msg_id, event_id,
        epoch_us(ts) // 1000 AS enqueue_ms,
        CAST(CASE WHEN event_id % 7 = 0 THEN epoch_us(ts) // 1000 + 3600000 ELSE 0 END AS BIGINT) AS not_before_ms,
        CAST(CASE WHEN event_id % 11 = 0 THEN 7200000 ELSE 0 END AS BIGINT) AS ttl_ms,
        CAST(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS max_attempts,
        concat('u', CAST(user_id AS VARCHAR), '-', CAST(event_id % 3 AS VARCHAR)) AS dedup_key,
        CAST(CASE WHEN event_id % 10 < 5 THEN 1 WHEN event_id % 10 = 5 THEN 2 WHEN event_id % 10 < 8 THEN 3
             WHEN event_id % 10 = 8 THEN 5 ELSE 4 END AS BIGINT) AS fate FROM events""",
    "live": "SELECT * FROM messages WHERE fate <= 3",
    "groups_t": """SELECT *, CAST(served_n AS DOUBLE) / weight AS virtual_time FROM (SELECT lane, group_id, CASE group_id WHEN 'g0' THEN 1.0E0 WHEN 'g1' THEN 2.0E0 WHEN 'g2' THEN 4.0E0 WHEN 'g3' THEN 8.0E0
        WHEN 'g4' THEN 1.0E0 WHEN 'g5' THEN 2.0E0 WHEN 'g6' THEN 4.0E0 ELSE 8.0E0 END AS weight,
        (group_id = 'g6' AND lane = 'error') AS paused, CAST(count(*) FILTER (WHERE fate = 1) AS BIGINT) AS ready,
        CAST(count(*) FILTER (WHERE fate = 2) AS BIGINT) AS delayed_n, CAST(count(*) FILTER (WHERE fate = 3) AS BIGINT) AS inflight,
        count(*) FILTER (WHERE fate IN (3, 5)) AS served_n, max(msg_id) + 1 AS next_seq, max(enqueue_ms) AS last_activity_ms FROM messages GROUP BY lane, group_id)""",
    "lease0": """SELECT CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS lease_id, lane, group_id, msg_id, event_id,
        concat('c', CAST(event_id % 4 AS VARCHAR)) AS consumer_id, 1706659200000 + (event_id % 21 - 10) * 1000 AS deadline_ms,
        CAST(30000 AS BIGINT) AS visibility_ms, event_id % 3 AS attempt_at_lease, event_id % 4 AS extend_count FROM messages WHERE fate = 3""",
    "leases": "SELECT *, CASE WHEN lease_id % 4 = 0 THEN sha256(concat('tok', CAST(lease_id AS VARCHAR))) ELSE '' END AS token_hash FROM lease0",
    "grants": """SELECT l.*, a.attempt, 4 * lease_id + a.attempt AS grant_id, max(4 * lease_id + a.attempt) OVER (PARTITION BY lane, group_id, msg_id) AS cur_lease
        FROM leases l JOIN (SELECT CAST(unnest(range(0, 3)) AS BIGINT) AS attempt) a ON a.attempt <= l.attempt_at_lease""",
    "lease_timers": """SELECT l.*, e.epoch, deadline_ms - 1000 * (extend_count - e.epoch) AS due_ms
        FROM leases l JOIN (SELECT CAST(unnest(range(0, 4)) AS BIGINT) AS epoch) e ON e.epoch <= l.extend_count""",
    "dead_letters": """SELECT lane, group_id, msg_id, event_id, enqueue_ms, max_attempts, enqueue_ms + 60000 * (1 + event_id % 3) AS dead_at_ms,
        CASE event_id % 4 WHEN 0 THEN 'max_attempts' WHEN 1 THEN 'terminal_nack' WHEN 2 THEN 'max_lease_lifetime' ELSE 'ttl' END AS reason
        FROM messages WHERE fate = 4""",
    "served": """SELECT CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS seq, event_id, lane, group_id, msg_id, enqueue_ms AS served_ms
        FROM messages WHERE fate IN (3, 5)""",
    "runs": """SELECT o_orderkey AS run_id, concat('wf', substring(o_orderpriority, 1, 1)) AS workflow_type,
        concat('c', CAST(o_custkey % 16 AS VARCHAR)) AS tenant_id,
        CAST(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 3 ELSE 1 END AS BIGINT) AS status, epoch_us(o_orderdate) // 1000 AS started_ms,
        CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey - 1 END AS parent_run_id, o_orderkey % 7 = 0 AS wf_task_pending FROM orders""",
    "lines_t": """SELECT l_orderkey, l_partkey, l_returnflag, l_linestatus, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
        l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag, l_linestatus) AS BIGINT) AS ln FROM lineitem""",
    "history": """SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ms, ord, ln) AS BIGINT) AS event_id,
        CAST(ty AS BIGINT) AS event_type, ms AS event_time_ms, ln AS activity_no FROM (
        SELECT o_orderkey AS run_id, epoch_us(o_orderdate) // 1000 AS ms, 0 AS ord, CAST(0 AS BIGINT) AS ln, 1 AS ty FROM orders
        UNION ALL SELECT l_orderkey, epoch_us(o_orderdate) // 1000 + 1000 * ln, 1, ln, 4 FROM lines_t JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT l_orderkey, epoch_us(o_orderdate) // 1000 + 1000 * ln + 1 + 1000 * (l_partkey % 600), 2, ln,
            CASE WHEN l_returnflag = 'R' THEN 6 ELSE 5 END FROM lines_t JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F'
        UNION ALL SELECT o_orderkey, epoch_us(o_orderdate) // 1000 + 7200000, 3, CAST(0 AS BIGINT),
            CASE o_orderstatus WHEN 'F' THEN 10 ELSE 11 END FROM orders WHERE o_orderstatus <> 'O')""",
    "hourly": "SELECT event_type AS lane, (epoch_us(ts) // 1000) // 3600000 AS h, count(*) AS c FROM events GROUP BY 1, 2",
    "samples": """SELECT l.lane, g.h - s.lo AS tick, CAST(coalesce(c, 0) AS BIGINT) AS n FROM (SELECT min(h) AS lo, max(h) AS hi FROM hourly) s,
        (SELECT DISTINCT lane FROM hourly) l, (SELECT unnest(range((SELECT min(h) FROM hourly), (SELECT max(h) + 1 FROM hourly))) AS h) g
        LEFT JOIN hourly q ON q.h = g.h AND q.lane = l.lane""",
    "grants_t": """SELECT * FROM (VALUES ('bob', 'view|click', 'g[0-3]', [1, 3]), ('eve', '^sign', '.*', [2]), ('eve', 'error', '^g1$', [4]),
        ('fay', 'purchase', '.*', [3])) v(name, lane_pattern, group_pattern, actions)""",
    "principals_t": """SELECT * FROM (VALUES ('ada', FALSE, ['administrator']), ('bob', FALSE, CAST([] AS VARCHAR[])), ('cyd', FALSE, ['dashboard']),
        ('dee', TRUE, ['administrator']), ('eve', FALSE, CAST([] AS VARCHAR[])), ('fay', FALSE, ['monitoring', 'ops'])) v(name, disabled, tags)""",
    "checks_t": """SELECT * FROM (VALUES ('peek', 1, 'view', 'g1'), ('publish', 2, 'signup', 'g5'), ('work', 3, 'click', 'g2'), ('work', 3, 'purchase', 'g7'),
        ('pause', 4, 'error', 'g1'), ('pause', 4, 'error', 'g12'), ('batch', 2, 'signup', 'g1'), ('batch', 2, 'view', 'g1')) v(call, action, lane, group_id)""",
}
