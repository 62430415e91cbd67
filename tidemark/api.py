"""A facade: the questions an operator of a work queue asks, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.control import Control
from tidemark.operators import fairness, history, joins, scans
from tidemark.plans import scheduling
from tidemark.registry import RAW, op
from tidemark.sources.views import Tables
from tidemark.worker import DeadLetter, Requeue, Worker


class Broker:
    """Read-only views of one input folder, and drains under a policy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.tables = Tables(spark, sf_dir)

    def publish(self) -> DataFrame:
        return scans.publish(self.tables)

    def drain(self, policy: str = "wfq", turns: int | None = None) -> DataFrame:
        """Served order of every lane under a named policy or a score expression."""
        return scheduling.plan(self.tables, policy, turns)

    def stats(self, lane: str | None = None) -> DataFrame:
        out = fairness.lane_stats(self.tables)
        return out if lane is None else out.where(F.col("lane") == lane)

    def fairness(self, lane: str) -> DataFrame:
        cols = ("lane", "group_id", "weight", "served", "expected", "actual", "score")
        return fairness.starvation(self.tables).where(F.col("lane") == lane).select(*cols)

    def groups(self, lane: str) -> DataFrame:
        return scans.group_stats(self.tables).where(F.col("lane") == lane)

    def leases(self, lane: str | None = None) -> DataFrame:
        out = scans.lease_info(self.tables)
        return out if lane is None else out.where(F.col("lane") == lane)

    def messages(self, lane: str, group_id: str) -> DataFrame:
        """A group's live messages."""
        m = self.tables.live.where((F.col("lane") == lane) & (F.col("group_id") == group_id))
        return m.select("msg_id", F.col("fate").alias("state"), "enqueue_ms")

    def dead_letters(self, lane: str | None = None) -> DataFrame:
        out = scans.dead_letter_info(self.tables)
        return out if lane is None else out.where(F.col("lane") == lane)

    def doctor(self) -> DataFrame:
        return fairness.findings(self.tables)

    def workflow(self, run_id: int) -> DataFrame:
        return history.run_history(self.tables, run_id)

    def workflows(self, status: str | None = None) -> DataFrame:
        return scans.runs_by_status(self.tables, status)

    def timeline(self) -> DataFrame:
        return history.timelines(self.tables)

    def authorize(self) -> DataFrame:
        return joins.authorized_calls(self.tables)


ROUTES = {
    "/api/lanes/{lane}/fairness": lambda b, lane: b.fairness(lane),
    "/api/lanes/{lane}/groups": lambda b, lane: b.groups(lane),
    "/api/lanes/{lane}/stats": lambda b, lane: b.stats(lane),
    "/api/lanes/{lane}/dlq": lambda b, lane: b.dead_letters(lane),
    "/api/lanes/{lane}/leases": lambda b, lane: b.leases(lane),
}


def get(broker: Broker, path: str) -> DataFrame:
    """A route's rows; the lane may hold slashes, so the path is matched from the right."""
    for route, f in ROUTES.items():
        head, tail = route.split("{lane}")
        if path.startswith(head) and path.endswith(tail) and len(path) > len(head) + len(tail):
            return f(broker, path[len(head) : len(path) - len(tail)])
    raise KeyError(path)


_G = "SELECT lane, group_id, ready, delayed_n AS delayed, inflight, ready + delayed_n + inflight AS total, weight, paused, next_seq, last_activity_ms, virtual_time FROM groups_t WHERE lane = 'view'"

_LIVE = "(SELECT count(*) FROM messages WHERE {0})"
_DROPPED = "NOT (lane = 'view' AND group_id = 'g1' AND fate IN (1, 2)) AND group_id <> 'g5'"
_SESSION = [
    ("cancel_group", "affected", _LIVE.format("lane = 'view' AND group_id = 'g1' AND fate IN (1, 2)")),
    ("cancel_group", "total_after", _LIVE.format("lane = 'view' AND group_id = 'g1' AND fate = 3")),
    ("purge_group", "affected", "0"),
    ("teardown_group", "lanes", "(SELECT count(DISTINCT lane) FROM live WHERE group_id = 'g5')"),
    ("teardown_group", "total", _LIVE.format("group_id = 'g5' AND fate <= 3")),
    ("reap_group", "total_after", "0"),
    ("set_group_config", "weight", "1"),
    ("get_group_config", "weight", "(SELECT weight FROM groups_t WHERE lane = 'click' AND group_id = 'g3')"),
    ("pause_group", "paused", "1"),
    ("resume_group", "paused", "0"),
    ("set_lane_config", "burst", "5"),
    ("pause_lane", "until_ms", "1706659230000"),
    ("resume_lane", "paused", "0"),
    ("validate_policy", "valid", "0"),
    ("set_policy", "version", "2"),
    ("get_policy", "version", "2"),
    ("schedule_cron", "next_fire_ms", "1706660100000"),
    ("pause_cron", "paused", "1"),
    ("list_cron", "rows", "1"),
    ("delete_cron", "existed", "1"),
    ("acquire_singleton", "fence", "1"),
    ("renew_singleton", "ok", "1"),
    ("release_singleton", "ok", "1"),
    ("complete_by_token", "lease_id", "(SELECT min(lease_id) FROM leases WHERE token_hash = sha256('tok4'))"),
    ("complete_by_token", "again", "(SELECT min(lease_id) FROM leases WHERE token_hash = '-')"),
    ("get_stats", "ready", _LIVE.format(f"fate = 1 AND {_DROPPED}")),
    ("get_stats", "inflight", _LIVE.format(f"fate = 3 AND {_DROPPED}")),
    ("describe_cluster", "answers", "1"),
    ("health", "serving", "1"),
]


@op("api_01", " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS step, '{m}' AS method, '{k}' AS answer, CAST({v} AS BIGINT) AS n" for i, (m, k, v) in enumerate(_SESSION, 1)))
def control_session(t: Tables) -> DataFrame:
    """Every method of the control client, called in one session, with a number from each answer."""
    c = Control(t.spark, t.sf_dir)
    cancelled, purged, torn = c.cancel_group("view", "g1"), c.purge_group("view", "g1"), c.teardown_group("g5")
    policy = [c.validate_policy("view", "backlog +"), c.set_policy("view", "-virtual_time"), c.set_policy("view", "weight * 2.0E0"), c.get_policy("view")]
    cron = [c.schedule_cron("nightly", "view", "g1", "*/15 * * * *"), c.pause_cron("nightly"), c.list_cron("view").count(), c.delete_cron("nightly")]
    lock = c.acquire_singleton("leader", "a", 30.0)
    lock = [lock, c.renew_singleton("leader", "a", lock["fence"], 30.0), c.release_singleton("leader", "a", lock["fence"])]
    tokens, stats = [c.complete_by_token("tok4"), c.complete_by_token("tok4")], c.get_stats().agg(F.sum("ready"), F.sum("inflight")).first()
    answers = [
        cancelled["affected"], cancelled["total_after"], purged["affected"], len(torn["lanes"]), torn["total"], c.reap_group("view", "g5")["total_after"],
        c.set_group_config("click", "g3", weight=0, batch_size=4)["weight"], Control(t.spark, t.sf_dir).get_group_config("click", "g3")["weight"], c.pause_group("click", "g3")["paused"],
        c.resume_group("click", "g3")["paused"], c.set_lane_config("click", 2.0, 5)["burst"], c.pause_lane("click", 30.0)["until_ms"], c.resume_lane("click")["paused"], policy[0]["valid"],
        policy[2]["version"], policy[3]["version"], cron[0]["next_fire_ms"], cron[1]["paused"], cron[2], cron[3]["existed"], lock[0]["fence"], lock[1]["ok"], lock[2]["ok"],
        tokens[0]["lease_id"], tokens[1]["lease_id"], stats[0], stats[1], c.describe_cluster()["slots"] > 0, c.health()["serving"],
    ]
    rows = [(i, m, k, None if n is None else int(n)) for i, ((m, k, _), n) in enumerate(zip(_SESSION, answers, strict=True), 1)]
    return t.values("step long, method string, answer string, n long", rows)


@op(
    "api_02",
    f"""SELECT lane, turn, group_id, msg_id, CASE WHEN msg_id % 7 = 0 THEN 'dead' WHEN msg_id % 5 = 0 THEN 'requeue' WHEN msg_id % 3 = 0 THEN 'retry' ELSE 'ack' END AS outcome FROM ({RAW["sch_01"]}) WHERE turn <= 100""",
)
def worked(t: Tables) -> DataFrame:
    """A worker's first hundred turns of each lane: what its handler returns or raises settles each lease."""

    def handler(message: dict) -> None:
        n = message["msg_id"]
        if n % 7 == 0:
            raise DeadLetter
        if n % 5 == 0:
            raise Requeue
        if n % 3 == 0:
            raise RuntimeError(n)

    return Worker(Broker(t.spark, t.sf_dir), handler).run(100)


@op("api_03", _G)
def route_groups(t: Tables) -> DataFrame:
    return get(Broker(t.spark, t.sf_dir), "/api/lanes/view/groups")


@op("api_04", " UNION ALL ".join(f"SELECT '{c}' AS command" for c in ("backup", "bench", "demo", "dlq", "doctor", "drain", "group", "lane", "leases", "messages", "restore", "stats", "workflow")))
def commands(t: Tables) -> DataFrame:
    """What python -m tidemark can do."""
    from tidemark.__main__ import COMMANDS

    return t.values("command string", [(c,) for c in sorted(COMMANDS)])
