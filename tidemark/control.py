"""The commands of a work queue's operator, and their answers.

The input folder is never changed. What commands change is kept here: one entry for each group, lane, cron, policy or
singleton that was configured, and one for each token that was settled. Everything that counts messages is a
query over the tables less what commands have dropped. Single answers are dicts, listings are DataFrames.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import cron_field, cron_fires, retry_base
from tidemark.operators.commands import DEFAULT_ATTEMPTS, fold_singleton
from tidemark.plans.scheduling import validate
from tidemark.sources.views import DELAYED, LEASED, READY, Tables

CRON_FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
CRON_SPAN_DAYS = 366


class Control:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.tables = Tables(spark, sf_dir)
        self.now_ms = self.tables.asof_ms
        self._groups: dict[tuple[str, str], dict] = {}
        self._lanes: dict[str, dict] = {}
        self._policies: dict[str, dict] = {}
        self._crons: dict[str, dict] = {}
        self._singletons: dict[str, list[tuple]] = {}
        self._cancelled: set[tuple[str, str]] = set()
        self._torn_down: set[str] = set()
        self._settled: set[str] = set()

    # ---------------------------------------------------------------- groups
    def messages(self) -> DataFrame:
        """Live messages less what was cancelled or torn down."""
        m = self.tables.fates.where(F.col("fate") <= LEASED)
        for lane, group in sorted(self._cancelled):
            m = m.where(~((F.col("lane") == lane) & (F.col("group_id") == group) & F.col("fate").isin(READY, DELAYED)))
        return m.where(~F.col("group_id").isin(*sorted(self._torn_down))) if self._torn_down else m

    def _in(self, lane: str, group_id: str) -> DataFrame:
        return self.messages().where((F.col("lane") == lane) & (F.col("group_id") == group_id))

    def set_group_config(self, lane: str, group_id: str, weight: float | None = None, batch_size: int | None = None) -> dict:
        """A field that is not given keeps its value; weight 0 means 1."""
        if weight is not None and not 0 <= weight < float("inf"):
            raise ValueError("a weight is a finite number, not negative")
        return self._configure(lane, group_id, weight=None if weight is None else float(weight) or 1.0, batch_size=batch_size)

    def _configure(self, lane: str, group_id: str, **fields) -> dict:
        self._groups.setdefault((lane, group_id), {}).update({k: v for k, v in fields.items() if v is not None})
        return self.get_group_config(lane, group_id)

    def get_group_config(self, lane: str, group_id: str) -> dict:
        row = self.tables.groups.where((F.col("lane") == lane) & (F.col("group_id") == group_id)).select("weight", "paused").first()
        known = {"weight": row["weight"], "paused": row["paused"]} if row else {"weight": 1.0, "paused": False}
        return {"lane": lane, "group_id": group_id, "batch_size": 0} | known | self._groups.get((lane, group_id), {})

    def pause_group(self, lane: str, group_id: str) -> dict:
        return self._configure(lane, group_id, paused=True)

    def resume_group(self, lane: str, group_id: str) -> dict:
        return self._configure(lane, group_id, paused=False)

    def cancel_group(self, lane: str, group_id: str) -> dict:
        """Ready and delayed messages go; what is leased stays until it is settled."""
        fate = F.col("fate")
        row = self._in(lane, group_id).agg(F.count_if(fate.isin(READY, DELAYED)).alias("affected"), F.count_if(fate == LEASED).alias("left")).first()
        self._cancelled.add((lane, group_id))
        return {"lane": lane, "group_id": group_id, "affected": row["affected"], "total_after": row["left"]}

    #: Purging drops the same messages; either way the group's configuration stays.
    purge_group = cancel_group

    def reap_group(self, lane: str, group_id: str) -> dict:
        """Forgets a group, which must be empty."""
        left = self._in(lane, group_id).count()
        if left:
            raise ValueError(f"{lane}/{group_id} holds {left} messages")
        known = self._groups.pop((lane, group_id), None) is not None
        return {"lane": lane, "group_id": group_id, "affected": int(known), "total_after": 0}

    def teardown_group(self, group_id: str) -> dict:
        """Removes a group from all lanes; lanes are configuration, and so few."""
        rows = self.messages().where(F.col("group_id") == group_id).groupBy("lane").count().collect()
        self._torn_down.add(group_id)
        self._groups = {k: v for k, v in self._groups.items() if k[1] != group_id}
        return {"group_id": group_id, "lanes": sorted(r["lane"] for r in rows), "total": sum(r["count"] for r in rows)}

    # ---------------------------------------------------------------- lanes and policies
    def _lane(self, lane: str, **fields) -> dict:
        state = self._lanes.setdefault(lane, {"rate_per_sec": 0.0, "burst": 0, "paused": False, "until_ms": None})
        state.update(fields)
        return {"lane": lane} | state

    def set_lane_config(self, lane: str, rate_per_sec: float = 0.0, burst: int = 0) -> dict:
        """A rate of 0 or less is no limit."""
        return self._lane(lane, rate_per_sec=float(rate_per_sec), burst=int(burst))

    def pause_lane(self, lane: str, duration: float = 0.0) -> dict:
        """For some seconds, or with 0 until it is resumed."""
        return self._lane(lane, paused=True, until_ms=self.now_ms + round(duration * 1000) if duration else None)

    def resume_lane(self, lane: str) -> dict:
        return self._lane(lane, paused=False, until_ms=None)

    def set_policy(self, lane: str, source: str = "") -> dict:
        """Each accepted source, '' for weighted fair queueing, is the lane's next version; a bad one changes nothing."""
        checked = self.validate_policy(lane, source)
        if not checked["valid"]:
            raise ValueError(checked["reason"])
        version = self._policies.get(lane, {"version": 0})["version"] + 1
        self._policies[lane] = {"version": version, "engine": "expression" if source else "builtin", "source": source, "hash": hashlib.sha256(source.encode()).hexdigest()}
        return self.get_policy(lane)

    def get_policy(self, lane: str) -> dict:
        return {"lane": lane} | self._policies.get(lane, {"version": 0, "engine": "builtin", "source": "", "hash": ""})

    def validate_policy(self, lane: str, source: str = "") -> dict:
        """Compiles and tries a policy without installing it."""
        reason = validate(self.tables, source) if source else ""
        return {"lane": lane, "valid": not reason, "reason": reason}

    # ---------------------------------------------------------------- crons
    def schedule_cron(self, cron_id: str, lane: str, group_id: str, schedule: str, start_at: float | None = None, end_at: float | None = None) -> dict:
        """A five-field crontab, UTC; one that is scheduled again is replaced and runs."""
        fields = schedule.split()
        if len(fields) != len(CRON_FIELDS):
            raise ValueError(f"a schedule has five fields: {schedule}")
        for spec, (lo, hi) in zip(fields, CRON_FIELDS, strict=True):
            cron_field(spec, lo, hi)
        at = lambda seconds: None if seconds is None else round(seconds * 1000)
        self._crons[cron_id] = {"lane": lane, "group_id": group_id, "schedule": schedule, "start_ms": at(start_at), "end_ms": at(end_at), "paused": False}
        return self._cron(cron_id)

    def _fires(self, cron: dict, n: int) -> list[int]:
        """The next n fire times within a year; a paused cron has none."""
        if cron["paused"] or not n:
            return []
        fires = cron_fires(self.tables, cron["schedule"], max(self.now_ms, (cron["start_ms"] or 0) - 1), CRON_SPAN_DAYS)
        if cron["end_ms"] is not None:
            fires = fires.where(F.col("fire_ms") <= cron["end_ms"])
        return [r["fire_ms"] for r in fires.orderBy("fire_ms").limit(n).collect()]

    def _cron(self, cron_id: str) -> dict:
        cron = self._crons[cron_id]
        return {"cron_id": cron_id} | cron | {"next_fire_ms": next(iter(self._fires(cron, 1)), None)}

    def list_cron(self, lane: str = "", next_n: int = 0) -> DataFrame:
        rows = [(i, c["lane"], c["group_id"], c["schedule"], c["paused"], self._fires(c, next_n)) for i, c in sorted(self._crons.items()) if lane in ("", c["lane"])]
        return self.tables.values("cron_id string, lane string, group_id string, schedule string, paused boolean, next_fires_ms array<long>", rows)

    def delete_cron(self, cron_id: str) -> dict:
        return {"cron_id": cron_id, "existed": self._crons.pop(cron_id, None) is not None}

    def pause_cron(self, cron_id: str) -> dict:
        self._crons[cron_id]["paused"] = True
        return self._cron(cron_id)

    # ---------------------------------------------------------------- singletons
    def _singleton(self, name: str, what: str, holder: str, fence: int, ttl: float) -> dict:
        log = self._singletons.setdefault(name, [])
        log.append((self.now_ms, what, holder, fence, round(ttl * 1000), len(log)))
        _, ok, now = list(fold_singleton(log))[-1]
        return {"name": name, "holder": holder, "ok": ok, "fence": now}

    def acquire_singleton(self, name: str, holder: str, ttl: float) -> dict:
        return self._singleton(name, "acquire", holder, 0, ttl)

    def renew_singleton(self, name: str, holder: str, fence: int, ttl: float) -> dict:
        return self._singleton(name, "renew", holder, fence, ttl)

    def release_singleton(self, name: str, holder: str, fence: int) -> dict:
        return self._singleton(name, "release", holder, fence, 0.0)

    # ---------------------------------------------------------------- completion, questions
    def complete_by_token(self, token: str, success: bool = True, delay: float | None = None) -> dict:
        """Success acks, failure is a retry until the message's limit makes it dead; an unknown or settled token changes nothing."""
        digest = hashlib.sha256(token.encode()).hexdigest()
        t, key = self.tables, ["lane", "group_id", "msg_id"]
        limit = F.when(F.col("max_attempts") == 0, DEFAULT_ATTEMPTS).otherwise(F.col("max_attempts"))
        held = t.leases.where(F.col("token_hash") == digest).join(t.messages.select(*key, limit.alias("most")), key)
        row = None if digest in self._settled else held.select("lease_id", "attempt_at_lease", "most", retry_base(F.col("attempt_at_lease") + 1).alias("backoff")).first()
        if row is None:
            return {"outcome": "unknown", "lease_id": None, "not_before_ms": None}
        self._settled.add(digest)
        again = row["attempt_at_lease"] + 1 < row["most"]
        wait = row["backoff"] if delay is None else round(delay * 1000)
        what = "acked" if success else "retry" if again else "max_attempts"
        return {"outcome": what, "lease_id": row["lease_id"], "not_before_ms": self.now_ms + wait if what == "retry" else None}

    def get_stats(self, lane: str = "", group_id: str = "") -> DataFrame:
        """lane, ready, delayed, inflight, groups of live messages."""
        m = self.messages()
        keep: Iterable[Column] = [F.col(c) == v for c, v in (("lane", lane), ("group_id", group_id)) if v]
        for k in keep:
            m = m.where(k)
        n = lambda fate: F.count_if(F.col("fate") == fate)
        return m.groupBy("lane").agg(n(READY).alias("ready"), n(DELAYED).alias("delayed"), n(LEASED).alias("inflight"), F.count_distinct("group_id").alias("groups"))

    def describe_cluster(self) -> dict:
        """The Spark application takes the cluster's place; its driver is the one leader."""
        sc = self.tables.spark.sparkContext
        return {"cluster_id": sc.applicationId, "leader": sc.master, "slots": sc.defaultParallelism, "version": sc.version}

    def health(self) -> dict:
        alive = not self.tables.spark.sparkContext._jsc.sc().isStopped()
        return {"serving": alive, "has_quorum": alive, "is_leader": alive}
