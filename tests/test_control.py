"""The control client, publishers and workers, and the commands of the command line."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.__main__ import COMMANDS
from tidemark.api import Broker
from tidemark.control import Control
from tidemark.worker import DeadLetter, Publisher, Requeue, Worker, handled, outcome


@pytest.fixture()
def control(spark, sf):
    return Control(spark, sf)


def test_cancelled_and_torn_down_messages_are_gone_from_every_answer(control):
    before = control.get_stats("view").first()
    done = control.cancel_group("view", "g2")
    after = control.get_stats("view").first()
    assert done["affected"] == before["ready"] + before["delayed"] - after["ready"] - after["delayed"] > 0
    assert before["inflight"] == after["inflight"]
    torn = control.teardown_group("g2")
    assert torn["total"] >= done["total_after"] and control.get_stats(group_id="g2").count() == 0
    assert control.teardown_group("g2") == {"group_id": "g2", "lanes": [], "total": 0}


def test_only_empty_groups_are_reaped(control):
    with pytest.raises(ValueError):
        control.reap_group("view", "g1")
    control.set_group_config("view", "new", weight=3)
    assert control.reap_group("view", "new")["affected"] == 1 and control.reap_group("view", "new")["affected"] == 0


def test_unset_fields_keep_their_value(control):
    control.set_group_config("view", "g1", batch_size=7)
    assert control.set_group_config("view", "g1", weight=4)["batch_size"] == 7
    assert control.pause_group("view", "g1")["weight"] == 4
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            control.set_group_config("view", "g1", weight=bad)


def test_a_bad_policy_changes_nothing(control):
    control.set_policy("view", "-virtual_time")
    with pytest.raises(ValueError):
        control.set_policy("view", "backlog +")
    assert control.get_policy("view")["version"] == 1 and control.get_policy("click")["version"] == 0


def test_crons_fire_inside_their_bounds(control):
    now = control.now_ms / 1000
    assert control.schedule_cron("c", "view", "g1", "0 * * * *", start_at=now + 7200)["next_fire_ms"] == control.now_ms + 7_200_000
    assert control.schedule_cron("c", "view", "g1", "0 * * * *", end_at=now + 1800)["next_fire_ms"] is None
    control.schedule_cron("d", "click", "g1", "30 12 * * *")
    assert [r["cron_id"] for r in control.list_cron("click", 2).collect()] == ["d"] and control.list_cron().count() == 2
    assert len(control.list_cron("click", 2).first()["next_fires_ms"]) == 2
    for bad in ("* * * *", "61 * * * *", "x * * * *"):
        with pytest.raises(ValueError):
            control.schedule_cron("bad", "view", "g1", bad)
    assert control.delete_cron("c")["existed"] and not control.delete_cron("c")["existed"]


def test_singletons_are_fenced(control):
    first = control.acquire_singleton("s", "a", 10.0)
    assert not control.acquire_singleton("s", "b", 10.0)["ok"]
    assert not control.renew_singleton("s", "a", first["fence"] + 1, 10.0)["ok"] and control.release_singleton("s", "a", first["fence"])["ok"]
    assert control.acquire_singleton("s", "b", 10.0)["fence"] == first["fence"] + 1


def test_failure_by_token_is_a_retry_with_its_delay(control):
    done = control.complete_by_token("tok8", success=False, delay=2.0)
    assert done["outcome"] in ("retry", "max_attempts") and control.complete_by_token("tok8")["outcome"] == "unknown"
    assert done["outcome"] != "retry" or done["not_before_ms"] == control.now_ms + 2000
    assert control.complete_by_token("nothing")["outcome"] == "unknown"


def test_a_batch_that_is_sent_again_replaces_itself(spark, tmp_path):
    p = Publisher(spark, str(tmp_path / "out"))
    rows = spark.createDataFrame([("view", "g1", "x"), ("view", "g2", None)], "lane string, group_id string, payload string")
    assert p.publish(rows, "b1") == p.publish(rows, "b1") == "b1"
    p.publish(rows.limit(1))
    assert p.published().where("batch = 'b1'").count() == 2 and p.published().count() == 3
    for bad, name in ((rows.drop("lane"), "b2"), (rows.withColumn("extra", F.lit(1)), "b2"), (rows, "../b2")):
        with pytest.raises(ValueError):
            p.publish(bad, name)


def test_handlers_settle_leases(spark, sf):
    def raises(error):
        raise error

    assert [outcome(f, {}) for f in (lambda m: 1, lambda m: raises(Requeue()), lambda m: raises(DeadLetter()), lambda m: raises(KeyError()))] == ["ack", "requeue", "dead", "retry"]
    assert handled(spark.range(0).toDF("msg_id"), lambda m: 1).count() == 0
    rows = Worker(Broker(spark, sf), lambda m: m["nothing"], lanes=("view",)).run(3).collect()
    assert len(rows) == 3 and {(r["lane"], r["outcome"]) for r in rows} == {("view", "retry")}


def test_command_line(spark, sf, tmp_path):
    b, saved = Broker(spark, sf), str(tmp_path / "saved")
    arguments = {"backup": saved, "group": "view", "lane": "view", "leases": "view", "dlq": "view", "messages": "view,g1"}
    for name in sorted(set(COMMANDS) - {"bench", "restore", "doctor"}):
        assert COMMANDS[name](b, arguments.get(name)).limit(1).count() == 1, name
    assert COMMANDS["bench"](b, "shortest").first()["turns"] > 0
    back = COMMANDS["restore"](b, f"{saved},{tmp_path / 'state'}").collect()
    assert back and not any(r["differing"] for r in back)
    with pytest.raises(FileExistsError):
        COMMANDS["restore"](b, f"{saved},{tmp_path / 'state'}")
