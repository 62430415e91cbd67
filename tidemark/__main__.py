"""python -m tidemark COMMAND FOLDER [ARGUMENT]

backup PATH, bench POLICY, demo, dlq LANE, doctor, drain POLICY, group LANE, lane LANE, leases LANE, messages LANE,GROUP,
restore SOURCE,TARGET, stats LANE, workflow RUN. Listings show at most 200 rows.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import functions as F

from tidemark.session import session
from tidemark.streaming import live


def _backup(b, x):
    live.save(b.tables, x)
    return live.compared(b.tables, live.restored(b.tables.spark, x))


def _restore(b, x):
    """SOURCE,TARGET: a target that holds anything is refused."""
    source, target = x.split(",")
    live.restore(b.tables.spark, source, target)
    return live.compared(b.tables, live.restored(b.tables.spark, target))


def _bench(b, x):
    """Seconds that draining takes under a policy."""
    began = time.time()
    turns = b.drain(x or "wfq").agg(F.count(F.lit(1))).first()[0]
    took = time.time() - began
    return b.tables.values("policy string, turns long, seconds double", [(x or "wfq", turns, round(took, 3))])


def _messages(b, x):
    """LANE,GROUP"""
    return b.messages(*x.split(",")).orderBy("msg_id").limit(200)


COMMANDS = {
    "backup": _backup,
    "bench": _bench,
    "demo": lambda b, x: b.drain("wfq").groupBy("lane", "group_id").agg({"turn": "max"}).orderBy("lane", "group_id"),
    "dlq": lambda b, x: b.dead_letters(x).orderBy("dead_at_ms", "lane", "group_id", "msg_id").limit(200),
    "doctor": lambda b, x: b.doctor().orderBy("status", "code", "lane"),
    "drain": lambda b, x: b.drain(x or "wfq", 20).orderBy("lane", "turn"),
    "group": lambda b, x: b.groups(x).orderBy("group_id"),
    "lane": lambda b, x: b.fairness(x).orderBy("group_id"),
    "leases": lambda b, x: b.leases(x).orderBy("lease_id").limit(200),
    "messages": _messages,
    "restore": _restore,
    "stats": lambda b, x: b.stats(x),
    "workflow": lambda b, x: b.workflow(int(x or 1)),
}


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in COMMANDS:
        print(__doc__)
        return 2
    from tidemark.api import Broker

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    COMMANDS[args[0]](Broker(spark, args[1]), args[2] if len(args) > 2 else None).show(100, False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
