"""Folds, invariants and scalar functions on literal cases."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tidemark.functions.scalars import cron_field, fnv64, history_checksum, retry_delay
from tidemark.operators.commands import TokenBucket, fold_appends, fold_dedup, fold_singleton
from tidemark.operators.sequence import by_cuts, by_ranges, cut_points, keyed_row_number, ranged_row_number
from tidemark.plans.scheduling import fnv64a
from tidemark.sources.views import Tables
from tidemark.streaming.live import fold_work, idempotent, safe_member


def test_singleton_fence_rises():
    log = [(0, "acquire", "h1", 0, 10, 1), (1, "acquire", "h2", 0, 10, 2), (2, "release", "h1", 1, 0, 3), (3, "acquire", "h2", 0, 10, 4), (13, "acquire", "h3", 0, 10, 5), (14, "renew", "h2", 2, 10, 6)]
    assert [(ok, fence) for _, ok, fence in fold_singleton(log)] == [(True, 1), (False, 1), (True, 1), (True, 2), (True, 3), (False, 3)]


def test_second_append_on_one_snapshot_is_stale():
    assert [x[1:] for x in fold_appends([(1, 0, 1, 2), (2, 0, 1, 2)])] == [("applied", 1, 3), ("stale", 1, 3)]


def test_dedup_window_counts_from_the_accepted_publish():
    assert list(fold_dedup([0, 200, 299, 300, 500, 600], 300)) == [True, False, False, True, False, True]


def test_token_bucket():
    b = TokenBucket(10, 2)
    assert sum(b.allow(0) for _ in range(10)) == 2
    assert b.allow(100) and not b.allow(100) and TokenBucket(0, 1).allow(0)


def test_credit_bounds_leases_in_flight():
    frames = [("ack", 0), ("lease_request", 1), ("extend", 0), ("ack", 0), ("lease_request", 2), ("complete", 0), ("nack", 0)]
    # credit, inflight, delivered, work: one credit is strictly serial, and no work leaves credit idle
    assert list(fold_work(frames, 4)) == [(0, 0, 0, 4), (1, 1, 1, 3), (1, 1, 0, 3), (1, 1, 1, 2), (3, 3, 2, 0), (3, 2, 0, 0), (3, 1, 0, 0)]


def test_counter_identity_and_ids(spark, sf):
    t = Tables(spark, sf)
    bad = t.groups.where("ready + delayed_n + inflight > next_seq - 1").count()
    gaps = t.messages.groupBy("lane", "group_id").agg(F.max("msg_id").alias("m"), F.count("*").alias("n")).where("m <> n").count()
    assert bad == 0 and gaps == 0


def test_fnv_and_retry_delay_equal_python(spark):
    rows = spark.createDataFrame([("",), ("a",), ("g17",), ("naïve",)], "s string").select("s", fnv64(F.encode("s", "utf-8")).cast("string").alias("h")).collect()
    assert all(int(r["h"]) == fnv64a(r["s"].encode()) for r in rows)
    for r in spark.range(1, 40, 7).select("id", retry_delay(F.col("id"), F.lit(2).cast("long")).alias("d")).collect():
        h = fnv64a(r["id"].to_bytes(8, "little") + (2).to_bytes(4, "little"))
        assert r["d"] == min(2000 + h % 501, 30000)


def test_checksum_is_sha256_up_to_the_gap(spark):
    h = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 4, "bc"), (1, 4, 5, "x")], "run_id long, event_id long, event_type long, attrs string")
    want = hashlib.sha256(b"".join(i.to_bytes(8, "big") + k.to_bytes(4, "big") + a for i, k, a in ((1, 1, b"a"), (2, 4, b"bc")))).hexdigest()
    assert history_checksum(h).first()["checksum"] == want


def test_row_numbers_in_buckets_equal_one_long_window(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 1000).alias("x"))
    cuts = cut_points(df, "x", width=100)
    assert len(cuts) == 3 and cut_points(df, "x") == []
    for out in (keyed_row_number(df, ["k"], "x", "n", cuts), keyed_row_number(df, ["k"], "x", "n", []), ranged_row_number(df, ["k"], ["x"], "n")):
        rows = out.collect()
        for k in range(3):
            mine = sorted((r["x"], r["n"]) for r in rows if r["k"] == k)
            assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_a_hot_lane_of_equal_keys_splits_evenly(spark):
    """A hundred thousand tenants with one message each, all with the same virtual time; sparse and huge ids."""
    df = spark.range(100_000).select(F.lit("hot").alias("lane"), F.lit(0.0).alias("vt"), F.format_string("g%06d", F.pmod(F.xxhash64("id"), F.lit(1_000_000))).alias("g"), "id")
    cut = by_ranges(df, ["lane"], ["vt", "g", "id"])
    sizes = [r["count"] for r in cut.groupBy("_b").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 25_000
    out = ranged_row_number(df, ["lane"], ["vt", "g", "id"], "n")
    assert out.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, 100_000, 100_000)
    sparse = spark.range(1000).select((F.col("id") * F.col("id") * 1_000_003).alias("x"))
    sizes = [r["count"] for r in by_cuts(sparse, "x", cut_points(sparse, "x", width=10)).groupBy("_b").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 300


def test_numbered_views_cross_buckets(spark, sf, monkeypatch):
    """The views' numbers are the same in one bucket and in several."""
    one, many = Tables(spark, sf), Tables(spark, sf)
    many.event_cuts = cut_points(many.events, "event_id", width=50)
    assert many.event_cuts and not one.event_cuts
    for name in ("numbered", "leases", "served"):
        assert getattr(one, name).exceptAll(getattr(many, name)).isEmpty() and getattr(many, name).count() == getattr(one, name).count()


def test_batches_are_applied_once():
    seen: list[int] = []
    body = idempotent(lambda b, i: seen.append(i), lambda: max(seen, default=-1))
    for i in (0, 1, 1, 0, 2):
        body(None, i)
    assert seen == [0, 1, 2]


def test_archive_members_stay_inside():
    assert safe_member("a/b.parquet") and not any(map(safe_member, ("", "/a", "../a", "a/../../b", "C:/a", "\\a")))


def test_crontab_fields():
    assert cron_field("*/15", 0, 59) == [0, 15, 30, 45] and cron_field("1-5,9", 0, 10) == [1, 2, 3, 4, 5, 9]
