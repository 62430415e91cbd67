"""Structured Streaming versions of the time operators, and sinks.

Streams read the events table as files; ts is cast to a timestamp with time zone, which watermarks need.
Every query here drains what is there (availableNow) and returns the sink's rows, so that batch and
stream can be compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.commands import TokenBucket, fold_dedup
from tidemark.operators.sequence import ranged_row_number
from tidemark.registry import RAW, op
from tidemark.session import shared_folder
from tidemark.sources.views import READY, Tables


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def event_stream(t: Tables) -> DataFrame:
    """The events as a stream; a glob of one file name, since a stream reads folders."""
    schema = t.events.schema
    s = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ms", F.unix_millis("ts"))


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to its present end into parquet files and read them."""
    spark, out = df.sparkSession, folder(df.sparkSession, name)
    if mode == "append":
        writer = df.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows")
    else:
        # complete mode: each batch replaces the table, which keeps the last one
        writer = df.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/rows"))
    writer.option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def idempotent(write: Callable[[DataFrame, int], None], committed: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body that skips batches at or below the last committed one."""

    def body(batch: DataFrame, batch_id: int) -> None:
        if batch_id > committed():
            write(batch, batch_id)

    return body


@op("snk_01", "SELECT event_type AS lane, CAST(count(*) AS BIGINT) AS n, max(event_id) AS last_event_id FROM events GROUP BY event_type")
def committed_batches(t: Tables) -> DataFrame:
    """All effects of one micro-batch in one folder named by its id: a batch that is written again replaces itself."""
    out = folder(t.spark, "commits")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col("event_type").alias("lane"), "event_id").write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    event_stream(t).writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    return rows.groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event_id"))


@op("snk_02", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS repeated FROM events")
def replayed(t: Tables) -> DataFrame:
    """The same batch delivered twice is applied once."""
    out = folder(t.spark, "replay")

    def write(batch: DataFrame, batch_id: int) -> None:
        # the folder of a batch is complete once its success mark is there, which also tells what was committed last
        batch.select("event_id").write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    once = idempotent(write, lambda: last_committed(t.spark, f"{out}/rows"))

    def twice(batch: DataFrame, batch_id: int) -> None:
        once(batch, batch_id)
        once(batch, batch_id)

    event_stream(t).writeStream.foreachBatch(twice).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.parquet(f"{out}/rows")
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("event_id")).alias("repeated"))


def last_committed(spark: SparkSession, path: str) -> int:
    """The largest batch id whose folder is complete, -1 if none: it survives a restart, being in the sink itself."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [x.getPath() for x in fs.listStatus(root)] if fs.exists(root) else []
    return max((int(p.getName().split("=")[1]) for p in done if p.getName().startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), default=-1)


@op("snk_06", "SELECT event_type AS lane, CAST(count(*) AS BIGINT) AS served, max(event_id) AS last_event_id FROM events WHERE event_id % 10 IN (6, 7, 8) GROUP BY event_type")
def served_frames(t: Tables) -> DataFrame:
    """The live feed: one frame per lane with its served count and last event."""
    s = event_stream(t).where("event_id % 10 IN (6, 7, 8)").groupBy(F.col("event_type").alias("lane"))
    return drained(s.agg(F.count(F.lit(1)).alias("served"), F.max("event_id").alias("last_event_id")), "frames", "complete")


op("st_11", RAW["snk_06"])(served_frames)


SWEEP = 256


@op(
    "st_07",
    """SELECT event_id, due_ms, CAST((row_number() OVER (ORDER BY due_ms, event_id) - 1) // 256 AS BIGINT) AS tick FROM (SELECT event_id, (epoch_us(ts) // 1000) + 1000 * (event_id % 60) AS due_ms FROM events WHERE event_id % 7 = 0) WHERE due_ms <= 1706659200000""",
)
def swept_timers(t: Tables, batch: int = SWEEP) -> DataFrame:
    """The sweep of the timer wheel: each tick takes the oldest `batch` timers due at its instant and no others.

    The timers arrive as a stream and are kept; what is due by now comes out in ticks, later ones stay.
    """
    due = (F.col("ms") + 1000 * (F.col("event_id") % 60)).alias("due_ms")
    kept = drained(event_stream(t).where("event_id % 7 = 0").select("event_id", due), "sweep")
    n = ranged_row_number(kept.where(F.col("due_ms") <= t.asof_ms), [], ["due_ms", "event_id"], "n")
    return n.select("event_id", "due_ms", F.floor((F.col("n") - 1) / batch).cast("long").alias("tick"))


@op("st_16", "SELECT event_type AS lane, (epoch_us(ts) // 1000) // 86400000 * 86400000 AS day_ms, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2 HAVING (epoch_us(max(ts)) // 1000) // 86400000 < (SELECT (epoch_us(max(ts)) // 1000) // 86400000 FROM events)")
def daily_windows(t: Tables) -> DataFrame:
    """Event-time windows under a watermark; the window that is still open is not compared."""
    s = event_stream(t).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), F.col("event_type").alias("lane")).count()
    rows = drained(s.select("lane", F.unix_millis("window.start").alias("day_ms"), F.col("count").alias("n")), "windows")
    last = t.events.agg(F.max(F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 86400000) * 86400000).alias("last"))
    return rows.join(F.broadcast(last)).where("day_ms < last").drop("last")


def keyed(stream: DataFrame, key: list[str], fold, out_schema: str, state_schema: str) -> DataFrame:
    """A per-key fold over a stream, with the fold's state kept between triggers."""
    return stream.groupBy(*key).applyInPandasWithState(fold, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- work streams
FRAMES = ("lease_request", "ack", "nack", "extend", "complete")
CONSUMERS = 4


def fold_work(frames: Iterable[tuple[str, int]], work: int, credit: int = 0, inflight: int = 0):
    """(kind, credit asked) in order -> (credit, inflight, delivered, work left) after each frame of one consumer.

    Credit adds up. A settled lease frees its place, an extend does not. Then leases go out while fewer are in flight
    than there is credit, and while there is work.
    """
    for kind, asked in frames:
        if kind == "lease_request":
            credit += asked
        elif kind != "extend":
            inflight = max(0, inflight - 1)
        delivered = max(0, min(work, credit - inflight))
        inflight, work = inflight + delivered, work - delivered
        yield credit, inflight, delivered, work


_FRAME = f"""SELECT event_type AS lane, concat('c', CAST(event_id % {CONSUMERS} AS VARCHAR)) AS consumer_id, event_id, event_id % 5 AS kind, 1 + event_id % 3 AS asked,
      row_number() OVER (PARTITION BY event_type, event_id % {CONSUMERS} ORDER BY event_id) AS k FROM events"""


@op(
    "src_09",
    f"""WITH RECURSIVE frames AS MATERIALIZED ({_FRAME}),
    run(lane, consumer_id, event_id, kind, k, credit, inflight, delivered, work) AS (SELECT f.lane, consumer_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), work
      FROM (SELECT DISTINCT lane, consumer_id FROM frames) f JOIN (SELECT lane, CAST(sum(ready) AS BIGINT) // {CONSUMERS} AS work FROM groups_t GROUP BY lane) w ON w.lane = f.lane
    UNION ALL SELECT lane, consumer_id, event_id, kind, k, credit, busy + give, give, work - give FROM (SELECT *, greatest(0, least(work, credit - busy)) AS give FROM
      (SELECT f.lane, f.consumer_id, f.event_id, f.kind, f.k, r.work, r.credit + CASE WHEN f.kind = 0 THEN asked ELSE 0 END AS credit, CASE WHEN f.kind IN (0, 3) THEN r.inflight ELSE greatest(0, r.inflight - 1) END AS busy
      FROM run r JOIN frames f ON f.lane = r.lane AND f.consumer_id = r.consumer_id AND f.k = r.k + 1)))
    SELECT lane, consumer_id, event_id, CASE kind WHEN 0 THEN 'lease_request' WHEN 1 THEN 'ack' WHEN 2 THEN 'nack' WHEN 3 THEN 'extend' ELSE 'complete' END AS kind, credit, inflight, delivered FROM run WHERE k > 0""",
)
def work_stream(t: Tables) -> DataFrame:
    """Typed client frames as a stream, each with the credit and the leases in flight after it, and how many leases it set free.

    A consumer's credit, leases and share of its lane's ready messages are kept between triggers.
    """

    def fold(key, batches, state: GroupState):
        rows = pd.concat(list(batches)).sort_values("event_id")
        work, credit, inflight = state.get if state.exists else (int(rows["work"].iloc[0]), 0, 0)
        out = list(fold_work(zip(rows["kind"], rows["asked"].tolist(), strict=True), work, credit, inflight))
        credit, inflight, _, work = out[-1]
        state.update((work, credit, inflight))
        after = pd.DataFrame(out, columns=["credit", "inflight", "delivered", "work"]).drop(columns="work")
        yield pd.concat([rows[["lane", "consumer_id", "event_id", "kind"]].reset_index(drop=True), after], axis=1)

    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, FRAMES)), (e % 5).cast("int") + 1)
    work = t.fates.groupBy("lane").agg(F.floor(F.count_if(F.col("fate") == READY) / CONSUMERS).alias("work"))  # one row per lane
    s = event_stream(t).select(F.col("event_type").alias("lane"), F.concat(F.lit("c"), (e % CONSUMERS).cast("string")).alias("consumer_id"), "event_id", kind.alias("kind"), (1 + e % 3).alias("asked"))
    s = s.join(F.broadcast(work), "lane")
    out = "lane string, consumer_id string, event_id long, kind string, credit long, inflight long, delivered long"
    return drained(keyed(s, ["lane", "consumer_id"], fold, out, "work long, credit long, inflight long"), "work")


@op(
    "st_10",
    f"""SELECT lane, consumer_id, max(credit) AS credit, CAST(sum(delivered) AS BIGINT) AS delivered, max(inflight) AS most_inflight, CAST(count(*) FILTER (WHERE inflight < credit) AS BIGINT) AS idle,
    max(inflight - credit) <= 0 AS held FROM ({RAW["src_09"]}) GROUP BY lane, consumer_id""",
)
def credit_flow(t: Tables) -> DataFrame:
    """Credit control of each consumer: what was granted and delivered, the most in flight, frames that left credit idle for
    want of work, and whether leases in flight never passed the credit."""
    c = work_stream(t).groupBy("lane", "consumer_id")
    held = (F.max(F.col("inflight") - F.col("credit")) <= 0).alias("held")
    return c.agg(F.max("credit").alias("credit"), F.sum("delivered").alias("delivered"), F.max("inflight").alias("most_inflight"), F.count_if(F.col("inflight") < F.col("credit")).alias("idle"), held)


@op("stream_dedup", RAW["st_05"])
def streamed_dedup(t: Tables, window_ms: int = 86_400_000) -> DataFrame:
    """st_05 as a stream: the state is the end of the window of the last accepted publish."""

    def fold(key, batches, state: GroupState):
        rows = pd.concat(list(batches)).sort_values("event_id")
        until = state.get[0] if state.exists else None
        ok = []
        for at in rows["ms"]:
            fresh = until is None or until <= at
            until = at + window_ms if fresh else until
            ok.append(fresh)
        state.update((int(until),))
        yield pd.DataFrame({"event_id": rows["event_id"], "accepted": ok})

    e = F.col("event_id")
    s = event_stream(t).select(F.col("event_type").alias("lane"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), (e % 3).cast("string")).alias("dedup_key"), "event_id", "ms")
    return drained(keyed(s, ["lane", "dedup_key"], fold, "event_id long, accepted boolean", "until long"), "dedup")


@op("stream_rate_limit", RAW["st_08"])
def streamed_rate_limit(t: Tables, rate: float = 0.001, burst: float = 2.0) -> DataFrame:
    """st_08 as a stream; one batch folds in time order, the bucket is kept between batches."""

    def fold(key, batches, state: GroupState):
        rows = pd.concat(list(batches)).sort_values(["ms", "event_id"])
        bucket = TokenBucket(rate, burst, *(state.get if state.exists else ()))
        yield pd.DataFrame({"lane": key[0], "event_id": rows["event_id"], "allowed": [bucket.allow(x) for x in rows["ms"].tolist()]})
        state.update((float(bucket.tokens), bucket.before))

    s = event_stream(t).select(F.col("event_type").alias("lane"), "event_id", "ms")
    return drained(keyed(s, ["lane"], fold, "lane string, event_id long, allowed boolean", "tokens double, before long"), "rate")


# ---------------------------------------------------------------- snapshots and backups
TABLES = ("messages", "groups", "leases", "dead_letters", "runs", "history")


def save(t: Tables, path: str, **options: str) -> None:
    """One parquet folder per table."""
    for name in TABLES:
        getattr(t, name).write.mode("errorifexists").options(**options).parquet(f"{path}/{name}")


def restored(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def safe_member(name: str) -> bool:
    """A member of an archive stays inside its target."""
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and ":" not in parts[0]


_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS name, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS differing FROM {v}" for n, v in (("messages", "messages"), ("groups", "groups_t"), ("leases", "leases"), ("dead_letters", "dead_letters"), ("runs", "runs"), ("history", "history")))


def compared(t: Tables, tables: dict[str, DataFrame]) -> DataFrame:
    """name, n, differing: rows of each table, and how many of either side the other lacks."""
    out = None
    for name, df in tables.items():
        was = getattr(t, name)
        n, differ = df.agg(F.count(F.lit(1)).alias("n")), df.exceptAll(was).union(was.exceptAll(df)).agg(F.count(F.lit(1)).alias("differing"))
        one = n.join(F.broadcast(differ)).select(F.lit(name).alias("name"), "n", "differing")
        out = one if out is None else out.union(one)
    return out


def _round_trip(t: Tables, name: str, **options: str) -> DataFrame:
    path = folder(t.spark, name)
    save(t, path, **options)
    return compared(t, restored(t.spark, path))


def restore(spark: SparkSession, source: str, target: str, force: bool = False) -> None:
    """Replace target's tables by source's. A target that holds anything is refused unless forced."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(root) and len(fs.listStatus(root)) and not force:
        raise FileExistsError(f"{target} is not empty")
    for name, df in restored(spark, source).items():
        df.write.mode("overwrite").parquet(f"{target}/{name}")


def _restored_over(t: Tables) -> DataFrame:
    """A snapshot restored over another state: what was there before is gone."""
    source, target = folder(t.spark, "snapshot"), folder(t.spark, "state")
    save(t, source)
    t.messages.limit(3).write.parquet(f"{target}/messages")
    try:
        restore(t.spark, source, target)
    except FileExistsError:
        restore(t.spark, source, target, force=True)
    return compared(t, restored(t.spark, target))


op("snk_03", _COUNTS)(lambda t: _round_trip(t, "snapshot"))
op("snk_04", _COUNTS)(lambda t: _round_trip(t, "backup", compression="gzip"))
op("src_10", _COUNTS)(_restored_over)


@op("src_11", "SELECT * FROM (VALUES ('messages/part-0.parquet', TRUE), ('../etc/passwd', FALSE), ('/abs', FALSE), ('a/../../b', FALSE), ('', FALSE)) v(member, safe)")
def archive_members(t: Tables) -> DataFrame:
    names = ["messages/part-0.parquet", "../etc/passwd", "/abs", "a/../../b", ""]
    return t.values("member string, safe boolean", [(n, safe_member(n)) for n in names])


__all__ = ["drained", "event_stream", "fold_dedup", "idempotent", "keyed", "restored", "save"]
