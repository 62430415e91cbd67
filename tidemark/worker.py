"""Publishers and workers: batches of messages into a queue's folder, and handlers over served messages."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: What a published batch holds; all but the first two may be missing.
MESSAGE = StructType(
    [StructField(c, StringType()) for c in ("lane", "group_id", "payload", "dedup_key")] + [StructField(c, LongType()) for c in ("enqueue_ms", "not_before_ms", "ttl_ms", "max_attempts")]
)


class Requeue(Exception):
    """Raised by a handler: the message goes back with no attempt used."""


class DeadLetter(Exception):
    """Raised by a handler: the message is dead at once."""


def outcome(handler: Callable[[dict], object], message: dict) -> str:
    """ack if the handler returns; any exception but the two named means a retry."""
    try:
        handler(message)
    except Requeue:
        return "requeue"
    except DeadLetter:
        return "dead"
    except Exception:  # noqa: BLE001  a handler may raise anything, and a message that failed is tried again
        return "retry"
    return "ack"


def handled(messages: DataFrame, handler: Callable[[dict], object]) -> DataFrame:
    """messages with a column outcome: what the handler's return or exception means for the lease.

    Handlers may run twice for one message (a lost executor), so they must bear repeats, as with any delivery at least once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(outcome=[outcome(handler, m) for m in rows.to_dict("records")])

    return messages.mapInPandas(run, StructType([*messages.schema.fields, StructField("outcome", StringType())]))


class Publisher:
    """Writes batches into a folder, each under its own name: a batch that is sent again under one name replaces itself."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def publish(self, messages: DataFrame, batch: str | None = None) -> str:
        """The batch's name. Columns of MESSAGE that are missing are null; others are refused."""
        unknown = set(messages.columns) - set(MESSAGE.names)
        if unknown or not {"lane", "group_id"} <= set(messages.columns):
            raise ValueError(f"a message has lane, group_id and any of {MESSAGE.names[2:]}, not {sorted(unknown)}")
        name = batch or uuid.uuid4().hex
        if not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"bad name of a batch: {name}")
        cols = [(F.col(f.name) if f.name in messages.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MESSAGE.fields]
        messages.select(*cols).write.mode("overwrite").parquet(f"{self.folder}/batch={name}")
        return name

    def published(self) -> DataFrame:
        """All batches; batch names where a message came from."""
        return self.spark.read.schema(StructType([*MESSAGE.fields, StructField("batch", StringType())])).option("basePath", self.folder).parquet(self.folder)


class Worker:
    """Serves a queue's lanes under a policy and hands each message to a handler."""

    def __init__(self, broker, handler: Callable[[dict], object], policy: str = "wfq", lanes: tuple[str, ...] = ()):
        self.broker, self.handler, self.policy, self.lanes = broker, handler, policy, lanes

    def run(self, turns: int) -> DataFrame:
        """lane, turn, group_id, msg_id, outcome of the first turns of each lane."""
        rows = self.broker.drain(self.policy, turns)
        if self.lanes:
            rows = rows.where(F.col("lane").isin(*self.lanes))
        return handled(rows, self.handler)
