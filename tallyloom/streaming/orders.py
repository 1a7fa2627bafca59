"""Chats that grow while they are read: kept as state until they have been quiet for a while, then one order each.

Each chat is a key with its messages so far. A timer closes it when no message has come for `gap`; it is given once, with all
of its messages in order of time, and its messages leave the state. What comes after that is late, and is given by itself.
Every batch of closed chats goes to the extractor once, and its orders are numbered on from the batches before. A batch that
is run again, after a restart, replaces what it had written.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.utils import AnalysisException

from tallyloom.functions.text import chat_name
from tallyloom.operators import orders
from tallyloom.operators.calls import Ledger
from tallyloom.operators.extract import extracted

#: What the state gives: a chat that is closed, or a late message, whose list has one.
GIVEN = "kind string, file string, first timestamp, last timestamp, said string"
SAID = "array<struct<user:string,message:string>>"
CLOSED, LATE = "closed", "late"
#: Stateful steps of this kind keep their state in RocksDB.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Chat(StatefulProcessor):
    def __init__(self, gap_seconds: float):
        self.gap = gap_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "time timestamp, user string, message string")
        self.closed = handle.getValueState("closed", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for part in rows:
            told = [(None if pd.isna(t) else t.to_pydatetime(), u, m) for t, u, m in zip(part["time"], part["user"], part["message"], strict=True)]
            if self.closed.exists():
                yield pd.DataFrame([(LATE, key[0], t, t, json.dumps([{"user": u, "message": m}])) for t, u, m in told], columns=["kind", "file", "first", "last", "said"])
            else:
                self.messages.appendList(told)
        if not self.closed.exists():
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + int(1000 * self.gap))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told = sorted(self.messages.get(), key=lambda m: (m[0] is None, m[0]))
        times = [m[0] for m in told if m[0] is not None]
        self.messages.clear()
        self.closed.update((timerValues.getCurrentProcessingTimeInMs(),))
        yield pd.DataFrame([(CLOSED, key[0], times[0] if times else None, times[-1] if times else None, json.dumps([{"user": u, "message": m} for _, u, m in told]))], columns=["kind", "file", "first", "last", "said"])

    def close(self) -> None:
        pass


def closing_chats(messages: DataFrame, gap_seconds: float = 1800) -> DataFrame:
    """(kind, file, first, last, said) out of a stream of (file, user, message, time): chats as they close, and late messages. said is JSON."""
    messages.sparkSession.conf.set(*PROVIDER)
    told = messages.select("file", "user", "message", F.col("time").cast("timestamp").alias("time"))
    return told.groupBy("file").transformWithStateInPandas(_Chat(gap_seconds), GIVEN, outputMode="append", timeMode="processingTime")


def order_stream(
    messages: DataFrame,
    extract: Callable[[list[dict]], dict | None],
    day: str,
    folder: str,
    checkpoint: str,
    gap_seconds: float = 1800,
    ledger: Callable[[Callable[[str], str | None]], Ledger] | None = None,
    prefix: str = "",
    **trigger,
) -> StreamingQuery:
    """Orders of chats that close, as they do, to tables in folder: orders, late, and counts, a folder for each batch.

    trigger: as of writeStream.trigger(), e.g. processingTime="1 minute". Timers are looked at in every batch.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            late = batch.where(F.col("kind") == LATE).select("file", F.col("first").alias("time"), F.explode(F.from_json("said", SAID)).alias("m"))
            late.select("file", "time", "m.user", "m.message").write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
            chats = batch.where(F.col("kind") == CLOSED).select("file", "first", F.col("last").alias("time"), F.from_json("said", SAID).alias("messages"))
            done = extracted(chats, extract, ledger=ledger)
            with_items = done.where(F.size("result.items") > 0)
            # a batch's chats are few: what closes between two triggers
            n = F.row_number().over(Window.orderBy("first", "file")) + numbered_before(spark, folder, batch_id)
            named = with_items.withColumns({"order_number": orders.order_number(day, n), "chat_name": chat_name(F.col("file"), prefix), "live_time": F.lit(None).cast("timestamp")})
            orders.explode_items(named).write.mode("overwrite").parquet(f"{folder}/orders/batch={batch_id}")
            spark.createDataFrame([(with_items.count(),)], "n long").write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")
        finally:
            batch.unpersist()

    made = closing_chats(messages, gap_seconds)
    return made.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def numbered_before(spark: SparkSession, folder: str, batch_id: int) -> int:
    """How many chats the batches before have numbered."""
    try:
        rows = spark.read.schema("n long, batch long").parquet(f"{folder}/counts")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return rows.where(F.col("batch") < batch_id).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
