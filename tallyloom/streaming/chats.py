"""Chats that arrive as files in a folder, as streams."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.functions.text import na_as_text, na_to_null, parse_time
from tallyloom.operators.extract import structural_items
from tallyloom.operators.messages import normalised


def _csv_rows(batches):
    """A file's messages, each column by its name in the file's header, whatever else the header has."""
    for files in batches:
        out = []
        for path, raw in zip(files["path"], files["content"], strict=True):
            rows = csv.reader(io.StringIO(bytes(raw).decode("utf-8-sig"), newline=""))
            at = {name.strip().lower(): i for i, name in enumerate(next(rows, []))}
            cell = lambda row, name: row[at[name]] if name in at and at[name] < len(row) else None
            out += [(path.rsplit("/", 1)[1], cell(r, "user"), cell(r, "message") or "", cell(r, "date")) for r in rows if r]
        yield pd.DataFrame(out, columns=["file", "user", "message", "date"])


def watch_chats(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """(file, user, message, time) of CSV files as they arrive in folder, each read by its own header."""
    files = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.csv").load(folder)
    rows = files.select("path", "content").mapInPandas(_csv_rows, "file string, user string, message string, date string")
    return rows.select("file", na_to_null(F.col("user")).alias("user"), na_as_text(F.col("message")).alias("message"), parse_time(na_to_null(F.col("date"))).alias("time"))


def item_stream(messages: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Items of messages, one by one: no state."""
    return structural_items(normalised(messages, list(exclude)))


def message_counts(messages: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, user, messages): counts in windows of time; messages later than `late` are left out, and windows are given once, when they close."""
    timed = messages.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late)
    return timed.groupBy(F.window("time", window), "user").agg(F.count("*").alias("messages"))


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived to Parquet, each row once, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
