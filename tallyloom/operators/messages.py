"""Messages of chats: normalising, leaving out system messages, chat times, chats as arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import collapse, parse_time


def without_prefixes(rows: DataFrame, prefixes: list[str], message: str = "message") -> DataFrame:
    """Rows whose message begins with none of the prefixes, as they stand. A null message stays."""
    if not prefixes:
        return rows
    begins = reduce(Column.__or__, [F.col(message).startswith(p) for p in prefixes])
    return rows.where(~F.coalesce(begins, F.lit(False)))


def normalised(rows: DataFrame, exclude: list[str] = (), message: str = "message") -> DataFrame:
    """rows with the white space of messages collapsed, without those that then begin with an excluded text."""
    return without_prefixes(rows.withColumn(message, collapse(F.col(message))), list(exclude), message)


def excluded_first(rows: DataFrame, exclude: list[str], message: str = "message") -> DataFrame:
    """As normalised(), but texts are excluded by how they begin before white space is collapsed: the converter's order."""
    return without_prefixes(rows, list(exclude), message).withColumn(message, collapse(F.col(message)))


def last_time(rows: DataFrame, chat: str = "file", ord: str = "ord", date: str = "date") -> DataFrame:
    """(chat, time): the time of each chat's last row in order of ord, before any filter; null if it can't be read or is missing."""
    return rows.groupBy(chat).agg(F.max_by(date, ord).alias("_date")).select(chat, _time(rows, date, "_date").alias("time"))


def first_last_time(rows: DataFrame, chat: str = "file", ord: str = "ord", date: str = "date") -> DataFrame:
    """(chat, first, last): the dates of each chat's first and last rows, as they stand."""
    return rows.groupBy(chat).agg(F.min_by(date, ord).alias("first"), F.max_by(date, ord).alias("last"))


def _time(rows: DataFrame, date: str, column: str) -> Column:
    return F.col(column).cast("timestamp_ntz") if dict(rows.dtypes)[date].startswith("timestamp") else parse_time(F.col(column))


def as_arrays(rows: DataFrame, chat: str = "file", ord: str = "ord", fields: tuple[str, ...] = ("user", "message")) -> DataFrame:
    """(chat, messages): a chat's messages in order, as one array, as a prompt or a training record needs them.

    A prompt holds its whole chat, so the size of a row is that of a chat, which the extractor's context bounds. Steps that
    look at single messages don't need this.
    """
    told = F.array_sort(F.collect_list(F.struct(ord, *fields)))
    return rows.groupBy(chat).agg(F.transform(told, lambda m: F.struct(*[m[f].alias(f) for f in fields])).alias("messages"))
