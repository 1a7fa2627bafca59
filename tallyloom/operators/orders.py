"""Orders out of extraction results: exploding, numbering, formatting, and the output sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import phone
from tallyloom.operators.numbering import numbered


def order_number(day: Column | str, n: Column) -> Column:
    """YYYYMMDD and the number in three digits, or more from 1000 on."""
    return F.format_string("%s%03d", F.lit(day) if isinstance(day, str) else day, n)


def number_orders(chats: DataFrame, day: str, ord: str = "ord", has_items: Column | None = None) -> DataFrame:
    """(chats' columns, order_number): chats that have items, numbered in order of ord; others have no row and use no number."""
    has = F.size("result.items") > 0 if has_items is None else has_items
    made = numbered(chats.where(F.coalesce(has, F.lit(False))), ord, "_n")
    return made.withColumn("order_number", order_number(day, F.col("_n"))).drop("_n")


def explode_items(chats: DataFrame, keep: tuple[str, ...] = ("time", "chat_name", "live_time", "order_number")) -> DataFrame:
    """One row for each item: its fields, the order's header fields, and the columns in keep. Phone numbers are formatted."""
    head = [F.col(f"result.{c}").alias(c) for c in ("order_name", "phone_number", "address", "search_address")]
    rows = chats.select(F.posexplode("result.items").alias("item_no", "item"), *head, *keep)
    return rows.select("item_no", "item.*", *[c for c in rows.columns[2:]]).withColumn("phone_number", phone(F.col("phone_number")))


def sheet(orders: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """The output columns, name -> field, in order. A field of None, or one that orders lack, is empty text; nulls stay null."""
    return orders.select(*[F.col(f"`{f}`").alias(name) if f in orders.columns else F.lit("").alias(name) for name, f in columns.items()])


def without(orders: DataFrame, names: tuple[str, ...] = ("id", "job_id", "created_at")) -> DataFrame:
    """orders without the columns of these names that they have."""
    return orders.drop(*names)
