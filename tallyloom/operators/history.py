"""Jobs, their orders and training records: what is stored, and how it is looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import job_label, live_label
from tallyloom.sources.schemas import ORDERS


def order_records(orders: DataFrame, job_id: str, as_of: str) -> DataFrame:
    """orders in the stored columns; fields that they lack are null."""
    fixed = {"job_id": F.lit(job_id), "created_at": F.lit(as_of)}
    return orders.select(*[fixed.get(name, F.col(name) if name in orders.columns else F.lit(None)).cast(kind).alias(name) for name, kind in ORDERS.items()])


def training_records(chats: DataFrame, job_id: str, user_id: str, catalog_json: str, as_of: str, name: str = "file") -> DataFrame:
    """A record for each chat that has a result, with items or without: catalog, chat and result as JSON text, not verified."""
    keep = {"ignoreNullFields": "false"}
    return chats.where("result is not null").select(
        F.lit(job_id).alias("job_id"), F.lit(user_id).alias("user_id"), F.col(name).alias("chat_filename"), F.lit(catalog_json).alias("catalog_json"),
        F.to_json("messages", keep).alias("chat_json"), F.to_json("result", keep).alias("predicted_json"), F.lit(False).alias("is_verified"), F.lit(as_of).alias("created_at"),
    )


def recent_jobs(jobs: DataFrame, user_id, limit: int = 5) -> DataFrame:
    """A user's newest jobs, by created_at and then id."""
    return jobs.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def labelled(jobs: DataFrame) -> DataFrame:
    """jobs with live and label, as they are listed; total_orders is null where a job has none."""
    total = F.coalesce("total_orders", F.lit(0))
    return jobs.withColumns({"live": live_label(F.col("live_start_time")), "label": job_label(F.col("title"), F.col("live_start_time"), total)})


def orders_of(orders: DataFrame, job_id) -> DataFrame:
    """A job's orders in order of their numbers as text."""
    return orders.where(F.col("job_id") == job_id).orderBy("order_number")


def catalog_of(training: DataFrame, id: str = "created_at") -> DataFrame:
    """(job_id, catalog_json): of each job, that of its least record."""
    return training.groupBy("job_id").agg(F.min_by("catalog_json", id).alias("catalog_json"))


def totals(orders: DataFrame) -> DataFrame:
    """(job_id, total_orders): the rows of each job."""
    return orders.groupBy("job_id").agg(F.count("*").alias("total_orders"))


def totals_of(jobs: DataFrame, orders: DataFrame) -> DataFrame:
    """(job_id, total_orders) of a few jobs (id): only their orders are counted.

    The jobs are sent to the orders' scan, which they filter while it runs, so that no other order is shuffled. They must be
    few, as after recent_jobs().
    """
    few = F.broadcast(jobs.select(F.col("id").alias("job_id")))
    return totals(orders.join(few, "job_id", "left_semi"))


def active_account(accounts: DataFrame, user_id, **equal) -> DataFrame:
    """(user_id) of the account of this id, with these values in other columns, if it is active."""
    rows = accounts.where(F.col("user_id") == user_id)
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows.where("is_active").limit(1)
