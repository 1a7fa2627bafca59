"""Whole flows: chats to orders, stock lists to catalogs, address sheets to codes, and chat files to lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import chat_name, date_slug, file_time, nickname, suffix, zip_code
from tallyloom.operators import catalog, history, messages, orders, zipcodes
from tallyloom.operators.extract import extracted
from tallyloom.operators.files import deduplicate_uploads
from tallyloom.sources.chats import UNDATED, UNREADABLE, fault, in_range, lines_in_range, literal_path, read_chat_csv, read_chat_lines, write_chat_lines
from tallyloom.sources.quarantine import sort_out
from tallyloom.sources.schemas import ADDRESS, OPTIONS, PRODUCT, STORED_CATALOG, ZIP
from tallyloom.sources.settings import Settings
from tallyloom.sources.stock import read_stock
from tallyloom.sources.store import Store


def extract_orders(
    spark: SparkSession,
    paths: list[str],
    extract: Callable[[list[dict]], dict | None],
    day: str,
    settings: Settings | None = None,
    after=None,
    before=None,
    zip_service: zipcodes.Service | None = None,
    quarantine: str | None = None,
    told: Callable[[dict[str, int]], None] = lambda counts: None,
) -> tuple[DataFrame, DataFrame]:
    """(orders, chats) out of chat files. orders has a row for each item, in ORDERS' fields besides time and live_time; chats has results and errors.

    Files are CSV if their names end so, and else lines of literals. Files of one name and content count once. Messages
    between after and before, both included, go to the extractor, those of CSV files normalised and without system
    messages, lines as they stand; a chat without any is asked about too. A CSV chat's time is its last row's, that of
    lines is in the file's name. Chats are numbered in order of the files, which is that of paths for uploads of different
    names. Postal codes are looked up for search addresses where there is a service. With a quarantine, a folder that isn't
    there yet, lines that can't be read, or whose dates can't, are set aside there with the reason, and `told` gets their counts.
    """
    s = settings or Settings()
    files = manifest(spark, paths)
    named = deduplicate_uploads(files).join(files.select("path", "ord"), "ord").select("path", "display", "position")
    known = files.select("path", F.lit(True).alias("_listed")).join(named.select("path", "display"), "path", "left")
    literal = [literal_path(p) for p in paths]
    csv, other = [p for p in literal if p.endswith(".csv")], [p for p in literal if not p.endswith(".csv")]
    kept, times = [], []
    if csv:
        rows = _of_files(read_chat_csv(spark, csv), known)
        times.append(messages.last_time(rows, chat="display"))
        kept.append(messages.normalised(in_range(rows, after, before), s.exclude))
    if other:
        rows = read_chat_lines(spark, other)
        if quarantine is not None:
            done = sort_out(rows, fault(rows), [UNREADABLE, UNDATED], quarantine)
            told(done.counts)
            # undated lines stay where no bound is given, as without a quarantine
            rows = done.kept if after or before else done.kept.unionByName(done.set_aside.where(F.col("reason") == UNDATED).drop("reason"))
        rows = _of_files(rows, known)
        times.append(named.where(suffix(F.col("display")) != ".csv").select("display", file_time(F.col("display"), strict=False).alias("time")))
        kept.append(lines_in_range(rows, after, before))
    kept = reduce(DataFrame.unionByName, [k.select("display", "ord", "user", "message") for k in kept])
    times = reduce(DataFrame.unionByName, times)
    chats = messages.as_arrays(kept, chat="display")
    chats = named.select("display", F.col("position").alias("ord")).join(times, "display", "left").join(chats, "display", "left")
    none = F.array().cast(chats.schema["messages"].dataType)
    done = extracted(chats.withColumn("messages", F.coalesce("messages", none)), extract)
    is_csv = suffix(F.col("display")) == ".csv"
    name = F.when(is_csv, chat_name(F.col("display"), s.prefix)).otherwise(chat_name(F.col("display")))
    named_chats = done.withColumns({"chat_name": name, "live_time": F.lit(after).cast("timestamp_ntz")})
    made = orders.explode_items(orders.number_orders(named_chats, day))
    if zip_service is not None:
        made = zipcodes.look_up(made, zip_service, address="search_address")
    return made, done.withColumnRenamed("display", "file")


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, name, content, ord) of the files in paths, a row each: content is their SHA-256; the files themselves stay where they are.

    Paths are names of files, not patterns. One that isn't found raises.
    """
    listed = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "asked string, ord long")
    files = spark.read.format("binaryFile").load([literal_path(p) for p in paths])
    tail = lambda c: F.regexp_replace(c, r"^(file:)?/*", "")
    lost = listed.join(files.select("path"), tail(F.col("path")) == tail(F.col("asked")), "left_anti").select("asked").take(3)
    if lost:
        raise FileNotFoundError(f"not found as they are named: {', '.join(r['asked'] for r in lost)}")
    found = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("content"))
    return found.join(listed, tail(F.col("path")) == tail(F.col("asked"))).select("path", "name", "content", "ord")


def _of_files(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with display, the name of their file. Rows of a repeated file go; rows of a file that isn't listed raise."""
    unknown = F.raise_error(F.concat(F.lit("read, but not listed: "), "path")).cast("boolean")
    return rows.join(known, "path", "left").where(F.when(F.col("_listed").isNull(), unknown).otherwise(F.col("display").isNotNull())).drop("_listed")


def store_run(made: DataFrame, chats: DataFrame, folder: str, job_id: str, user_id: str, catalog_json: str, as_of: str, title: str = "", live_start_time: str | None = None, model: str = "") -> None:
    """Store a run: its job, its orders and its training records, all of them or none. A job that is stored again is replaced."""
    job = {"id": job_id, "user_id": user_id, "title": title, "live_start_time": live_start_time, "model": model, "created_at": as_of}
    tables = {"extracted_orders": history.order_records(made, job_id, as_of), "training_data": history.training_records(chats, job_id, user_id, catalog_json, as_of)}
    Store(made.sparkSession, folder).put(job, tables)


def jobs_of(spark: SparkSession, folder: str, user_id: str, limit: int = 5) -> DataFrame:
    """A user's newest jobs with their totals and labels, newest first. Totals were counted when the jobs were stored; no orders are read."""
    jobs = history.recent_jobs(Store(spark, folder).jobs(user_id), user_id, limit)
    return history.labelled(jobs.drop("run", "committed")).orderBy(F.desc("created_at"), F.desc("id"))


def job_sheet(spark: SparkSession, folder: str, job_id: str, settings: Settings | None = None) -> DataFrame:
    """A stored job's orders as an output sheet, with postal codes as five digits, in order of their numbers as text."""
    store = Store(spark, folder)
    rows = history.orders_of(store.rows("extracted_orders", store.job(job_id)), job_id)
    made = orders.without(rows.withColumn("zip_code", zip_code(F.col("zip_code"))))
    return orders.sheet(made, (settings or Settings()).columns)


def job_catalog(spark: SparkSession, folder: str, job_id: str) -> str | None:
    """The catalog that a job was run with, as one indented JSON object; None if it has none. Stored catalogs are lists of products with their options."""
    store = Store(spark, folder)
    rows = history.catalog_of(store.rows("training_data", store.job(job_id)))
    listed = rows.select(F.posexplode(F.from_json("catalog_json", STORED_CATALOG)).alias("ord", "entry")).select("ord", f"entry.{PRODUCT}", f"entry.{OPTIONS}")
    found = catalog.last_of_each(listed, PRODUCT, OPTIONS)
    return None if found.isEmpty() else catalog.to_json(found)


def stock_catalog(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The catalog of stock lists."""
    return catalog.build(read_stock(spark, paths), "product", "option")


def code_sheet(rows: DataFrame, service: zipcodes.Service, rewrite: zipcodes.Service | None = None) -> DataFrame:
    """An address sheet with codes: in their column if it has one, else in a new one behind the addresses."""
    made = zipcodes.look_up(rows, service, rewrite, ADDRESS, ZIP)
    return made if ZIP in rows.columns else zipcodes.beside(made, ZIP, ADDRESS)


def convert(spark: SparkSession, paths: str | list[str], folder: str, prefix: str, exclude: list[str], after=None) -> None:
    """Chat files as lines of dict literals, partitioned by the new file name: nickname and the slug of the last row's date."""
    rows = in_range(read_chat_csv(spark, paths), after)
    ends = messages.first_last_time(rows)
    names = ends.select("file", F.concat(nickname(F.col("file"), prefix), F.lit("_"), date_slug(F.col("last"))).alias("name"))
    write_chat_lines(messages.excluded_first(rows, exclude).join(names, "file"), folder, by="name")
