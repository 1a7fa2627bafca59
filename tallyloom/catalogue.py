"""Queries over the driver's tables, one or more for each operator, and the SQL that says what they return.

The tables hold no chats, catalogs or address sheets, so each query builds such a frame out of what they hold: a
conversation is a chat, a brand is a product and a part's type its option, a customer's nation is an address, and so on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import addresses, catalog, extract, files, history, matching, messages, numbering, orders, zipcodes
from tallyloom.operators.calls import Ledger, Policy
from tallyloom.session import shared_folder, spread
from tallyloom.sources import chats as chat_files
from tallyloom.sources.chats import in_range, lines_in_range
from tallyloom.sources.quarantine import sort_out
from tallyloom.sources.schemas import OUTPUT_COLUMNS
from tallyloom.sources.store import Store

QUERIES: dict = {}
ORACLES: dict = {}

EXCLUDED = ["The be ", "Èauxaux", "Rees "]
AFTER, BEFORE = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
DAY = "20260315"


def query(sql: str | None = None):
    """Register a query, and its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.select(*columns) if columns else table


# --- messages -------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS message FROM conversations")
def msg_normalize(spark, sf_dir):
    return messages.normalised(read(spark, sf_dir, "conversations", "conv_id", "turn", F.col("text").alias("message")))


@query(
    "SELECT * FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS message FROM conversations) "
    "WHERE NOT (starts_with(message, 'The be ') OR starts_with(message, 'Èauxaux') OR starts_with(message, 'Rees '))"
)
def msg_exclude_prefix(spark, sf_dir):
    return messages.normalised(read(spark, sf_dir, "conversations", "conv_id", "turn", F.col("text").alias("message")), EXCLUDED)


@query(
    "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS message FROM conversations "
    "WHERE NOT (starts_with(text, 'The be ') OR starts_with(text, 'Èauxaux') OR starts_with(text, 'Rees '))"
)
def converter_exclude(spark, sf_dir):
    return messages.excluded_first(read(spark, sf_dir, "conversations", "conv_id", "turn", F.col("text").alias("message")), EXCLUDED)


@query(f"SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '{AFTER}' AND ts <= TIMESTAMP '{BEFORE}'")
def time_range_inclusive(spark, sf_dir):
    return in_range(read(spark, sf_dir, "events", "event_id", "ts", "user_id"), AFTER, BEFORE, date="ts")


@query(
    f"SELECT event_id, date FROM (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'no date' "
    f"WHEN event_type = 'signup' THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS date FROM events) "
    f"WHERE event_type = 'signup' OR (try_strptime(date, '%Y-%m-%d %H:%M:%S') >= TIMESTAMP '{AFTER}' AND try_strptime(date, '%Y-%m-%d %H:%M:%S') <= TIMESTAMP '{BEFORE}')"
)
def line_time_range(spark, sf_dir):
    rows = read(spark, sf_dir, "events", "event_id", "ts", "event_type")
    date = F.when(F.col("event_type") == "error", "no date").when(F.col("event_type") != "signup", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = rows.select("event_id", date.alias("date"), (F.col("event_type") != "signup").alias("has_date"), F.lit(False).alias("bad"))
    return lines_in_range(rows, AFTER, BEFORE).select("event_id", "date")


@query(
    f"SELECT reason, count(*) AS n, count(*) AS stored FROM (SELECT CASE event_type WHEN 'error' THEN '{chat_files.UNREADABLE}' WHEN 'signup' THEN '{chat_files.UNDATED}' END AS reason FROM events) WHERE reason IS NOT NULL GROUP BY reason "
    "UNION ALL SELECT 'kept', count(*), count(*) FROM events WHERE event_type NOT IN ('error', 'signup')"
)
def bad_lines(spark, sf_dir):
    """Lines of literals, of which errors miss their end and signups a date that can be read: what was counted on the way, and what was stored."""
    rows = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    date = F.when(F.col("event_type") == "signup", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    end = F.when(F.col("event_type") == "error", "").otherwise("}")
    line = F.concat(F.lit("{'user': '"), F.col("user_id").cast("string"), F.lit("', 'message': '"), "event_type", F.lit("', 'date': '"), date, F.lit("'"), end)
    said = chat_files.read_literals(rows.select(F.lit("events").alias("path"), F.lit("events").alias("file"), F.col("event_id").alias("ord"), line.alias("line")))
    done = sort_out(said, chat_files.fault(said), [chat_files.UNREADABLE, chat_files.UNDATED], f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}")
    seen = spark.createDataFrame([(r, n) for r, n in done.counts.items() if r != "rows"], "reason string, n long")
    stored = done.set_aside.groupBy("reason").agg(F.count("*").alias("stored")).union(done.kept.select(F.lit("kept"), F.lit(1)).groupBy("kept").agg(F.count("*")))
    return seen.join(stored, "reason")


@query("SELECT event_id, ts FROM events WHERE strftime(ts, '%Y-%m-%d %H:%M:%S') >= '2024-01-05 00:00:00'")
def converter_time_after(spark, sf_dir):
    return in_range(read(spark, sf_dir, "events", "event_id", "ts"), AFTER, date="ts")


@query("SELECT user_id, arg_max(ts, event_id) AS time FROM events GROUP BY user_id")
def last_row_timestamp(spark, sf_dir):
    return messages.last_time(read(spark, sf_dir, "events", "user_id", "event_id", "ts"), "user_id", "event_id", "ts")


@query("SELECT user_id, arg_min(ts, event_id) AS first, arg_max(ts, event_id) AS last FROM events GROUP BY user_id")
def first_last_date(spark, sf_dir):
    return messages.first_last_time(read(spark, sf_dir, "events", "user_id", "event_id", "ts"), "user_id", "event_id", "ts")


# --- scalar functions -----------------------------------------------------------------------------------------------

_P = "lpad(CAST(c_custkey % 100000000 AS VARCHAR), 8, '0')"
_RAW_PHONE = (
    f"CASE c_custkey % 5 WHEN 0 THEN '010' || {_P} WHEN 1 THEN '010 ' || substr({_P}, 1, 4) || ' ' || substr({_P}, 5) WHEN 2 THEN '+82 10-' || {_P} WHEN 3 THEN '02-' || {_P} ELSE NULL END"
)


@query(
    f"SELECT c_custkey, raw, CASE WHEN length(regexp_replace(raw, '\\D', '', 'g')) = 11 AND starts_with(regexp_replace(raw, '\\D', '', 'g'), '010') "
    f"THEN substr(d, 1, 3) || '-' || substr(d, 4, 4) || '-' || substr(d, 8, 4) ELSE raw END AS phone "
    f"FROM (SELECT c_custkey, raw, regexp_replace(raw, '\\D', '', 'g') AS d FROM (SELECT c_custkey, {_RAW_PHONE} AS raw FROM customer))"
)
def phone_format(spark, sf_dir):
    p = F.lpad((F.col("c_custkey") % 100_000_000).cast("string"), 8, "0")
    kind = F.col("c_custkey") % 5
    raw = F.when(kind == 0, F.concat(F.lit("010"), p)).when(kind == 1, F.concat(F.lit("010 "), F.substring(p, 1, 4), F.lit(" "), F.substring(p, 5, 4)))
    raw = raw.when(kind == 2, F.concat(F.lit("+82 10-"), p)).when(kind == 3, F.concat(F.lit("02-"), p))
    return read(spark, sf_dir, "customer", "c_custkey", raw.alias("raw")).withColumn("phone", text.phone(F.col("raw")))


_RAW_ZIP = "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ' ' || CAST(c_custkey AS VARCHAR) WHEN 3 THEN '123-' || CAST(1000 + c_custkey AS VARCHAR) WHEN 4 THEN ' abc ' ELSE CAST(c_custkey % 10 AS VARCHAR) || '-1' END"


@query(
    f"SELECT c_custkey, raw, CASE WHEN raw IS NULL OR trim(raw) = '' THEN '' WHEN d = '' THEN trim(raw) WHEN length(d) <= 5 THEN lpad(d, 5, '0') ELSE d END AS zip_code "
    f"FROM (SELECT c_custkey, raw, regexp_replace(raw, '\\D', '', 'g') AS d FROM (SELECT c_custkey, {_RAW_ZIP} AS raw FROM customer))"
)
def zip_normalize(spark, sf_dir):
    kind, own = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    raw = F.when(kind == 1, "  ").when(kind == 2, F.concat(F.lit(" "), own)).when(kind == 3, F.concat(F.lit("123-"), (1000 + F.col("c_custkey")).cast("string")))
    raw = raw.when(kind == 4, " abc ").when(kind == 5, F.concat((F.col("c_custkey") % 10).cast("string"), F.lit("-1")))
    return read(spark, sf_dir, "customer", "c_custkey", raw.alias("raw")).withColumn("zip_code", text.zip_code(F.col("raw")))


_FILE = "CASE c_custkey % 4 WHEN 0 THEN 'mode_' || c_name || '.csv' WHEN 1 THEN c_name || '_2026-03-12-10-17-22.jsonl' WHEN 2 THEN c_name || '.csv' ELSE 'mode_.csv' END"


@query(
    f"SELECT c_custkey, CASE WHEN starts_with(stem, 'mode_') THEN substr(stem, 6) ELSE nullif(regexp_replace(stem, '_\\d{{4}}-\\d{{2}}-\\d{{2}}-\\d{{2}}-\\d{{2}}-\\d{{2}}$', ''), '') END AS chat_name "
    f"FROM (SELECT c_custkey, regexp_replace({_FILE}, '\\.[^.]+$', '') AS stem FROM customer)"
)
def chat_name(spark, sf_dir):
    kind, own = F.col("c_custkey") % 4, F.col("c_name")
    file = F.when(kind == 0, F.concat(F.lit("mode_"), own, F.lit(".csv"))).when(kind == 1, F.concat(own, F.lit("_2026-03-12-10-17-22.jsonl"))).when(kind == 2, F.concat(own, F.lit(".csv"))).otherwise("mode_.csv")
    return read(spark, sf_dir, "customer", "c_custkey", text.chat_name(file, "mode_", normal=lambda c: c).alias("chat_name"))


@query(
    "SELECT c_custkey, CASE WHEN starts_with(stem, nfc_normalize('모드_')) THEN substr(stem, length(nfc_normalize('모드_')) + 1) ELSE stem END AS chat_name "
    "FROM (SELECT c_custkey, nfc_normalize(CASE WHEN c_custkey % 2 = 0 THEN '\u1106\u1169\u1103\u1173_' || c_name ELSE '\u1112\u1161\u11ab ' || c_name END) AS stem FROM customer)"
)
def chat_name_decomposed(spark, sf_dir):
    """File names whose Hangul syllables are written letter by letter."""
    file = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("\u1106\u1169\u1103\u1173_"), "c_name", F.lit(".csv"))).otherwise(F.concat(F.lit("\u1112\u1161\u11ab "), "c_name", F.lit(".csv")))
    return read(spark, sf_dir, "customer", "c_custkey", text.chat_name(file, "모드_").alias("chat_name"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Other' || c_name END AS nickname FROM (SELECT c_custkey, replace(c_name, 'Customer#', '') AS c_name FROM customer)")
def nickname(spark, sf_dir):
    file = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/in/"), "c_name", F.lit(".csv"))).otherwise(F.concat(F.lit("Other"), F.replace("c_name", F.lit("Customer#"), F.lit("")), F.lit(".csv")))
    return read(spark, sf_dir, "customer", "c_custkey", text.nickname(file, "Customer#").alias("nickname"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS file_time FROM orders")
def filename_timestamp(spark, sf_dir):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd-HH-mm-ss")
    file = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("chat_"), stamp, F.lit(".jsonl"))).otherwise("chat.csv")
    return read(spark, sf_dir, "orders", "o_orderkey", text.file_time(file).alias("file_time"))


@query("SELECT event_id, translate(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' :', '--') AS slug FROM events")
def end_date_slug(spark, sf_dir):
    return read(spark, sf_dir, "events", "event_id", text.date_slug(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("slug"))


@query("SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[^\\x20-\\x7E]', '', 'g'), '^ +| +$', '', 'g') AS ascii FROM conversations")
def printable_ascii(spark, sf_dir):
    return read(spark, sf_dir, "conversations", "conv_id", "turn", text.printable_ascii(F.col("text")).alias("ascii"))


# --- catalogs -------------------------------------------------------------------------------------------------------


def _catalog(spark, sf_dir) -> DataFrame:
    return catalog.build(read(spark, sf_dir, "part", "p_brand", "p_type", F.col("p_partkey").alias("ord")), "p_brand", "p_type")


_CATALOG = "SELECT p_brand AS product, min(ord) AS ord, count(*) AS n, string_agg(p_type, '|' ORDER BY ord) AS options FROM (SELECT p_brand, p_type, min(p_partkey) AS ord FROM part GROUP BY ALL) GROUP BY p_brand"


@query(f"SELECT product, ord, options FROM ({_CATALOG})")
def catalog_build(spark, sf_dir):
    return _catalog(spark, sf_dir).select("product", "ord", F.array_join("options", "|").alias("options"))


@query("SELECT count(DISTINCT p_brand) AS products, count(DISTINCT (p_brand, p_type)) AS options, 0::BIGINT AS single FROM part")
def catalog_stats(spark, sf_dir):
    return catalog.counts(_catalog(spark, sf_dir))


_STOCK = (
    "(SELECT c_custkey AS ord, CASE c_custkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN NULL WHEN 2 THEN 'nan' ELSE ' P' || CAST(c_nationkey AS VARCHAR) || ' ' END AS product, "
    "CASE WHEN c_nationkey % 3 = 0 THEN '단일상품' WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS option FROM customer)"
)


def _stock(spark, sf_dir) -> DataFrame:
    """A stock list with blank products, missing options, and products that have but a single one."""
    kind = F.col("c_custkey") % 5
    product = F.when(kind == 0, "  ").when(kind == 2, "nan").when(kind > 2, F.concat(F.lit(" P"), F.col("c_nationkey").cast("string"), F.lit(" ")))
    option = F.when(F.col("c_nationkey") % 3 == 0, "단일상품").when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    return catalog.build(read(spark, sf_dir, "customer", F.col("c_custkey").alias("ord"), product.alias("product"), option.alias("option")), "product", "option")


@query(
    f"SELECT product, min(ord) AS ord, coalesce(string_agg(option, '|' ORDER BY ord) FILTER (option IS NOT NULL), '') AS options FROM (SELECT trim(product) AS product, option, min(ord) AS ord FROM {_STOCK} WHERE coalesce(trim(product), '') NOT IN ('', 'nan') GROUP BY ALL) GROUP BY product"
)
def catalog_without_blanks(spark, sf_dir):
    return _stock(spark, sf_dir).select("product", "ord", F.array_join("options", "|").alias("options"))


@query(
    f"SELECT count(*) AS products, CAST(sum(n) AS BIGINT) AS options, count(*) FILTER (n = 1 AND one = '단일상품') AS single FROM (SELECT trim(product) AS p, count(DISTINCT option) AS n, min(option) AS one FROM {_STOCK} WHERE coalesce(trim(product), '') NOT IN ('', 'nan') GROUP BY 1)"
)
def catalog_single_option(spark, sf_dir):
    return catalog.counts(_stock(spark, sf_dir))


@query(f"SELECT row_number() OVER (ORDER BY ord) AS \"#\", product, replace(options, '|', ', ') AS options, n AS n_options FROM ({_CATALOG})")
def catalog_listing(spark, sf_dir):
    return catalog.listing(_catalog(spark, sf_dir))


@query("SELECT p_brand AS product, row_number() OVER (PARTITION BY p_brand ORDER BY ord) - 1 AS option_no, p_type AS option FROM (SELECT p_brand, p_type, min(p_partkey) AS ord FROM part GROUP BY ALL)")
def catalog_explode(spark, sf_dir):
    return catalog.to_rows(_catalog(spark, sf_dir))


@query(f"SELECT product, options FROM ({_CATALOG})")
def catalog_roundtrip(spark, sf_dir):
    return catalog.from_rows(catalog.to_rows(_catalog(spark, sf_dir))).select("product", F.array_join("options", "|").alias("options"))


@query("SELECT p_brand AS product, min(p_partkey) AS ord, arg_max(p_name, p_partkey) AS options FROM part GROUP BY p_brand")
def catalog_reexport(spark, sf_dir):
    entries = read(spark, sf_dir, "part", "p_brand", F.array("p_name").alias("options"), F.col("p_partkey").alias("ord"))
    return catalog.last_of_each(entries, "p_brand").select("product", "ord", F.array_join("options", "|").alias("options"))


# --- orders ---------------------------------------------------------------------------------------------------------


def _chats(spark, sf_dir) -> DataFrame:
    """Each order with its lines as the items of an extraction result; orders without lines have none."""
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    item = F.struct(F.col("l_partkey").cast("string").alias("product"), F.col("l_suppkey").cast("string").alias("option"), F.col("l_quantity").cast("long").alias("volume"))
    items = lines.groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    head = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    none = F.array().cast("array<struct<product:string,option:string,volume:bigint>>")
    result = F.struct(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("order_name"), F.concat(F.lit("010"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("phone_number"), F.col("o_orderpriority").alias("address"), F.lit(None).cast("string").alias("search_address"), F.coalesce("items", none).alias("items"))
    return head.join(items, head["o_orderkey"] == items["l_orderkey"], "left").select(F.col("o_orderkey").alias("ord"), F.col("o_orderdate").alias("time"), F.concat(F.lit("chat "), F.col("o_orderkey").cast("string")).alias("chat_name"), F.lit(AFTER).cast("timestamp_ntz").alias("live_time"), result.alias("result"))


_NUMBERS = f"(SELECT o_orderkey, '{DAY}' || printf('%03d', row_number() OVER (ORDER BY o_orderkey)) AS order_number FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"
_ITEMS = "CAST(l_partkey AS VARCHAR) AS product, CAST(l_suppkey AS VARCHAR) AS option, CAST(l_quantity AS BIGINT) AS volume"


@query(
    f"SELECT 'chat ' || CAST(o_orderkey AS VARCHAR) AS chat_name, {_ITEMS}, 'C' || CAST(o_custkey AS VARCHAR) AS order_name, '010-' || substr(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 1, 4) || '-' || substr(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 5) AS phone_number, "
    f"o_orderpriority AS address, order_number FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN {_NUMBERS} USING (o_orderkey)"
)
def order_explode(spark, sf_dir):
    made = orders.explode_items(orders.number_orders(_chats(spark, sf_dir), DAY))
    return made.select("chat_name", "product", "option", "volume", "order_name", "phone_number", "address", "order_number")


@query(f"SELECT 'chat ' || CAST(o_orderkey AS VARCHAR) AS chat_name, order_number FROM {_NUMBERS}")
def order_number(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("ord")).distinct()
    chats = read(spark, sf_dir, "orders", F.col("o_orderkey").alias("ord")).join(lines, "ord", "left_semi")
    return orders.number_orders(chats, DAY, has_items=F.lit(True)).select(F.concat(F.lit("chat "), F.col("ord").cast("string")).alias("chat_name"), "order_number")


@query(
    'SELECT order_number AS "주문번호", CAST(l_partkey AS VARCHAR) AS "상품명", CAST(l_suppkey AS VARCHAR) AS "옵션명", CAST(l_quantity AS BIGINT) AS "수량", \'chat \' || CAST(o_orderkey AS VARCHAR) AS "채팅명", '
    "'C' || CAST(o_custkey AS VARCHAR) AS \"수령자\", '010-' || substr(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 1, 4) || '-' || substr(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 5) AS \"전화번호\", "
    f"o_orderpriority AS \"주소\", '' AS \"우편번호\" FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN {_NUMBERS} USING (o_orderkey)"
)
def output_projection(spark, sf_dir):
    return orders.sheet(orders.without(orders.explode_items(orders.number_orders(_chats(spark, sf_dir), DAY))), OUTPUT_COLUMNS)


_WORDS = "(SELECT conv_id, turn, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM conversations WHERE role = 'user')"


@query(f"SELECT conv_id, turn, w[1] AS product, w[len(w)] AS option, len(w) AS volume FROM {_WORDS} WHERE len(w) >= {extract.LEAST_WORDS}")
def extract_structural(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("message"))
    return extract.structural_items(said).select("conv_id", "turn", "product", "option", "volume")


@query(
    f"WITH items AS (SELECT * FROM {_WORDS} WHERE len(w) >= {extract.LEAST_WORDS}), numbers AS (SELECT conv_id, '{DAY}' || printf('%03d', row_number() OVER (ORDER BY conv_id)) AS order_number FROM (SELECT DISTINCT conv_id FROM items)) "
    'SELECT order_number AS "주문번호", w[1] AS "상품명", w[len(w)] AS "옵션명", len(w) AS "수량", \'chat \' || CAST(conv_id AS VARCHAR) AS "채팅명", \'user \' || CAST(conv_id AS VARCHAR) AS "수령자", '
    "'010-' || substr(lpad(CAST(conv_id AS VARCHAR), 8, '0'), 1, 4) || '-' || substr(lpad(CAST(conv_id AS VARCHAR), 8, '0'), 5) AS \"전화번호\", '' AS \"주소\", '' AS \"우편번호\" FROM items JOIN numbers USING (conv_id)"
)
def order_sheet(spark, sf_dir):
    """Conversations to an output sheet: messages normalised, items extracted, chats numbered, columns projected."""
    said = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("message"))
    items = extract.structural_items(messages.normalised(said)).select("conv_id", "product", "option", "volume")
    chats = orders.number_orders(items.select("conv_id").distinct(), DAY, ord="conv_id", has_items=F.lit(True))
    number = F.concat(F.lit("010"), F.lpad(F.col("conv_id").cast("string"), 8, "0"))
    own = lambda name: F.concat(F.lit(f"{name} "), F.col("conv_id").cast("string"))
    made = items.join(chats, "conv_id").select("order_number", "product", "option", "volume", own("chat").alias("chat_name"), own("user").alias("order_name"), text.phone(number).alias("phone_number"))
    return orders.sheet(made, OUTPUT_COLUMNS)


@query("SELECT conv_id, string_agg(role || ':' || text, '\n' ORDER BY turn) AS chat, count(*) AS n FROM conversations GROUP BY conv_id")
def training_records(spark, sf_dir):
    chats = messages.as_arrays(read(spark, sf_dir, "conversations", "conv_id", "turn", F.col("role").alias("user"), F.col("text").alias("message")), "conv_id", "turn")
    told = F.array_join(F.transform("messages", lambda m: F.concat(m["user"], F.lit(":"), m["message"])), "\n")
    return chats.select("conv_id", told.alias("chat"), F.size("messages").cast("long").alias("n"))


@query("SELECT CAST(conv_id AS VARCHAR) AS chat_filename, to_json(list({'user': role, 'message': text} ORDER BY turn)) AS chat_json, '{\"items\":[]}' AS predicted_json, false AS is_verified FROM conversations GROUP BY conv_id")
def training_json(spark, sf_dir):
    """Training records as they are stored, chats and results as compact JSON."""
    chats = messages.as_arrays(read(spark, sf_dir, "conversations", F.col("conv_id").cast("string").alias("file"), "turn", F.col("role").alias("user"), F.col("text").alias("message")), "file", "turn")
    chats = chats.withColumn("result", F.struct(F.array().cast("array<string>").alias("items")))
    return history.training_records(chats, "1", "me", "[]", "2026-01-01").select("chat_filename", "chat_json", "predicted_json", "is_verified")


@query(
    "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS product, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS option, CAST(l_quantity AS BIGINT) AS volume, l_linestatus AS order_name, CAST(NULL AS VARCHAR) AS address FROM lineitem WHERE l_linenumber % 5 <> 0"
)
def result_json(spark, sf_dir):
    """Answers of an extractor, JSON text, read in their schema: absent and null fields are null, text that is no JSON is no result."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    option = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('"'), "l_returnflag", F.lit('"'))).otherwise("null")
    told = F.concat(F.lit('{"order_name": "'), "l_linestatus", F.lit('", "more": 1, "items": [{"product": "'), F.col("l_partkey").cast("string"), F.lit('", "option": '), option, F.lit(', "volume": '), F.col("l_quantity").cast("long").cast("string"), F.lit("}]}"))
    said = F.when(F.col("l_linenumber") % 5 != 0, told).otherwise("no answer")
    made = rows.select("l_orderkey", "l_linenumber", extract.parsed(said).alias("result")).select("l_orderkey", "l_linenumber", F.explode("result.items").alias("item"), "result.order_name", "result.address")
    return made.select("l_orderkey", "l_linenumber", "item.product", "item.option", "item.volume", "order_name", "address")


_SAID = "p_name || 's, no ' || p_brand || ' but ' || l_linenumber::VARCHAR || ' ' || p_name || ' and ' || (l_quantity::BIGINT)::VARCHAR || 'x ' || p_brand || p_type || ', small' || p_name || ' ' || p_brand"
_SAID_NAMES = "(SELECT p_name AS name FROM part UNION SELECT split_part(p_name, ' ', 2) FROM part UNION SELECT p_brand FROM part)"


def _said(spark, sf_dir) -> DataFrame:
    """A message for each order line: names of its part by themselves, and within longer words."""
    rows = spread(read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")).join(read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    parts = ["p_name", F.lit("s, no "), "p_brand", F.lit(" but "), F.col("l_linenumber").cast("string"), F.lit(" "), "p_name", F.lit(" and "), F.col("l_quantity").cast("long").cast("string"), F.lit("x "), "p_brand", "p_type", F.lit(", small"), "p_name", F.lit(" "), "p_brand"]
    return rows.select("l_orderkey", "l_linenumber", F.concat(*parts).alias("message"))


@query(
    f"WITH p AS (SELECT '\\b(?:' || string_agg(name, '|' ORDER BY length(name) DESC, name) || ')\\b' AS p FROM {_SAID_NAMES}), "
    f"t AS (SELECT l_orderkey, l_linenumber, regexp_extract_all({_SAID}, (SELECT p FROM p)) AS f FROM lineitem JOIN part ON l_partkey = p_partkey) "
    "SELECT l_orderkey, l_linenumber, unnest(range(1, len(f) + 1))::INT AS n, unnest(f) AS found FROM t"
)
def catalog_matches(spark, sf_dir):
    """Names of parts, brands and kinds, found in messages: the longest at each place, and none within a word."""
    part = read(spark, sf_dir, "part", "p_name", "p_brand")
    names = part.select(F.explode(F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(2)), "p_brand")).alias("name"))
    return matching.matches(_said(spark, sf_dir), names).select("l_orderkey", "l_linenumber", "n", "found")


@query(
    "WITH t AS (SELECT l_orderkey, l_linenumber, p_name, p_brand, l_quantity::BIGINT AS q, (SELECT count(DISTINCT p_brand) FROM part x WHERE x.p_name = part.p_name) AS k FROM lineitem JOIN part ON l_partkey = p_partkey) "
    "SELECT l_orderkey, l_linenumber, 1 AS n, p_name AS product, p_brand AS option, q AS volume FROM t "
    "UNION ALL SELECT l_orderkey, l_linenumber, 2, p_name, CASE WHEN k = 1 THEN p_brand END, 1 FROM t"
)
def extract_by_catalog(spark, sf_dir):
    """Items said in messages, by a catalog of part names with their brands as options; the second one is said without brand or number."""
    part = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    listed = catalog.build(part.select("p_name", "p_brand", F.col("p_partkey").alias("ord")), "p_name", "p_brand").select("product", "options")
    rows = spread(read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    said = F.concat(F.lit("please, "), "p_name", F.lit(": "), "p_brand", F.lit(" x "), F.col("l_quantity").cast("long").cast("string"), F.lit(". And a "), "p_name", F.lit(", thanks"))
    return matching.catalog_items(rows.select("l_orderkey", "l_linenumber", said.alias("message")), listed).drop("message")


# --- uploads --------------------------------------------------------------------------------------------------------


@query(
    "WITH f AS (SELECT source AS name, text, min(doc_id) AS ord FROM documents GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) AS i, count(*) OVER (PARTITION BY name) AS c, min(ord) OVER (PARTITION BY name) AS first FROM f) "
    "SELECT name || '.csv' AS name, ord, sha256(text) AS hash, CASE WHEN c = 1 THEN name || '.csv' ELSE name || '(' || CAST(i AS VARCHAR) || ').csv' END AS display, row_number() OVER (ORDER BY first, i) AS position FROM n"
)
def upload_dedupe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", F.concat("source", F.lit(".csv")).alias("name"), F.col("text").alias("content"), F.col("doc_id").alias("ord"))
    return files.deduplicate_uploads(docs)


# --- services -------------------------------------------------------------------------------------------------------


def answer(name: str) -> str | None:
    """A service that knows no rings and fails for bolts."""
    if "bolt" in name:
        raise ValueError("busy")
    return None if "ring" in name else name.upper()


@query("SELECT DISTINCT p_name AS request, CASE WHEN NOT contains(p_name, 'bolt') AND NOT contains(p_name, 'ring') THEN upper(p_name) END AS answer, CASE WHEN contains(p_name, 'bolt') THEN 'ValueError: busy' END AS error FROM part")
def service_answers(spark, sf_dir):
    """Answers of a service for names of parts, by a ledger that knows some from an earlier run."""
    ledger = Ledger(answer, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}", policy=Policy(wait=0.0, attempts=2, parts=4))
    names = read(spark, sf_dir, "part", F.col("p_name").alias("request"))
    ledger.answers(names.where("request < 'h'"))
    return ledger.answers(names)


# --- postal codes ---------------------------------------------------------------------------------------------------

_ADDR = "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ' ' || n_name || ' ' ELSE n_name END"
_ADDRS = f"(SELECT c_custkey, {_ADDR} AS address FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _addresses(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(read(spark, sf_dir, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.col("c_custkey") % 7
    address = F.when(kind == 1, "  ").when(kind == 2, F.concat(F.lit(" "), "n_name", F.lit(" "))).when(kind > 2, F.col("n_name"))
    return rows.select("c_custkey", address.alias("address"))


def _codes(spark, sf_dir, third: int, name=lambda c: c) -> zipcodes.Service:
    known = read(spark, sf_dir, "nation").where(F.col("n_nationkey") % 3 == third)
    return zipcodes.from_table(known.select(name(F.col("n_name")).alias("address"), (100 * F.col("n_nationkey") + 7).alias("zip_code")))


def _both_codes(spark, sf_dir) -> tuple[zipcodes.Service, zipcodes.Service]:
    """Codes of a third of the nations by name, and of another third by a name that the rewriting step gives them."""
    nation = read(spark, sf_dir, "nation")
    name = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.concat(F.lit("road "), "n_name"))
    known = nation.where(F.col("n_nationkey") % 3 < 2).select(name.alias("address"), (100 * F.col("n_nationkey") + 7).alias("zip_code"))
    rewrite = lambda addrs: addrs.select("addr", F.concat(F.lit("road "), "addr").alias("search"))
    return zipcodes.from_table(known), rewrite


def _joined(thirds: str) -> str:
    return f"SELECT c_custkey, address, CASE WHEN n_nationkey IS NULL THEN '' ELSE lpad(CAST(100 * n_nationkey + 7 AS VARCHAR), 5, '0') END AS zip_code FROM {_ADDRS} LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 IN ({thirds})) ON n_name = trim(address)"


@query(_joined("0"))
def zip_lookup_join(spark, sf_dir):
    return zipcodes.look_up(_addresses(spark, sf_dir), _codes(spark, sf_dir, 0))


@query(_joined("0, 1"))
def zip_lookup_fallback(spark, sf_dir):
    return zipcodes.look_up(_addresses(spark, sf_dir), *_both_codes(spark, sf_dir))


_WORDED = "CASE c_custkey % 5 WHEN 0 THEN n_name || ', ' || r_name WHEN 1 THEN substr(n_name, 1, 2) || substr(n_name, 4) || ' ' || r_name WHEN 2 THEN upper(r_name) || ' ' || n_name || ' ' || c_mktsegment WHEN 3 THEN n_name ELSE c_mktsegment END"
_G = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({a}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 1), lambda i: substr('^' || w || '$', i, 3)))))"


@query(
    f"WITH k AS (SELECT n_name || ' ' || r_name AS address, lpad((100 * n_nationkey + 7)::VARCHAR, 5, '0') AS code, {_G.format(a='address')} AS g FROM nation JOIN region ON n_regionkey = r_regionkey), "
    f"a AS (SELECT c_custkey, {_WORDED} AS address FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), "
    f"q AS (SELECT DISTINCT address AS addr, {_G.format(a='address')} AS g FROM a), s AS (SELECT u AS x, count(*) AS known FROM (SELECT unnest(g) AS u FROM k) GROUP BY 1), "
    "wk AS (SELECT address, code, u AS x, round(1000 * ln(1 + (SELECT count(*) FROM k) / coalesce(known, 1)))::BIGINT AS w FROM (SELECT address, code, unnest(g) AS u FROM k) LEFT JOIN s ON u = x), "
    "wq AS (SELECT addr, u AS x, round(1000 * ln(1 + (SELECT count(*) FROM k) / coalesce(known, 1)))::BIGINT AS w FROM (SELECT addr, unnest(g) AS u FROM q) LEFT JOIN s ON u = x), "
    "tk AS (SELECT address, code, sum(w) AS t FROM wk GROUP BY ALL), tq AS (SELECT addr, sum(w) AS t FROM wq GROUP BY ALL), "
    "p AS (SELECT addr, address, code, 2.0 * sum(wq.w) / (any_value(tq.t) + any_value(tk.t)) AS near FROM wq JOIN wk USING (x) JOIN tk USING (address, code) JOIN tq USING (addr) GROUP BY ALL), "
    "b AS (SELECT addr, first(code ORDER BY near DESC, address) AS code FROM p WHERE near >= 0.6 GROUP BY addr) "
    "SELECT c_custkey, address, coalesce(code, '') AS zip_code FROM a LEFT JOIN b ON addr = address"
)
def zip_lookup_nearest(spark, sf_dir):
    """Codes of addresses with letters or parts missing, or more parts than the table's, by the nearest address of the table."""
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    kind, n = F.col("c_custkey") % 5, F.col("n_name")
    worded = F.when(kind == 0, F.concat(n, F.lit(", "), "r_name")).when(kind == 1, F.concat(F.substring(n, 1, 2), F.substring(n, 4, 100), F.lit(" "), "r_name"))
    worded = worded.when(kind == 2, F.concat(F.upper("r_name"), F.lit(" "), n, F.lit(" "), "c_mktsegment")).when(kind == 3, n).otherwise(F.col("c_mktsegment"))
    known = nation.select(F.concat(n, F.lit(" "), "r_name").alias("address"), (100 * F.col("n_nationkey") + 7).alias("zip_code"))
    return zipcodes.look_up(rows.select("c_custkey", worded.alias("address")), addresses.from_index(known))


@query(f"SELECT count(*) FILTER (zip_code <> '') AS found, count(*) FILTER (zip_code = '') AS missed FROM ({_joined('0, 1')})")
def zip_found_missed(spark, sf_dir):
    return zipcodes.found_missed(zip_lookup_fallback(spark, sf_dir))


@query(f"SELECT DISTINCT trim(address) AS addr FROM {_ADDRS} WHERE trim(address) <> ''")
def distinct_addresses(spark, sf_dir):
    return _addresses(spark, sf_dir).select(text.strip(F.col("address")).alias("addr")).where("addr <> ''").distinct()


@query(_joined("0"))
def zip_beside_address(spark, sf_dir):
    """Codes in a new column right behind the addresses."""
    return zipcodes.beside(zip_lookup_join(spark, sf_dir), "zip_code", "address")


# --- history --------------------------------------------------------------------------------------------------------


def _jobs(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders", F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("live_start_time"), F.col("o_orderdate").alias("created_at"))


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_custkey = 71 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def recent_jobs(spark, sf_dir):
    return history.recent_jobs(_jobs(spark, sf_dir), 71).select("id", "created_at")


@query(
    "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS live, o_orderpriority || '  |  라이브: ' || strftime(o_orderdate, '%Y-%m-%d %H:%M') || '  |  ' || CAST(coalesce(n, 0) AS VARCHAR) || '건' AS label "
    "FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"
)
def job_labels(spark, sf_dir):
    totals = history.totals(read(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("job_id")))
    jobs = _jobs(spark, sf_dir)
    return history.labelled(jobs.join(totals, jobs["id"] == totals["job_id"], "left")).select("id", "live", "label")


@query("SELECT o_orderkey AS id, count(*) AS total_orders FROM (SELECT * FROM orders WHERE o_custkey = 71 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5) JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def recent_jobs_totals(spark, sf_dir):
    """The newest jobs of a user first, then the totals of these only."""
    recent = history.recent_jobs(_jobs(spark, sf_dir), 71).select("id")
    return history.totals_of(recent, read(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("job_id"))).withColumnRenamed("job_id", "id")


_STORED = "SELECT o_orderpriority AS job_id, o_orderkey, CAST(l_partkey AS VARCHAR) AS product, CAST(l_quantity AS BIGINT) AS volume FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"


@query(f"SELECT job_id, count(*) AS total_orders, sum(volume)::BIGINT AS volume, count(DISTINCT product) AS products FROM ({_STORED}) GROUP BY job_id")
def stored_jobs(spark, sf_dir):
    """Orders of two priorities stored as two jobs, one of them twice, beside a run that wasn't committed: totals as committed, orders as read."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", F.col("l_partkey").cast("string").alias("product"), F.col("l_quantity").cast("long").alias("volume"))
    heads = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    # the orders of both jobs are joined once, and lie by job
    wanted, path = heads.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    own = lines.join(wanted, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").cast("string").alias("order_number"), "product", "volume", "o_orderpriority")
    own.write.partitionBy("o_orderpriority").parquet(path)
    joined = spark.read.schema(own.schema).parquet(path)
    for job_id in ("1-URGENT", "2-HIGH", "1-URGENT"):
        tables = {"extracted_orders": history.order_records(joined.where(F.col("o_orderpriority") == job_id), job_id, "2026-01-01")}
        store.put({"id": job_id, "user_id": "me", "created_at": "2026-01-01"}, tables)
    store.stage("2-HIGH", tables)
    rows = store.committed("extracted_orders").groupBy("job_id").agg(F.sum("volume").alias("volume"), F.count_distinct("product").alias("products"))
    jobs = store.jobs("me").select(F.col("id").alias("job_id"), "total_orders")
    return jobs.join(rows, "job_id").select("job_id", "total_orders", "volume", "products")


@query("SELECT l_orderkey AS job_id, count(*) AS total_orders FROM lineitem GROUP BY 1")
def job_totals(spark, sf_dir):
    return history.totals(read(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("job_id")))


@query("SELECT l_orderkey AS job_id, CAST(l_partkey AS VARCHAR) AS order_number, l_quantity AS volume FROM lineitem WHERE l_orderkey = 7")
def orders_by_job(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("job_id"), F.col("l_partkey").cast("string").alias("order_number"), F.col("l_quantity").alias("volume"))
    return history.orders_of(rows, 7)


@query("SELECT o_custkey AS job_id, arg_min(o_orderpriority, o_orderkey) AS catalog_json FROM orders GROUP BY 1")
def catalog_by_job(spark, sf_dir):
    return history.catalog_of(read(spark, sf_dir, "orders", F.col("o_custkey").alias("job_id"), F.col("o_orderpriority").alias("catalog_json"), F.col("o_orderkey").alias("id")), "id")


@query("SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE c_custkey = 42 AND c_name = 'Customer#000000042' AND c_acctbal > -10000 LIMIT 1")
def active_account(spark, sf_dir):
    accounts = read(spark, sf_dir, "customer", F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > -10000).alias("is_active"))
    return history.active_account(accounts, 42, name="Customer#000000042").select("user_id", "name")


@query("SELECT '1' AS job_id, CAST(l_orderkey AS VARCHAR) AS order_number, CAST(l_quantity AS BIGINT) AS volume, CAST(NULL AS VARCHAR) AS zip_code, '2026-01-01' AS created_at FROM lineitem")
def save_projection(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem", F.col("l_orderkey").cast("string").alias("order_number"), F.col("l_quantity").cast("long").alias("volume"))
    return history.order_records(rows, "1", "2026-01-01").select("job_id", "order_number", "volume", "zip_code", "created_at")


@query("SELECT event_id, sum(1) OVER (ORDER BY event_id) AS n, coalesce(sum(length(props)) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events")
def row_ordinals(spark, sf_dir):
    rows = read(spark, sf_dir, "events", "event_id", F.length("props").alias("size"))
    return numbering.numbered(numbering.running_total(rows, "event_id", "size", "before"), "event_id").select("event_id", "n", "before")
