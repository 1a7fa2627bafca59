"""Extractors: from a chat's messages to an order. What asks a service is a function that is given by the caller."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import collapse
from tallyloom.operators.calls import Ledger
from tallyloom.operators.matching import Names, option_of
from tallyloom.session import once
from tallyloom.sources.schemas import RESULT

PHONE, LIVES = re.compile(r"01\d[- ]?\d{3,4}[- ]?\d{4}"), re.compile(r"주소[:\s]+(.+)")
#: Words of a message from which the structural extractor takes it for an item.
LEAST_WORDS = 3


def structural_items(messages: DataFrame, message: str = "message", least: int = LEAST_WORDS) -> DataFrame:
    """messages with product, option and volume: first word, last word, and number of words; shorter messages have no row."""
    words = F.split(collapse(F.col(message)), " ")
    rows = messages.withColumn("_words", words).where(F.size("_words") >= least)
    return rows.withColumns({"product": F.get("_words", 0), "option": F.element_at("_words", -1), "volume": F.size("_words").cast("long")}).drop("_words")


def by_catalog(catalog: dict[str, list[str]]) -> Callable[[list[dict]], dict]:
    """An extractor that finds a catalog's products by name, with the options and numbers said behind them, a phone number and an address.

    The products are one automaton, made once and sent with the extractor; see matching.catalog_items for whole tables.
    """
    products = Names(list(catalog))

    def extract(messages: list[dict]) -> dict:
        items, number, address = [], None, None
        for m in messages:
            said = m["message"] or ""
            found = products.find(said)
            for (_, end, product), until in zip(found, [x[0] for x in found[1:]] + [None] * bool(found), strict=True):
                option, volume = option_of(said[end:until], catalog[product])
                items.append({"product": product, "option": option, "volume": volume})
            if told := PHONE.search(said):
                number = told[0]
            if told := LIVES.search(said):
                address = told[1]
        return {"order_name": messages[0]["user"] if messages else None, "phone_number": number, "address": address, "search_address": address, "items": items}

    return extract


def prompted(ask: Callable[[str], str], template: str, catalog: list[dict]) -> Callable[[list[dict]], dict]:
    """An extractor that fills a template's {catalog} and {chat}, asks a service with the text, and reads its answer as JSON."""
    told = json.dumps(catalog, ensure_ascii=False, indent=2)
    return lambda messages: json.loads(ask(template.format(catalog=told, chat=json.dumps(messages, ensure_ascii=False, indent=2))))


def parsed(told: Column) -> Column:
    """An answer in JSON as a result. Fields that it lacks are null, others are left out; text that is no JSON object has no result's fields."""
    return F.from_json(told, RESULT)


def extracted(chats: DataFrame, extract: Callable[[list[dict]], dict | None], parts: int | None = None, ledger: Callable[[Callable[[str], str | None]], Ledger] | None = None) -> DataFrame:
    """chats (with messages, an array of user and message) and two columns: result, and error, null where the extractor went well.

    One that raises fails its chat only. Chats are spread over `parts` tasks, which bounds the calls made at once; the step
    runs once, and its outcome is kept. With a ledger, made for a function of a chat's JSON text, chats that it knows aren't
    asked about again, failing calls are repeated, and equal chats are asked about once.
    """
    told = [f for f in chats.schema.fields if f.name != "messages"]
    frame = chats.withColumn("_chat", F.to_json("messages", {"ignoreNullFields": "false"}))
    names = [f.name for f in told]

    def ask(chat: str) -> str | None:
        said = extract(json.loads(chat or "[]"))
        return json.dumps(said, ensure_ascii=False) if said else None

    if ledger is not None:
        frame = once(frame)
        said = ledger(ask).answers(frame.select(F.col("_chat").alias("request")))
        made = frame.join(said.withColumnRenamed("request", "_chat"), "_chat", "left")
        return made.select(*names, "messages", parsed(F.col("answer")).alias("result"), "error")

    def run(batches):
        for b in batches:
            results, errors = [], []
            for chat in b["_chat"].to_pylist():
                try:
                    results.append(ask(chat))
                    errors.append(None)
                except Exception as e:
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(results, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, "_result", "error"])

    from pyspark.sql import types as T

    out = T.StructType([*frame.schema.fields, T.StructField("_result", T.StringType()), T.StructField("error", T.StringType())])
    # messages go through the step and are kept with its outcome, so that nothing before it is computed again
    made = once((frame.repartition(parts) if parts else frame).mapInArrow(run, out))
    return made.select(*names, "messages", parsed(F.col("_result")).alias("result"), "error")
