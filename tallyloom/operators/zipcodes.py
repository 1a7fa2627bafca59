"""Postal codes of addresses: each distinct address is looked up once, and again as rewritten where that failed."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import strip, zip_code
from tallyloom.operators.calls import Ledger
from tallyloom.session import once

#: (addr) -> (addr, zip): a step that knows the codes of distinct addresses; addresses that it doesn't know may be missing or null.
Service = Callable[[DataFrame], DataFrame]


def from_table(known: DataFrame, address: str = "address", code: str = "zip_code") -> Service:
    """Codes from a table of addresses; of repeated ones, the least code."""
    table = known.select(strip(F.col(address)).alias("addr"), F.col(code).cast("string").alias("zip")).groupBy("addr").agg(F.min("zip").alias("zip"))
    return lambda addrs: addrs.join(table, "addr", "left")


def from_calls(look_up: Callable[[str], str | None], parts: int | None = None) -> Service:
    """Codes from a function that asks a service; an error counts as unknown. Calls are made once, by `parts` tasks at a time."""

    def calls(batches):
        for b in batches:
            yield pd.DataFrame({"addr": b["addr"], "zip": [_quiet(look_up, a) for a in b["addr"]]})

    def service(addrs: DataFrame) -> DataFrame:
        spread = addrs.repartition(parts, "addr") if parts else addrs
        return once(spread.mapInPandas(calls, "addr string, zip string"))

    return service


def from_ledger(ledger: Ledger) -> Service:
    """Codes from a service whose answers are kept in a ledger: (addr, zip, error), error null where the call went well."""

    def service(addrs: DataFrame) -> DataFrame:
        return ledger.answers(addrs.select(F.col("addr").alias("request"))).select(F.col("request").alias("addr"), F.col("answer").alias("zip"), "error")

    return service


def rewriter_from_ledger(ledger: Ledger) -> Service:
    """(addr, search, error): addresses as a service words them, with its answers kept in a ledger; blank ones are null."""

    def service(addrs: DataFrame) -> DataFrame:
        said = ledger.answers(addrs.select(F.col("addr").alias("request")))
        return said.select(F.col("request").alias("addr"), F.when(strip(F.col("answer")) != "", F.col("answer")).alias("search"), "error")

    return service


def rewriter(rewrite: Callable[[str], str | None]) -> Service:
    """(addr) -> (addr, search): addresses as a function words them for searching; blank ones and errors are null."""

    def calls(batches):
        for b in batches:
            said = [_quiet(rewrite, a) for a in b["addr"]]
            yield pd.DataFrame({"addr": b["addr"], "search": [s if isinstance(s, str) and s.strip() else None for s in said]})

    return lambda addrs: once(addrs.mapInPandas(calls, "addr string, search string"))


def _quiet(call, x):
    try:
        return call(x)
    except Exception:
        return None


def resolve(addrs: DataFrame, service: Service, rewrite: Service | None = None) -> DataFrame:
    """(addr, zip, error) of distinct addresses: what service knows of them, or else of what rewrite makes of them; empty if neither does.

    error is that of the last call that failed for an address without a code, null for services that tell none.
    """
    told = lambda made, *names: made.select(*names, *(["error"] if "error" in made.columns else [F.lit(None).cast("string").alias("error")]))
    found = told(service(addrs), "addr", "zip").withColumn("zip", zip_code(F.col("zip")))
    if rewrite is None:
        return found
    missed = told(rewrite(found.where("zip = ''").select("addr")), "addr", "search").select("addr", strip(F.col("search")).alias("search"), F.col("error").alias("not_worded"))
    again = told(service(missed.where("search is not null").select(F.col("search").alias("addr")).distinct()), "addr", "zip")
    again = again.select(F.col("addr").alias("search"), zip_code(F.col("zip")).alias("again"), F.col("error").alias("not_found"))
    second = missed.join(again, "search", "left").select("addr", "again", "not_worded", "not_found")
    code = F.when(F.col("zip") != "", F.col("zip")).otherwise(F.coalesce("again", F.lit("")))
    made = found.join(second, "addr", "left").withColumn("zip", code)
    return made.select("addr", "zip", F.when(F.col("zip") == "", F.coalesce("not_found", "not_worded", "error")).alias("error"))


def look_up(rows: DataFrame, service: Service, rewrite: Service | None = None, address: str = "address", out: str = "zip_code", errors: str | None = None) -> DataFrame:
    """rows with `out`, the code of their address as 5 digits; empty for unknown, blank and null addresses. All rows stay.
    errors: a column for the error of the service that left an address without a code.

    A hot address is one row among the distinct ones; the join back is skewed then, which adaptive execution splits.
    """
    keyed = rows.withColumn("_addr", strip(F.col(address).cast("string")))
    addrs = keyed.where("_addr <> ''").select(F.col("_addr").alias("addr")).distinct()
    codes = resolve(addrs, service, rewrite).withColumnsRenamed({"addr": "_addr", "zip": "_zip", "error": "_error"})
    made = keyed.join(codes, "_addr", "left")
    code = F.coalesce("_zip", F.lit(""))
    more = [F.col("_error").alias(errors)] if errors else []
    if out in rows.columns:
        return made.select(*[code.alias(c) if c == out else F.col(f"`{c}`") for c in rows.columns], *more)
    return made.select(*[F.col(f"`{c}`") for c in rows.columns], code.alias(out), *more)


def beside(rows: DataFrame, column: str, after: str) -> DataFrame:
    """rows with column moved right behind another."""
    rest = [c for c in rows.columns if c != column]
    at = rest.index(after) + 1
    return rows.select(*[F.col(f"`{c}`") for c in [*rest[:at], column, *rest[at:]]])


def found_missed(rows: DataFrame, column: str = "zip_code") -> DataFrame:
    """One row: how many codes were found and missed."""
    found = F.count_if(F.col(column) != "")
    return rows.agg(found.alias("found"), (F.count("*") - found).alias("missed"))
